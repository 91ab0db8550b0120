"""The size guard against the staged walk in plain Python."""

import random

from pyspark.sql import functions as F

from graphlens.operators import guard


def plain(messages, limit, caps):
    """messages: (role, size, source) of one session; a token a byte, a preview of a cap has its size."""
    size = [m[1] for m in messages]
    state = ["kept"] * len(messages)
    total = sum(size)
    for cap in caps:
        for i, (role, n, _) in enumerate(messages):
            if total > limit and role == "tool" and n > cap and cap < size[i]:
                total -= size[i] - cap
                size[i], state[i] = cap, "capped"
    gone, guided = set(), False

    def drop(names):
        nonlocal total
        hit = False
        for name in names:
            for i, (role, _, source) in enumerate(messages):
                if total > limit and role == "system" and source == name and i not in gone:
                    total -= size[i]
                    gone.add(i)
                    hit = True
        return hit

    drop(guard.OPTIONAL)
    users = [i for i, m in enumerate(messages) if m[0] == "user"]
    prompts = []
    starts = [0, *users, len(messages)]
    for a, b in zip(starts, starts[1:], strict=False):
        if total <= limit or not users or a >= users[-1] or b > users[-1]:
            break
        for i in range(a, b):
            if messages[i][0] != "system":
                gone.add(i)
                total -= size[i]
                if messages[i][0] == "user" and messages[i][1] <= guard.SMALL:
                    prompts.append(i)
    guided = drop(guard.GUIDANCE)
    back = set()
    if users and messages[users[-1]][1] <= guard.BRIEF and not guided and total <= limit:
        for i in prompts[-4:][::-1]:
            if total + size[i] <= limit:
                total += size[i]
                back.add(i)
    return [("readmitted", size[i]) if i in back else ("dropped", 0) if i in gone else (state[i], size[i]) for i in range(len(messages))]


def test_trimming(spark):
    rng = random.Random(8)
    sessions = []
    for _ in range(150):
        n = rng.randrange(0, 14)
        rows = []
        for _ in range(n):
            role = rng.choice(["user", "assistant", "tool", "tool", "system"])
            rows.append((role, rng.choice([0, 3, 40, 200, 257, 600, 2000, 5000]), rng.choice([*guard.OPTIONAL, *guard.GUIDANCE, ""]) if role == "system" else None))
        sessions.append(rows)
    frame = spark.createDataFrame([(s, i, r, "x" * n if n or i % 2 else None, src) for s, rows in enumerate(sessions) for i, (r, n, src) in enumerate(rows)], "session int, idx int, role string, content string, source string")
    for limit in (100, 700, 2500):
        got = guard.trimmed(frame.repartition(3), limit, largest=1024, tokens=F.octet_length).collect()
        want = {(s, i): x for s, rows in enumerate(sessions) for i, x in enumerate(plain(rows, limit, [1024, 512, 256]))}
        assert {(r["session"], r["idx"]): (r["state"], r["tokens"]) for r in got} == want
    assert len({r["state"] for r in got}) == 4
    assert guard.trimmed(frame.limit(0), 5).count() == 0


def test_answers_fit_exactly(spark):
    """No answer is over its budget unless it is bare, and each has taken the fewest steps that bring it there."""
    import json
    import math

    rng = random.Random(9)
    queries = {q: [(r, rng.choice(["go", "py"]), "".join(rng.choice('ab "\\\né𝄞') for _ in range(rng.choice([0, 1, 2, 37, 300])))) for r in range(1, rng.randrange(1, 6))] for q in range(40)}
    frame = spark.createDataFrame([(q, r, h, x if x or r % 2 else None) for q, rows in queries.items() for r, h, x in rows], "query int, rank int, lang string, excerpt string")
    items = frame.select("query", "rank", F.struct("lang").alias("head"), "excerpt")
    for budget in (60, 100, 230):
        fit = guard.fitted(items.repartition(3), budget)
        told = {r["query"]: r["answer"] for r in guard.answers(items, fit, budget).collect()}
        for q, rows in queries.items():
            if not rows:
                continue
            held, cut = [[h, x] for _, h, x in rows], False
            dump = lambda: json.dumps({"items": [{"head": {"lang": h}, "excerpt": x} for h, x in held], "max_tokens": budget, "omitted": {"output_budget": 1} if cut else {}, "truncated": cut}, separators=(",", ":"), ensure_ascii=False)  # noqa: B023, E731
            cost = lambda: (lambda n: n + 32 + math.ceil(n / 10))((len(dump().encode()) + 2) // 3)
            while cost() > budget and held:
                last = next((k for k in range(len(held) - 1, -1, -1) if held[k][1]), None)
                cut = True
                if last is None:
                    held.pop()
                else:
                    held[last][1] = held[last][1][: len(held[last][1]) // 2]
            assert told[q] == dump()
    assert guard.fitted(items.limit(0), 60).count() == 0
