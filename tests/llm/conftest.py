import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rank int, g string, key long, count long, _key string, _size string, id string, finish_time string"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and blank texts, repeated rows, copies, near copies, a long text, clashing columns."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghéü") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary[: 40 if rng.random() < 0.5 else 300]) for _ in range(n))
    rows = [(None, say(40), "en", "a", 1), (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "b", 3), (3, "One", "en", "b", 3), (4, "one TWO", "en", "", 7)]
    base = say(120).split()
    rows += [(10 + k, " ".join(base), "en", "a", 1) for k in range(5)]
    for k in range(8):
        near = list(base)
        near[3 + 11 * k] = f"x{k}"
        rows.append((20 + k, " ".join(near), "en", "c", 1))
    rows += [(40 + k, say(rng.randint(5, 200)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "é", None]), 1) for k in range(40)]
    rows += [(90, say(9000), "de", "c", 1), (91, "same words " * 60, "en", "a", 1), (92, "Tail ÉCOLE école\x0b\x0cx\x1cy\u00a0z", "fr", "a", 1)]
    rows += [rows[7], rows[20], rows[20]]
    return spark.createDataFrame([(*r, 1, 2, "g", 3, 4, "K", "S", "I", "T") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
