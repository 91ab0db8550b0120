"""Text and key functions as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They must equal the originals for equal results.
STOPWORDS = (
    "a an and are as at be by do does for from how i if in is it its of on or that the this to was what when where which"
    " why with we you can should before after into there then them our my"
).split()
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
STEM_SUFFIXES = ("ation", "ion", "ing", "ed", "er")
SECRET_PATTERNS = ("AKIA[0-9A-Z]{16}", "ghp_[a-zA-Z0-9]{36}", "sk-[a-zA-Z0-9]{48}", "-----BEGIN.*PRIVATE KEY-----")
MAX_QUERY_TERMS = 32
#: A path segment that is a parameter, a parameter within one, and a file named in a message.
PARAMETER = r"^(?:\{[^/]*\}|\$\{[^/]*\}|:[A-Za-z_]\w*\??|<[^/>]*>|\[[^/\]]*\]|%[sdvq]|\*\w*|\d+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
PARAMETER_PART = r"\$\{[^}]*\}|\{[^}]*\}|<[^>]*>|%[sdvq]"
FILE_REFERENCE = r"\b[A-Za-z0-9_./-]+\.[A-Za-z]{1,8}\b"
#: Kinds of task by words in a message, the first that fits, and words that make a task a large one.
TASK_WORDS = (
    ("refactor", ("refactor", "extract", "rename", "move ")),
    ("debug", ("fix", "bug", "error", "crash", "panic", "failing")),
    ("explain", ("explain", "what is", "how does", "why does")),
    ("architect", ("design", "architect", "plan ", "roadmap")),
)
LARGE_TASK_WORDS = ("across", "entire", "all ", "every", "multi", "multiple")
#: Weights of what is shown, by category, and the tools of each category: by name or by the start of it.
ATTENTION = (("edit_target", 1.0), ("plan", 0.95), ("test_output", 0.9), ("graph", 0.7), ("read", 0.3), ("other", 0.1))
TOOLS = (
    ("edit_target", ("file_write",), ()),
    ("plan", ("update_plan", "create_plan"), ()),
    ("graph", ("find_callers", "find_implementations", "resolve_symbol", "multi_resolution_view", "impact_analysis", "test_map", "co_change"), ("graph_", "codebase_")),
    ("read", ("file_read", "file_list", "file_glob", "file_grep", "semantic_search", "workspace_info"), ()),
)

WORD = r"[\p{L}\p{Nd}_]+"


def words(text: Column) -> Column:
    """Runs of letters, digits and ``_``."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def subwords(word: Column) -> Column:
    """An identifier's parts: split at underscores and case changes (parseHTTPRequest_v2: parse, HTTP, Request, v2)."""
    marked = F.regexp_replace(word, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    marked = F.regexp_replace(marked, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    marked = F.regexp_replace(marked, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1_$2")
    return F.filter(F.split(marked, "_+"), lambda x: x != "")


def stem(word: Column) -> Column:
    """Words of more than four bytes lose a plural s and then the first suffix that leaves four bytes or more."""
    single = F.when(word.endswith("s") & ~word.endswith("ss"), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    out = single
    for suffix in reversed(STEM_SUFFIXES):
        out = F.when(single.endswith(suffix) & (F.octet_length(single) - len(suffix) >= 4), F.substr(single, F.lit(1), F.length(single) - len(suffix))).otherwise(out)
    return F.when(F.octet_length(word) <= 4, word).otherwise(out)


def is_stopword(word: Column) -> Column:
    return word.isin(STOPWORDS)


#: Words with parts: an underscore, or a change of case or kind within.
_PARTED = r"_|[\p{Ll}\p{Nd}]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"


def weighted_terms(df: DataFrame, key: list[str], text: str, weight: float = 1.0) -> DataFrame:
    """(key, term, tf): a word counts its weight, each of several parts half of it; stopwords are dropped, others stemmed.

    Words are counted where the texts are read, before they are split and stemmed, so each distinct word is handled once. Callers whose ``key`` is a
    document's deal the texts by it first, so that no other shuffle follows; a key of few values would deal them to as many tasks.
    """
    counted = df.select(*key, F.explode(words(F.col(text))).alias("_w")).groupBy(*key, "_w").agg(F.count("*").alias("_n"))
    term = lambda w, x: F.struct(F.lower(w).alias("t"), F.lit(x).alias("x"))
    parts = subwords(F.col("_w"))
    whole = F.array(term(F.col("_w"), weight))
    every = F.when(F.col("_w").rlike(_PARTED) & (F.size(parts) > 1), F.concat(whole, F.transform(parts, lambda p: term(p, weight / 2)))).otherwise(whole)
    said = counted.select(*key, "_n", F.explode(every).alias("_t")).select(*key, "_n", "_t.t", "_t.x").where(~is_stopword(F.col("t")))
    return said.groupBy(*key, stem(F.col("t")).alias("term")).agg(F.sum(F.col("x") * F.col("_n")).alias("tf"))


def query_terms(df: DataFrame, key: list[str], text: str, most: int | None = MAX_QUERY_TERMS) -> DataFrame:
    """(key, terms): the sorted distinct terms of a query, 32 at most; without ``most`` all of them."""
    terms = F.array_sort(F.collect_set("term"))
    return weighted_terms(df, key, text).groupBy(*key).agg((terms if most is None else F.slice(terms, 1, most)).alias("terms"))


def trigrams(text: Column) -> Column:
    """Trigrams of characters; none for texts under three characters."""
    at = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substr(text, i, F.lit(3)))


def normalize_trigger(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def base_type(receiver: Column) -> Column:
    """A receiver's type name without pointer marks and type arguments."""
    return F.regexp_replace(F.regexp_replace(F.trim(receiver), r"^[*&\s]+", ""), r"(?s)[\[<].*$", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1_$2"), r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1_$2"))


def code_shaped(token: Column) -> Column:
    """An underscore, a first dot between characters, or an upper-case letter after the first character."""
    dot = F.instr(token, ".")
    return (F.instr(token, "_") > 0) | ((dot > 1) & (dot < F.length(token))) | F.substr(token, F.lit(2)).rlike(r"\p{Lu}")


def identifiers(text: Column) -> Column:
    """Name-like and path-like words of a task's text in order, each once: at least two characters, the first a letter
    or an underscore, unless it is a path (with a slash and an extension)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}_./-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[.\-/]+|[.\-/]+$", ""))
    named = lambda w: w.rlike(r"^[\p{L}_]") | w.rlike(r"/.*\.[^./]+$|^[^/]+/.*\.[^./]+$")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 2) & named(w)))


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 2) / 3)


# --- contract keys ---

def route_key(method: Column, raw: Column) -> Column:
    """``METHOD /path`` with parameters as ``{}``; the empty string where there is no path. The method may lead the path."""
    raw = F.trim(raw)
    lead = F.upper(F.substring_index(raw, " ", 1))
    led = F.instr(raw, " ") > 0
    own = F.when(led & lead.isin(*HTTP_METHODS), lead).otherwise(F.upper(F.trim(method)))
    own = F.when(own.isin(*HTTP_METHODS), own).otherwise(F.lit("ANY"))
    path = F.when(led & lead.isin(*HTTP_METHODS), F.trim(F.regexp_replace(raw, r"^\S+ ", ""))).otherwise(raw)
    path = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    path = F.regexp_replace(path, r"(?s)[?#].*$", "")
    path = F.regexp_replace(path, r"^(?:\$?\{[^}]*\}|%[sv](?=.))", "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    keyed = F.transform(parts, lambda s: F.when(s.rlike(PARAMETER), F.lit("{}")).otherwise(F.regexp_replace(s, PARAMETER_PART, "{}")))
    return F.when(path.startswith("/"), F.concat(own, F.lit(" /"), F.array_join(keyed, "/"))).otherwise(F.lit(""))


def rpc_key(service: Column, method: Column) -> Column:
    title = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    last, m = F.trim(F.substring_index(F.trim(service), ".", -1)), F.trim(method)
    return F.when((last == "") | (m == ""), F.lit("")).otherwise(F.concat(title(last), F.lit("/"), title(m)))


def table_key(name: Column) -> Column:
    """A table's name without schema and quotes, in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(F.trim(name), ".", -1), "[\"`\\[\\]']", ""))


def join_path(prefix: Column, path: Column) -> Column:
    joined = F.concat(F.regexp_replace(prefix, "/$", ""), F.lit("/"), F.regexp_replace(path, "^/", ""))
    return F.when(prefix == "", path).when((path == "") | (path == "/"), prefix).otherwise(joined)


def _braces(pattern: str) -> list[str]:
    """The alternatives of ``{a,b}`` groups; braces without a partner are literal."""
    opened = pattern.find("{")
    closed = pattern.find("}", opened)
    if opened < 0 or closed < 0:
        return [pattern]
    return [x for alternative in pattern[opened + 1 : closed].split(",") for x in _braces(pattern[:opened] + alternative + pattern[closed + 1 :])]


def _segment_regex(segment: str) -> str:
    """One path segment: ``*``, ``?``, ``[a-z]``, ``[^a-z]`` and ``\\`` before a literal."""
    import re

    token = re.compile(r"(?P<star>\*+)|(?P<one>\?)|(?P<kind>\[\^?(?:\\.|[^\\\]])+\])|\\(?P<literal>.)|(?P<bad>[\[\\])|(?P<plain>.)", re.S)
    out = []
    for m in token.finditer(segment):
        if m["star"]:
            out.append("[^/]*")
        elif m["one"]:
            out.append("[^/]")
        elif m["kind"]:
            body = m["kind"][1:-1]
            out.append("(?!/)[" + re.sub(r"(?<!\\)([\[&])", r"\\\1", body) + "]")
        elif m["bad"]:
            return r"(?!)"  # not a pattern: nothing matches
        else:
            out.append(re.escape(m["literal"] or m["plain"]))
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: a segment ``**`` stands for any number of folders, ``{a,b}`` alternates."""
    every = []
    for one in _braces(pattern):
        parts, out = one.split("/"), ""
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part != "**":
                out += _segment_regex(part) + ("" if last or parts[k + 1 :] == ["**"] else "/")
            elif not last:
                out += "(?:[^/]*/)*"
            else:
                out += "(?:/.*)?" if k else ".*"
        every.append(out)
    return "^(?:" + "|".join(every) + ")$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def owner(key: Column, n: int) -> Column:
    """The first eight bytes of the key's SHA-256, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


# --- guard rails and routing ---


def secrets(text: Column, patterns=SECRET_PATTERNS) -> Column:
    """Matches of secret patterns that aren't placeholders (EXAMPLE, or their last eight characters are one)."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])
    placeholder = lambda m: F.upper(m).contains("EXAMPLE") | F.right(m, F.lit(8)).rlike(r"^(.)\1*$")
    return F.filter(found, lambda m: ~placeholder(m))


def redact(text: Column, patterns=SECRET_PATTERNS) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def reference_breadth(message: Column) -> tuple[Column, Column]:
    """Distinct file references, and distinct folders among those that name one."""
    files = F.array_distinct(F.regexp_extract_all(message, F.lit(FILE_REFERENCE), F.lit(0)))
    folders = F.array_distinct(F.transform(F.filter(files, lambda f: f.contains("/")), lambda f: F.regexp_replace(f, "/[^/]*$", "")))
    return F.size(files), F.size(F.filter(folders, lambda d: d != "."))


def _any(text: Column, *values: str) -> Column:
    found = F.lit(False)
    for v in values:
        found = found | text.contains(v)
    return found


def task_kind(message: Column) -> Column:
    text, out = F.lower(F.trim(message)), F.lit("edit")
    for kind, words_of in reversed(TASK_WORDS):
        out = F.when(_any(text, *words_of), kind).otherwise(out)
    return out


def task_complexity(message: Column) -> Column:
    text = F.lower(F.trim(message))
    high = (F.octet_length(text) > 500) | (F.size(F.regexp_extract_all(text, F.lit(FILE_REFERENCE), F.lit(0))) >= 3) | _any(text, *LARGE_TASK_WORDS)
    return F.when(high, "high").when(task_kind(message) == "debug", "medium").otherwise("low")


def route_intent(message: Column, rules: list[tuple[str, list[str]]], default: str = "code") -> Column:
    """The first rule, in order, with a pattern that matches anywhere, in any case."""
    out = F.lit(default)
    for intent, patterns in reversed(rules):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | message.rlike(f"(?i){p}")
        out = F.when(hit, intent).otherwise(out)
    return out


def attention_category(tool: Column, command: Column) -> Column:
    """The category of a tool's output; a shell command's is that of tests if it names any."""
    out = F.when((tool == "shell") & _any(command, "test", "jest"), "test_output").otherwise("other")
    for category, names, starts in TOOLS:
        fits = tool.isin(*names)
        for start in starts:
            fits = fits | tool.startswith(start)
        out = F.when(fits, category).otherwise(out)
    return out


def attention_weight(category: Column) -> Column:
    out = F.lit(0.1)
    for name, weight in ATTENTION:
        out = F.when(category == name, weight).otherwise(out)
    return out


def attention_threshold(base: Column, weight: Column) -> Column:
    scaled = F.floor(base * (F.lit(0.25) + weight * 1.75))
    return F.least(F.greatest(scaled, F.lit(50)), F.greatest(base * 2, F.lit(100)))


def truncate_utf8(text: Column, limit: int | Column) -> Column:
    """The longest prefix of whole characters of at most ``limit`` bytes."""
    most = (F.lit(limit) if isinstance(limit, int) else limit).cast("int")
    data = text.cast("binary")
    # a cut before a continuation byte moves back to the start of that character, three bytes at most
    continued = lambda n: F.hex(F.substr(data, n + 1, F.lit(1))).between("80", "BF")
    cut = F.coalesce(*[F.when(~continued(most - k), most - k) for k in range(4)], F.lit(0))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substr(data, F.lit(1), cut), "UTF-8"))


def fingerprint(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(value), 256))


#: What a model id can carry beyond its name.
VENDOR_PREFIX, VERSION_SUFFIX, DATE_SUFFIX = r"^(?:[a-z]+\.)+", r"-v\d+(?::\d+)?$", r"(?:[-@]\d{8}|-\d{4}-\d{2}-\d{2})$"


def model_candidates(model: Column) -> Column:
    """Spellings of a model id to look up, the most specific first, all in lower case: as it is, without its provider,
    then without vendor, version and date, and that with dashes for dots."""
    whole = F.lower(F.trim(model))
    own = F.substring_index(whole, "/", -1)
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, VERSION_SUFFIX, ""), VENDOR_PREFIX, ""), DATE_SUFFIX, "")
    dashed = F.replace(base, F.lit("."), F.lit("-"))
    return F.concat(F.array(whole), F.when(whole.contains("/"), F.array(own)).otherwise(F.array().cast("array<string>")), F.array(base), F.when(dashed != base, F.array(dashed)).otherwise(F.array().cast("array<string>")))


def qualified(name: Column, receiver: Column) -> Column:
    """``Type.name`` of a member, the name alone of anything else."""
    return F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat(base_type(receiver), F.lit("."), name))


def exceeds_cap(spent: Column, reserved: Column, requested: Column, cap: Column) -> Column:
    """Whether a request would pass the cap, with sums that cannot overflow."""
    return (spent > cap - reserved) | (requested > cap - spent - reserved)


def per_million_rate(usd: Column, most: float = 1e6) -> Column:
    """Microdollars for a million tokens; null where a rate is negative, not finite or above ``most``."""
    return F.when((usd >= 0) & (usd <= most), F.floor(usd * 1_000_000 + 0.5).cast("long"))


def parse_time(value: Column) -> Column:
    """A timestamp from the layouts that stores have used; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
