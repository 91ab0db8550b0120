"""JSON of any depth as Column expressions: canonical form, and redaction of all strings.

A VARIANT keeps an object's fields in the order of their names, at every level, so parsing a text and writing it again sorts
its keys. Strings are reached by a walk over the written form's tokens, an array in the row itself: nothing is exploded or
shuffled, and a document's depth doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlens.functions.text import SECRET_PATTERNS, redact

#: Tokens of JSON without blanks: a key with its colon, a string, or all up to the next string.
_STRING = r'"(?:[^"\\]|\\.)*+"'
_TOKEN = rf'{_STRING}:|{_STRING}|[^"]++'


def canonical_json(text: Column) -> Column:
    """The JSON of a text without blanks, keys sorted at every level, numbers without trailing zeros; what isn't JSON, or
    repeats a key within an object, stays as it is. Two calls with equal arguments in another order come out alike."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def _literal(value: Column) -> Column:
    """A string as a JSON string."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def map_strings(text: Column, change) -> Column:
    """Canonical JSON with ``change`` (Column to Column) made to every string at every depth, keys left as they are; a text
    that isn't JSON is one string."""
    canonical = F.to_json(F.try_parse_json(text))

    def one(token: Column) -> Column:
        said = F.from_json(F.concat(F.lit('{"v":'), token, F.lit("}")), "v string")["v"]
        return F.when(token.startswith('"') & token.endswith('"'), _literal(change(said))).otherwise(token)

    walked = F.array_join(F.transform(F.regexp_extract_all(canonical, F.lit(_TOKEN), F.lit(0)), one), "")
    return F.when(canonical.isNull(), change(text)).otherwise(walked)


def redact_json(text: Column, patterns=SECRET_PATTERNS) -> Column:
    """Secret patterns replaced in every string of a JSON text, however deep; keys, numbers and all else stay."""
    return map_strings(text, lambda s: redact(s, patterns))


def string_leaves(text: Column) -> Column:
    """All strings of a JSON text in the order of its canonical form, unescaped, keys left out."""
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(text)), F.lit(_TOKEN), F.lit(0))
    values = F.filter(tokens, lambda t: t.startswith('"') & t.endswith('"'))
    return F.transform(values, lambda t: F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"])
