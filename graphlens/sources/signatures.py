"""Parameters of a declaration from its signature, and the families of types: what choosing between overloads needs.

A signature is read by one walk over its characters that knows brackets and quotes; the walk is a small helper within an Arrow
batch, a row at a time. Everything about types is Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Languages that write ``name: Type``, marks of parameters that are no part of the type, words that precede a type.
NAME_FIRST = ("kotlin", "scala", "swift", "typescript", "python", "rust")
MARKS = ("final", "vararg", "params", "ref", "out", "in", "this", "noinline", "crossinline")
QUALIFIERS = ("const", "final", "struct", "class", "enum", "typename", "std")
#: Words that name a type of a family.
STRINGS = ("String", "string", "str", "wstring", "string_view", "NSString", "Substring")
BOOLEANS = ("bool", "boolean", "Bool")
CHARACTERS = ("char", "wchar_t", "Char", "char16_t", "char32_t")
ANYTHING = ("Object", "Any", "object", "id", "any", "dynamic")
NUMBERS = (
    "int", "long", "short", "byte", "float", "double", "size_t", "ssize_t", "unsigned", "signed", "decimal", "sbyte", "ushort", "uint", "ulong", "number", "bigint",
    "Int", "Long", "Short", "Byte", "Double", "Float", "UInt", "ULong", "CGFloat", "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "intptr_t", "uintptr_t", "ptrdiff_t",
    "i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "Int8", "Int16", "Int32", "Int64", "UInt8", "UInt16", "UInt32", "UInt64",
)
PARAMETERS = ArrayType(StructType([*(StructField(n, StringType()) for n in ("name", "label", "type")), *(StructField(n, BooleanType()) for n in ("optional", "variadic"))]))
PAIRS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("arg", "param")]))
_ANNOTATION = re.compile(r"@[\w$.]*")
_MARK = re.compile(rf"(?:{'|'.join(MARKS)}) ")


def _walk(text: str) -> Iterator[tuple[int, str, int]]:
    """(place, character, depth of brackets before it) outside quotes. An arrow's head closes nothing; an open quote ends the walk at
    a place past the text, with an empty character."""
    depth = at = 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            at = text.find(c, at + 1)
            if at < 0:
                yield len(text), "", depth
                return
        else:
            yield at, c, depth
            if c in "([{<":
                depth += 1
            elif c in ")]}" or (c == ">" and text[at - 1 : at] not in ("-", "=")):
                depth -= 1
        at += 1


def _closing(text: str) -> int:
    """Place behind the bracket that closes the first one, -1 without."""
    return next((at + 1 for at, c, depth in _walk(text) if depth == 1 and c in ")]}>" and not (c == ">" and text[at - 1] in "-=")), -1)


def _list_after(signature: str, name: str) -> str | None:
    """The signature from the parameter list of ``name`` on, past type parameters."""
    for m in re.finditer(rf"(?<![\w$]){re.escape(name)}", signature):
        rest = signature[m.end() :].lstrip(" ")
        if rest.startswith("<") and (end := _closing(rest)) > 0:
            rest = rest[end:].lstrip(" ")
        if rest.startswith("("):
            return rest
    return None


def _items(text: str) -> list[str] | None:
    """What stands between the commas of the list that a text begins with; None if it isn't closed."""
    items, start = [], 1
    for at, c, depth in _walk(text):
        if c == "," and depth == 1:
            items.append(text[start:at])
            start = at + 1
        elif depth == 1 and at and c in ("]", "}", ">", ")") and not (c == ">" and text[at - 1] in "-="):
            return [*items, text[start:at]] if c == ")" else None
    return None


def _without_default(text: str) -> str:
    equals = (at for at, c, depth in _walk(text) if c == "=" and depth == 0 and text[at + 1 : at + 2] not in ("=", ">") and text[at - 1 : at] not in ("=", "!"))
    at = next(equals, None)
    return text if at is None else text[:at].strip()


def _without_marks(text: str) -> str:
    """Annotations, with their arguments, and marks go from the front."""
    while True:
        text = text.strip()
        if m := _ANNOTATION.match(text):
            text = text[m.end() :]
            if text.startswith("("):
                end = _closing(text)
                text = text[end:] if end > 0 else ""
        elif m := _MARK.match(text):
            text = text[m.end() :]
        else:
            return text


def parameters(signature: str | None, name: str | None, lang: str | None) -> list[dict] | None:
    """The parameters of ``name``: name, label (Swift), type as written, whether it may be left out, whether it takes many. None if
    the list can't be read, as when the signature was cut."""
    rest = _list_after(signature, name) if signature and name else None
    items = _items(rest) if rest else None
    if items is None:
        return None
    found = []
    for raw in (x.strip() for x in items):
        if not raw or (raw == "void" and len(items) == 1):
            continue
        text = _without_default(raw)
        many = "..." in text or text.startswith(("vararg ", "params ")) or " vararg " in text or (text.rstrip().endswith("*") and lang in NAME_FIRST)
        one = {"name": "", "label": "", "type": "", "optional": text != raw or "?:" in raw, "variadic": many}
        text = _without_marks(text)
        if lang in NAME_FIRST:
            head, colon, kind = text.partition(":")
            words = head.strip().removesuffix("?").split()
            one["type"] = kind.strip() if colon else ""
            one["name"] = words[-1] if words else ""
            if lang == "swift" and words and words[0] != "_":
                one["label"] = words[0]
        else:
            words = text.split()
            if len(words) == 1:
                one["type"] = words[0]
            elif words:
                marked = re.fullmatch(r"([*&]*)(.*?)((?:\[\])?)", words[-1])
                one["type"] = text[: -len(words[-1])].strip() + marked[1] + marked[3]
                one["name"] = marked[2]
        found.append(one)
    return found


@F.udf(returnType=PARAMETERS, useArrow=True)
def parameter_list(signature, name, lang):
    """``parameters`` as a Column."""
    return parameters(signature, name, lang)


@F.udf(returnType=PAIRS, useArrow=True)
def bound(params, args, lang, extra, strict):
    """Which parameter each argument (name, trailing) goes to; null if a name fits none, a label is missing, or (``strict``) a parameter
    that must be given isn't. Arguments in order go to the next free parameter from ``extra`` on, named ones by name (Swift: label),
    a trailing lambda to the last; what is left over is for the count to judge."""
    taken, pairs, at = set(), [], extra
    for k, a in enumerate(args):
        if a["name"]:
            to = next((i for i, p in enumerate(params) if p["label" if lang == "swift" else "name"] == a["name"]), None)
            if to is None:
                return None
        elif a["trailing"] and lang in ("kotlin", "swift", "scala"):
            to = len(params) - 1
        else:
            while at < len(params) and at in taken and not params[at]["variadic"]:
                at += 1
            if at >= len(params):
                continue
            to = at
            at += not params[at]["variadic"]
            if lang == "swift" and params[to]["label"]:
                return None
        if to >= 0:
            taken.add(to)
            pairs.append((k, to))
    if strict and any(i >= extra and i not in taken and not (p["optional"] or p["variadic"]) for i, p in enumerate(params)):
        return None
    return pairs


# --- types ---


def type_base(kind: Column) -> Column:
    """The plain name of a type as written: without qualifying words, arguments, scope and marks."""
    bare = F.regexp_replace(F.trim(kind), rf"^(?:(?:{'|'.join(QUALIFIERS)}) +)+", "")
    bare = F.regexp_replace(bare, r"<.*$|[\[\]*&?! ].*$", "")
    return F.regexp_extract(bare, r"([\p{L}\p{N}_$]+)[^\p{L}\p{N}_$]*$", 1)


def type_family(kind: Column) -> Column:
    """The family (string, number, bool, char, any, class, or unknown) and the base name of a type as written."""
    compact = F.replace(kind, F.lit(" "), F.lit(""))
    words = F.regexp_extract_all(kind, F.lit(r"[\p{L}\p{N}_$]+"), F.lit(0))
    families = (("string", STRINGS), ("bool", BOOLEANS), ("char", CHARACTERS), ("number", NUMBERS), ("any", ANYTHING))

    def of(word: Column) -> Column:
        family = F.lit(None).cast("string")
        for name, held in reversed(families):
            family = F.when(word.isin(*held), name).otherwise(family)
        return F.struct(family.alias("family"), word.alias("base"))

    known = F.get(F.filter(F.transform(words, of), lambda w: w["family"].isNotNull()), F.lit(0))
    base = type_base(kind)
    last = F.element_at(F.filter(words, lambda w: ~w.isin("const", "std", "final", "struct")), -1)
    base = F.when(base != "", base).otherwise(F.when(F.size(words) > 0, last))
    fixed = lambda family, name: F.struct(F.lit(family).alias("family"), F.lit(name).alias("base"))
    text = compact.contains("char*") | (compact.contains("char[]") & ~compact.contains("unsigned"))
    named = F.struct(F.lit("class").alias("family"), base.alias("base"))
    return F.when(F.coalesce(F.trim(kind), F.lit("")) == "", fixed("unknown", "")).when(text, fixed("string", "char*")).when(compact.contains("void*"), fixed("any", "void*")).when(known.isNotNull(), known).when(base.isNull(), fixed("unknown", "")).otherwise(named)


def is_function(kind: Column) -> Column:
    """A function type as written."""
    return kind.contains("->") | kind.contains("=>") | kind.contains("std::function")
