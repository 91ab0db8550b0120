"""Declarations, imports and calls of source files in many languages, from one table of patterns.

A language is a row of ``LANGUAGES``; nothing else knows its name. Comments and literals are blanked out first, so that
braces and names in them do not count. Declarations are found line by line; a scope ends where its braces close or, in
languages by indentation, where a line stands as far left as its head. Each file is one small pass inside a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLASHES = r"//[^\n]*|/\*.*?\*/"
_QUOTES = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_MODIFIED = r"(?:public|private|protected|internal|static|final|abstract|synchronized|native|override|virtual|async|open|suspend|inline|operator|default|extern|unsafe|sealed|partial|mutating|required|convenience|fileprivate|external|tailrec|infix)\s+"


@dataclass(frozen=True)
class Language:
    """``declarations``: (kind, pattern); a pattern's group ``name`` is the name, ``receiver`` the type that a method
    belongs to, ``kind`` overrides the kind, ``mods`` are modifiers. ``imports``: patterns with ``spec`` and ``alias``."""

    extensions: tuple[str, ...]
    declarations: tuple[tuple[str, str], ...]
    imports: tuple[str, ...]
    blanks: str = f"{_SLASHES}|{_QUOTES}"
    exported: str = "not_private"
    indented: bool = False
    import_block: str = ""
    test: str = r"(?:^|/)tests?/|[_.]test\.|[_.]spec\.|Tests?\.\w+$"


def _named(pattern: str) -> str:
    return pattern.replace("<N>", r"(?P<name>[A-Za-z_$][\w$]*)")


_TYPES = rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?P<mods>(?:{_MODIFIED}|(?:data|readonly|inner|indirect|strictfp|case|implicit|lazy)\s+)*)(?P<kind>class|interface|enum|record|struct|object|trait|protocol|extension|actor)\s+<N>"
_METHOD = rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?P<mods>(?:{_MODIFIED})*)(?:<[^>(]*>\s+)?(?!\s*(?:return|new|else|throw|await|if|for|while|switch|catch|using|lock|yield|{_MODIFIED[:-3]})\b)[\w$<>\[\],.?*& ]+?[\s*&]<N>\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:throws\s+[\w., ]+)?\s*(?:where\b[^{{]*)?(?:\{{|=>|;|$)"
_CONSTRUCTOR = r"^\s+(?P<mods>(?:public|protected|private|internal)\s+)<N>\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+|:\s*(?:base|this)\([^)]*\)\s*)?(?:\{|$)"
_FUN = rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?P<mods>(?:{_MODIFIED})*)"
_JS = r"^\s*(?P<mods>(?:export\s+|default\s+|declare\s+|abstract\s+|async\s+)*)"

#: One row a language.
LANGUAGES: dict[str, Language] = {
    "go": Language((".go",), (("func", r"^func\s+(?:\(\s*(?:\w+\s+)?(?P<receiver>[*\w\[\], ]+?)\s*\)\s*)?<N>\s*[\[(]"), ("struct", r"^type\s+<N>(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+<N>(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^type\s+<N>(?:\[[^\]]*\])?\s+=?\s*(?!struct\b|interface\b)\S"), ("var", r"^var\s+<N>"), ("const", r"^const\s+<N>")), (r'^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?"(?P<spec>[^"\n]+)"',), blanks=rf"{_SLASHES}|{_QUOTES}|`[^`]*`", exported="upper", import_block=r"(?ms)^import\s*\(.*?\)|^import\s+[^\n(]*", test=r"_test\.go$"),
    "typescript": Language((".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"), (("func", _JS + r"function\s*\*?\s*<N>"), ("class", _JS + r"class\s+<N>"), ("interface", _JS + r"interface\s+<N>"), ("enum", _JS + r"(?:const\s+)?enum\s+<N>"), ("type_alias", _JS + r"type\s+<N>\s*(?:<[^=]*>)?\s*="), ("func", _JS + r"(?:const|let|var)\s+<N>\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("const", _JS + r"const\s+<N>"), ("var", _JS + r"(?:let|var)\s+<N>"), ("method", r"^\s+(?P<mods>(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+|readonly\s+|abstract\s+)*)\*?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b|await\b|super\b)#?<N>\s*(?:<[^>(]*>)?\([^)]*\)\s*(?::[^{;]+)?\{")), (r"""^\s*(?:import|export)\s+(?:type\s+)?(?:\*\s+as\s+(?P<alias>\w+)\s+from\s+|[^'"\n]*?from\s+)?['"](?P<spec>[^'"\n]+)['"]""", r"""\b(?:require|import)\(\s*['"](?P<spec>[^'"\n]+)['"]\s*\)"""), blanks=rf"{_SLASHES}|{_QUOTES}|`(?:\\.|[^`\\])*`", exported="export"),
    "java": Language((".java",), (("class", _TYPES), ("constructor", _CONSTRUCTOR), ("method", _METHOD)), (r"^\s*import\s+(?:static\s+)?(?P<spec>[\w.]+(?:\.\*)?)\s*;",), exported="public"),
    "csharp": Language((".cs",), (("class", _TYPES), ("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"), ("constructor", _CONSTRUCTOR), ("method", _METHOD)), (r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<spec>[\w.]+)\s*;",), exported="public"),
    "kotlin": Language((".kt", ".kts"), (("class", _TYPES), ("func", _FUN + r"fun\s+(?:<[^>]*>\s*)?(?:(?P<receiver>[\w.<>?]+)\.)?<N>\s*\("), ("var", _FUN + r"va[lr]\s+<N>")), (r"^\s*import\s+(?P<spec>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?",)),
    "scala": Language((".scala", ".sc"), (("class", _TYPES), ("func", _FUN + r"def\s+<N>"), ("var", _FUN + r"va[lr]\s+<N>")), (r"^\s*import\s+(?P<spec>[\w.]+(?:\.(?:_|\{[^}]*\}))?)",)),
    "swift": Language((".swift",), (("class", _TYPES), ("func", _FUN + r"func\s+<N>"), ("constructor", _FUN + r"(?P<name>init)[?!]?\s*[(<]"), ("var", _FUN + r"(?:var|let)\s+<N>")), (r"^\s*(?:@testable\s+)?import\s+(?:(?:struct|class|enum|protocol|func)\s+)?(?P<spec>[\w.]+)",)),
    "rust": Language((".rs",), (("func", r"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+|async\s+|const\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*)fn\s+<N>"), ("struct", r"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?P<kind>struct|enum|trait|union)\s+<N>"), ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>', ]+\s+for\s+)?<N>"), ("namespace", r"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)mod\s+<N>"), ("type_alias", r"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)type\s+<N>"), ("const", r"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:const|static)\s+(?:mut\s+)?<N>\s*:"), ("macro", r"^\s*macro_rules!\s*<N>")), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<spec>[\w:]+(?:::(?:\*|\{[^}]*\}))?)(?:\s+as\s+(?P<alias>\w+))?\s*;",), blanks=rf"{_SLASHES}|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'", exported="pub"),
    "c": Language((".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", ".m", ".mm"), (("class", r"^\s*(?:template\s*<[^>]*>\s*)?(?:typedef\s+)?(?P<kind>class|struct|enum|union|namespace)\s+(?:class\s+)?<N>\s*(?:final\s*)?(?:[:{]|$)"), ("macro", r"^\s*#\s*define\s+<N>"), ("func", r"^(?!\s*(?:return|else|if|for|while|switch|case|using|typedef|throw|delete|new|goto)\b)\s*(?:[\w:<>,~*&]+[\s*&]+)+(?:(?P<receiver>\w+)::)?<N>\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:\{|$)")), (r'^\s*#\s*(?:include|import)\s*[<"](?P<spec>[^>"\n]+)[>"]',)),
    "php": Language((".php",), (("class", r"^\s*(?P<mods>(?:abstract\s+|final\s+|readonly\s+)*)(?P<kind>class|interface|trait|enum)\s+<N>"), ("namespace", r"^\s*namespace\s+(?P<name>[\w\\]+)"), ("func", r"^\s*(?P<mods>(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+)*)function\s+&?<N>")), (r"^\s*use\s+(?:function\s+|const\s+)?(?P<spec>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"](?P<spec>[^'"\n]+)['"]"""), blanks=rf"{_SLASHES}|#(?!\[)[^\n]*|{_QUOTES}"),
    "dart": Language((".dart",), (("class", _TYPES), ("class", r"^\s*(?P<mods>(?:abstract\s+|base\s+|final\s+|sealed\s+)*)(?P<kind>mixin|class)\s+<N>"), ("func", _METHOD)), (r"""^\s*(?:import|export|part)\s+['"](?P<spec>[^'"\n]+)['"](?:\s+(?:deferred\s+)?as\s+(?P<alias>\w+))?""",)),
    "ruby": Language((".rb", ".rake"), (("class", r"^\s*(?P<kind>class|module)\s+(?P<name>[A-Z][\w:]*)"), ("func", r"^\s*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)")), (r"""^\s*(?:require|require_relative|load)\s+['"](?P<spec>[^'"\n]+)['"]""",), blanks=rf"(?m:^=begin.*?^=end)|#[^\n]*|{_QUOTES}", indented=True),
    "shell": Language((".sh", ".bash", ".zsh"), (("func", r"^\s*(?:function\s+(?P<name>[\w-]+)|(?P<name2>[\w-]+)\s*\(\))\s*(?:\(\))?\s*\{?"),), (r"""^\s*(?:source|\.)\s+['"]?(?P<spec>[^\s'";]+)""",), blanks=rf"(?<![$\w])#[^\n]*|{_QUOTES}"),
    "lua": Language((".lua",), (("func", r"^\s*(?:local\s+)?function\s+(?:(?P<receiver>\w+)[.:])?<N>"),), (r"""\brequire\s*\(?\s*['"](?P<spec>[^'"\n]+)['"]""",), blanks=rf"--\[\[.*?\]\]|--[^\n]*|{_QUOTES}", indented=True),
    "elixir": Language((".ex", ".exs"), (("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("func", r"^\s*def(?:p|macro)?\s+<N>")), (r"^\s*(?:import|alias|use|require)\s+(?P<spec>[\w.]+)",), blanks=rf'""".*?"""|#[^\n]*|{_QUOTES}', indented=True),
}

SCHEMAS = {
    "symbols": "path string, lang string, ord int, name string, kind string, receiver string, signature string, line int, end_line int, exported boolean, parent_ord int, is_test boolean",
    "imports": "path string, lang string, spec string, alias string, line int",
    "refs": "path string, lang string, kind string, enclosing_ord int, name string, qualifier string, line int, col int, n_args int",
}
_CALL = re.compile(r"(?:(?P<qualifier>[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*)(?:\.|::|->|\?\.))?(?P<name>[A-Za-z_$][\w$]*[!?]?)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return func function fn def fun new sizeof typeof await super elif else match when using lock until unless and or not in throw case foreach import".split())
_CONTROL = frozenset("if for while switch catch return else elif match".split())
_COMPILED: dict[str, tuple] = {}


def language_of(path: Column) -> Column:
    """The language of a path by its extension; null if none."""
    out = F.lit(None).cast("string")
    for name, row in LANGUAGES.items():
        out = F.when(F.lower(path).rlike(r"(?:" + "|".join(re.escape(x) for x in row.extensions) + ")$"), name).otherwise(out)
    return out


def _compiled(name: str) -> tuple:
    if name not in _COMPILED:
        row = LANGUAGES[name]
        _COMPILED[name] = (row, [(k, re.compile(_named(p))) for k, p in row.declarations], [re.compile(p, re.M) for p in row.imports], re.compile(row.blanks, re.S), re.compile(row.test), re.compile(row.import_block) if row.import_block else None)
    return _COMPILED[name]


def _exported(rule: str, name: str, mods: str) -> bool:
    words = set(re.findall(r"\w+", mods))
    if rule == "upper":
        return name[:1].isupper()
    if rule in ("export", "pub"):
        return rule in words
    if rule == "public":
        return "public" in words
    return not name.startswith("_") and not words & {"private", "fileprivate"}


def _arguments(text: str) -> dict[int, int]:
    """Number of arguments between each bracket that closes and the one that it closes, by the place behind the opening one. One walk
    over the text, so a call of any length is counted."""
    found, waiting = {}, []
    for k, c in enumerate(text):
        if c in ")]}":
            if waiting:
                at, commas, some = waiting.pop()
                found[at] = commas + 1 if some else 0
        elif c == "," and waiting:
            waiting[-1][1] += 1
        elif waiting and not c.isspace():
            waiting[-1][2] = True
        if c in "([{":
            waiting.append([k + 1, 0, False])
        elif c in ")]}" and waiting:
            waiting[-1][2] = True
    return found


def facts(path: str, name: str, text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Symbols, imports and calls of one file."""
    row, declarations, imports, blanks, test, block = _compiled(name)
    # literals keep their quotes, so that an argument is still seen
    clean = blanks.sub(lambda m: (m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]) if m[0][0] in "\"'`" and len(m[0]) > 1 else re.sub(r"[^\n]", " ", m[0]), text)
    lines, plain, is_test = text.split("\n"), clean.split("\n"), bool(test.search(path))
    symbols: list[list] = []
    open_scopes: list[tuple[int, int]] = []  # (number, depth or indent at its head)
    enclosing: list[int | None] = []
    depth = 0
    for k, line in enumerate(plain):
        indent = len(line) - len(line.lstrip())
        if row.indented and line.strip():
            while open_scopes and indent <= open_scopes[-1][1]:
                number, at = open_scopes.pop()
                symbols[number][8] = k + 1 if re.match(r"\s*end\b", line) and indent == at else k
        for kind, pattern in declarations:
            m = pattern.match(line)
            if not m:
                continue
            groups = m.groupdict()
            own = groups.get("name") or groups.get("name2")
            if not own or own in _CONTROL:
                continue
            parent = open_scopes[-1][0] if open_scopes else None
            within = symbols[parent][3:5] if parent is not None else ("", "")
            if kind in ("var", "const") and parent is not None and within[1] in ("func", "method", "constructor"):
                break
            kind = groups.get("kind") or kind
            receiver = (groups.get("receiver") or "").strip()
            if not receiver and kind == "func" and within[1] in ("class", "struct", "impl", "interface", "trait", "object", "enum", "record", "protocol", "extension", "actor", "module", "mixin"):
                receiver = within[0]
            kind = "method" if kind == "func" and receiver else kind
            symbols.append([path, name, len(symbols), own, kind, receiver, lines[k].strip(), k + 1, k + 1, _exported(row.exported, own, groups.get("mods") or ""), parent, is_test])
            if row.indented:
                open_scopes.append((len(symbols) - 1, indent))
            elif "{" in line[m.start() :] or (k + 1 < len(plain) and plain[k + 1].lstrip().startswith("{")):
                open_scopes.append((len(symbols) - 1, depth))
            break
        here = symbols[-1] if symbols and symbols[-1][7] == k + 1 and symbols[-1][4] in ("func", "method") else None
        enclosing.append(here[2] if here else open_scopes[-1][0] if open_scopes else None)
        if not row.indented:
            for c in re.findall(r"[{}]", line):
                depth += 1 if c == "{" else -1
                while c == "}" and open_scopes and depth <= open_scopes[-1][1]:
                    symbols[open_scopes.pop()[0]][8] = k + 1
    for number, _ in open_scopes:
        symbols[number][8] = len(lines)
    heads = {(s[7], s[3]) for s in symbols}
    found = []
    pieces = [(m.start(), m[0]) for m in block.finditer(text)] if block else [(0, text)]
    for at, part in pieces:
        for pattern in imports:
            found += [(path, name, m["spec"], m.groupdict().get("alias") or "", text.count("\n", 0, at + m.start("spec")) + 1) for m in pattern.finditer(part)]
    refs, starts, counts = [], [0], _arguments(clean)
    for line in plain:
        starts.append(starts[-1] + len(line) + 1)
    for k, line in enumerate(plain):
        for m in _CALL.finditer(line):
            if (m["qualifier"] or m["name"] not in _KEYWORDS) and (k + 1, m["name"]) not in heads:
                refs.append((path, name, "call", enclosing[k], m["name"], m["qualifier"] or "", k + 1, m.start("name") + 1, counts.get(starts[k] + m.end())))
    return [tuple(s) for s in symbols], sorted(set(found), key=lambda r: (r[4], r[2])), refs


def language_facts(files: DataFrame, table: str) -> DataFrame:
    """Symbols, imports or calls (``table``) of files (path, text) in the languages of ``LANGUAGES``; others give nothing.
    A null text is empty."""
    which, schema = list(SCHEMAS).index(table), SCHEMAS[table]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([r for p, lang, text in zip(pdf["path"], pdf["lang"], pdf["text"], strict=True) for r in facts(p, lang, text)[which]], columns=names)
            for c in ("parent_ord", "enclosing_ord", "n_args"):
                if c in out:
                    out[c] = out[c].astype("Int32")
            yield out

    known = files.select("path", language_of(F.col("path")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("lang is not null")
    return known.mapInPandas(run, schema)


# --- import specs ---


def import_units(imports: DataFrame, units: DataFrame) -> DataFrame:
    """(path, spec, unit): the local units that an import can mean. A unit is a folder or a file without its extension.

    * relative specs (``./a``, ``../b``): the path from the importing file's folder, or that folder's ``index``
    * dotted, ``::`` or ``\\\\`` specs: with slashes; wildcards and lists dropped, ``crate`` and ``self`` being the root
    * others as they are, without an extension

    A spec fits a unit that it equals or is a whole-segment end of; of several the shortest. The last segment of both is
    the join key. ``imports``: path, lang, spec; ``units``: unit.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    bare = F.regexp_replace("spec", r"(?:\.\*|::\*|\._|[.:]+\{[^}]*\})$", "")
    slashed = F.when(F.col("lang").isin("java", "kotlin", "scala", "csharp", "elixir", "swift"), F.translate(bare, ".", "/")).when(F.col("lang") == "rust", F.regexp_replace(F.replace(bare, F.lit("::"), F.lit("/")), r"^(?:crate|self|super)/", "")).when(F.col("lang") == "php", F.translate(bare, "\\", "/")).otherwise(bare)
    relative = F.col("spec").rlike(r"^\.{1,2}(?:/|$)")
    joined = F.when(relative, F.concat(folder, F.lit("/"), "spec")).otherwise(slashed)
    for _ in range(4):  # folders that are left again
        joined = F.regexp_replace(F.regexp_replace(joined, r"(^|/)(?:\./)+", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    wanted = F.regexp_replace(F.regexp_replace(joined, r"\.(?:[jt]sx?|[cm][jt]s|h|hpp|hh|c|cc|cpp|dart|rb|sh|lua|php)$", ""), r"^/+|/+$", "")
    asked = imports.select("path", "spec", relative.alias("_rel"), wanted.alias("_w")).where("_w <> ''").distinct()
    # a type's import also means the unit of its package
    either = asked.select("path", "spec", "_rel", F.explode(F.array(F.struct("_w", F.lit(0).alias("_s")), F.struct(F.regexp_replace("_w", r"/[^/]*$", "").alias("_w"), F.lit(1).alias("_s")))).alias("_e")).select("path", "spec", "_rel", "_e._w", "_e._s").where("_w <> ''").distinct()
    last = F.substring_index("_w", "/", -1)
    known = units.select("unit", F.regexp_replace("unit", "/index$", "").alias("_u")).distinct()
    pairs = either.withColumn("_l", last).join(known.withColumn("_l", F.substring_index("_u", "/", -1)), "_l")
    fits = (F.col("_u") == F.col("_w")) | (~F.col("_rel") & F.col("_u").endswith(F.concat(F.lit("/"), "_w"))) | (~F.col("_rel") & F.col("_w").endswith(F.concat(F.lit("/"), "_u")) & F.col("_w").contains("."))
    best = pairs.where(fits).groupBy("path", "spec").agg(F.min(F.struct("_s", F.length("_u").alias("_n"), "unit")).alias("_b"))
    return best.select("path", "spec", "_b.unit")
