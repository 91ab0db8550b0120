"""SCIP indexes: a data source that splits an index at its documents, and the import of sites that still fit their files.

``spark.read.format("scip")`` reads an index (the public protobuf layout) as one row an occurrence. Planning walks the
top-level messages by their lengths, without reading them, and deals runs of whole documents to tasks; a task holds one
document at a time. Everything after that is joins: symbols are parsed once each, documents gated by hash or checked against the
lines of their files, references joined to the nearest definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Roles and position encodings of the layout.
DEFINITION, IMPORT, FORWARD = 0x1, 0x2, 0x40
UTF8, UTF16, UTF32 = 1, 2, 3
#: Names that indexers give constructors, and methods that languages call by syntax.
CONSTRUCTORS = ("<init>", ".ctor", "<constructor>", "constructor", "__init__")
OPERATORS = (
    "invoke", "apply", "get", "set", "iterator", "hasNext", "next", "contains", "not", "plus", "minus", "times", "div", "rem", "rangeTo", "rangeUntil", "compareTo", "equals", "unaryMinus", "unaryPlus",
    "inc", "dec", "getValue", "setValue", "provideDelegate", "plusAssign", "minusAssign",
)
SCHEMA = "source string, doc long, path string, language string, encoding int, text_hash string, start_line int, start_char int, end_line int, end_char int, symbol string, roles int"
ROWS = 10_000


# --- the layout ---


def _varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; nested messages as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            size, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise EOFError("a field ends after its message")
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _stream_varint(f) -> int | None:
    value = shift = 0
    while byte := f.read(1):
        value |= (byte[0] & 0x7F) << shift
        if byte[0] < 0x80:
            return value
        shift += 7
    if shift:
        raise EOFError("an index ends within a number")
    return None


def messages(f, size: int, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(number, begin, at, length) of the top-level messages of a seekable file that begin from ``start`` to before ``end``: where a
    message's tag and its content begin. Contents are passed over."""
    f.seek(start)
    while (begin := f.tell()) < (size if end is None else end):
        tag = _stream_varint(f)
        if tag is None:
            return
        kind = tag & 7
        if kind == 0:
            _stream_varint(f)
        elif kind in (1, 5):
            f.seek(f.tell() + (8 if kind == 1 else 4))
        elif kind == 2:
            length = _stream_varint(f)
            at = f.tell()
            if length is None or at + length > size:
                raise EOFError("an index ends within a document")
            yield tag >> 3, begin, at, length
            f.seek(at + length)
        else:
            raise ValueError(f"wire type {kind}")


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def document(data: bytes) -> tuple[tuple, Iterator[tuple]]:
    """A document's (path, language, encoding, hash of its text or null), and its occurrences one by one."""
    head = {1: b"", 4: b"", 6: 0}
    text = None
    for number, value in fields(data):
        if number in head:
            head[number] = value
        elif number == 5:
            text = hashlib.sha256(value).hexdigest()

    def occurrences() -> Iterator[tuple]:
        for number, value in fields(data):
            if number != 2:
                continue
            span, symbol, roles = [], b"", 0
            for n, x in fields(value):
                if n == 1:
                    span += _packed(x) if isinstance(x, bytes) else [x]
                elif n == 2:
                    symbol = x
                elif n == 3:
                    roles = x
            if len(span) in (3, 4):
                end = span[2:] if len(span) == 4 else [span[0], span[2]]
                yield span[0], span[1], end[0], end[1], symbol.decode("utf-8", "replace"), roles

    return (head[1].decode("utf-8", "replace"), head[4].decode("utf-8", "replace"), head[6], text), occurrences()


# --- the data source ---


def _opened(path: str):
    """A seekable file and its size, on any file system that Arrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return system.open_input_file(inner), info.size


class Run(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class ScipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.split = int(options.get("splitbytes", 32 << 20))

    def partitions(self) -> list[Run]:
        runs = []
        for path in self.paths:
            f, size = _opened(path)
            with f:
                start = end = 0
                for _, begin, at, length in messages(f, size):
                    if begin > start and at + length - start > self.split:
                        runs.append(Run(path, start, begin))
                        start = begin
                    end = at + length
                if end > start:
                    runs.append(Run(path, start, end))
        return runs

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None:  # an index without messages
            return
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in SCHEMA.split(", "))])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        f, size = _opened(run.path)
        rows = []
        with f:
            for number, begin, at, length in messages(f, size, run.start, run.end):
                if number == 2:
                    f.seek(at)
                    head, occurrences = document(f.read(length))
                    for o in occurrences:
                        rows.append((run.path, begin, *head, *o))
                        if len(rows) >= ROWS:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)


class ScipSource(DataSource):
    """Option ``path``: indexes, comma-separated. Option ``splitBytes``: about how much of an index a task reads."""

    @classmethod
    def name(cls) -> str:
        return "scip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScipReader:
        return ScipReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, *paths: str, split_bytes: int = 32 << 20) -> DataFrame:
    """The occurrences of some indexes."""
    spark.dataSource.register(ScipSource)
    return spark.read.format("scip").option("splitBytes", split_bytes).load(",".join(paths))


# --- symbols ---


def _field(said: str) -> tuple[str, str] | None:
    """A blank-terminated field, in which two blanks stand for one, and what follows."""
    out, at = [], 0
    while (blank := said.find(" ", at)) >= 0:
        out.append(said[at:blank])
        if said[blank + 1 : blank + 2] != " ":
            return " ".join(out), said[blank + 1 :]
        at = blank + 2
    return None


def _name(said: str) -> tuple[str, str] | None:
    """A plain name, or one between backticks in which two stand for one, and what follows."""
    if not said.startswith("`"):
        n = next((k for k, c in enumerate(said) if not (c.isalnum() or c in "_+-$")), len(said))
        return (said[:n], said[n:]) if n else None
    out, at = [], 1
    while (tick := said.find("`", at)) >= 0:
        out.append(said[at:tick])
        if said[tick + 1 : tick + 2] != "`":
            return "`".join(out), said[tick + 1 :]
        at = tick + 2
    return None


def parsed(symbol: str) -> tuple[str, list[tuple[str, str]]] | None:
    """Package and descriptors (name, suffix; ``m`` a method's) of a symbol; no descriptors for a local one; None if malformed."""
    if symbol.startswith("local "):
        return "", []
    rest, head = symbol, []
    for _ in range(4):
        found = _field(rest)
        if found is None:
            return None
        head.append(found[0])
        rest = found[1]
    descriptors = []
    while rest:
        opened = rest[0] if rest[0] in "[(" else ""
        found = _name(rest[len(opened) :])
        if found is None:
            return None
        name, rest = found
        if opened:
            closing = "]" if opened == "[" else ")"
            if not rest.startswith(closing):
                return None
            suffix, rest = opened, rest[1:]
        elif rest.startswith("("):
            close = rest.find(").")
            if close < 0:
                return None
            suffix, rest = "m", rest[close + 2 :]
        elif rest[:1] in tuple("/#.:!"):
            suffix, rest = rest[0], rest[1:]
        else:
            return None
        descriptors.append((name, suffix))
    return (" ".join(head), descriptors) if descriptors else None


def _identifier(word: str) -> bool:
    return word != "" and all(c in "_$" or c.isalnum() for c in word) and not word[0].isdigit()


def spellings(descriptors: list[tuple[str, str]]) -> list[str]:
    """Texts that a reference can have: the name; a constructor's class and keywords; an accessor's property. None if the
    name is no identifier."""
    name, suffix = descriptors[-1]
    owner = descriptors[-2][0] if len(descriptors) > 1 else ""
    if name.startswith("$"):
        return []
    if suffix == "m" and name in CONSTRUCTORS:
        said = [x for x in (owner, name) if _identifier(x)]
        return said if name == "constructor" else [*said, "constructor"]
    if suffix == "m" and name[:3] in ("get", "set") and "A" <= name[3:4] <= "Z":
        return [name, name[3:], name[3].lower() + name[4:], name[:3]]
    return [name] if _identifier(name) else []


def symbols(occurrences: DataFrame) -> DataFrame:
    """(symbol, package, kind, implicit, spellings) of each distinct symbol that is well-formed and not local; kind is ``call``, ``type``,
    ``macro`` or ``other``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for symbol in frame["symbol"]:
                found = parsed(symbol)
                if not found or not found[1]:
                    continue
                package, descriptors = found
                name, suffix = descriptors[-1]
                owner = descriptors[-2][0] if len(descriptors) > 1 else ""
                operator = name in OPERATORS or (name.startswith("component") and name[9:].isdigit())
                implicit = suffix == "m" and (name in CONSTRUCTORS or name == owner or operator)
                rows.append((symbol, package, {"m": "call", "#": "type", "!": "macro"}.get(suffix, "other"), implicit, spellings(descriptors)))
            yield pd.DataFrame(rows, columns=["symbol", "package", "kind", "implicit", "spellings"])

    return occurrences.select("symbol").distinct().mapInPandas(run, "symbol string, package string, kind string, implicit boolean, spellings array<string>")


# --- gates ---


def documents(occurrences: DataFrame) -> DataFrame:
    """(path, source, doc, text_hash): of the documents that name a path, the first in order of source and place."""
    return occurrences.groupBy("path").agg(F.min(F.struct("source", "doc", "text_hash")).alias("_d")).select("path", "_d.*")


def gate(docs: DataFrame, files: DataFrame, observed: DataFrame | None = None, written: Column | None = None) -> DataFrame:
    """Documents with ``file_hash`` and ``verdict``: ``hash`` (its own text, or the run that was observed, has the file's hash), ``check`` (the file is not
    younger than the index, its lines must fit), or why it is rejected.

    ``files``: path, hash, modified; ``observed``: path, hash as they were while the indexer ran; ``written``: when an index was, by its ``source``.
    """
    found = docs.join(files.select("path", F.col("hash").alias("file_hash"), "modified", F.lit(True).alias("_known")), "path", "left")
    seen = F.lit(None).cast("string")
    if observed is not None:
        found = found.join(observed.select("path", F.col("hash").alias("_seen")), "path", "left")
        seen = F.col("_seen")
    verdict = F.when(F.col("_known").isNull(), "not indexed")
    verdict = verdict.when(F.col("text_hash").isNotNull(), F.when(F.col("text_hash") == F.col("file_hash"), "hash").otherwise("document text differs"))
    if observed is not None:
        verdict = verdict.otherwise(F.when(seen == F.col("file_hash"), "hash").otherwise("changed while the indexer ran"))
    else:
        late = F.col("modified") > written if written is not None else F.lit(False)
        verdict = verdict.otherwise(F.when(late, "modified after the index was written").otherwise("check"))
    return found.select(*docs.columns, "file_hash", verdict.alias("verdict"))


def _slice(line: str, start: int, end: int, encoding: int) -> tuple[int, int]:
    """A range in the units of an encoding as places in a string, cut to the line."""
    if encoding == UTF32:
        return min(start, len(line)), min(end, len(line))
    kind, width = ("utf-8", 1) if encoding == UTF8 else ("utf-16-le", 2)
    data = line.encode(kind, "surrogatepass")
    return tuple(len(data[: at * width].decode(kind, "ignore")) for at in (start, end))


def _word(c: str) -> bool:
    return c in "_$" or c >= "\x80" or (c.isascii() and c.isalnum())


def _bare(line: str, start: int, end: int) -> bool:
    """Whether neither neighbour of a range belongs to an identifier."""
    return not (start > 0 and _word(line[start - 1])) and not (end < len(line) and _word(line[end]))


def _untab(line: str, column: int) -> int:
    """A column that counts a tab as going on to the next multiple of eight, as a place in the line."""
    width = 0
    for at, c in enumerate(line):
        if width >= column:
            return at
        width += 8 - width % 8 if c == "\t" else 1
    return len(line)


def place(line: str, start: int, end: int, encoding: int, said: list[str]) -> tuple[int, str, bool, str, bool]:
    """Where an occurrence's name stands in its line: (byte offset, text, whether it is a whole identifier, the range's own text,
    whether that is no part of a longer one). If the range spells something else, columns that count tabs are tried, then a spelling that is a word within the range."""
    a, b = _slice(line, start, end, encoding)
    raw, raw_whole = line[a:b], _bare(line, a, b)
    if raw not in said and "\t" in line:
        c, d = _untab(line, start), _untab(line, end)
        if line[c:d] in said:
            a, b = c, d
    if line[a:b] not in said and a < b:
        inner = next(((k, w) for w in said for k in range(a, b - len(w) + 1) if w and line.startswith(w, k) and _bare(line[a:b], k - a, k - a + len(w))), None)
        if inner:
            a, b = inner[0], inner[0] + len(inner[1])
    text = line[a:b]
    return len(line[:a].encode("utf-8", "surrogatepass")), text, _identifier(text) and _bare(line, a, b), raw, raw_whole


def located(occurrences: DataFrame, lines: DataFrame, known: DataFrame) -> DataFrame:
    """Occurrences of calls and types on one line, with their symbol's columns and where its name stands. ``line`` (from 1) is
    null past the end of a file. Where a macro occurs, occurrences of its range are its expansion and no sites.

    ``lines``: path, line_no (from 1), line; ``known``: the rows of ``symbols``.
    """
    every = occurrences.join(known, "symbol").where("start_line = end_line")
    span = ["path", "start_line", "start_char", "end_char"]
    every = every.join(every.where("kind = 'macro'").select(*span).distinct(), span, "left_anti").where("kind in ('call', 'type')")
    joined = every.withColumn("line_no", F.col("start_line") + 1).join(lines.select("path", "line_no", F.col("line").alias("_line"), F.col("line_no").alias("line")), ["path", "line_no"], "left")

    @F.pandas_udf("start int, text string, whole boolean, raw string, raw_whole boolean")
    def where(line: pd.Series, start: pd.Series, end: pd.Series, encoding: pd.Series, said: pd.Series) -> pd.DataFrame:
        rows = [(None, None, False, None, False) if x is None else place(x, a, b, e, list(s)) for x, a, b, e, s in zip(line, start, end, encoding, said, strict=True)]
        return pd.DataFrame(rows, columns=["start", "text", "whole", "raw", "raw_whole"])

    return joined.withColumn("_at", where("_line", "start_char", "end_char", "encoding", "spellings")).drop("_line").select("*", "_at.*").drop("_at")


def misfits(found: DataFrame) -> DataFrame:
    """(path, reason) of documents whose occurrences do not fit the lines that their file has now: one past its end, a
    definition that spells another name, a range that splits an identifier or begins or ends in blank space, or more references to other names than aliases explain
    (a tenth of what was checked, three at least)."""
    fits = F.array_contains("spellings", F.col("text"))
    defines = F.col("roles").bitwiseAND(DEFINITION) != 0
    counted = (F.size("spellings") > 0) & (defines | ~F.col("implicit")) & F.col("line").isNotNull()
    name = F.col("raw").rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$")
    blank = (F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")) != F.col("raw")) | (F.col("raw") == "")
    hard = F.col("line").isNull() | (counted & ~fits & ((defines & name) | ~F.col("raw_whole") | blank))
    soft = counted & ~fits & ~hard & name
    per = found.groupBy("path").agg(F.count_if(hard).alias("hard"), F.count_if(soft).alias("soft"), F.count_if(counted & (fits | soft)).alias("checked"))
    reason = F.when(F.col("hard") > 0, "no longer spells its symbols").when(F.col("soft") > F.greatest(F.lit(3), F.floor(F.col("checked") / 10)), "too many references spell another name")
    return per.select("path", reason.alias("reason")).where("reason is not null")


def sites(found: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, line, col, name, kind, target_path, target_name, def_line) of references that spell their symbol: the target is the nearest
    definition before it in its file, else after it, else the first elsewhere; null for symbols of other packages. References to
    a package (``packages``) of the workspace without a definition, and places with several targets, give none."""
    defines = F.col("roles").bitwiseAND(DEFINITION) != 0
    spelt = found.where(F.array_contains("spellings", F.col("text")) & F.col("whole"))
    defs = spelt.where(defines).select("symbol", F.col("path").alias("d_path"), F.col("line").alias("d_line"), F.col("text").alias("d_text")).distinct()
    uses = spelt.where(~defines & (F.col("roles").bitwiseAND(IMPORT | FORWARD) == 0)).select("path", "line", (F.col("start") + 1).alias("col"), F.col("text").alias("name"), "kind", "symbol", "package").distinct()
    own = F.col("d_path") == F.col("path")
    before = F.col("d_line") <= F.col("line")
    near = F.struct(F.when(own & before, 0).when(own, 1).otherwise(2), F.when(own, F.abs(F.col("d_line") - F.col("line"))).otherwise(0), "d_path", "d_line")
    target = F.struct("d_path", "d_text", "d_line")
    best = uses.join(defs, "symbol", "left").groupBy(*uses.columns).agg(F.min_by(target, F.when(F.col("d_path").isNotNull(), near)).alias("_t"))
    ours = packages.select("package", F.lit(True).alias("_ours")).distinct()
    kept = best.join(ours, "package", "left").where(F.col("_t").isNotNull() | F.col("_ours").isNull())
    rows = kept.select("path", "line", "col", F.coalesce("_t.d_text", "name").alias("name"), "kind", F.col("_t.d_path").alias("target_path"), F.col("_t.d_text").alias("target_name"), F.col("_t.d_line").alias("def_line"))
    at = ["path", "line", "col", "kind"]
    single = rows.groupBy(*at).agg(F.collect_set(F.struct("name", F.coalesce("target_path", F.lit("")).alias("p"), F.coalesce("def_line", F.lit(0)).alias("l"))).alias("_all"), F.min(F.struct("name", "target_path", "target_name", "def_line")).alias("_r"))
    return single.where(F.size("_all") == 1).select(*at, "_r.*")


def imported(occurrences: DataFrame, files: DataFrame, lines: DataFrame, observed: DataFrame | None = None, written: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The sites of all documents that describe their file as it is, each with the ``file_hash`` that they hold for, and (path, reason) of those rejected."""
    judged = gate(documents(occurrences), files, observed, written)
    kept = occurrences.join(judged.where("verdict in ('hash', 'check')").select("path", "source", "doc", "file_hash", "verdict"), ["path", "source", "doc"])
    known = symbols(occurrences)
    found = located(kept, lines, known)
    wrong = misfits(found.where("verdict = 'check'"))
    packages = occurrences.where(F.col("roles").bitwiseAND(DEFINITION) != 0).join(known, "symbol").select("package")
    fitting = found.join(wrong.select("path"), "path", "left_anti")
    hashes = judged.select("path", "file_hash")
    rejected = judged.where("verdict not in ('hash', 'check')").select("path", F.col("verdict").alias("reason")).unionByName(wrong)
    return sites(fitting, packages).join(hashes, "path"), rejected
