"""WARC archives: writing with revisit records, and a normaliser for monolithic gzip files.

Many archives are one gzip stream over all records, which no one can seek in. The normaliser inflates such a file once,
as a stream, rewrites every record as a gzip member of its own and returns a sidecar index (offset and length of each
member). Archives are rows (archive, content): Spark reads and writes them on whatever store the cluster has, and no
task touches a local folder. An archive written here is at most ``ARCHIVE_BYTES`` of records, or one longer record. Of a
file made elsewhere, the compressed bytes are one value of a row, so it can have at most 2 GB; what it inflates to has no
limit, as at most one record is held.

Rows whose payloads are equal and of at least ``LEAST`` bytes: that with the largest page_id is written as response, the
others as revisit records without payload that refer to it. Equal means equal SHA-1 and length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import common

LEAST, ARCHIVE_BYTES, LEVEL, DATE = 1000, 8 << 20, 3, "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. The block is an HTTP message; of a revisit, its head alone."""
    name = "" if page_id is None else str(page_id)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    block = _HTTP + payload
    said = "".join(f"{x}\r\n" for x in ["WARC/1.1", *head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"])
    return said.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def inflate(content: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The gzip file's data in pieces; it may have one member or many. A file that ends early raises ValueError."""
    stream, rest = zlib.decompressobj(31), memoryview(content)
    while len(rest):
        got = stream.decompress(rest[:step])
        rest = rest[step:]
        if got:
            yield got
        while stream.eof and (stream.unused_data or len(rest)):
            left = stream.unused_data
            stream = zlib.decompressobj(31)
            if left:
                if got := stream.decompress(left):
                    yield got
            else:
                break
    if content and not stream.eof:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The WARC records of a stream, each with its closing blank lines; at most one record is held."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                found = _LENGTH.search(held, 0, end + 2)
                if not found or not held.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                need = end + 4 + int(found[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the last WARC record is cut off")


def fields(one: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and the payload of a record."""
    head, _, rest = one.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    named = {k.lower(): v for k, v in named.items()}
    return named, rest[: int(named["content-length"])].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty; of a revisit null), digest and refers_to of every row of ``pages``; other columns
    are left out.

    Equal payloads meet as ids, digests and lengths only. Repeated rows are written each; of rows that share the largest
    page_id of their payload, each is a response. A row without page_id is a response.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    short = rows.select("page_id", "digest", F.octet_length("html").alias("_bytes")).where((F.col("_bytes") >= LEAST) & F.col("page_id").isNotNull())
    last = short.groupBy("digest", "_bytes").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisits = short.join(last, ["digest", "_bytes"]).where("page_id < _kept").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "_kept").distinct()
    # rows without page_id are spread by what they hold; they match nothing
    key = F.coalesce("page_id", F.xxhash64("url", "html"))
    joined = rows.withColumn("_key", key).join(revisits, (F.col("_key") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    refers_to = F.when(F.col("page_id").isNotNull(), F.col("_kept"))
    return joined.select("page_id", "url", F.when(refers_to.isNull(), F.col("html")).alias("html"), "digest", refers_to.alias("refers_to"))


def write(rows: DataFrame) -> DataFrame:
    """Archives (archive, content), each one gzip stream over its records."""

    def run(batches):
        from pyspark import TaskContext

        task, number, size = TaskContext.get().partitionId(), 0, 0
        packer, parts = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                one = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to)
                parts.append(packer.compress(one))
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield [[f"{task:06d}-{number:04d}.warc.gz"], [b"".join(parts) + packer.flush()]]
                    packer, parts, size, number = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0, number + 1
        if size:
            yield [[f"{task:06d}-{number:04d}.warc.gz"], [b"".join(parts) + packer.flush()]]

    return common.mapped(rows, run, "archive string, content binary")


def normalise(archives: DataFrame) -> DataFrame:
    """Archives with a gzip member for each record, and their sidecar index as two arrays: offsets and lengths."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                try:
                    members = [_gzip(x) for x in records(inflate(content.as_py()))]
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{name}: {e}") from e
                offsets, at = [], 0
                for m in members:
                    offsets.append(at)
                    at += len(m)
                yield [[name], [b"".join(members)], [offsets], [[len(m) for m in members]]]

    return common.mapped(archives, run, "archive string, content binary, offsets array<long>, lengths array<long>")


def index(normalised: DataFrame) -> DataFrame:
    """The sidecar index: archive, record (from 0), offset, length."""
    return normalised.select("archive", F.posexplode(F.arrays_zip("offsets", "lengths")).alias("record", "_at")).select("archive", "record", F.col("_at.offsets").alias("offset"), F.col("_at.lengths").alias("length"))


def read(archives: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Every record, sought by the sidecar index (archive, offset, length): page_id, url, record_type, refers_to;
    payload_bytes and payload_digest, of a response computed from its payload, of a revisit null and as its head states."""
    places = sidecar.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("_at"))  # the records of one archive
    # merged, whatever the sizes: contents are never sent to every task
    sought = archives.select("archive", "content").hint("merge").join(places, "archive").select("content", F.col("_at.offset").alias("offsets"), F.col("_at.length").alias("lengths"))

    def run(batches):
        import hashlib

        number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
        for batch in batches:
            for content, offsets, lengths in zip(batch.column("content"), batch.column("offsets").to_pylist(), batch.column("lengths").to_pylist(), strict=True):
                data, out = memoryview(content.as_buffer()), [[] for _ in range(6)]
                for at, n in zip(offsets, lengths, strict=True):
                    named, payload = fields(zlib.decompress(data[at : at + n], 31))
                    full = named["warc-type"] == "response"
                    row = (number(named["warc-record-id"]), named.get("warc-target-uri"), named["warc-type"], number(named.get("warc-refers-to")), len(payload) if full else None, hashlib.sha1(payload).hexdigest() if full else named["warc-payload-digest"].removeprefix("sha1:"))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield out

    return common.mapped(sought, run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string")


def resolved(found: DataFrame) -> DataFrame:
    """Records with payload_bytes of the full payload: a revisit takes it, and its digest, from the response that it
    refers to, whose payload must have the digest that the revisit states."""
    full = found.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = found.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")))
    revisits = revisits.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    return found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(revisits)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = common.materialize(write(planned(common.table(spark, sf_dir, "pages"))))
    normal = common.materialize(normalise(archives))
    common.release(archives)
    sidecar = common.materialize(index(normal))
    return resolved(common.materialize(read(normal, sidecar)))


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= {LEAST} GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept > page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND payload_bytes >= {LEAST}
"""
