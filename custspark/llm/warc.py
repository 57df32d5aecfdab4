"""WARC archives: writing with revisits, segments and chunked framing; reading back.

Writing goes through Spark's text writer: a page is UTF-8, so a record is text, and
two line ends close each record as WARC asks. Reading goes through Spark's binary
reader, so both work wherever Spark can write and read.

A record longer than a segment is split; its continuation records may lie in other
files and in any order. Reading groups them by the origin's identifier, orders them by
segment number, verifies the total length, and decodes the chunked framing.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custspark.llm.common import column, prepare
from custspark.session import materialise

#: Pages with an equal payload of so many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of a record's block before it is segmented, bytes of a transfer chunk, records of a file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16 << 10, 4 << 10, 2000

# Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def split_utf8(raw: bytes, size: int) -> list[bytes]:
    """Pieces of at most `size` bytes (at least 4) that end between characters."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in split_utf8(payload, size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; an error if it is not exactly that."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            while (end := body.index(b"\r\n", at)) > at:  # trailing fields
                at = end + 2
            if end + 2 != len(body):
                raise ValueError("bytes follow the last chunk")
            return b"".join(parts)
        parts.append(body[at : at + size])
        at += size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        at += 2


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = [VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head) + END + block.decode()


def records(
    page: str | None, url: str | None, payload: bytes, head: str | None, date: str, segment: int, chunk: int
) -> Iterator[str]:
    """The records of one page, without the two line ends after each; head: the page that a revisit refers to."""
    digest = hashlib.sha1(payload).hexdigest()

    def identifier(p: str | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(_IDS, f'{p}/{digest}')}>"

    common = [
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Page-Id", None if page is None else quote(page, safe="")),
    ]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if head is not None:
        own = [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_IDS, f'revisit/{page}/{digest}')}>"),
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", identifier(head)),
            ("Refers-To-Page-Id", quote(head, safe="")),
        ]
        yield _record([*own, *common], f"{http}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk)
    parts = split_utf8(block, segment)
    own_id = identifier(page)
    for number, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", own_id), *common]
        if number > 1:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_IDS, f'{own_id}/{number}')}>"),
                ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", own_id),
            ]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", number))
        if 1 < number == len(parts):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(fields, part)


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    date: str | None = None,
) -> None:
    """Write one record per page, its continuations beside it, as compressed archives below `path`.

    Of equal payloads of `revisit_bytes` or more, the page with the largest id is the
    response, and the others revisit it. Rows that repeat that id and payload are
    responses too. A null page is an empty payload; a null id never is the largest, and
    payloads that only null ids have are all responses. An empty table gives no record.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(
        column(pages, id_col).alias("id"),
        column(pages, url_col).cast("string").alias("url"),
        F.coalesce(column(pages, html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.when(F.octet_length("html") >= revisit_bytes, F.sha1(F.col("html").cast("binary"))))
    # Written, so that its size is known before the join: small, it is broadcast; large, a hot payload's rows are split.
    heads = materialise(
        rows.filter("digest is not null")
        .groupBy("digest")
        .agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and head is not null")
        .drop("n"),
        "warc-heads",
    )
    joined = rows.join(heads, "digest", "left").select(
        F.col("id").cast("string").alias("id"),
        "url",
        "html",
        F.when(~F.col("id").eqNullSafe(F.col("head")), F.col("head").cast("string")).alias("head"),
    )
    now = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)]
            for low in range(0, batch.num_rows, 50):  # records of some rows at a time
                few = zip(*(c.slice(low, 50).to_pylist() for c in columns))
                made = [r for p, u, h, head in few for r in records(p, u, h, head, now, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    lines = joined.mapInArrow(run, "value string")
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELDS = pa.schema(
    [
        ("page", pa.string()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers", pa.string()),
        ("digest", pa.string()),
        ("origin", pa.string()),
        ("segment", pa.int64()),
        ("total", pa.int64()),
        ("block", pa.binary()),
    ]
)
_READ = (
    "page string, url string, record_type string, refers string, payload_bytes bigint, payload_digest string, "
    "html binary, problem string"
)
_SEGMENT = "origin string, segment bigint, total bigint, block binary"


def _unquoted(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of an archive by their stated lengths, as _FIELDS."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = end + 4
        at = begin + int(head["content-length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
        yield (
            _unquoted(head.get("page-id")),
            head.get("warc-target-uri"),
            head["warc-type"],
            _unquoted(head.get("refers-to-page-id")),
            head.get("warc-payload-digest", "").removeprefix("sha1:"),
            head.get("warc-segment-origin-id", head["warc-record-id"]),
            None if number is None else int(number),
            None if total is None else int(total),
            archive[begin:at],
        )
        at += 4


def decode(record_type: str, digest: str, block: bytes) -> tuple[int | None, str, bytes | None, str | None]:
    """payload_bytes, payload_digest, payload and what is wrong, of a whole block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if record_type == "revisit":
        return int(fields[b"content-length"]), digest, None, None
    try:
        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    except ValueError as e:
        return None, digest, None, str(e)
    found = hashlib.sha1(payload).hexdigest()
    return len(payload), found, payload, None if found == digest else "digest differs"


def _decoded(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    out = []
    for page, url, kind, refers, digest, block, problem in rows:
        size, found, payload, wrong = (None, digest, None, problem) if problem else decode(kind, digest, block)
        out.append((page, url, kind, refers, size, found, payload if payloads else None, wrong))
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string()]
    columns = zip(*out) if out else [[]] * len(types)
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit record: page, url, record_type, refers, payload_bytes,
    payload_digest, html (the payload; null for a revisit, or without `payloads`) and problem.

    problem is null, or says why a record has no payload: a segment is missing, the total
    length or the framing is wrong; or that its digest differs. A record that is there
    several times is read as often.
    """
    prepare(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows: list[tuple] = []
                size = 0
                for row in parse(raw):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 4 << 20:
                        yield _columns(rows)
                        rows, size = [], 0
                if rows:
                    yield _columns(rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split(batches):
            alone = batch.filter(pc.is_null(batch.column("segment")))
            rows = [
                (r["page"], r["url"], r["record_type"], r["refers"], r["digest"], r["block"], None)
                for r in alone.to_pylist()
            ]
            done = _decoded(rows, payloads)
            rest = batch.filter(pc.is_valid(batch.column("segment")))
            yield _both(done, rest)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = materialise(files.mapInArrow(whole, f"{_READ}, {_SEGMENT}"), "warc-records")
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    segments = (
        parsed.filter("segment is not null")
        .groupBy("origin")
        .agg(
            F.max("page").alias("page"),
            F.max("url").alias("url"),
            F.max("payload_digest").alias("digest"),
            F.max("total").alias("total"),
            F.collect_set(F.struct("segment", "block")).alias("parts"),
            F.count(F.when(F.col("segment") == 1, 1)).alias("copies"),
        )
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                parts = sorted((p["segment"], p["block"]) for p in r["parts"])
                block = b"".join(b for _, b in parts)
                problem = None
                if [n for n, _ in parts] != list(range(1, len(parts) + 1)) or r["total"] is None:
                    problem = "a segment is missing"
                elif r["total"] != len(block):
                    problem = f"{len(block)} bytes of {r['total']}"
                row = (r["page"], r["url"], "response", None, r["digest"], block, problem)
                yield _decoded([row] * max(1, r["copies"]), payloads)

    return parsed.filter("segment is null").select(*names).unionByName(segments.mapInArrow(joined, _READ))


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


def _both(done: pa.RecordBatch, rest: pa.RecordBatch) -> pa.RecordBatch:
    """Decoded records, and segments that still wait for others, in one shape."""
    n, m = done.num_rows, rest.num_rows

    def either(a: pa.Array | None, b: pa.Array | None, kind: pa.DataType) -> pa.Array:
        parts = [a if a is not None else pa.nulls(n, kind), b if b is not None else pa.nulls(m, kind)]
        return pa.concat_arrays([p.cast(kind) for p in parts])

    same = {"payload_digest": "digest"}
    arrays, names = [], []
    for f in done.schema:
        b = rest.column(same.get(f.name, f.name)) if same.get(f.name, f.name) in rest.schema.names else None
        arrays.append(either(done.column(f.name), b, f.type))
        names.append(f.name)
    for name in ("origin", "segment", "total", "block"):
        arrays.append(either(None, rest.column(name), rest.schema.field(name).type))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)
