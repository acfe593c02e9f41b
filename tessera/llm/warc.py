"""WARC archives: a writer with identical-payload revisits, and a splittable reader.

Every record is a gzip member of its own. The reader gives tasks byte ranges of the archives: Spark's text source is told that the
gzip magic ends a line, so a task scans its range for the magic, and a piece belongs to the range in which its magic
starts. Each piece is a candidate member. It is validated by decoding its header (flags, and ``WARC/`` at the front of what it
inflates to); magic that occurs by chance inside compressed data fails that, and its piece is joined to the member before it. Where such a
member reaches into the next range, both sides hand over the few pieces concerned and a second step joins them.
Bytes only pass through Spark's own readers and writers, so archives may be in any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.durable import new_path, settle

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
#: An empty gzip member; it ends in a zero byte.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")

MIN_REVISIT_BYTES = 100
#: Hadoop would inflate what is named ``.gz`` before anything looks for the magic; this codec hands its bytes on as they are.
#: (The second name is that of builds which rename packages.)
RAW = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", "io.compress.passthrough.extension": ".gz", "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".gz"}
LEVEL = 3


def _member(record: bytes, level: int) -> bytes:
    """A gzip member without its last byte, which is zero and which the text writer adds as the end of a line.

    The last byte is the high byte of the length; for records of 16 MiB or more an empty member follows.
    """
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(record) + packer.flush()
    return (packed if packed[-1] == 0 else packed + EMPTY_MEMBER)[:-1]


def _clean(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _packer(date: str, level: int):
    """For mapInArrow over (page_id, payload, url, digest, first): one packed record a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textkit.pieces(batches):
            out = []
            ids, urls, digests, firsts = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for i, (page, url, digest, first) in enumerate(zip(ids, urls, digests, firsts, strict=True)):
                payload = data[offsets[i] : offsets[i + 1]].tobytes()
                revisit = first is not None
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                block = http if revisit else http + payload
                head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page is None else page}>", f"WARC-Date: {date}"]
                if url is not None:
                    head.append(f"WARC-Target-URI: {_clean(url)}")
                head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
                if revisit:
                    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{first}>"]
                head.append(f"Content-Length: {len(block)}")
                out.append(_member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    return pack


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", level: int = LEVEL) -> None:
    """Write a record for each row of ``pages`` to gzipped WARC files in ``path``.

    A null payload is empty. Of rows with equal payloads of at least 100 bytes the one with the smallest id is the
    response and the others revisit it (rows that share that id are all responses; where all ids are null, so are all rows). Control characters
    in a URL are percent-encoded. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), payload.alias("payload"), F.col(url_col).alias("url")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= MIN_REVISIT_BYTES
    again = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("key"), "first")
    # short payloads take no part; their rows get keys of their own, so they spread over all partitions
    rows = rows.withColumn("key", F.when(long, F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))))
    rows = rows.join(again.hint("shuffle_merge"), "key", "left").select(
        "page_id", "payload", "url", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("first")
    )
    members = rows.mapInArrow(_packer(date, level), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


def _head(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) of a header block and what follows it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, rest


def parse(record: bytes, payloads: bool) -> tuple:
    """(record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload) of an unpacked record."""
    fields, rest = _head(record)
    kind = fields.get("warc-type")
    block = rest[: int(fields.get("content-length", len(rest)))]
    payload = block
    size = len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, payload = _head(block)
        size = len(payload)
        if kind == "revisit":
            size = int(http.get("content-length", size))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(payload).hexdigest()
    strip = lambda x: x and x.strip("<>")
    return strip(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), strip(fields.get("warc-refers-to")), digest, size, payload if payloads else None


class _Member:
    """A gzip member that grows by pieces until its deflate stream ends."""

    def __init__(self, piece: bytes):
        self.raw = piece
        self.inflater = zlib.decompressobj(31)
        self.out = [self.inflater.decompress(piece)]

    @classmethod
    def open(cls, piece: bytes) -> _Member | None:
        """None unless the piece starts as a WARC record's member does."""
        if len(piece) < 4 or piece[3] & 0xE0:
            return None
        try:
            front = zlib.decompressobj(31).decompress(piece, 64)
            if not front.startswith(b"WARC/"):
                return None
            return cls(piece)
        except zlib.error:
            return None

    def grow(self, piece: bytes) -> None:
        self.raw += piece
        self.out.append(self.inflater.decompress(piece))

    @property
    def whole(self) -> bool:
        return self.inflater.eof


FIELDS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
SHAPE = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _reader(payloads: bool):
    """For mapInArrow over (path, start, piece): records, and (path, start, order, piece) of pieces that need a neighbouring range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*FIELDS, "path", "start", "order", "piece"]
        types = [*_TYPES, pa.string(), pa.int64(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        at, last, opened, order = None, None, False, 0

        def flush(least: int = 0) -> Iterator[pa.RecordBatch]:
            if len(rows) > least:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                rows.clear()

        def handed(piece: bytes) -> tuple:
            return (*[None] * len(FIELDS), *at, order, piece)

        for batch in batches:
            for path, start, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (path, start):
                    if last is not None:
                        rows.append(handed(last.raw))
                    at, last, opened, order = (path, start), None, False, 0
                    if start == 0:  # what stands before the first magic
                        continue
                piece = MAGIC + piece
                fresh = _Member.open(piece)
                if fresh is not None:
                    if last is not None:  # cut short: the archive is damaged there
                        rows.append((None, "damaged", None, None, None, None, None, *at, None, None))
                    opened, last = True, fresh
                elif last is not None:
                    try:
                        last.grow(piece)
                    except zlib.error:
                        rows.append((None, "damaged", None, None, None, None, None, *at, None, None))
                        last = None
                elif not opened:
                    rows.append(handed(piece))
                    order += 1
                if last is not None and last.whole:
                    rows.append((*parse(b"".join(last.out), payloads), *at, None, None))
                    last = None
            yield from flush(0 if payloads else 2000)
        if last is not None:
            rows.append(handed(last.raw))
        yield from flush()

    return read


def _joiner(payloads: bool):
    """For mapInArrow over the handed pieces (path, start, order, piece), sorted so: members that reach over the ends of ranges, one at a time."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            rows: list[tuple] = []
            for path, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if path != at:
                    at, last = path, None
                fresh = _Member.open(piece)
                if fresh is not None:
                    last = fresh
                elif last is not None:
                    try:
                        last.grow(piece)
                    except zlib.error:
                        last = None
                if last is not None and last.whole:
                    rows.append(parse(b"".join(last.out), payloads))
                    last = None
            columns = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(FIELDS))

    return join


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records of the gzipped WARC files in ``path``; ``payloads=False`` leaves the payloads (not their sizes and digests) out.

    Files are split into ranges whatever they are named, but for names that end in ``.gz``: Spark's text source gives such a file to one task, which streams it. A record is held in memory whole, a file is not.
    Members that are not WARC records are passed over; a record whose compressed data is broken gives a row of type ``damaged``. Of a
    revisit, digest and size are those of the payload it stands for. Empty files give no rows.
    """
    lines = spark.read.options(**RAW).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    # written once, so that nothing is decoded twice: records, and the few pieces that go to the second step
    found = settle(pieces.mapInArrow(_reader(payloads), f"{SHAPE}, path string, start long, order long, piece binary"), "warc-records")
    handed = found.filter("piece IS NOT NULL").select("path", "start", "order", "piece").repartition("path").sortWithinPartitions("path", "start", "order")
    return found.filter("piece IS NULL").select(*FIELDS).union(handed.mapInArrow(_joiner(payloads), SHAPE))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) AS BIGINT)")
    return read(spark, path, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= {MIN_REVISIT_BYTES}
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": ORACLE}
