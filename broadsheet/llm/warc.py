"""WARC archives: a writer of record-wise gzip members and a splittable reader.

The writer stores each payload once: of the pages with equal payloads the one with
the smallest id becomes a response, the others are revisits that refer to it.
Every record is a gzip member of its own. A task strings members together to
chunks of bounded size, and Spark's text writer stores each chunk as a file, byte
for byte, through its commit protocol; one zero byte, which gzip allows as
padding, ends a file. The committed files are then renamed to ``.warc.gz``, the
usual name.

The reader deals byte ranges to tasks, and each range owns the candidates that
start inside it: places with the three bytes that begin a gzip member. Files
without a codec's name are cut by Spark's line reader at these bytes. Spark's
readers unpack files named ``.gz`` by themselves, from the start, which cannot be
turned off; such files are fetched raw (``binaryFile``, at most 2 GB each) and their
ranges are dealt out. A candidate is a member if its gzip header is sound and what
it inflates to begins like a record. Magic bytes may also occur inside a member;
such a candidate continues the one before. Where a range's end falls between, its
rest is carried over to a short second step by file and place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, written

MAGIC = b"\x1f\x8b\x08"
# Bytes of a written file, and of a range of a file that is fetched raw.
CHUNK_BYTES, RANGE_BYTES = 64 << 20, 16 << 20
# Bytes in which a member's gzip header and the start of its record must lie.
AHEAD = 1 << 16
# So many repeated digests may be broadcast (about 30 MB); more meet by shuffle.
FEW_DIGESTS = 200_000
HEAD = re.compile(rb"WARC/\d\.\d\r\n")
RECORD = "page_id long, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. The id of a record tells its page."""
    name = "none" if page_id is None else page_id
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


SAFE = "".join(chr(c) for c in range(33, 127))


def write_warc(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
               id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write a record for each row and return the folder.

    Null payloads are empty; a null URL has no target header. Of equal payloads of
    at least ``min_revisit_bytes`` the smallest id is the response (null ids are
    never referred to unless all are null; then each is a response), and rows that
    repeat that id are responses too. Other columns are not read. Digests are
    grouped first, without payloads. Where few occur more than once (counted, at most
    ``FEW_DIGESTS``) these are broadcast and no payload moves; else payloads move once,
    to the task of their digest, and one that very many pages share is split by
    Spark's skew join.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("sha"))
    first = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "digests")
    first = F.broadcast(first) if first.count() <= FEW_DIGESTS else first.hint("merge")
    rows = rows.join(first, "sha", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(member(*row))
                size += len(held[-1])
                if size >= chunk_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])

    files = rows.mapInArrow(chunks, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    aside = shared_path(spark, "warc-new")
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(aside)
    move_named(spark, aside, path)
    return path


def move_named(spark: SparkSession, aside: str, path: str) -> None:
    """Move the committed files of ``aside`` into ``path`` as ``.warc.gz``: renames only,
    one for each file."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = new(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    for status in fs.listStatus(new(aside)):
        name = status.getPath().getName()
        if name.startswith("part-") and not fs.rename(status.getPath(), new(f"{path.rstrip('/')}/{name.removesuffix('.txt')}.warc.gz")):
            raise OSError(f"{name} could not be moved to {path}")
    fs.delete(new(aside), True)


class Member:
    """A gzip member that is inflated as its pieces come, each byte once."""

    def __init__(self, data: bytes):
        self.raw, self.out = [], []
        self.z: zlib._Decompress | None = zlib.decompressobj(31)
        self.add(data)

    def add(self, data: bytes) -> None:
        self.raw.append(data)
        if self.z is not None and not self.z.eof:
            try:
                self.out.append(self.z.decompress(data))
            except zlib.error:
                self.z = None  # damaged

    def record(self) -> bytes | None:
        """The record, once the member is whole (zero bytes may follow it)."""
        if self.z is None or not self.z.eof or self.z.unused_data.strip(b"\0"):
            return None
        return b"".join(self.out)


def sound(data: bytes) -> bool:
    """Is this a gzip header (no reserved flags) whose member begins a record?"""
    if len(data) < 10 or data[3] & 0xE0:
        return False
    try:
        return bool(HEAD.match(zlib.decompressobj(31).decompress(data, 16)))
    except zlib.error:
        return False


def parse(raw: bytes) -> tuple | None:
    """Record bytes -> a row of RECORD; None for other record types."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = page_of(fields["warc-record-id"])
    if kind == "response":
        return page, kind, fields.get("warc-target-uri"), payload, len(payload), digest(payload), None
    size = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
    return (page, kind, fields.get("warc-target-uri"), None, int(size[1]) if size else None,
            fields["warc-payload-digest"].partition(":")[2], page_of(fields["warc-refers-to"]))


def page_of(record_id: str) -> int | None:
    name = record_id.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


# A row is a record (seq null) or a piece of one that a range could not finish.
FOUND = RECORD + ", file string, block long, seq long, begins boolean, piece binary"
TYPES = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(),
         pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of byte ranges, in order -> records and unfinished pieces."""
    place, held, seq = None, None, 0
    rows: list[tuple] = []

    def close():
        nonlocal held
        if held is not None:
            rows.append((None,) * 7 + (*place, 0, True, b"".join(held.raw)))
        held = None

    def settle():
        nonlocal held
        record = held.record()
        if record is not None:
            rows.extend((*r, *place, None, None, None) for r in [parse(record)] if r)
            held = None

    for batch in batches:
        for value, file, block, start in zip(*(c.to_pylist() for c in batch.columns)):
            if place != (file, block):
                close()
                place, seq = (file, block), 0
            # The reader strips the magic bytes before a candidate; the bytes before a
            # file's first ones are a candidate without them.
            data = value if start and not seq else MAGIC + value
            seq += 1
            if start and seq == 1:
                if data.strip(b"\0"):
                    raise ValueError(f"{file} does not begin with a gzip member")
                continue
            if sound(data):
                close()
                held = Member(data)
                settle()
            elif held is not None:
                held.add(data)
                settle()
            else:
                rows.append((None,) * 7 + (*place, seq, False, data))
        yield batch_of(rows)
        rows = []
    close()
    yield batch_of(rows)


def named(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Are there files of other names, and files named ``.gz``, under ``path``? Hidden
    files do not count. A listing; no file is opened."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    plain = packed = False
    if fs.exists(top):
        files = fs.listFiles(top, True)
        while files.hasNext() and not (plain and packed):
            name = files.next().getPath().getName()
            if not name.startswith(("_", ".")):
                plain, packed = plain or not name.endswith("z"), packed or name.endswith(".gz")
    return plain, packed


def scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges -> records and unfinished pieces, as ``scan`` gives them. A range comes
    with some bytes after it, so that the header of a member that starts at its end can
    be decoded; they belong to the next range."""
    for batch in batches:
        for value, file, block, size in zip(*(c.to_pylist() for c in batch.columns)):
            begins, at, rows = [], value.find(MAGIC), []
            while 0 <= at < size:
                if sound(value[at: at + AHEAD]):
                    begins.append(at)
                at = value.find(MAGIC, at + 1)
            head = value[: begins[0] if begins else size]
            if block == 0 and head.strip(b"\0"):
                raise ValueError(f"{file} does not begin with a gzip member")
            if head and block:
                rows.append((None,) * 7 + (file, block, 0, False, head))
            for k, (at, end) in enumerate(zip(begins, [*begins[1:], size])):
                record = Member(value[at:end]).record()
                if record is None:
                    rows.append((None,) * 7 + (file, block, k, True, value[at:end]))
                else:
                    rows += [(*r, file, block, None, None, None) for r in [parse(record)] if r]
            yield batch_of(rows)


def found_in_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """What the ranges of the files named ``.gz`` under ``path`` hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("length") - 1), F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select(at.alias("block"), "content", "length", F.col("path").alias("file")).select(
        F.substring("content", (F.col("block") + 1).cast("int"), F.lit(range_bytes + AHEAD)).alias("value"), "file", "block",
        F.least(F.lit(range_bytes).cast("long"), F.col("length") - F.col("block")).alias("size"))
    return ranges.repartition("file", "block").mapInArrow(scan_ranges, FOUND)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Response and revisit records of all files under ``path``: ``page_id,
    record_type, target_uri, payload`` (null for revisits), ``payload_bytes,
    payload_digest`` (bare upper-case base32 SHA-1 of the full payload),
    ``refers_to``. A folder without files gives no rows. A member that stays
    damaged after all its pieces are joined fails the job: no record is skipped.
    """
    small_batches(spark)
    plain, packed = named(spark, path)
    parts = []
    if plain:
        parts.append(spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "*[!z]").text(path)
                     .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                             F.col("_metadata.file_block_start").alias("block"),
                             (F.col("_metadata.file_block_start") == 0).alias("start")).mapInArrow(scan, FOUND))
    if packed:
        parts.append(found_in_ranges(spark, path, range_bytes))
    if not parts:
        return spark.createDataFrame([], RECORD)
    found = reduce(DataFrame.unionByName, parts)
    # Pieces of one record: it begins in one range and goes on in those after it.
    order = Window.partitionBy("file").orderBy("block", F.col("begins").cast("int"), "seq")
    pieces = found.where("piece is not null").withColumn("record", F.sum(F.col("begins").cast("int")).over(order))
    joined = (pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", F.col("begins").cast("int").alias("b"), "seq", "piece"))).alias("all"))
              .select(F.transform("all", lambda p: p["piece"]).alias("all")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column(0).to_pylist():
                record = Member(b"".join(parts)).record()
                if record is None:
                    raise ValueError("a WARC member is cut off or damaged")
                rows += [r for r in [parse(record)] if r]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES[:7])], NAMES[:7])

    own = [c.split()[0] for c in RECORD.split(", ")]
    return found.where("piece is null").select(*own).unionByName(joined.mapInArrow(finish, RECORD))
