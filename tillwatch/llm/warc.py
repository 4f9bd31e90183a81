"""WARC archives in Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

An archive begins with a skippable frame that holds the dictionary (plain, or itself a Zstandard frame); every record is
a frame of its own, so a reader needs no more of an archive in memory than one record. Payloads that repeat are written
once, as a response; their other captures are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.batches import arrow_session
from tillwatch.session import materialise, work_dir

# Magic numbers of frames and dictionaries, the revisit profile, the date of records without one.
ZSTD_MAGIC, DICTIONARY_MAGIC, SKIPPABLE, DICTIONARY_FRAME = 0xFD2FB528, 0xEC30A437, 0x184D2A50, 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

#: Payloads from this size on are written once.
SHARED_BYTES = 1000
#: A new archive is begun after so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: The dictionary, its sample (rows, bytes of each), and the level of compression.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, LEVEL = 64 << 10, 512, 8 << 10, 3
#: Tasks that read archives; with more archives a task reads several.
MOST_TASKS = 100_000
#: Bytes asked of a file at a time.
READ_BYTES = 1 << 20

RECORD = (
    "archive string, offset long, type string, record_id string, target_uri string, refers_to string, row_key string, "
    "content_length long, payload_bytes long, payload_digest string, payload binary, error string"
)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; of Hadoop's names for object stores too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path) if ":" in path else f"file://{path}")


def train(samples: list[bytes]) -> bytes:
    """A dictionary of what the samples share; empty if they are too few to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def label(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def hex_digest(labelled: str | None) -> str | None:
    """Bare hex of a labelled digest in base 32 or base 16; None if it is neither."""
    algorithm, _, value = (labelled or "").partition(":")
    try:
        if algorithm.lower() != "sha1":
            return None
        return (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
    except ValueError:
        return None


def record_id(row: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{row} {digest}'.encode()).hexdigest())}>"


def header_text(value: str) -> str:
    """Characters that would end a header line, or a URI, as percent escapes of their bytes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: int, key: object, uri: str | None, digest: str, payload: bytes | None, original: str | None) -> bytes:
    """One record: a response with its payload, or, given the id of an ``original``, a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if original else http + (payload or b"")
    fields = [("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", record_id(row, digest)), ("WARC-Date", EPOCH)]
    if uri is not None:
        fields.append(("WARC-Target-URI", header_text(uri)))
    if key is not None:
        fields.append(("WARC-Row-Key", str(key)))
    fields += [("WARC-Payload-Digest", label(digest)), ("WARC-Block-Digest", label(hashlib.sha1(block).hexdigest()))]
    if original:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", original)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Broken(Exception):
    """What an archive or a record lacks."""


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record that fills ``data`` exactly."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise Broken("header without end")
    version, *lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", version):
        raise Broken("no version line")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Broken("header line without name")
        if name.lower().decode() in fields and name.lower() != b"warc-concurrent-to":
            raise Broken(f"header {name.decode()} twice")
        fields[name.lower().decode()] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise Broken(f"no header {name}")
    if not re.fullmatch(r"[0-9]{1,18}", fields["content-length"]):
        raise Broken("content-length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Broken(f"content-length {size}, block {max(len(rest) - 4, 0)}")
    return fields, rest[:size]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What the block carries: the body of an HTTP message, or the block itself."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return block
    _, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise Broken("HTTP header without end")
    return body


def check_digests(fields: dict[str, str], block: bytes, payload: bytes) -> None:
    """A digest of another algorithm is not looked at; a revisit's payload is elsewhere."""
    for name, content in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        if fields.get(name, "").lower().startswith("sha1:") and (name != "warc-payload-digest" or fields["warc-type"] != "revisit"):
            if hex_digest(fields[name]) != hashlib.sha1(content).hexdigest():
                raise Broken(f"{name} does not match")


class Frames:
    """Frames of a file, read one after the other: (offset, magic number, bytes of the frame)."""

    def __init__(self, file: io.RawIOBase | pa.NativeFile) -> None:
        self.file, self.buffer, self.at, self.before = file, bytearray(), 0, 0

    def need(self, n: int) -> None:
        """Have n bytes from the present place on."""
        if self.at > READ_BYTES:
            del self.buffer[: self.at]
            self.before += self.at
            self.at = 0
        while len(self.buffer) - self.at < n:
            more = self.file.read(READ_BYTES)
            if not more:
                raise Broken("archive ends within a frame")
            self.buffer += more

    def ended(self) -> bool:
        try:
            self.need(1)
        except Broken:
            return True
        return False

    def number(self, at: int, size: int) -> int:
        self.need(at + size)
        return int.from_bytes(self.buffer[self.at + at : self.at + at + size], "little")

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        while not self.ended():
            magic = self.number(0, 4)
            if magic & 0xFFFFFFF0 == SKIPPABLE:
                size = 8 + self.number(4, 4)
            elif magic == ZSTD_MAGIC:
                size = self.zstd_size()
            else:
                raise Broken("no frame begins here")
            self.need(size)
            frame, offset = bytes(self.buffer[self.at : self.at + size]), self.before + self.at
            self.at += size
            yield offset, magic, frame

    def zstd_size(self) -> int:
        """By the header and the three bytes that begin each block."""
        flags = self.number(4, 1)
        single = flags >> 5 & 1
        at = 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        while True:
            block = self.number(at, 3)
            kind = block >> 1 & 3
            if kind == 3:
                raise Broken("reserved block type")
            at += 3 + (1 if kind == 1 else block >> 3)
            if block & 1:
                return at + (4 if flags & 4 else 0)


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    if content[:4] == ZSTD_MAGIC.to_bytes(4, "little"):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if content[:4] != DICTIONARY_MAGIC.to_bytes(4, "little"):
        raise Broken("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content)


def read_archive(file: io.RawIOBase | pa.NativeFile) -> Iterator[tuple[int, dict[str, str] | None, bytes, str | None]]:
    """(offset, fields, payload, error) of each record. A broken record is a row, and the next frame is read;
    an archive that breaks off, or has something else between frames, ends with a row."""
    frames, decompressor = Frames(file), zstandard.ZstdDecompressor()
    try:
        for offset, magic, frame in frames:
            if magic != ZSTD_MAGIC:
                if magic == DICTIONARY_FRAME and offset == 0:
                    decompressor = zstandard.ZstdDecompressor(dict_data=load_dictionary(frame[8:]))
                continue
            fields = None
            try:
                decoder = decompressor.decompressobj()
                data = decoder.decompress(frame)
                if not decoder.eof:
                    raise Broken("the frame is not whole")
                fields, block = parse_record(data)
                payload = payload_of(fields, block)
                check_digests(fields, block, payload)
                yield offset, fields, payload, None
            except (Broken, zstandard.ZstdError) as problem:
                yield offset, fields, b"", str(problem)
    except (Broken, zstandard.ZstdError) as problem:
        yield frames.before + frames.at, None, b"", str(problem)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Hadoop resolves it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def numbered(pages: DataFrame, key: str, uri: str, body: str) -> DataFrame:
    """Rows with a number of their own, digest and size of the payload; written, so that numbers hold."""
    payload = F.encode(F.coalesce(body, F.lit("")), "UTF-8") if dict(pages.dtypes)[body] == "string" else F.coalesce(body, F.unhex(F.lit("")))
    rows = pages.select(F.col(key).alias("row_key"), F.col(uri).alias("uri"), payload.alias("payload"))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")), "numbered")


def write_archives(
    pages: DataFrame,
    key: str = "page_id",
    uri: str = "url",
    body: str = "html",
    shared_bytes: int = SHARED_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Write a record per row; returns the archives written: path, records, bytes.

    Of rows with equal payloads of ``shared_bytes`` or more, the one with the largest key (null last) is a response,
    the others are revisits of it; of rows equal in both any one is. A null body is empty, a null URI or key
    leaves its header out. Each task writes archives of its own name in ``folder`` (below the session's
    shared folder if None), and only those of finished tasks are in the table returned: a task that
    is repeated leaves an archive that nothing refers to. A record has to fit a task. No rows, no archives.

    The dictionary is trained on the first 8 KB of any 512 rows; it changes sizes, not what is read back. ``folder`` has to be
    a store that pyarrow opens (a shared file system, S3, HDFS, GCS, Azure).
    """
    spark = arrow_session(pages.sparkSession)
    folder = qualified(spark, folder or work_dir(spark, "warc"))
    rows = numbered(pages, key, uri, body)
    sample = rows.where("size > 0").select(F.expr(f"substring(payload, 1, {SAMPLE_BYTES})").alias("part")).limit(SAMPLE_ROWS)
    dictionary = train([bytes(r.part) for r in sample.collect()])
    originals = (
        rows.where(F.col("size") >= shared_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("row_key", "row")).alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", F.col("original.row").alias("original"))
    )
    # Rows of a digest that a third of all pages share stay in as many tasks as adaptive execution cuts them into.
    placed = rows.join(materialise(originals, "originals"), "digest", "left").select(
        "row", "row_key", "uri", "digest", F.when(F.col("original").isNull() | (F.col("original") == F.col("row")), F.col("payload")).alias("payload"), F.nullif(F.col("original"), F.col("row")).alias("original")
    )
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "row_key", "uri", "digest", "payload", "original")]
            for row, key, uri, digest, payload, original in zip(*columns):
                out = out or Writer(folder, shared.value)
                out.add(record(row, key, uri, digest, payload, None if original is None else record_id(original, digest)))
                if out.bytes >= archive_bytes:
                    yield out.close()
                    out = None
        if out:
            yield out.close()

    return materialise(placed.mapInArrow(write, "archive string, records long, bytes long"), "archives")


class Writer:
    """One archive that is being written."""

    def __init__(self, folder: str, dictionary: bytes) -> None:
        self.path, self.records, self.bytes = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
        system, place = open_path(self.path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(place, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        if dictionary:
            self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary))
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def add(self, content: bytes) -> None:
        self._put(self.compressor.compress(content))
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.file.close()
        return pa.RecordBatch.from_pylist([{"archive": self.path, "records": self.records, "bytes": self.bytes}], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives whose paths are in the column ``archive``: the columns of ``RECORD``.

    Archives are dealt over as many tasks, and read frame by frame; their paths are counted first. ``error`` tells what is wrong with a record or an archive
    (no version line, missing or repeated headers, a length or a digest that does not match, a frame that does not
    decode, an archive that breaks off or cannot be opened) and is null otherwise. ``payload_bytes`` and ``payload_digest`` (hex) are those of the
    payload in the record; a revisit has no payload, its digest is the one it names. Without ``payloads``
    the column ``payload`` is null. Null paths are left out, repeated paths are read again.
    """
    arrow_session(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                yield from batched(records_of(path, payloads))

    paths = archives.where("archive IS NOT NULL").select("archive")
    return paths.repartition(min(max(paths.count(), 1), MOST_TASKS)).mapInArrow(read, RECORD)


def records_of(path: str, payloads: bool) -> Iterator[dict]:
    empty = dict.fromkeys(re.findall(r"(\w+) \w+", RECORD))
    try:
        system, place = open_path(path)
        file = system.open_input_stream(place, compression=None)
    except (OSError, pa.ArrowInvalid) as problem:
        yield empty | {"archive": path, "error": f"cannot be opened: {problem}"}
        return
    with file:
        for offset, fields, payload, error in read_archive(file):
            fields = fields or {}
            kind = fields.get("warc-type")
            found = empty | {"archive": path, "offset": offset, "type": kind, "error": error, "record_id": fields.get("warc-record-id")}
            found |= {"target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "row_key": fields.get("warc-row-key")}
            if error is None:
                found["content_length"] = int(fields["content-length"])
                if kind == "revisit":
                    found["payload_digest"] = hex_digest(fields.get("warc-payload-digest"))
                else:
                    found |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload if payloads else None}
            yield found


def batched(rows: Iterator[dict], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of 2,000 rows or ``most`` bytes of payload."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in re.findall(r"(\w+) (\w+)", RECORD)])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"")
        if len(held) >= 2000 or size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with payload_bytes and original_key of the response that a revisit refers to.

    Both stay null if it is not there; original_key is null for all but revisits. ``records`` is read three times.
    A response that a third of all records refer to is one row of the join's smaller side.
    """
    columns = [c for c in records.columns if c not in ("payload_bytes", "original_key")]
    originals = records.where("type = 'response' AND error IS NULL").select(F.col("record_id").alias("refers_to"), F.col("row_key").alias("original_key"), "payload_bytes")
    revisit = F.coalesce(F.col("type") == "revisit", F.lit(False))
    revisits = records.where(revisit).select(*columns).join(originals, "refers_to", "left")
    others = records.where(~revisit).select(*columns, F.lit(None).cast("string").alias("original_key"), "payload_bytes")
    return revisits.select(*others.columns).unionByName(others)
