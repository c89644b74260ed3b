"""Dictionary-compressed WARC writer and reader (.warc.zst).

Each archive begins with a skippable frame (magic 0x184D2A5D) that holds the Zstandard
dictionary; each record is a frame of its own, compressed with it, so records can be read
one by one. The dictionary is trained on a sample of records bounded by `sample_records` and
`sample_bytes` (documented parameters; it only affects size, never content). Every row becomes
a record: of equal payloads the one with the smallest id is the `response`, the others are
`revisit` records that name it.

Defined results: a null html is the empty payload, a null url is an empty target. Payloads shorter
than `least` are all responses. A null id is not the smallest unless all are null (then all are
responses); rows that repeat both id and payload are one capture written more than once, each a
response. Extra columns are ignored. An empty table gives no archive and no rows.

Tasks write to a name of their own attempt and move the file to its final name when it is whole,
so a lost executor or a repeated task leaves no half archive; the manifest names the files of the
attempts that counted. An archive is closed beyond ARCHIVE_BYTES. Folders are any file
system that pyarrow.fs knows. Equality is by SHA-256 and length; equal payloads meet as one partial
row per map task, and the rows are joined to one row per payload, which AQE splits where it is hot.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import ship
from gaugeline.operators.staging import new_table_path, stage

DICT_MAGIC = 0x184D2A5D  # fixed value of the format: the skippable frame that holds a dictionary
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: the revisit profile
ARCHIVE_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    # a target is one line: other characters are percent-encoded
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and block of a record; the digests are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{payload_digest(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(http.decode().rpartition("Content-Length: ")[2])
    if headers["WARC-Type"] == "response" and (len(payload) != full or f"sha1:{payload_digest(payload)}" != headers["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
    return {"headers": headers, "payload": payload, "payload_bytes": full}


def judged(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, first_id, revisit): first_id is the smallest id with this payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256))).withColumn("size", F.octet_length("html"))
    first = rows.groupBy("key", "size").agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("size") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, ["key", "size"]).select("page_id", "url", "html", "first_id", revisit.alias("revisit"))


def train_dictionary(pages: DataFrame, sample_records: int = 2000, sample_bytes: int = 8 << 20, size: int = 64 << 10) -> bytes:
    """A dictionary from the records with the smallest hashed ids, or none (b"") where they are too few or too alike."""
    fits = F.octet_length("html") <= sample_bytes // 64
    chosen = pages.filter(fits & F.col("page_id").isNotNull()).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_records)
    # at most sample_records ids; an id that many rows have gives one record
    rows = pages.filter(fits).join(F.broadcast(chosen.distinct()), "page_id").groupBy("page_id").agg(F.min(F.struct("html", "url")).alias("r"))
    rows = rows.select("page_id", "r.*")
    sample, total = [], 0
    for r in sorted(rows.collect(), key=lambda r: r.page_id):
        raw = record(r.page_id, r.url or "", r.html.encode(), None, False)
        total += len(raw)
        if total > sample_bytes:
            break
        sample.append(raw)
    try:
        return zstandard.train_dictionary(size, sample, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, folder: str, least: int = 0, dictionary: bytes | None = None, level: int = 3) -> DataFrame:
    """Write the archives into folder; the manifest (path, records, bytes) of those that count, as a stored table."""
    spark = pages.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(train_dictionary(pages) if dictionary is None else dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        packed = zstandard.ZstdCompressor(level=19).compress(known.value) if known.value else b""
        front = struct.pack("<II", DICT_MAGIC, len(packed)) + packed if packed else b""
        extra = {"dict_data": zstandard.ZstdCompressionDict(known.value)} if known.value else {}
        squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, **extra)
        out, path, done, records, size = None, "", [], 0, 0

        def close() -> None:
            out.close()
            final = path.removesuffix(".tmp")
            fs.move(path, final)
            done.append((final, records, size))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "revisit"))):
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst.tmp"
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    out.write(front)
                    records, size = 0, len(front)
                page_id, url, html, first, revisit = row
                frame = squeeze.compress(record(page_id, url, html.encode(), first, revisit))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*done)) or [(), (), ()], (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return stage(judged(pages, least).mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


def frames(source: pa.NativeFile) -> Iterator[bytes]:
    """Uncompressed records of an archive, frame by frame."""
    data = b""
    head = source.read(8)
    extra = {}
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
        packed = source.read(struct.unpack("<I", head[4:])[0])
        extra = {"dict_data": zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))}
    else:
        data = head
    reader = zstandard.ZstdDecompressor(**extra)
    while True:
        data = data or source.read(1 << 20)
        if not data:
            return
        one, out = reader.decompressobj(), []
        while not one.eof:
            if not data:
                data = source.read(1 << 20)
                if not data:
                    raise ValueError("archive ends inside a record")
            out.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(out)


READ_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """All records of the archives of a manifest, verified; payload is null for revisits, and everywhere unless wanted."""
    spark = manifest.sparkSession
    ship(spark)
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for raw in frames(source):
                        r = parse(raw)
                        h = r["headers"]
                        number = lambda k, h=h: int(h[k]) if h.get(k, "None") != "None" else None
                        body = r["payload"] if payload and h["WARC-Type"] == "response" else None
                        rows.append((number("X-Page-Id"), h["WARC-Target-URI"], r["payload_bytes"], h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], number("X-Refers-To-Page-Id"), body))
                        held += len(body or b"") + 200
                        if held > 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, F.xxhash64("path")).mapInArrow(run, READ_SCHEMA)


def write_and_read(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    folder = folder or new_table_path(pages.sparkSession, "warc")
    return read(write(pages, folder, least), folder, payload=False)
