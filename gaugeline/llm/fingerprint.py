"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line, cut every PIECE_WORDS words) is hashed to a wide vector of LANES signs; a
document's fingerprint is the sum of its vectors, each lane modulo 2**16. Sums do not depend on
order, and paragraphs are inserted or deleted by adding or subtracting their vectors, so an edit
costs only the paragraphs it touches. Equal multisets have equal fingerprints. Since the lanes are
signs, inner products of two fingerprints estimate how many paragraphs they share: the likeness
2ab / (aa + bb) is 1 for equal fingerprints and about 0 (within some 1/sqrt(LANES)) for unrelated.
It is taken from the sums before they are reduced, as a text that repeats a paragraph often wraps its lanes.

Defined results: a null or blank text is the empty multiset, the zero vector; two empty ones have
likeness 1. Documents follow one another by id (null first), rows of equal id by text, repeated rows
each on its own; after the last comes the first, and a single document follows itself. An empty
table gives an empty one. Extra columns are ignored.

Scale: documents are dealt into contiguous id ranges by quantiles, each range is sorted in one task
and read as a stream with one document of look-ahead; a copy of the next range's first document
closes each range. The text is shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm import text as tx
from gaugeline.llm.common import ship

LANES = 256
PIECE_WORDS = 8
_SEEDS = np.array([0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(LANES // 64)], dtype=np.uint64)


def pieces(text: str) -> list[int]:
    """Hashes of the paragraphs; blank ones have none."""
    out = []
    for line in text.encode().split(b"\n"):
        w = line.split()
        for i in range(0, len(w), PIECE_WORDS):
            out.append(xxhash.xxh3_64_intdigest(b" ".join(w[i : i + PIECE_WORDS])))
    return out


def sums(groups: list[list[int]]) -> np.ndarray:
    """One row of LANES lanes, not yet reduced modulo 2**16, for each group of paragraph hashes."""
    out = np.zeros((len(groups), LANES), np.int32)
    size = np.array([len(g) for g in groups], np.int64)
    if not size.sum():
        return out
    flat = np.fromiter((h for g in groups for h in g), dtype=np.uint64, count=int(size.sum()))
    wide = tx.mix(flat[:, None] + _SEEDS[None, :]).view(np.uint8)
    full = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[full]
    out[full] = 2 * np.add.reduceat(np.unpackbits(wide, axis=1), starts, axis=0, dtype=np.int32) - size[full, None]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows of `sums`, whose lanes have not wrapped."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    both = (x * x).sum(1) + (y * y).sum(1)
    got = np.where(both > 0, 2 * (x * y).sum(1) / np.where(both > 0, both, 1), 1.0)
    return np.clip(got, 0.0, 1.0)


def hexed(rows: np.ndarray) -> list[str]:
    """The fingerprints: each lane modulo 2**16."""
    return [r.astype(">u2").tobytes().hex() for r in rows]


def edited_text(text: str, following: str) -> tuple[str, int]:
    """The text whose last quarter is replaced by the start of the following one, and where the change begins."""
    cut = len(text) - len(text) // 4
    return text[:cut] + following[: len(text) // 4], cut


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all but the last text, each against its follower."""
    n = len(texts) - 1
    before, after, shas = [], [], []
    for text, following in zip(texts, texts[1:]):
        edited, cut = edited_text(text, following)
        line = text.rfind("\n", 0, cut) + 1
        before.append(pieces(text[line:]))
        after.append(pieces(edited[line:]))
        shas.append(hashlib.sha256(edited.encode()).hexdigest())
    vectors = sums([pieces(t) for t in texts])
    edited = vectors[:-1] - sums(before) + sums(after)
    columns = [
        pa.array(ids[:n], pa.int64()),
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array(shas, pa.string()),
        pa.array(hexed(vectors[:-1]), pa.string()),
        pa.array(hexed(edited), pa.string()),
        pa.array(likeness(vectors[:-1], edited)),
        pa.array(likeness(vectors[:-1], vectors[1:])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (doc_id, text, closes): compare each with the next; a closing row ends its range."""
    ids, texts = [], []
    for batch in batches:
        for part in tx.slices(batch, "text"):
            for i, t, closes in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("closes").to_pylist()):
                ids.append(i)
                texts.append(t)
                if closes:
                    yield _compare(ids, texts)
                    ids, texts = [], []
            if len(texts) > 1:
                yield _compare(ids, texts)
                ids, texts = ids[-1:], texts[-1:]


def follow(docs: DataFrame, text: str = "text", id_col: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """SCHEMA for every document: its fingerprint, that of the text edited with its follower's start, and the likenesses."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 2 * parts
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = sorted(set(rows.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    if cuts:
        rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_key", outputCol="bucket", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    rows = rows.select(F.col("bucket").cast("int").alias("bucket"), "doc_id", "text")
    # at most one row for each range: its first document, to close the range before
    heads = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    order = Window.orderBy("bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closing = heads.select("bucket", F.coalesce(F.lead("head").over(order), F.first("head").over(everything)).alias("head")).select("bucket", "head.doc_id", "head.text", F.lit(True).alias("closes"))
    both = rows.withColumn("closes", F.lit(False)).unionByName(closing)
    dealt = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "closes", F.asc_nulls_first("doc_id"), "text")
    return dealt.select("doc_id", "text", "closes").mapInArrow(_stream, SCHEMA)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text as hexadecimal lanes."""
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != out), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text):
                got = hexed(sums([pieces(t or "") for t in part.column(text).to_pylist()]))
                kept = [c for c in part.schema.names if c != out]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(got, pa.string())], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lane-wise sum (or difference) of two fingerprints in hexadecimal: insertion (or deletion) of paragraphs."""
    lane = lambda c, k: F.conv(F.substring(c, 4 * k + 1, F.lit(4)), 16, 10).cast("int")
    total = lambda k: F.lpad(F.lower(F.hex(F.pmod(lane(a, k) + sign * lane(b, k), F.lit(65536)))), 4, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), total), "")
