"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words (all of its text). Each passage is encoded
from its byte classes, word shapes, repetitions and a histogram of hashed byte pairs; a gated
attention network, learned from document labels only, weighs the passages, and the weighted
passage representation gives the score. Language, source and id are never inputs.

The model is fitted on a bounded sample: the `max_fit_docs` labelled rows with the smallest hashed
ids outside the held-out fold, with all their passages. Only their features reach the driver; where
texts are very long, fewer rows (`max_fit_docs`) bound its memory. Scoring reads every passage of every document.

Defined results: a null or blank text is one empty passage and has a score; labels that are null or not
0/1 are ignored, repeated labels of an id are averaged and cut at one half; without labels, or with
labels of one kind only, every score is the (smoothed) share of label 1, 0.5 if there are none. Repeated
rows get equal scores. An empty table gives an empty one. Extra columns pass through; a column named like
the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm import text as tx
from gaugeline.llm.common import ship

PASSAGE_WORDS = 48
PAIRS = 64
_CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "bang": b"!?", "bar": b"|", "mark": b"#%&*$@^~=+<>\\/_{}[]", "stop": b".,;:", "quote": b"'\"()-", "wide": range(128, 256)}


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for k, members in enumerate(_CLASSES.values()):
        table[list(members)] = k
    return table


CLASS_OF = _class_table()
SIZE = len(_CLASSES) + 9 + PAIRS


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage (rows of SIZE) and, for each document, the index of its first passage and one past its last."""
    starts, ends, first = tx.words(data, at)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    bounds = np.concatenate([[0], np.cumsum(n_pass)])
    out = np.zeros((int(bounds[-1]), SIZE), np.float32)
    if not len(starts):
        return out, bounds
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(starts)) - first[:-1][doc]
    owner = bounds[:-1][doc] + place // PASSAGE_WORDS
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    rows, tails = owner[heads], np.concatenate([heads[1:], [len(starts)]]) - 1
    begin, stop, count = starts[heads], ends[tails], (tails - heads + 1).astype(np.float64)
    size = (stop - begin).astype(np.float64)
    kinds = CLASS_OF[data]
    for k in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        out[rows, k] = (total[stop] - total[begin]) / size
    h = tx.word_hashes(data, starts, ends)
    same = lambda lag: np.concatenate([np.zeros(min(lag, len(h)), bool), (h[lag:] == h[:-lag]) & (owner[lag:] == owner[:-lag])])
    length = (ends - starts).astype(np.float64)
    one, last = kinds[starts], kinds[ends - 1]
    second = kinds[np.minimum(starts + 1, len(kinds) - 1)]
    per_word = (same(1), same(2), (one == 1) & ((length == 1) | (second != 1)), (one == 1) & (second == 1) & (length > 1), last == 6, last == 5, length > 18)
    base = len(_CLASSES)
    for k, flag in enumerate(per_word):
        out[rows, base + k] = np.add.reduceat(flag.astype(np.float64), heads) / count
    out[rows, base + 7] = np.add.reduceat(length, heads) / count / 10
    out[rows, base + 8] = np.log1p(count) / 4
    pair = ((data[:-1].astype(np.int32) * 31 + data[1:] * 17) ^ (data[1:] >> 3)) % PAIRS
    inner = np.repeat(np.arange(len(rows)), np.maximum(stop - begin - 1, 0))
    where = np.arange(len(inner)) - np.repeat(np.cumsum(np.maximum(stop - begin - 1, 0)) - np.maximum(stop - begin - 1, 0), np.maximum(stop - begin - 1, 0)) + np.repeat(begin, np.maximum(stop - begin - 1, 0))
    hist = np.bincount(inner * PAIRS + pair[where], minlength=len(rows) * PAIRS).reshape(len(rows), PAIRS)
    out[rows, base + 9 :] = np.sqrt(hist / np.maximum(hist.sum(1, keepdims=True), 1))
    return out, bounds


class Attention:
    """Encoder, gated attention and output of one layer each; forward and gradient in numpy."""

    def __init__(self, width: int = 16, gate: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"E": draw(SIZE, width), "e": np.zeros(width, np.float32), "V": draw(width, gate), "U": draw(width, gate), "a": draw(gate, 1)[:, 0], "c": draw(width, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.mean, self.scale, self.constant = np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32), None

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        w, heads = self.w, bounds[:-1]
        x = np.clip((x - self.mean) * self.scale, -6, 6)
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        g = (t * s) @ w["a"]
        owner = np.repeat(np.arange(len(heads)), np.diff(bounds))
        p = np.exp(g - np.maximum.reduceat(g, heads)[owner])
        p /= np.add.reduceat(p, heads)[owner]
        z = np.add.reduceat(p[:, None] * h, heads, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "p": p, "z": z, "owner": owner, "score": 1 / (1 + np.exp(-(z @ w["c"] + w["b"])))}

    def gradient(self, f: dict, y: np.ndarray) -> dict:
        w, h, p, owner = self.w, f["h"], f["p"], f["owner"]
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * w["c"]
        inner = (dz[owner] * h).sum(1)
        mean = np.zeros(len(y), np.float32)
        np.add.at(mean, owner, p * inner)
        dg = p * (inner - mean[owner])
        dt, ds = dg[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2), dg[:, None] * w["a"] * f["t"] * f["s"] * (1 - f["s"])
        dh = p[:, None] * dz[owner] + dt @ w["V"].T + ds @ w["U"].T
        de = dh * (1 - h**2)
        return {"E": f["x"].T @ de, "e": de.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (f["t"] * f["s"]).T @ dg, "c": f["z"].T @ d, "b": np.array([d.sum()], np.float32)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Attention:
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        flat = np.concatenate(bags)
        self.mean, self.scale = flat.mean(0), (1 / np.maximum(flat.std(0), 1e-3)).astype(np.float32)
        del flat
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                pick, step = order[i : i + batch], step + 1
                bounds = np.concatenate([[0], np.cumsum([len(bags[k]) for k in pick])])
                grads = self.gradient(self.forward(np.concatenate([bags[k] for k in pick]), bounds), y[pick].astype(np.float32))
                now = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
                for k, g in grads.items():
                    g = g + decay * self.w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        return np.clip(self.forward(x, bounds)["score"].astype(np.float64), 0.0, 1.0)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", max_fit_docs: int = 6000) -> Attention:
    """Learn from the labelled rows outside the held-out fold, at most max_fit_docs of them, chosen by hash."""
    ship(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("k"), F.col(label).alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("k")))
    marks = marks.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_fit_docs)
    # at most max_fit_docs rows
    rows = docs.select(F.col(id_col).alias("k"), F.col(text).alias("t")).join(F.broadcast(marks), "k").select("k", "t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "t"):
                x, bounds = passages(*tx.utf8(part.column("t")))
                bags = [x[a:b] for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), pa.array([b.astype(np.float32).tobytes() for b in bags], pa.binary())], names=["k", "y", "x"])

    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    got = sorted(((r.k, r.y, bytes(r.x)) for r in rows.mapInArrow(run, schema).collect()))[:max_fit_docs]
    return Attention().fit([np.frombuffer(x, np.float32).reshape(-1, SIZE) for _, _, x in got], np.array([y for _, y, _ in got], np.float32))


def score(docs: DataFrame, model: Attention, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each text."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != out), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text):
                got = known.value.scores(*passages(*tx.utf8(part.column(text))))
                kept = [c for c in part.schema.names if c != out]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(got)], names=[*kept, out])

    return docs.mapInArrow(run, schema)
