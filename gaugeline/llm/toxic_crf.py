"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give spans and document scores.

Two states, clean and toxic, one per word. A word's features are its letters' first 3 to 7 bytes and the
whole word (lower case, without punctuation at its ends), hashed into a table of weights; neighbours meet
in the transition weights. Forward-backward gives each word's marginal probability of being toxic.

Documents carry labels, words do not. Words are labelled from them: a feature that occurs, or occurs more than once, in far more
toxic documents than chance allows (binomial tail, corrected for the features that are as frequent) and in few clean
ones marks a word of a toxic document as toxic; every other word is clean, the same word in a clean document too. The field is fitted to
those labelled words by gradient descent on the exact likelihood. The document score is a logistic
function of the strongest and second strongest marginal, of the expected number of toxic words and of the number of words, fitted
on the same documents. Language, source and id are never inputs.

The model is fitted on a bounded sample: of the labelled rows outside the held-out fold, in the order of a hash
of the id, at most `max_fit_docs` and only as many as keep within `max_fit_words` words in all. Equal texts count once in
choosing features. Scoring reads every word of every document.

Defined results: a null or blank text has no words and the score of a text without any sign of toxicity; labels that
are null or not 0/1 are ignored, repeated labels of an id are averaged and cut at one half; without labels, or with labels of
one kind only, every score is the (smoothed) share of label 1, 0.5 if there are none, and there are no spans. Repeated rows get equal
scores. An empty table gives an empty one. Extra columns pass through; columns named like the outputs are replaced.
Texts are worked on in slices of about 2 MB, a longer one alone, in time proportional to their length.
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
from gaugeline.operators.staging import stage

U64 = tx.U64
PREFIXES = (3, 4, 5, 6, 7)
FEATURES = len(PREFIXES) + 1
TABLE_BITS = 18
ROW = 64
RATIO = 5
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("stop", T.IntegerType(), False)]), False)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word, FEATURES places in the table of weights (-1: none), and where its letters begin and end."""
    n = len(starts)
    if not n:
        return np.zeros((0, FEATURES), np.int32), starts, ends
    # the first and last letter of each word; a word without any keeps its borders
    place = np.arange(len(data), dtype=np.int64)
    after = np.minimum.accumulate(np.where(_LETTER[data], place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(_LETTER[data], place, -1))
    begin, end = after[starts], before[ends - 1] + 1
    none = begin >= ends
    begin, end = np.where(none, starts, begin), np.where(none, ends, end)
    lower = tx.LOWER[data]
    size = end - begin
    padded = np.concatenate([lower, np.zeros(8, np.uint8)])
    lane = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(lower) + 1,), strides=(1,))[begin]
    out = np.full((n, FEATURES), -1, np.int32)
    slot = lambda h: (h >> U64(64 - TABLE_BITS)).astype(np.int32)
    for k, width in enumerate(PREFIXES):
        have = size >= width
        out[have, k] = slot(tx.mix((lane[have] & U64((1 << 8 * width) - 1)) * U64(0x9E3779B97F4A7C15) + U64(width)))
    out[:, -1] = slot(tx.mix(tx.word_hashes(lower, begin, end) + U64(99)))
    return out, begin, end


def marginals(gain: np.ndarray, begins: np.ndarray, begin: np.ndarray, step: np.ndarray, pairs: bool = False):
    """Probability of state 1 for each word of chains laid end to end, from forward-backward.

    gain is each word's log weight of state 1 over state 0; begins marks the first word of each chain; begin (2) and
    step (2 x 2) are log weights. With `pairs`, also the expected number of each step (2 x 2).
    The words are cut into rows of ROW words; a row's matrix carries the messages past it, so the loops
    are over the ROW columns and over the rows, not over words. Messages are scaled every few columns.
    """
    n = len(gain)
    rows = -(-n // ROW)
    lift = np.ones(rows * ROW)
    lift[:n] = np.exp(gain)
    lift = np.ascontiguousarray(lift.reshape(rows, ROW).T)
    heads = np.zeros(rows * ROW, bool)
    heads[:n] = begins
    # words past the end are chains of their own
    heads[n:] = True
    heads = [np.flatnonzero(h) for h in heads.reshape(rows, ROW).T]
    (b0, b1), ((m00, m01), (m10, m11)) = np.exp(begin - begin.max()), np.exp(step - step.max())

    def onward(x: np.ndarray, y: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The weights (x, y) of the two states after word c; at the start of a chain only their sum matters."""
        u, v = x * m00 + y * m10, x * m01 + y * m11
        h = heads[c]
        if len(h):
            both = x[h] + y[h]
            u[h], v[h] = both * b0, both * b1
        v *= lift[c]
        return u, v

    def scaled(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
        total = sum(arrays)
        return tuple(x / total for x in arrays)

    one, none = np.ones(rows), np.zeros(rows)
    p, q, r, s = one, none, none, one
    for c in range(ROW):
        (p, q), (r, s) = onward(p, q, c), onward(r, s, c)
        if c % 8 == 7:
            p, q, r, s = scaled(p, q, r, s)
    left, right = np.empty((2, rows)), np.empty((2, rows))
    through = np.stack([p, q, r, s], 1).tolist()
    x, y = 0.5, 0.5
    for k, (p, q, r, s) in enumerate(through):
        left[:, k] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(rows - 1, -1, -1):
        right[:, k] = x, y
        p, q, r, s = through[k]
        x, y = p * x + q * y, r * x + s * y
        x, y = x / (x + y), y / (x + y)
    ahead = np.empty((ROW + 1, 2, rows))
    ahead[0] = left
    for c in range(ROW):
        ahead[c + 1] = onward(*ahead[c], c)
        if c % 8 == 7:
            ahead[c + 1] = scaled(*ahead[c + 1])
    out, steps = np.empty((ROW, rows)), np.zeros((2, 2))
    x, y = right
    for c in range(ROW - 1, -1, -1):
        f0, f1 = ahead[c + 1]
        f1 = f1 * y
        out[c] = f1 / (f0 * x + f1)
        h = heads[c]
        y = y * lift[c]
        if pairs:
            old0, old1 = ahead[c]
            inner = np.ones(rows, bool)
            inner[h] = False
            joint = np.stack([old0 * m00 * x, old0 * m01 * y, old1 * m10 * x, old1 * m11 * y])[:, inner]
            steps += (joint / joint.sum(0)).sum(1).reshape(2, 2)
        u, v = m00 * x + m01 * y, m10 * x + m11 * y
        if len(h):
            u[h] = v[h] = b0 * x[h] + b1 * y[h]
        x, y = scaled(u, v) if c % 8 == 0 else (u, v)
    probability = out.T.reshape(-1)[:n]
    return (probability, steps) if pairs else probability


class Field:
    """Weights of the chain and of the document score."""

    def __init__(self) -> None:
        self.w = np.zeros(1 << TABLE_BITS, np.float32)
        self.bias, self.begin, self.step = 0.0, np.zeros(2), np.zeros((2, 2))
        self.out, self.mean, self.scale = np.zeros(5), np.zeros(4), np.ones(4)
        self.constant: float | None = 0.5

    def gains(self, f: np.ndarray) -> np.ndarray:
        return np.clip(np.where(f >= 0, self.w[f], 0).sum(1, dtype=np.float64) + self.bias, -30, 30)

    def words(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marginal of each word; document d has the words first[d] to first[d + 1]."""
        if self.constant is not None or not len(f):
            return np.zeros(len(f))
        begins = np.zeros(len(f), bool)
        begins[first[:-1][np.diff(first) > 0]] = True
        return marginals(self.gains(f), begins, self.begin, self.step)

    @staticmethod
    def signs(p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What a document's score is made of: its strongest and second strongest marginal as log odds, expected toxic words, words."""
        n_words = np.diff(first)
        out = np.zeros((len(n_words), 4))
        floor = 1e-4
        out[:, :2] = np.log(floor / (1 - floor))
        doc = np.repeat(np.arange(len(n_words)), n_words)
        strong = np.flatnonzero(p > floor)
        order = strong[np.lexsort((-p[strong], doc[strong]))]
        owner = doc[order]
        place = np.arange(len(order)) - np.searchsorted(owner, owner)
        odds = np.log(p[order] / np.maximum(1 - p[order], floor))
        for k in (0, 1):
            out[owner[place == k], k] = np.minimum(odds[place == k], -np.log(floor))
        out[:, 2] = np.log1p(np.bincount(owner, weights=p[order], minlength=len(n_words)))
        out[:, 3] = np.log1p(n_words)
        return out

    def scores(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        x = (self.signs(p, first) - self.mean) * self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.out[:4] + self.out[4], -30, 30)))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Field:
        """bags: the features of each document's words; y: the documents' labels."""
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        self.constant = None
        marks = labelled_words(bags, y)
        n_words, n_toxic = sum(map(len, marks)), sum(int(m.sum()) for m in marks)
        self.bias = float(np.log((n_toxic + 1) / (n_words + 1)))
        rng, t = np.random.default_rng(seed), 0
        rest = {"b": np.zeros(1), "begin": np.zeros(2), "step": np.zeros((2, 2))}
        m1, m2 = ({k: np.zeros_like(v) for k, v in rest.items()} for _ in range(2))
        power = np.full(1 << TABLE_BITS, 1e-8, np.float32)
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                pick = [k for k in order[i : i + batch] if len(bags[k])]
                if not pick:
                    continue
                f, mark = np.concatenate([bags[k] for k in pick]), np.concatenate([marks[k] for k in pick])
                begins = np.zeros(len(f), bool)
                begins[np.cumsum([0, *(len(bags[k]) for k in pick[:-1])])] = True
                p, expected = marginals(self.gains(f), begins, self.begin, self.step, pairs=True)
                wrong = p - mark
                # weights of features: adaptive steps on what this batch has seen
                live = f >= 0
                slots, where = np.unique(f[live], return_inverse=True)
                g = np.bincount(where, weights=np.broadcast_to(wrong[:, None], f.shape)[live]).astype(np.float32) + decay * len(pick) * self.w[slots]
                power[slots] += g * g
                now = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
                self.w[slots] -= 5 * now * g / np.sqrt(power[slots])
                # transitions: expected less observed
                old, new = mark[:-1][~begins[1:]].astype(int), mark[1:][~begins[1:]].astype(int)
                seen = np.bincount(old * 2 + new, minlength=4).reshape(2, 2)
                g_begin = np.array([(1 - p[begins]).sum() - (1 - mark[begins]).sum(), wrong[begins].sum()])
                grads = {"b": np.array([wrong.sum()]), "begin": g_begin, "step": expected - seen}
                t += 1
                move = {}
                for k, g in grads.items():
                    g = g / len(pick) + decay * rest[k]
                    m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                    move[k] = now * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
                    rest[k] = rest[k] - move[k]
                self.bias -= float(move["b"][0])
                self.begin, self.step = rest["begin"], rest["step"]
        self._fit_score(bags, y)
        return self

    def _fit_score(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        """Logistic regression by Newton steps; a ridge keeps separable documents finite."""
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        x = self.signs(self.words(np.concatenate(bags), first), first)
        self.mean, self.scale = x.mean(0), 1 / np.maximum(x.std(0), 1e-3)
        x = np.column_stack([(x - self.mean) * self.scale, np.ones(len(y))])
        w, ridge = np.zeros(5), np.diag([0.1] * 4 + [1e-3])
        for _ in range(30):
            s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + ridge, x.T @ (s - y) + ridge @ w)
        self.out = w


def labelled_words(bags: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """For each document, which of its words are taken for toxic, from the documents' labels alone."""
    seen: dict[bytes, int] = {}
    once = [k for k, b in enumerate(bags) if seen.setdefault(b.tobytes(), k) == k]
    share = sum(int(y[k]) for k in once) / len(once)
    telling = np.zeros(1 << TABLE_BITS, bool)
    # documents that have a feature at all, and those that have it more than once
    for least in (1, 2):
        hits, clean = np.zeros(len(telling)), np.zeros(len(telling))
        for k in once:
            slots, count = np.unique(bags[k][bags[k] >= 0], return_counts=True)
            (hits if y[k] else clean)[slots[count >= least]] += 1
        n = (hits + clean).astype(np.int64)
        signs = np.flatnonzero((hits >= 3) & (hits > RATIO * share / max(1 - share, 1e-9) * clean))
        if len(signs):
            # of all the features that occur in as many documents, less than one may look so by chance
            alike = np.bincount(n)[n[signs]]
            telling[signs] |= _log_tail(hits[signs], n[signs], share) + np.log(alike) < 0
    return [((telling[b] & (b >= 0)).any(1) if y[k] else np.zeros(len(b), bool)).astype(np.int8) for k, b in enumerate(bags)]


def _log_tail(a: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """An upper bound of log P(X >= a) for n draws at the given rate (Chernoff)."""
    q = np.clip(a / n, 1e-9, 1 - 1e-9)
    bound = -n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / max(1 - share, 1e-9)))
    return np.where(a / n > share, bound, 0.0)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", max_fit_docs: int = 4000, max_fit_words: int = 1_500_000) -> Field:
    """Learn from the labelled rows outside the held-out fold, within the two bounds, chosen by hash."""
    ship(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("k"), F.col(label).alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("k")))
    marks = marks.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_fit_docs)
    # at most max_fit_docs rows
    rows = docs.select(F.col(id_col).alias("k"), F.col(text).alias("t")).join(F.broadcast(marks), "k").select("k", "t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "t"):
                data, at = tx.utf8(part.column("t"))
                starts, ends, first = tx.words(data, at)
                f, _, _ = features(data, starts, ends)
                blobs = pa.array([f[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), pa.array(np.diff(first)), blobs], names=["k", "y", "n", "x"])

    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("y", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("x", T.BinaryType())])
    found = stage(rows.mapInArrow(run, schema), "labelled-words")
    # a length and a hash per row decide which rows come to the driver
    lengths = found.select("k", "n", F.xxhash64("x").alias("h")).distinct().orderBy(F.xxhash64("k"), "k", "h").limit(max_fit_docs)
    chosen, used = [], 0
    for r in lengths.collect():
        if used + r.n <= max_fit_words:
            used += r.n
            chosen.append((r.k, r.h))
    key = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("h", T.LongType())])
    picked = docs.sparkSession.createDataFrame(chosen, key)
    got = found.withColumn("h", F.xxhash64("x")).join(F.broadcast(picked), ["k", "h"]).dropDuplicates(["k", "h"]).select("k", "h", "y", "x").collect()
    got = sorted(got, key=lambda r: (r.k, r.h))
    bags = [np.frombuffer(bytes(r.x), np.int32).reshape(-1, FEATURES) for r in got]
    return Field().fit(bags, np.array([r.y for r in got], np.int64))


def tag(docs: DataFrame, model: Field, text: str = "text", score: str = "score", spans: str = "toxic_spans", least: float = 0.5) -> DataFrame:
    """docs with the score (0 to 1) and the spans (code points, end exclusive) of neighbouring words whose marginal is `least` or more."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in (score, spans)]
    schema = T.StructType([*kept, T.StructField(score, T.DoubleType()), T.StructField(spans, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text):
                data, at = tx.utf8(part.column(text))
                starts, ends, first = tx.words(data, at)
                f, begin, end = features(data, starts, ends)
                p = known.value.words(f, first)
                got = known.value.scores(p, first)
                hot = p >= least
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                joint = hot[1:] & hot[:-1] & (doc[1:] == doc[:-1])
                opens = hot & ~np.append(False, joint)[: len(hot)]
                closes = hot & ~np.append(joint, False)[: len(hot)]
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[at[:-1]][doc[opens]]
                fields = [pa.array((points[x] - base).astype(np.int32)) for x in (begin[opens], end[closes])]
                offsets = pa.array(np.searchsorted(doc[opens], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "stop"]))
                yield pa.RecordBatch.from_arrays([*(part.column(c.name) for c in kept), pa.array(got), lists], names=[*(c.name for c in kept), score, spans])

    return docs.mapInArrow(run, schema)
