"""Substring dedup by prefix-partitioned suffix trees.

Removes each word that lies in a window of `window` words whose word sequence also starts anywhere
else, in this document or another: a word below an internal node of depth `window` or more of the suffix
tree of all documents. The tree is never built whole; it is cut into subtrees by prefixes of variable length.

1. Prefixes: a suffix that starts a window is filed under the window's anchor, its smallest `PREFIX`-word gram, so that
   neighbouring suffixes share a prefix and travel as one row. Equal windows have equal anchors at equal places. Prefixes that
   more than `group` suffixes have are drawn out by the first 16, then 24 words of the suffix, then by the whole window, until
   groups fit in memory; one job more counts all three lengths. Prefixes that occur once end no deep node and are dropped. Both
   sets, repeated and too frequent, are Bloom filters of bounded size; a false positive gives a longer prefix or a row too
   many, alike for all suffixes of that prefix, never another result.
2. Subtrees: the rows of a prefix hold the words of their suffixes. Within a group, suffixes are ordered by prefix doubling (the
   ranks of k words at two places give the rank of 2k words), and neighbours in that order whose first `window` words have
   one rank hang under one node of that depth: a deep internal node if it has two leaves or more. A slice of documents finds its
   own repeats first and sends one leaf for each distinct window, so a passage in a third of all documents is one row per slice.
3. Maximal repeats: the leaves of deep nodes that follow each other in a document are one repeat, from its first word to its
   last, across the borders of groups; `maximal_repeats` gives them with their true length, and `removed` cuts them out.

Words, grams and prefixes are known by 64 bits of hash and documents by 128 bits; windows are compared word by word in a
subtree, and by 64 bits within a slice. A document is named by the hash of its word sequence, so repeated rows and texts that differ only
in white space share their ranges. Defined results: null, empty and blank texts have no words and keep
none; documents shorter than the window lose nothing; very long texts are a slice of their own, whose rows leave in
pieces; ties do not arise; an empty table gives an empty one; extra columns are ignored by `removed` unless asked for. A
window shorter than PREFIX words is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm import text as tx
from gaugeline.llm.bloom import Bloom, build
from gaugeline.llm.common import ship
from gaugeline.operators.staging import stage

WINDOW = 35
PREFIX = 8
LONGER = (16, 24)
GROUP = 50_000
PIECE_ROWS = 20_000
U64 = np.uint64


def _running(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) of each n values in a row, in about log2(n) passes."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


class Words:
    """The words of a slice of documents."""

    def __init__(self, part: pa.RecordBatch, text: str):
        data, at = tx.utf8(part.column(text))
        starts, ends, self.first = tx.words(data, at)
        self.h = tx.word_hashes(data, starts, ends)
        self.n_words = np.diff(self.first)

    def digests(self) -> np.ndarray:
        """Two 64-bit hashes of each document's word sequence."""
        out = np.zeros((len(self.n_words), 2), U64)
        for k in range(len(out)):
            raw = hashlib.blake2b(self.h[self.first[k] : self.first[k + 1]].tobytes(), digest_size=16).digest()
            out[k] = np.frombuffer(raw, U64)
        return out

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """tx.windows(self.h, n)[at] for ascending places, from the stretches around them if those are less than all words."""
        heads, size = runs(np.zeros(len(at), np.int64), at)
        length = size + n - 1
        if int(length.sum()) >= len(self.h):
            return tx.windows(self.h, n)[at]
        return tx.windows(self.h[_spread(at[heads], length)], n)[_spread(np.cumsum(length) - length, size)]


class Slice(Words):
    """Its windows and anchors too."""

    def __init__(self, part: pa.RecordBatch, text: str, window: int):
        super().__init__(part, text)
        self.start, self.doc = tx.inside(self.first, window)
        self.spread = window - PREFIX + 1
        self.window = window
        if not len(self.start):
            self.least = np.zeros(0, U64)
            return
        self.grams = tx.ngrams(self.h, PREFIX)
        # windows over a document's end never count: only those in self.start are used
        self.all_least = _running(self.grams, self.spread, np.minimum)
        self.least = self.all_least[self.start]

    def anchors(self) -> np.ndarray:
        """Hashes of the anchor grams, once for each place."""
        if not len(self.start):
            return np.zeros(0, U64)
        # a gram is an anchor if a real window over it has it as its least: then it is the largest of their leasts
        valid = np.zeros(len(self.all_least), U64)
        valid[self.start] = self.least
        padded = np.concatenate([np.zeros(self.spread - 1, U64), valid, np.zeros(self.spread - 1, U64)])
        return self.grams[_running(padded, self.spread, np.maximum)[: len(self.grams)] == self.grams]


def runs(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted (group, at): first index of each run of consecutive places, and its length."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(group) != 0)) + 1
    heads = np.concatenate([[0], cut])
    return heads, np.diff(np.concatenate([heads, [len(at)]]))


def held(bloom: Bloom, key: np.ndarray) -> np.ndarray:
    """bloom.has, asked once for each run of equal keys."""
    if not len(key):
        return np.zeros(0, bool)
    heads = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return np.repeat(bloom.has(key[heads]), np.diff(np.concatenate([heads, [len(key)]])))


class Prefixes:
    """How many words of a suffix its prefix takes: more for each filter of too frequent prefixes that it meets."""

    def __init__(self, window: int, longer: tuple[int, ...] = LONGER):
        self.window = window
        self.lengths = [*(n for n in longer if PREFIX < n < window), window]
        self.frequent: list[Bloom] = []

    @property
    def whole(self) -> bool:
        """The longest prefixes counted so far are whole windows."""
        return len(self.frequent) == len(self.lengths)

    def keys(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The prefix of each window of the slice, and which of them have the longest kind."""
        key, open_ = s.least.copy(), np.arange(len(s.start))
        for bloom, n in zip(self.frequent, self.lengths):
            open_ = open_[held(bloom, key[open_])]
            if not len(open_):
                break
            key[open_] = tx.mix(key[open_] ^ s.hashes(s.start[open_], n))
        return key, open_

    def longer(self, s: Slice) -> Iterator[np.ndarray]:
        """The prefixes of each longer kind, of all windows whose anchors are too frequent."""
        open_ = np.flatnonzero(held(self.frequent[0], s.least))
        key = s.least[open_]
        for n in self.lengths:
            key = tx.mix(key ^ s.hashes(s.start[open_], n))
            yield key


def prefix_counts(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(prefix, n): the anchors that two suffixes or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text):
                names, n = np.unique(Slice(part, text, window).anchors(), return_counts=True)
                yield pa.RecordBatch.from_arrays([tx.signed(names), pa.array(n.astype(np.int64))], names=["prefix", "n"])

    counts = docs.select(text).mapInArrow(run, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    return stage(counts.filter("n > 1"), "prefixes")


def longer_counts(docs: DataFrame, text: str, prefixes: Prefixes) -> DataFrame:
    """(kind, prefix, n): the prefixes of all longer kinds (from 1) that two suffixes or more under too frequent anchors have.

    One pass for all kinds: passes over the text cost more than counting kinds that turn out not to be needed.
    """
    known = docs.sparkSession.sparkContext.broadcast(prefixes)  # a filter of at most 32 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = known.value
        for batch in batches:
            for part in tx.slices(batch, text):
                for k, found in enumerate(kinds.longer(Slice(part, text, kinds.window)), 1):
                    names, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), tx.signed(names), pa.array(n.astype(np.int64))], names=["kind", "prefix", "n"])

    counts = docs.select(text).mapInArrow(run, "kind int, prefix bigint, n bigint").groupBy("kind", "prefix").agg(F.sum("n").alias("n"))
    return stage(counts.filter("n > 1"), "longer-prefixes")


LEAVES = "key bigint, d1 bigint, d2 bigint, place int, size int, words binary, told boolean"
FOUND = "d1 bigint, d2 bigint, place int, size int"


def _rows(key, digest, place, size, words, told) -> pa.RecordBatch:
    whole = lambda x: tx.signed(np.ascontiguousarray(x))
    columns = [whole(key), whole(digest[:, 0]), whole(digest[:, 1]), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), words, pa.array(told)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in LEAVES.split(", ")])


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for size[0] values, then the same for the others."""
    return np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _blobs(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """The values as one binary for each row of so many values."""
    ends = np.concatenate([[0], np.cumsum(size) * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def suffix_groups(docs: DataFrame, text: str, prefixes: Prefixes, repeated: Bloom) -> DataFrame:
    """Rows of LEAVES: the suffixes at `size` places of a document from word `place` on, under the prefix `key`.

    `words` are the hashes of the words of all their windows, or empty where the prefix spells the whole window. Rows with null
    words are repeats that a slice found by itself.
    """
    known = docs.sparkSession.sparkContext.broadcast((repeated, prefixes))
    window = prefixes.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, kinds = known.value
        for batch in batches:
            for part in tx.slices(batch, text):
                s = Slice(part, text, window)
                if not len(s.start):
                    continue
                key, longest = kinds.keys(s)
                lone = np.zeros(len(key), bool)
                lone[longest] = kinds.whole
                passes = held(bloom, key)
                start, doc, key, lone = s.start[passes], s.doc[passes], key[passes], lone[passes]
                if not len(start):
                    continue
                digest = s.digests()
                # repeats within the slice: all their places are known, one of them goes on
                _, first, back, count = np.unique(s.hashes(start, window), return_index=True, return_inverse=True, return_counts=True)
                place = start - s.first[doc]
                own = count[back] > 1
                heads, size = runs(doc[own], place[own])
                yield _rows(digest[doc[own][heads], 0], digest[doc[own][heads]], place[own][heads], size, pa.nulls(len(heads), pa.binary()), np.ones(len(heads), bool))
                sent = np.zeros(len(start), bool)
                sent[first] = True
                start, doc, place, key, lone = start[sent], doc[sent], place[sent], key[sent], lone[sent]
                # suffixes in a row under one prefix travel together
                group = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (key[1:] != key[:-1]) | lone[1:] | lone[:-1]]))
                heads, size = runs(group, place)
                for i in range(0, len(heads), PIECE_ROWS):
                    at, n = heads[i : i + PIECE_ROWS], size[i : i + PIECE_ROWS]
                    length = np.where(lone[at], 0, n + window - 1)
                    words = _blobs(s.h[_spread(start[at], length)], length)
                    yield _rows(key[at], digest[doc[at]], place[at], n, words, np.zeros(len(at), bool))

    return docs.select(text).mapInArrow(run, LEAVES)


def suffix_order(words: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of rows of size+window-1 words that start a window, ordered by their first `window` words.

    Gives the order, and for each place in it whether the suffix shares those words with the one before it.
    """
    length = size + window - 1
    stop = np.repeat(np.cumsum(length), length)
    here = np.arange(len(words))
    rank = np.unique(words, return_inverse=True)[1]
    k = 1
    while 2 * k <= window:
        after = np.where(here + k < stop, rank[np.minimum(here + k, len(words) - 1)] + 1, 0)
        rank = np.unique(rank * (len(words) + 1) + after, return_inverse=True)[1]
        k *= 2
    start = _spread(np.cumsum(length) - length, size)
    # two runs of k words cover the window
    rank = rank[start] * len(words) + rank[start + window - k]
    order = np.argsort(rank, kind="stable")
    return order, np.concatenate([[False], np.diff(rank[order]) == 0])[: len(order)]


class Leaves:
    """The suffixes of a table's rows: which hang under a deep node, and which come first in their node."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table
        size = self.column("size").astype(np.int64)
        blobs = table.column("words").to_pylist()
        self.words = np.frombuffer(b"".join(blobs), U64)
        self.length = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
        self.row = np.repeat(np.arange(len(size)), size)
        self.place = _spread(self.column("place").astype(np.int64), size)
        self.offset = _spread(np.cumsum(self.length) - self.length, size)
        self.spelled = self.length[self.row] == 0
        self.deep, self.first = np.zeros(len(self.row), bool), np.zeros(len(self.row), bool)
        by_words = np.flatnonzero(~self.spelled)
        if len(by_words):
            order, same = suffix_order(self.words, size[self.length > 0], window)
            self._mark(by_words[order], same)
        # prefixes that spell the whole window are the nodes themselves; the rows are in their order
        by_prefix = np.flatnonzero(self.spelled)
        if len(by_prefix):
            key = self.column("key")[self.row[by_prefix]]
            self._mark(by_prefix, np.concatenate([[False], key[1:] == key[:-1]]))

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def _mark(self, leaf: np.ndarray, same: np.ndarray) -> None:
        self.deep[leaf] = same | np.concatenate([same[1:], [False]])
        self.first[leaf] = ~same


def subtree(table: pa.Table, window: int) -> pa.RecordBatch:
    """Rows of FOUND: the runs of places whose suffixes hang under a deep internal node."""
    leaves = Leaves(table, window)
    new = leaves.deep & ~leaves.column("told")[leaves.row]
    row, place = leaves.row[new], leaves.place[new]
    heads, n = runs(row, place)
    d1, d2 = (pa.array(leaves.column(c)[row[heads]]) for c in ("d1", "d2"))
    return pa.RecordBatch.from_arrays([d1, d2, pa.array(place[heads].astype(np.int32)), pa.array(n.astype(np.int32))], names=["d1", "d2", "place", "size"])


def one_leaf_each(table: pa.Table, window: int) -> pa.Table:
    """The table with one row for each distinct window, told if its place has been given out."""
    leaves = Leaves(table, window)
    at = np.flatnonzero(leaves.first)
    row, length = leaves.row[at], np.where(leaves.spelled[at], 0, window)
    words = _blobs(leaves.words[_spread(leaves.offset[at], length)], length)
    digest = np.stack([leaves.column(c)[row] for c in ("d1", "d2")], axis=1)
    told = leaves.column("told")[row] | leaves.deep[at]
    return pa.Table.from_batches([_rows(leaves.column("key")[row], digest, leaves.place[at], np.ones(len(at), np.int64), words, told)])


def deep_nodes(window: int, group: int):
    """Rows of LEAVES sorted by prefix to rows of FOUND.

    A group is ordered when the next prefix comes. One that grows beyond `group` rows (only whole windows do, of which one
    slice sends one leaf) gives out what it has and goes on with one leaf for each distinct window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, limit = None, group
        for batch in batches:
            if batch.column("words").null_count:
                yield batch.filter(batch.column("words").is_null()).select(["d1", "d2", "place", "size"])
                batch = batch.filter(batch.column("words").is_valid())
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            key = table.column("key").to_numpy()
            others = np.flatnonzero(key != key[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield subtree(table.slice(0, cut), window)
                limit = group
            carry = table.slice(cut)
            if carry.num_rows > limit:
                yield subtree(carry, window)
                carry = one_leaf_each(carry, window)
                limit = max(group, 2 * carry.num_rows)
        if carry is not None:
            yield subtree(carry, window)

    return run


def repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(d1, d2, ranges): for each word sequence that has any, the runs of its repeated windows (first window, count)."""
    if window < PREFIX:
        raise ValueError(f"window must have {PREFIX} words or more")
    spark = docs.sparkSession
    ship(spark)
    prefixes = Prefixes(window)
    known = prefix_counts(docs, text, window)
    frequent = known.filter(F.col("n") > group)
    if n := frequent.count():
        prefixes.frequent.append(build(frequent, "prefix", n))
        longer = longer_counts(docs, text, prefixes)
        known = known.unionByName(longer.select("prefix", "n"))
        many = longer.filter(F.col("n") > group)
        sizes = {r.kind: r["count"] for r in many.groupBy("kind").count().collect()}  # one row for each kind
        while not prefixes.whole and (n := sizes.get(len(prefixes.frequent))):
            prefixes.frequent.append(build(many.filter(F.col("kind") == len(prefixes.frequent)), "prefix", n))
    rows = suffix_groups(docs, text, prefixes, build(known, "prefix", known.count()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(deep_nodes(window, group), FOUND)
    lists = found.distinct().groupBy("d1", "d2").agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("ranges"))
    return stage(lists, "repeats")


def stretches(ranges: list, window: int) -> list[tuple[int, int]]:
    """Sorted (first window, count) to the maximal runs of repeated windows, as (first word, words)."""
    out: list[list[int]] = []
    for place, size in ranges:
        if out and place <= out[-1][1]:
            out[-1][1] = max(out[-1][1], place + size)
        else:
            out.append([place, place + size])
    return [(a, b - a + window - 1) for a, b in out]


def maximal_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(id, start, n_words): every longest stretch of a document's words all of whose windows occur elsewhere, one row each."""
    found = repeats(docs, text, window, group)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                digest = Words(part, "_text").digests()
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(tx.signed(np.ascontiguousarray(digest[:, k])) for k in (0, 1))], names=["_id", "d1", "d2"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [stretches([(x["place"], x["size"]) for x in r], window) for r in batch.column("ranges").to_pylist()]
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            start, n = (pa.array([x[k] for one in lists for x in one], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(row, pa.int64())), start, n], names=[id, "start", "n_words"])

    kind = docs.schema[id].dataType
    source = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    named = source.mapInArrow(name, T.StructType([T.StructField("_id", kind), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]))
    out = T.StructType([T.StructField(id, kind), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())])
    return named.join(found, ["d1", "d2"]).select("_id", "ranges").mapInArrow(spell, out)


def removed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, group: int = GROUP, with_text: bool = True) -> DataFrame:
    """The columns `keep`, then n_words, n_removed, kept_sha256 and (with_text) the kept words joined by one space."""
    spark = docs.sparkSession
    found = repeats(docs, text, window, group)
    known = spark.sparkContext.broadcast(build(found, "d1", found.count()))
    kept_fields = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in kept_fields]
    result = ("n_words", "n_removed", "kept_sha256", "kept_text")

    def cut(words: list[bytes], ranges: list | None) -> tuple[int, int, str, str | None]:
        n = len(words)
        if ranges:
            gone = np.zeros(n, bool)
            for start, size in stretches(ranges, window):
                gone[start : start + size] = True
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        kept = b" ".join(words)
        return n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None

    results = lambda rows: [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without repeats are done at once; the text of the others goes on to meet its ranges."""
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                s = Words(part, "_text")
                digest = s.digests()
                maybe = known.value.has(np.ascontiguousarray(digest[:, 0])) & (s.n_words >= window)
                rows = [(None,) * 4 if m else cut((t or "").encode().split(), None) for t, m in zip(part.column("_text").to_pylist(), maybe.tolist())]
                texts = pa.array([t if m else None for t, m in zip(part.column("_text").to_pylist(), maybe.tolist())], pa.string())
                ids = [tx.signed(np.ascontiguousarray(digest[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(f"_{c}") for c in names), *ids, *results(rows), texts], names=[*(f"_{c}" for c in names), "d1", "d2", *result, "_text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                done = list(zip(*(part.column(c).to_pylist() for c in result)))
                texts, ranges = part.column("_text").to_pylist(), part.column("ranges").to_pylist()
                rows = [d if t is None else cut(t.encode().split(), [(x["place"], x["size"]) for x in r or ()]) for d, t, r in zip(done, texts, ranges)]
                yield pa.RecordBatch.from_arrays([*(part.column(f"_{c}") for c in names), *results(rows)], names=[*names, *result])

    prefixed = [T.StructField(f"_{f.name}", f.dataType) for f in kept_fields]
    out = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
    ids = [T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]
    source = docs.select(*(F.col(c).alias(f"_{c}") for c in names), F.col(text).alias("_text"))
    routed = source.mapInArrow(route, T.StructType([*prefixed, *ids, *out, T.StructField("_text", T.StringType())]))
    met = routed.join(found, ["d1", "d2"], "left").select(*(f"_{c}" for c in names), *result, "_text", "ranges")
    final = met.mapInArrow(finish, T.StructType([*kept_fields, *out]))
    return final if with_text else final.drop("kept_text")
