"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct shingles of `shingle` words (A-Z lower-cased), known by 64-bit
hashes; with fewer words the whole sequence is one shingle. Documents link when 100 |A and B| >=
`percent` |A or B|.

1. Classes: documents of equal sets are one class, named by a hash of the set. All later steps work on
   classes, so copies cost one row each and are never paired.
2. Screening, exact: two linked sets of sizes n and m have the l smallest of their common shingles, in any
   fixed order, among the first n - ceil(t n) + l of the one and m - ceil(t m) + l of the other. In hash
   order with l = n/8 (for a partner, at least t n/8) nearly all that is left has a partner, for a third
   of the shingles in one shuffle.
3. Rare-first order among the classes left: shingles by their number of classes. A shingle of one class
   cannot join and only shifts positions. Prefixes of n - ceil(t n) + 1 shingles are the postings.
4. Candidates share a posting, and pass the length and positional filters. Each pair is verified once:
   suffix filter first (a bound on the differences from a probe in the middle, twice), then the exact
   intersection of the sorted sets.
5. Components: a block of postings that thousands of near copies share is not paired out. A star round
   verifies each member against a few leaders of its block and merges what links; then only pairs between
   different components can still matter, and those are generated and verified without limit, so the answer
   does not depend on the leaders.

Defined results: null and blank texts have an empty set, are linked with nothing and are their own
component; rows that repeat an id share its smallest label; null ids are labelled by the smallest other id
in their component, or null; an empty table gives an empty one. Extra columns are ignored. Two different sets under
one 64-bit class name are detected (a second hash differs) and stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import text as tx
from gaugeline.llm.bloom import build
from gaugeline.llm.common import ship
from gaugeline.llm.graph import components
from gaugeline.operators.staging import stage

SHINGLE = 5
PERCENT = 75
SCREEN = 8
LEADERS = 16
U64 = np.uint64


def at_least(n, percent: int):
    """ceil(percent n / 100): shingles that a partner of a set of n must share."""
    return (n * percent + 99) // 100


class Sets:
    """The shingle sets of a slice of documents, each a sorted array of distinct hashes."""

    def __init__(self, part: pa.RecordBatch, text: str, shingle: int):
        data, at = tx.utf8(part.column(text))
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, at)
        h = tx.word_hashes(data, starts, ends)
        grams = tx.ngrams(h, shingle)
        self.sets = []
        for a, b in zip(first, first[1:]):
            if b - a >= shingle:
                self.sets.append(np.unique(grams[a : b - shingle + 1]))
            elif b > a:
                self.sets.append(tx.ngrams(h[a:b], int(b - a)))
            else:
                self.sets.append(np.zeros(0, U64))

    def names(self) -> np.ndarray:
        """Two 64-bit hashes of each set; 0 for the empty set."""
        out = np.zeros((len(self.sets), 2), U64)
        for k, s in enumerate(self.sets):
            if len(s):
                out[k] = (tx.mix(tx.mix(s).sum(dtype=U64, keepdims=True) + U64(len(s)))[0], tx.mix(s + U64(0x9E3779B97F4A7C15)).sum(dtype=U64))
        return out


def document_sets(docs: DataFrame, text: str, id_col: str, shingle: int) -> DataFrame:
    """(doc_id, n, c, check): size and names of each document's set; c is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                s = Sets(part, "text", shingle)
                n = np.array([len(x) for x in s.sets], np.int64)
                names = s.names()
                c = pa.array(np.ascontiguousarray(names[:, 0]).view(np.int64), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), c, tx.signed(np.ascontiguousarray(names[:, 1]))], names=["doc_id", "n", "c", "check"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n bigint, c bigint, check bigint")


def screened(docs: DataFrame, text: str, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(c): the classes that share enough of the first shingles, in hash order, with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                s = Sets(part, "text", shingle)
                names = np.ascontiguousarray(s.names()[:, 0])
                _, once = np.unique(names, return_index=True)  # copies in a slice speak once
                sets = [(names[k], s.sets[k]) for k in once if len(s.sets[k])]
                take = [len(x) - at_least(len(x), percent) + max(1, len(x) // SCREEN) for _, x in sets]
                c = np.repeat(np.array([c for c, _ in sets], U64), take)
                h = np.concatenate([x[:k] for (_, x), k in zip(sets, take)]) if sets else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([tx.signed(h), tx.signed(c)], names=["h", "c"])

    firsts = docs.select(F.col(text).alias("text")).mapInArrow(run, "h bigint, c bigint")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle by shingle; a shingle of two classes or more is streamed through, never gathered
    shared = firsts.repartition(parts, "h").sortWithinPartitions("h", "c").mapInArrow(_of_several, "c bigint, n bigint")
    counts = shared.groupBy("c").agg(F.sum("n").alias("shared"))
    # the smallest partner has ceil(t n) shingles, and may have sent fewer of them
    least = F.greatest(F.lit(1), F.floor(at_least_sql(F.col("n"), percent) / SCREEN))
    return counts.join(classes.select("c", "n"), "c").filter(F.col("shared") >= least).select("c")


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (h, c) sorted, how many of its shingles each class shares with another one; a batch counts for itself."""
    last_h = last_c = None  # the last row so far, and whether it has been counted
    counted = False
    for batch in batches:
        h, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "c"))
        if not len(h):
            continue
        carried = last_h is not None
        if carried:
            h, c = np.concatenate([[last_h], h]), np.concatenate([[last_c], c])
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])  # one row for each (h, c)
        old = carried and counted
        h, c = h[new], c[new]
        same = h[1:] == h[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        report = several.copy()
        if old:
            report[0] = False
            several[0] = True
        last_h, last_c, counted = h[-1], c[-1], bool(several[-1])
        names, n = np.unique(c[report], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64))], names=["c", "n"])


def rare_first(docs: DataFrame, text: str, left: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """items (c, n, own, toks): shared shingles rare first, and how many are in no other class; postings (h, c, n, pos)."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(build(left, "c", left.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                s = Sets(part, "text", shingle)
                names = np.ascontiguousarray(s.names()[:, 0])
                _, once = np.unique(names, return_index=True)
                once = [k for k in once[known.value.has(names[once])] if len(s.sets[k])]
                at = np.cumsum([0, *(len(s.sets[k]) for k in once)]).astype(np.int32)
                flat = np.concatenate([s.sets[k] for k in once]) if once else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([tx.signed(names[once]), pa.ListArray.from_arrays(pa.array(at), tx.signed(flat))], names=["c", "hs"])

    sets = docs.select(F.col(text).alias("text")).mapInArrow(run, "c bigint, hs array<bigint>")
    sets = stage(sets.join(left, "c", "left_semi").dropDuplicates(["c"]), "screened-sets")
    tokens = sets.select("c", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    common = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = tokens.join(common, "h").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("pairs"))
    least = at_least_sql(F.col("n"), percent)
    items = lists.filter(F.size("pairs") >= least).select("c", F.col("n").cast("int").alias("n"), (F.col("n") - F.size("pairs")).cast("int").alias("own"), F.col("pairs.h").alias("toks"))
    items = stage(items, "jaccard-items")
    first = (F.col("n") - least + 1 - F.col("own")).cast("int")
    posts = items.filter(first > 0).select("c", "n", "own", F.posexplode(F.slice("toks", F.lit(1), first)).alias("i", "h"))
    return items, stage(posts.select("h", "c", "n", (F.col("own") + F.col("i")).alias("pos")), "postings")


def at_least_sql(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _passes(percent: int) -> Column:
    """Length and positional filters of a candidate (n, pos), (n2, pos2)."""
    least, most = F.least("n", "n2"), F.greatest("n", "n2")
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))  # this shingle and all behind it
    # overlap o links when 100 o >= percent (n + n2 - o)
    return (least * 100 >= most * percent) & (rest * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)


def _suffix_bound(a: np.ndarray, b: np.ndarray, allowed: int, depth: int) -> int:
    """A lower bound on the number of shingles that are in one of two sorted sets only."""
    gap = abs(len(a) - len(b))
    if depth == 0 or gap > allowed or not len(a) or not len(b):
        return gap
    mid = len(b) // 2
    cut = int(np.searchsorted(a, b[mid]))
    hit = int(cut < len(a) and a[cut] == b[mid])
    low = _suffix_bound(a[:cut], b[:mid], allowed, depth - 1)
    if low > allowed:
        return low
    return low + _suffix_bound(a[cut + hit :], b[mid + 1 :], allowed - low, depth - 1) + 1 - hit


def linked(a: np.ndarray, b: np.ndarray, n: int, n2: int, percent: int) -> int:
    """Size of the intersection of two sorted arrays if the sets (of n and n2 shingles) link, else -1."""
    need = -(-percent * (n + n2) // (100 + percent))
    # shingles of one class only are not in the arrays; they differ in any case
    allowed = len(a) + len(b) - 2 * need
    if allowed < 0 or _suffix_bound(a, b, allowed, 2) > allowed:
        return -1
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    overlap = int((both[1:] == both[:-1]).sum())
    return overlap if overlap >= need else -1


def verify(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap, n, n2) of the pairs (a, b) that link; each pair is judged once."""
    side = lambda c, toks, n: items.select(F.col("c").alias(c), F.array_sort("toks").alias(toks), F.col("n").alias(n))
    met = pairs.join(side("a", "x", "n"), "a").join(side("b", "y", "n2"), "b").select("a", "b", "n", "n2", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            xs, ys = x.values.to_numpy(), y.values.to_numpy()
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            n, n2 = batch.column("n").to_pylist(), batch.column("n2").to_pylist()
            got = np.array([linked(xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]], n[i], n2[i], percent) for i in range(batch.num_rows)], np.int64)
            keep = pa.array(got >= 0)
            out = batch.select(["a", "b", "n", "n2"]).append_column("overlap", pa.array(got))
            yield out.filter(keep)

    return met.mapInArrow(run, "a bigint, b bigint, n int, n2 int, overlap bigint")


def star_pairs(posts: DataFrame, labels: DataFrame, percent: int, turn: int, leaders: int = LEADERS) -> DataFrame:
    """Candidates of each posting with the leaders of its block: the members with the smallest hash, for several hashes."""
    lead = lambda k: F.struct(F.xxhash64(F.lit(turn * leaders + k), "c").alias("r"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("label2"))
    members = posts.join(labels, "c")
    chosen = members.groupBy("h").agg(F.count(F.lit(1)).alias("m"), *(F.min(lead(k)).alias(f"l{k}") for k in range(leaders))).filter("m > 1")
    chosen = chosen.select("h", F.explode(F.array_distinct(F.transform(F.array(*(f"l{k}" for k in range(leaders))), lambda x: x.dropFields("r")))).alias("l")).select("h", "l.*")
    found = members.join(chosen, "h").filter("label <> label2").filter(_passes(percent))
    return found.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")).distinct()


def cross_pairs(posts: DataFrame, labels: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """All candidates between different components, each at its first common posting only.

    In each block, the members outside its largest component are paired with the others; members of the
    largest one never meet among themselves.
    """
    members = posts.join(labels, "c")
    sizes = members.groupBy("h", "label").agg(F.count(F.lit(1)).alias("m"))
    blocks = sizes.groupBy("h").agg(F.max(F.struct("m", "label"))["label"].alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("h", "top")
    prefix = items.select("c", F.col("own").alias("o"), F.col("toks").alias("t"))
    members = members.join(blocks, "h").join(prefix, "c")
    members = members.select("h", "top", "label", "c", "n", "pos", F.expr("slice(t, 1, pos - o)").alias("before"))
    right = members.select("h", *(F.col(k).alias(f"{k}2") for k in ("label", "c", "n", "pos", "before")))
    once = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("top")) | (F.col("c") < F.col("c2")))
    found = members.filter("label <> top").join(right, "h").filter(once & _passes(percent) & ~F.arrays_overlap("before", "before2"))
    return found.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b"))


def _prepared(docs: DataFrame, text: str, id_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    ship(docs.sparkSession)
    sets = stage(document_sets(docs, text, id_col, shingle), "document-sets")
    one = sets.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    clash = F.raise_error(F.lit("two different shingle sets have one 64-bit name"))
    classes = stage(one.select("c", "n", F.when(F.col("lo") == F.col("hi"), F.col("first_id")).otherwise(clash).alias("first_id")), "set-classes")
    left = stage(screened(docs, text, classes, shingle, percent), "screened-classes")
    items, posts = rare_first(docs, text, left, shingle, percent)
    return sets, classes, items, posts


def jaccard_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All linked pairs of different sets (a, b, n, n2, overlap), and the membership (doc_id, n, c) of their classes."""
    sets, _, items, posts = _prepared(docs, text, id_col, shingle, percent)
    own = posts.select("c", F.col("c").alias("label")).distinct()
    return verify(cross_pairs(posts, own, items, percent), items, percent), sets.select("doc_id", "n", "c")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, leaders: int = LEADERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    sets, classes, items, posts = _prepared(docs, text, id_col, shingle, percent)
    labels = stage(posts.select("c").distinct().withColumn("label", F.col("c")), "labels")
    own, edges = labels.select("c"), []
    for find in (lambda: star_pairs(posts, labels, percent, 0, leaders), lambda: cross_pairs(posts, labels, items, percent)):
        edges.append(stage(verify(find(), items, percent).select("a", "b"), "links"))
        if len(edges) == 2 and edges[1].isEmpty():
            break
        # what has merged stays merged: the second time its labels stand for the links
        old = labels.select(F.col("c").alias("a"), F.col("label").alias("b"))
        merged = components(edges[-1].unionByName(old)).withColumnRenamed("node", "c")
        labels = stage(own.join(merged, "c", "left").select("c", F.coalesce("label", "c").alias("label")), "labels")
    named = classes.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_class = stage(named.join(smallest, "label").select("c", "component_id"), "components")
    out = sets.join(by_class, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
