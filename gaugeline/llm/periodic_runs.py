"""Periodic runs of words, by an online diagonal DP over a text's sparse repeats.

Words i and i-p that are equal are a match on the diagonal of lag p; a stretch of words with period p
is an unbroken row of matches. The scan goes through the words in order: each word's earlier
occurrence lengthens the match on its lag, and a diagonal that a word does not lengthen has ended and
gives its run at once, if long enough.

Which earlier occurrences of a word count is what keeps the table of diagonals sparse. A run of period q
has at least `times - 1` times q matches. So lags are taken in levels [low, high] with one gram length L for
each, such that every run of the level has L matches and L >= 2 * high; at a level the word counts only
with the gram of L words that begins at it, and only its nearest earlier occurrence in the text.
Nothing is lost by that: were there a nearer one, at a lag d < q, the gram would have the periods d and q,
hence (Fine and Wilf, as L >= d + q) their greatest common divisor, and so would the whole run, whose
smallest period would not be q. For the same reason a diagonal of nearest occurrences never
carries a period that is not the smallest. Grams that occur once in the text are left out of all
higher levels, so ordinary prose is done after the first one. Work is O(n log n) for n words whatever
the text: a text of one word is one diagonal.

Equality of grams is equality of 64-bit hashes, mixed at every doubling of their length.

Defined results: a null, empty or blank text has no words and no runs; rows are taken one by one, so repeated
rows and ids give equal results; an empty table gives an empty table; extra columns pass through, and
columns named like the results are replaced. Texts are worked on whole, in slices of about 2 MB, a longer one alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeline.llm import text as tx
from gaugeline.llm.common import ship

LEAST_WORDS, LEAST_TIMES = 6, 4
U64 = tx.U64
_STEP = U64(0x9E3779B97F4A7C15)
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def levels(longest: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, L): lags and the gram length for them, up to the longest period that `longest` words can hold."""
    matches = lambda q: max(least - q, (times - 1) * q)
    low = 1
    while low * times <= longest:
        high, gram = low, matches(low)
        while min(gram, matches(high + 1)) >= 2 * (high + 1):
            high, gram = high + 1, min(gram, matches(high + 1))
        yield low, high, gram
        low = high + 1


def seeds(h: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, L) in word order: the nearest earlier occurrence of the gram from each word on, where its lag is of the level.

    h has the hash of each word; document d has the words first[d] to first[d + 1].
    """
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    stop = first[1:][doc]
    alive, found = np.arange(len(h)), []
    doubled, reach = h, 1
    for low, high, gram in levels(int(n_words.max(initial=0)), least, times):
        alive = alive[alive + gram <= stop[alive]]
        while 2 * reach <= gram and len(alive):
            doubled = np.append(tx.mix(doubled[:-reach] * _STEP + doubled[reach:]), doubled[-reach:])
            reach *= 2
        if not len(alive):
            break
        key = tx.mix(tx.mix(doubled[alive] + U64(gram)) * _STEP + doubled[alive + gram - reach] + doc[alive].astype(U64) * U64(0xD1342543DE82EF95))
        order = np.argsort(key, kind="stable")
        at, same = alive[order], key[order][1:] == key[order][:-1]
        lag = at[1:] - at[:-1]
        good = same & (lag >= low) & (lag <= high)
        found.append((at[1:][good], lag[good], np.full(int(good.sum()), gram)))
        alive = np.sort(at[np.append(False, same) | np.append(same, False)])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    word, lag, gram = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((lag, word))
    return word[order], lag[order], gram[order]


def scan(word: np.ndarray, lag: np.ndarray, gram: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """The online part: (start, length, period) of each run, as its diagonal ends."""
    active: dict[int, list[int]] = {}  # lag: first and last word whose gram matched, gram length

    def ended(p: int, first: int, last: int, size: int) -> Iterator[tuple[int, int, int]]:
        matched = last - first + size
        if matched >= max(least - p, (times - 1) * p):
            yield first - p, matched + p, p

    now = -1
    for i, p, size in zip(word.tolist(), lag.tolist(), gram.tolist()):
        if i != now:
            for q in [q for q, d in active.items() if d[1] < i - 1]:
                yield from ended(q, *active.pop(q))
            now = i
        if p in active:
            active[p][1] = i
        else:
            active[p] = [i, i, size]
    for q, d in active.items():
        yield from ended(q, *d)


def find(h: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Runs as rows (start, length, period), starts counted over the whole slice, by start and period; and their documents."""
    if times < 4:
        raise ValueError("runs of fewer than four periods are not supported")
    runs = np.array(sorted(scan(*seeds(h, first, least, times), least, times), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    return runs, np.searchsorted(first, runs[:, 0], "right") - 1


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES, with_text: bool = True) -> DataFrame:
    """docs with n_words, runs (by start and period, in words from 0) and, in place of the text, collapsed:
    the words that no run holds after its first period, joined by one space."""
    ship(docs.sparkSession)
    names = ("n_words", "runs", "collapsed")
    kept = [f for f in docs.schema.fields if f.name not in names and f.name != text]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text):
                data, at = tx.utf8(part.column(text))
                starts, ends, first = tx.words(data, at)
                runs, owner = find(tx.word_hashes(data, starts, ends), first, least, times)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                keep = np.cumsum(change[:-1]) == 0
                offsets = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                fields = [pa.array(c) for c in (runs[:, 0] - first[:-1][owner], runs[:, 1], runs[:, 2])]
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                result = [pa.array(np.diff(first)), lists, tx.joined(data, starts, ends, first, keep)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *result], names=[*(f.name for f in kept), *names])

    out = docs.mapInArrow(run, schema)
    return out if with_text else out.drop("collapsed")
