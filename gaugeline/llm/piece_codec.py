"""SentencePiece encoding and decoding with offsets into the original bytes.

The model file is read once on the driver and broadcast (a vocabulary, some hundred kB).
A text is normalised by longest-prefix matches in the model's compiled character map; each
normalised byte keeps the source byte it came from, and every piece is projected back to a
source span. Merging (BPE) works on words: no piece of a supported vocabulary has a space
mark after another character, so words cannot influence each other, and each distinct word
is merged once per worker, all new words of a slice together. Word results live in flat arrays; a slice of documents is
assembled from them by numpy indexing.

Supported: BPE models with byte fallback; others are refused. Defined results: a null text is
empty and has no pieces; white-space-only texts and texts of any length are whole; repeated rows
are encoded each; an empty table gives an empty one; extra columns pass through, and columns
named like the output are replaced. Memory per task: one Arrow batch, one slice of about SLICE_BYTES of
text (or one longer document) and a word table of WORD_TABLE entries and one slice's words at most, then rebuilt.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeline.llm import text as tx
from gaugeline.llm.common import ship

MARK = "▁"
# a worker outlives its stage and keeps its table, next to a JVM that has grown to its whole heap
WORD_TABLE = 150_000
SLICE_BYTES = 512 << 10
DECODE_ROWS = 500
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format
BPE = 2
# symbols of longer pieces follow those of single characters
PIECE = 0x110000


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = blob[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(blob):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = blob[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """A compiled character map: a double array over UTF-8 bytes, whose values point at replacement strings."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
            self.strings = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest key that raw has at `at`, and the key's length."""
        units, found = self.units, None
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = jump(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != raw[i]:
                break
            node ^= jump(unit)
            if unit & 0x100:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(b"\0", start)], found[1]


class Numbered(dict):
    """Words and their numbers; a word that is asked for the first time gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class Codec:
    def __init__(self, model: bytes):
        pieces, trainer, norm = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        types = {t for _, _, t in pieces}
        if trainer.get(3) != BPE or not trainer.get(35) or types & {UNUSED, USER_DEFINED} or trainer.get(24) or not norm.get(5, 1):
            raise ValueError("only BPE models with byte fallback, escaped prefix spaces and plain pieces are supported")
        self.map = CharMap(norm.get(2, b""))
        self.dummy, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.is_byte = np.array([t == BYTE for _, _, t in pieces])
        self.unknown = {i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN}
        surface = trainer[44].decode() if 44 in trainer else " \u2047 "
        self.out = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else (surface if t == UNKNOWN else p.replace(MARK, " ")).encode() for p, _, t in pieces]
        self.strings = [p for p, _, _ in pieces]
        self.pairs = self._pairs()
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.by_word else re.compile("(?s).+")
        self._clear()

    # words and their pieces

    def _clear(self) -> None:
        self.words = Numbered()
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat_ids, self.flat_size, self.used = np.zeros(4096, np.int32), np.zeros(4096, np.int32), 0

    def _learn(self, new: list[str]) -> None:
        """Merge new words, which already have the next numbers, and file their pieces."""
        short = [w for w in new if len(w) <= 400]
        ids, sizes, counts = self._merge_all(short)
        if len(short) < len(new):
            parts, stop = [], np.concatenate([[0], np.cumsum(counts)])
            at = iter(range(len(short)))
            for w in new:
                if len(w) <= 400:
                    k = next(at)
                    parts.append((ids[stop[k] : stop[k + 1]], sizes[stop[k] : stop[k + 1]]))
                else:
                    parts.append(tuple(map(np.array, self.merged(w))))
            ids, sizes = (np.concatenate(x) for x in zip(*parts))
            counts = np.array([len(p[0]) for p in parts])
        first, n, used = len(self.words) - len(new), len(self.words), self.used + len(ids)
        while n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while used > len(self.flat_ids):
            self.flat_ids, self.flat_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.flat_ids, self.flat_size))
        self.first[first:n], self.count[first:n] = self.used + np.cumsum(counts) - counts, counts
        self.flat_ids[self.used : used], self.flat_size[self.used : used] = ids, sizes
        self.used = used

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every pair of symbols that makes a piece: sorted keys, the piece's symbol and its rank by score (equal scores, equal ranks).

        A symbol is a character's code point, or PIECE plus the id of a longer piece.
        """
        symbol = lambda p: ord(p) if len(p) == 1 else PIECE + self.ids[p] if p in self.ids else -1
        place = {x: k for k, x in enumerate(sorted({-x for x in self.score.values()}))}
        rows = []
        for p in self.ids:
            for cut in range(1, len(p)):
                left, right = symbol(p[:cut]), symbol(p[cut:])
                if left >= 0 and right >= 0:
                    rows.append(((left << 21) | right, symbol(p), place[-self.score[p]]))
        keys, made, rank = (np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else [np.zeros(0, np.int64)] * 3
        return keys, made, rank

    def _merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """merged() for many words at once: ids and sizes end to end, and the number of ids of each word.

        All words' symbols lie in one array; each round makes the best merge of every word, the leftmost of equals.
        """
        none = np.iinfo(np.int64).max
        keys, made, rank = self.pairs

        def look(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = (left << 21) | right
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            return np.where(hit, rank[at], none) if len(keys) else np.full(len(key), none), made[at] if len(keys) else key

        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_word, done = [], []
        best = np.full(len(chars), none)
        both = np.zeros(len(chars), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        best[inner], both[inner] = look(chars[inner], chars[inner + 1])
        while len(chars):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(best, heads)
            size = np.diff(np.append(heads, len(chars)))
            live = np.repeat(least < none, size)
            if not live.all():
                done_word.append(word[~live])
                done.append(chars[~live])
                chars, word, best, both = chars[live], word[live], best[live], both[live]
                size, least = size[least < none], least[least < none]
                if not len(chars):
                    break
            hits = np.flatnonzero(best == np.repeat(least, size))
            hits = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            chars[hits] = both[hits]
            keep = np.ones(len(chars), bool)
            keep[hits + 1] = False
            hits = hits - np.arange(len(hits))
            chars, word, best, both = chars[keep], word[keep], best[keep], both[keep]
            # the merged symbol has new pairs with the one after it and the one before it
            joined = np.append(word[1:] == word[:-1], False)
            best[hits[~joined[hits]]] = none
            left = np.concatenate([hits, hits[hits > 0] - 1])
            left = left[joined[left]]
            best[left], both[left] = look(chars[left], chars[left + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, symbols = np.concatenate(done_word), np.concatenate(done)
        order = np.argsort(word, kind="stable")
        word, symbols = word[order], symbols[order]
        kinds, which = np.unique(symbols, return_inverse=True)
        ids, sizes = zip(*(self._spelled(self.strings[k - PIECE] if k >= PIECE else chr(k)) for k in kinds.tolist()))
        length = np.array([len(x) for x in ids])
        start = np.cumsum(length) - length
        flat_ids, flat_sizes = (np.array([y for x in xs for y in x], np.int64) for xs in (ids, sizes))
        count = length[which]
        total = np.cumsum(count)
        pick = np.repeat(start[which] - (total - count), count) + np.arange(total[-1])
        return flat_ids[pick], flat_sizes[pick], np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)

    def _spelled(self, part: str) -> tuple[list[int], list[int]]:
        """Ids of a part that nothing merges further, and the normalised bytes each covers; of byte pieces the last covers all."""
        raw = part.encode()
        if (i := self.ids.get(part)) is not None:
            return [i], [len(raw)]
        return [self.byte_id[b] for b in raw], [0] * (len(raw) - 1) + [len(raw)]

    def merged(self, word: str) -> tuple[list[int], list[int]]:
        """Ids of a normalised word and the normalised bytes that each covers."""
        spelled = [self._spelled(p) for p in self._merge_many(word)]
        return [i for ids, _ in spelled for i in ids], [n for _, sizes in spelled for n in sizes]

    def _merge_many(self, word: str) -> list[str]:
        """Merge the best pair, the leftmost of equals, until none is a piece; with a heap and linked neighbours, for a long word."""
        parts: list[str] = list(word)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    # texts

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes and of its end."""
        raw, out, source = text.encode(), bytearray(), []
        at = 0

        def unit(at: int) -> tuple[bytes, int]:
            if self.map.units and (hit := self.map.longest(raw, at)):
                return hit
            size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            return raw[at : at + size], size

        while self.squeeze and at < len(raw) and (u := unit(at))[0] == b" ":
            at += u[1]
        if at == len(raw):
            return "", np.zeros(1, np.int32)
        mark = MARK.encode()
        if self.dummy:
            out += mark
            source += [at] * 3
        after_space = self.squeeze
        while at < len(raw):
            new, size = unit(at)
            new = new.lstrip(b" ") if after_space else new
            if new:
                for b in new:
                    grown = mark if b == 0x20 else bytes([b])
                    out += grown
                    source += [at] * len(grown)
                after_space = self.squeeze and new.endswith(b" ")
            at += size
        end = len(raw)
        while self.squeeze and out.endswith(mark):
            del out[-3:]
            end = source[len(out)]
            del source[len(out) :]
        return out.decode(), np.array([*source, end], np.int32)

    def _plain(self, data: np.ndarray, at: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """normalise() for a slice of documents, for models whose map is empty: only spaces change."""
        size = np.diff(at)
        full = size > 0
        width = np.where(data == 0x20, 3, 1)
        heads = at[:-1][full]
        place = np.arange(len(data)) - np.repeat(at[:-1], size)
        # each document gets one entry for its end after it (before what the next one begins with), and its prefix mark before
        where = np.concatenate([at[1:], heads])
        values = np.insert(place, where, np.concatenate([size, np.zeros(len(heads), int)]))
        widths = np.insert(width, where, np.concatenate([np.ones(len(size), int), np.full(len(heads), 3)]))
        return [MARK + t.replace(" ", MARK) if t else "" for t in texts], np.repeat(values, widths).astype(np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a slice of texts: offsets of the documents in the pieces, ids, begins, ends."""
        if len(self.words) > WORD_TABLE:
            self._clear()
        texts = [t or "" for t in column.to_pylist()]
        if self.map.units or self.squeeze or not self.dummy:
            pairs = [self.normalise(t) for t in texts]
            normal, source = [n for n, _ in pairs], np.concatenate([s for _, s in pairs]) if pairs else np.zeros(0, np.int32)
        else:
            normal, source = self._plain(*tx.utf8(column), texts)
        before, find = len(self.words), self.chunks.findall
        codes, ends = [], [0]
        for t in normal:
            codes += map(self.words.__getitem__, find(t))
            ends.append(len(codes))
        if len(self.words) > before:
            self._learn(list(itertools.islice(self.words, before, None)))
        codes = np.array(codes, np.int64)
        count = self.count[codes].astype(np.int64)
        stop = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        pick = np.repeat(self.first[codes] - stop[:-1], count) + np.arange(stop[-1])
        ids, size = self.flat_ids[pick], self.flat_size[pick].astype(np.int64)
        docs = stop[np.array(ends)]
        shift = np.repeat(np.arange(len(texts)), np.diff(docs))  # one entry for its end before each later document
        last = np.cumsum(size)
        return docs, ids, source[last - size + shift], source[last + shift]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte runs that are not UTF-8 give U+FFFD for each bad byte, the prefix space goes."""
        ids = ids.tolist()
        raw = b"".join(map(self.out.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._careful(ids)
        return text[1:] if self.dummy and text.startswith(" ") and self._has_prefix(ids) else text

    def _has_prefix(self, ids: list[int]) -> bool:
        """Whether the first piece that writes anything is a plain one."""
        first = next((i for i in ids if self.out[i]), None)
        return first is not None and not self.is_byte[first] and first not in self.unknown

    def _careful(self, ids: list[int]) -> str:
        out, k = [], 0
        while k < len(ids):
            run = k
            while run < len(ids) and self.is_byte[ids[run]]:
                run += 1
            raw = b"".join(self.out[i] for i in ids[k:run])
            while raw:
                size = 1 if raw[0] < 0x80 else 2 if raw[0] < 0xE0 else 3 if raw[0] < 0xF0 else 4
                try:
                    out.append(raw[:size].decode())
                    raw = raw[size:]
                except UnicodeDecodeError:
                    out.append("\ufffd")
                    raw = raw[1:]
            if run < len(ids):
                out.append(self.out[ids[run]].decode())
            k = run + 1
        return "".join(out)


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for each model and worker, so that its word table outlives a task."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _coded(c: Codec, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Slices of the batches, each with the offsets of its documents in the pieces and [ids, begins, ends]."""
    for batch in batches:
        for part in tx.slices(batch, text, SLICE_BYTES):
            docs, *columns = c.encode(part.column(text))
            yield part, docs, columns


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in new and c not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new.values()], names=[*kept, *new])


def encode(df: DataFrame, model_path: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """df with ids, begins and ends (array<int>): pieces and their spans in the UTF-8 bytes of the text."""
    spark = df.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    names = ("ids", "begins", "ends")
    drop = (text,) if drop_text else ()
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    schema = T.StructType([*kept, *(T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, docs, columns in _coded(codec(model.value), batches, text):
            at = pa.array(docs.astype(np.int32))
            yield _with(part, {n: pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for n, v in zip(names, columns)}, drop)

    return df.mapInArrow(run, schema)


def recode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """df, without the text, with ids, their decoded text and the SHA-256 of their spans, in one pass.

    spans_sha256 is over the begins and then the ends as little-endian 32-bit numbers.
    """
    spark = df.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    new = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType()), T.StructField("spans_sha256", T.StringType())]
    names = tuple(f.name for f in new)
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in names and f.name != text), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for part, docs, columns in _coded(c, batches, text):
            ids, begins, ends = (v.astype("<i4") for v in columns)
            bounds = list(zip(docs[:-1].tolist(), docs[1:].tolist()))
            lists = pa.ListArray.from_arrays(pa.array(docs.astype(np.int32)), pa.array(ids))
            texts = pa.array([c.decode(ids[a:b]) for a, b in bounds], pa.string())
            spans = pa.array([hashlib.sha256(begins[a:b].tobytes() + ends[a:b].tobytes()).hexdigest() for a, b in bounds], pa.string())
            yield _with(part, dict(zip(names, (lists, texts, spans))), (text,))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids give an empty text."""
    spark = df.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for whole in batches:
            for first in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(first, DECODE_ROWS)
                lists = batch.column(ids)
                at = lists.offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)
                dead = lists.is_null().to_pylist() if lists.null_count else None
                texts = [c.decode(values[at[i] : at[i + 1]]) if not (dead and dead[i]) else "" for i in range(batch.num_rows)]
                yield _with(batch, {out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)
