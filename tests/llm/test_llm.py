"""The training-data operators against brute force, libraries, exact round trips and their SQL."""

import base64
import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from check_queries import compare, duck
from gaugeline.llm import chat_format, exact_dedup, fingerprint, jaccard_join, mixing, piece_codec, quality_mil, queries, secret_scan, substring_dedup, warc_writer
from gaugeline.operators.staging import new_table_path

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a  b"), (6, "A b"), (7, "x" * 5000 + " y"), (7, "x" * 5000 + " y"), (None, "a b"), (9, "é日本 　 z")]
DOCS = "doc_id long, text string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert compare(got, duck(sf).execute(queries.ORACLE[name]).df()) == "ok"


@pytest.mark.parametrize("build", [jaccard_join.near_duplicates, exact_dedup.mark, exact_dedup.deduplicate, substring_dedup.removed, fingerprint.follow])
def test_empty_and_extra_columns(spark, build):
    empty = spark.createDataFrame([], DOCS)
    assert build(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 2), (2, "a b", "y", 3)], DOCS + ", _dd_hash string, n long")
    assert build(clash).count() in (1, 2)


def test_piece_codec_equals_library(spark, docs):
    import sentencepiece

    path = queries.piece_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(1)
    noise = ["".join(random.choice("ab th\n\t▁é日😀\x00.#1<> ") for _ in range(random.randint(0, 60))) for _ in range(300)]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(noise)), (9999, " " * 900 + "a" * 900), *docs[:40]]
    coded = piece_codec.decode(piece_codec.encode(spark.createDataFrame(rows, DOCS), path), path).collect()
    assert len(coded) == len(rows)
    for r in coded:
        want = lib.encode(r.text or "", return_type="proto").pieces
        assert r.ids == [p.id for p in want]
        assert list(zip(r.begins, r.ends)) == [(p.begin, p.end) for p in want]
        assert r.decoded == lib.decode(r.ids)


def test_piece_codec_memory():
    """Encoding 8 MB of ever new words takes a bounded part of a worker's memory, whatever the size of the batch, and loses no row."""
    import tracemalloc

    c = piece_codec.Codec(Path(queries.piece_model()).read_bytes())
    texts = [" ".join(f"{(7919 * (400 * i + j)) % 10**9:09d}" for j in range(400)) for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    try:
        before, rows, pieces = tracemalloc.get_traced_memory()[0], 0, 0
        for part, docs, (ids, _, _) in piece_codec._coded(c, iter([batch]), "text"):
            rows, pieces = rows + part.num_rows, pieces + len(ids)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert rows == 2000 and pieces > 800_000
    assert peak < 100e6, peak


def test_character_map_equals_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(piece_codec._fields(dict(piece_codec._fields(lib.serialized_model_proto()))[3]))
    codec = piece_codec.Codec(Path(queries.piece_model()).read_bytes())
    codec.map, codec.dummy, codec.squeeze = piece_codec.CharMap(spec[2]), True, True
    random.seed(2)
    for _ in range(500):
        t = "".join(random.choice("ab  ﬁＡ①㍿é́ｶﾞ　\t\n") for _ in range(random.randint(0, 20)))
        got, source = codec.normalise(t)
        assert got == lib.normalize(t)
        assert len(source) == len(got.encode()) + 1 and all(np.diff(source) >= 0)


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}
    seen = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            seen[g].append(i)
    common = Counter(p for ids in seen.values() for p in itertools.combinations(ids, 2))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {p for p, o in common.items() if 100 * o >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - o)}
    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}, links, sets


def near_copies(n, seed=3):
    random.seed(seed)
    base = [str(random.randint(0, 999)) for _ in range(90)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(random.randint(1, 5)):
            w[random.randrange(len(w))] = str(random.randint(0, 99999))
        out.append((1000 + i, " ".join(w)))
    return out


def test_jaccard_components_and_pairs(spark, docs):
    rows = [*docs, *near_copies(120), *((10_000 + i, t) for i, t in ODD[:6]), *((20_000 + i, docs[0][1]) for i in range(50))]
    want, links, sets = jaccard_brute(rows)
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == want
    pairs, members = jaccard_join.jaccard_pairs(df)
    member = {r.doc_id: r.c for r in members.collect()}
    found = [frozenset((r.a, r.b)) for r in pairs.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {frozenset((member[a], member[b])) for a, b in links if sets[a] != sets[b]}


def test_jaccard_odd_rows(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(ODD, DOCS)).collect()}
    assert got[1] == got[1] and got[1][0] == 0 and got[1][1] == 1 and got[2] == (0, 2)
    assert got[5][1] == 4 and got[6][1] == 4 and got[None][1] == 4


def secrets_brute(t):
    t, out = t or "", []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base_spans_and_ownership(spark, docs):
    own, copied = "q7Zp" * 3 + "9xK2mL8vB4nT", "AKIA" + "ABCDEFGH12345678"
    rows = [*docs, (900, f'😀 Token= "ab" password: token=abcdef {"0a" * 15} {copied}'), (901, f"see {own} here"), (902, f'API_KEY="{own}"'), *((910 + i, f"key {copied}") for i in range(4)), (None, None)]
    df = spark.createDataFrame([(*r, f"s{r[0] if r[0] else 0}" if r[0] not in (901, 902) else "same", "en") for r in rows], DOCS + ", source string, lang string")
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert [(s.start, s.kind, s.stop) for s in got[i].spans if s.kind < secret_scan.OWNED] == secrets_brute(t)
    assert [(s.start, s.kind, s.status) for s in got[901].spans] == [(4, 3, "live")]
    assert {s.status for s in got[911].spans} == {"copied"}


def test_exact_dedup_separates_colliding_hashes(spark):
    df = spark.createDataFrame([*ODD, (10, "c"), (11, "c ")], DOCS)
    weak = exact_dedup.mark(df, hash_of=lambda c: F.unhex(F.lit("00")))
    key = lambda rows: sorted(((r.doc_id or -1), r.keep_id, r.group_size, r.kept) for r in rows)
    assert key(weak.collect()) == key(exact_dedup.mark(df).collect())
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert kept.count() == len({norm(t) for _, t in df.collect()}) == exact_dedup.deduplicate(df, hash_of=lambda c: F.unhex(F.lit("00"))).count()


def test_fingerprints(spark, docs):
    random.seed(4)
    lines = [f"line {i} of the text" for i in range(20)]
    mixed = random.sample(lines, 20)
    one, two, part, rest = fingerprint.sums([fingerprint.pieces("\n".join(x)) for x in (lines, mixed, lines[:7], lines[7:])])
    assert (one == two).all() and (part + rest == one).all() and (one - rest == part).all()
    rows = spark.createDataFrame([("\n".join(lines[:7]), "\n".join(lines[7:]), "\n".join(mixed))], "a string, b string, c string")
    for c in "abc":
        rows = fingerprint.fingerprints(rows, c, f"f{c}")
    r = rows.select("fa", "fc", fingerprint.combined(F.col("fa"), F.col("fb")).alias("sum"), fingerprint.combined(F.col("fc"), F.col("fb"), -1).alias("less")).first()
    assert r["sum"] == r.fc and r.less == r.fa

    table = [*docs, (10_001, None), (10_002, ""), (10_003, "é" * 9)]
    got = {r.doc_id: r for r in fingerprint.follow(spark.createDataFrame(table, DOCS)).collect()}
    order = sorted(table)
    for (i, t), (_, f) in zip(order, order[1:] + order[:1]):
        t, f = t or "", f or ""
        edited = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        a, b, c = fingerprint.sums([fingerprint.pieces(x) for x in (t, edited, f)])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edited), *fingerprint.hexed([a, b]))
        assert r.near_edited == pytest.approx(fingerprint.likeness(a[None], b[None])[0]) and r.near_next == pytest.approx(fingerprint.likeness(a[None], c[None])[0])


def test_likeness_of_often_repeated_paragraphs(spark):
    line = "one paragraph of some words\n"
    a, b = fingerprint.sums([fingerprint.pieces(line * n) for n in (40_000, 30_000)])
    assert fingerprint.likeness(a[None], b[None])[0] == pytest.approx(0.96)
    df = spark.createDataFrame([(1, line * 40_000), (2, line * 30_000)], DOCS)
    got = {r.doc_id: r for r in fingerprint.follow(df).collect()}
    assert got[1].near_next == pytest.approx(0.96) and got[1].near_edited > 0.9


def test_mixing_reaches_the_targets(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 10 < 7, 'a', IF(id % 10 < 9, 'b', NULL)) AS source", "id AS copy_no")
    out = mixing.mix(df, weights={"a": 1.0, "b": 1.0}).cache()
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert None not in n and all(abs(v - 10_000) < 400 for v in n.values())
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys) and out.groupBy("doc_id", "copy_no").count().filter("count > 1").isEmpty()
    high = mixing.mix(spark.range(400).selectExpr("id AS doc_id", "IF(id < 4, 'x', 'y') AS source"), weights={"x": 0.99, "y": 0.01 * 1e-9})
    assert abs(high.count() - 400) < 100
    assert mixing.mix(df.limit(0)).count() == 0


def test_quality_gradient_and_accuracy(spark, sf):
    rng = np.random.default_rng(0)
    model, bounds, y = quality_mil.Attention(), np.array([0, 3, 4, 9]), np.array([0, 1, 1], np.float32)
    x = rng.standard_normal((9, quality_mil.SIZE)).astype(np.float32)
    grads, loss = model.gradient(model.forward(x, bounds), y), lambda: float(-np.mean(np.log(np.where(y == 1, s := model.forward(x, bounds)["score"], 1 - s))))
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, model.w[k] = model.w[k], model.w[k].astype(np.float64)
        model.w[k][at] += 1e-3
        up = loss()
        model.w[k][at] -= 2e-3
        slope, model.w[k] = (up - loss()) / 2e-3, old
        assert slope == pytest.approx(float(g[at]), rel=0.05, abs=1e-4)
    big = "/root/testdata/sf0.01"
    got = queries.op7_quality_mil(spark, big).toPandas()
    assert ((got.held_out) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{big}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_fits_on_all_passages(spark, monkeypatch):
    words = quality_mil.PASSAGE_WORDS * 600
    df = spark.createDataFrame([(i, "word " * words) for i in range(12)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality_mil.Attention, "fit", lambda self, bags, y: seen.extend(map(len, bags)) or self)
    quality_mil.fit(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"))
    assert seen and set(seen) == {600}


def test_quality_without_labels(spark):
    df = spark.createDataFrame(ODD, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_mil.score(df, quality_mil.fit(df, none)).collect()} == {0.5}
    assert quality_mil.score(df.limit(0), quality_mil.Attention()).count() == 0
    assert quality_mil.score(df, quality_mil.Attention()).count() == len(ODD)


def cut_brute(rows, window):
    texts = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d or -1, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


@pytest.mark.parametrize(("window", "group"), [(35, 50_000), (35, 1), (9, 2)])
def test_substring_dedup(spark, docs, window, group):
    random.seed(5)
    rows = [*docs, *ODD, *((5000 + i, " ".join(random.choices("ab", k=random.randint(0, 60)))) for i in range(40)), (6000, "z " * 200)]
    got = substring_dedup.removed(spark.createDataFrame(rows, DOCS), window=window, group=group).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == cut_brute(rows, window)
    assert all(sha(r.kept_text) == r.kept_sha256 for r in got)


def test_longer_prefixes_in_one_pass(spark, monkeypatch):
    """However many kinds of longer prefixes are needed, the documents are read for one more count only."""
    staged, real = [], substring_dedup.stage
    monkeypatch.setattr(substring_dedup, "stage", lambda df, label: staged.append(label) or real(df, label))
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}", *passage[: 60 - i % 3], f"b{i}"])) for i in range(1, 13)] + [(50, "z " * 90), (51, " ".join(passage[5:25])), (52, None)]
    got = substring_dedup.removed(spark.createDataFrame(rows, DOCS), group=2).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == cut_brute(rows, 35)
    assert len(staged) == 3, staged


def test_hashes_of_some_windows():
    """Windows at some places hash as among all windows: none, one, runs, all."""
    rng = np.random.default_rng(4)
    s = substring_dedup.Words(pa.RecordBatch.from_pydict({"text": [" ".join(map(str, rng.integers(0, 9, 400))), None, "a b"]}), "text")
    for n in (8, 16, 24, 35):
        last = len(s.h) - n
        for at in ([], [0], [last], [3, 4, 5, 100, 101, last], [0, 2, 4, 6], range(last + 1)):
            at = np.array(list(at), np.int64)
            assert (s.hashes(at, n) == substring_dedup.tx.windows(s.h, n)[at]).all()


def test_suffix_order():
    """Ordered suffixes of rows against sorting the word lists themselves."""
    rng = np.random.default_rng(3)
    for window in (8, 9, 16, 35):
        size = rng.integers(1, 6, 40)
        words = rng.integers(0, 2, int((size + window - 1).sum())).astype(np.uint64)
        words[: len(words) // 2] = 7
        order, same = substring_dedup.suffix_order(words, size, window)
        starts = [a + i for a, n in zip(np.cumsum(size + window - 1) - size - window + 1, size) for i in range(n)]
        lists = [tuple(words[a : a + window].tolist()) for a in starts]
        assert [lists[i] for i in order] == sorted(lists)
        assert same.tolist() == [i > 0 and lists[order[i]] == lists[order[i - 1]] for i in range(len(order))]


@pytest.mark.parametrize("group", [50_000, 3, 1])
def test_maximal_repeats(spark, group):
    """Lengths of repeats against brute force: a passage of 50 words, one within one text, hot groups, null and empty rows."""
    random.seed(8)
    word = lambda: str(random.randrange(10**9))
    passage, inner = [word() for _ in range(50)], [word() for _ in range(12)]
    rows = [(i, " ".join([*(word() for _ in range(i % 5)), *passage, *(word() for _ in range(3))])) for i in range(30)]
    rows += [(100, " ".join([*inner, word(), *inner])), (101, " ".join([*passage[:20], *passage[10:]])), (102, None), (103, ""), (None, " ".join(passage)), (104, "q " * 40)]
    window = 10
    texts = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    want = []
    for (d, _), w in zip(rows, texts):
        hit = [count[tuple(w[i : i + window])] > 1 for i in range(len(w) - window + 1)]
        for i, h in enumerate(hit):
            if h and not (i and hit[i - 1]):
                n = next((j for j in range(i, len(hit)) if not hit[j]), len(hit)) - i
                want.append((d or -1, i, n + window - 1))
    df = spark.createDataFrame(rows, DOCS).withColumn("d1", F.lit(1)).withColumn("ranges", F.lit("x"))
    got = substring_dedup.maximal_repeats(df, window=window, group=group).collect()
    assert sorted((r.doc_id or -1 if r.doc_id is not None else -1, r.start, r.n_words) for r in got) == sorted(want)
    assert substring_dedup.maximal_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_one_hot_window(spark):
    """A group beyond its bound goes on with one leaf for each window: one slice a row, so that all leaves travel."""
    batch = lambda rows: pa.RecordBatch.from_pydict(dict(zip(["key", "d1", "d2", "place", "size", "words", "told"], zip(*rows))), schema=pa.schema([("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("words", pa.binary()), ("told", pa.bool_())]))
    blob = lambda *w: np.array(w, np.uint64).tobytes()
    hot = [(1, i, 0, 4, 1, blob(*range(8)), False) for i in range(40)]
    lone = [(1, 100 + i, 0, 0, 2, blob(*range(100 * i + 50, 100 * i + 59)), False) for i in range(20)]
    late = [(2, 200, 0, 0, 1, blob(*range(9, 17)), False), (2, 201, 0, 7, 1, blob(*range(9, 17)), False)]
    spelled = [(3, 300 + i, 0, 0, 1, b"", False) for i in range(9)]
    rows = [*hot[:20], *lone, *hot[20:], *late, *spelled, (4, 400, 0, 0, 1, b"", False)]
    for width in (1, 7, 100):
        parts = [batch(rows[i : i + width]) for i in range(0, len(rows), width)]
        got = Counter((r["d1"], r["place"], r["size"]) for b in substring_dedup.deep_nodes(8, 4)(iter(parts)) for r in b.to_pylist())
        assert got == Counter({**{(i, 4, 1): 1 for i in range(40)}, (200, 0, 1): 1, (201, 7, 1): 1, **{(300 + i, 0, 1): 1 for i in range(9)}})


def test_chat_round_trip(spark):
    nasty = ["", None, "</s>", "[INST] x [/INST]", "\\s\\i\\e\\", "<s", "[/TURN] [ROLE]a[/ROLE]", " lead ", "[", "<", "[/INST"]
    rows = [(c, t, r, x) for c, r2 in ((1, "user"), (2, "system"), (3, "assistant"), (4, "to[/ROLE]ol"), (5, None)) for t, x in enumerate(nasty) for r in ((r2,) if t % 2 else ("assistant",))]
    ex = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = ex.select("conv_id", "n_turns", "example", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_stop")).alias("reply")).collect()
    for c in range(1, 6):
        turns = [((r or ""), (x or "")) for k, _, r, x in rows if k == c]
        mine = sorted((g for g in got if g.conv_id == c), key=lambda g: g.example)
        assert [(t.role, t.text) for t in mine[-1].turns] == turns
        assert [g.reply for g in mine if turns[g.n_turns - 1][0] == "assistant"] == [x for r, x in turns if r == "assistant"]
    assert chat_format.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_warc_round_trip(spark):
    page = [(i, f"http://x/{i}\nb", f"<p>{i % 7}</p>" * 50) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "u", "lone"), (103, "u", "é" * 100_000)]
    df, folder = spark.createDataFrame(page, "page_id long, url string, html string"), new_table_path(spark, "warc")
    manifest = warc_writer.write(df, folder)
    back = {r.page_id: r for r in warc_writer.read(manifest, folder).collect()}
    first = {}
    for i, _, h in sorted(page, key=lambda p: (p[0] is None, p[0])):
        raw = (h or "").encode()
        r, seen = back[i], first.setdefault(raw, i)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if seen == i else ("revisit", seen))
        assert r.payload == (raw if seen == i else None)
    heads = [Path(r.path).read_bytes()[:4] for r in manifest.collect()]
    assert heads and all(h in (b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd") for h in heads)
    assert warc_writer.write_and_read(df.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, sf):
    names = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, names, sf)
    model = quality_mil.fit(names, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = names.select("doc_id", "text").toPandas()
    score = model.scores(*quality_mil.passages(*piece_codec.tx.utf8(pa.array(rows.text))))
    assert sorted(r.doc_id for r in good.select("doc_id").collect()) == sorted(rows.doc_id[score >= queries.KEEP_SCORE])
    assert good.columns == names.columns
    once = corpus_pipeline.drop_copies(spark, good, sf)
    kept = [(r.doc_id, r.text) for r in once.select("doc_id", "text").collect()]
    want, _, _ = jaccard_brute(kept)
    left = corpus_pipeline.drop_near_copies(spark, once, sf)
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    out = corpus_pipeline.run(spark, sf)
    mixed = corpus_pipeline.mix_sources(spark, left, sf).groupBy("doc_id").count()
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {r.doc_id: r["count"] for r in mixed.collect()}
    want = [(r.shuffle_key, r.doc_id, r.copy_no) for r in mixing.mix(left).collect()]
    assert [(r.shuffle_key, r.doc_id, r.copy_no) for r in out.select("shuffle_key", "doc_id", "copy_no").collect()] == want


def test_order_of_a_mix_is_restored(spark):
    df = spark.range(300).selectExpr("id % 290 AS doc_id", "IF(id % 7 = 0, NULL, concat('t', id % 290)) AS text", "IF(id < 30, 'rare', 'common') AS source", "'x' AS _text_hash", "1 AS copy_no")
    mixed = mixing.mix(df, weights={"rare": 0.5, "common": 0.5})
    lost = mixed.select("doc_id", "text", "source", "_text_hash").repartition(7, "source")
    got = [r.shuffle_key for r in mixing.restore_order(lost).collect()]
    assert got == sorted(got) and len(got) == mixed.count()
    once = mixing.mix(df.filter("doc_id >= 10"))
    back = mixing.restore_order(once.select("doc_id", "text", "source").repartition(5))
    assert [(r.doc_id, r.copy_no) for r in back.collect()] == [(r.doc_id, r.copy_no) for r in once.collect()]
    assert mixing.restore_order(df.limit(0)).count() == 0
