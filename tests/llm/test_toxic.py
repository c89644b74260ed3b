"""The toxicity field: marginals against enumeration, likelihood by finite differences, spans, odd rows, held-out accuracy."""

import itertools
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from gaugeline.llm import queries, toxic_crf
from gaugeline.llm import text as tx

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "?! ..."), (5, "x" * 9000), (5, "x" * 9000), (None, "a nasty word"), (9, "é日本 　 z")]


def test_marginals_equal_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    for n, row in ((1, 64), (9, 64), (9, 2), (11, 3)):
        monkeypatch.setattr(toxic_crf, "ROW", row)
        gain, begin, step = rng.normal(size=n) * 3, rng.normal(size=2), rng.normal(size=(2, 2))
        begins = rng.random(n) < 0.3
        begins[0] = True
        total, mean, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for z in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(gain[i] * z[i] + (begin[z[i]] if begins[i] else step[z[i - 1], z[i]]) for i in range(n)))
            total, mean = total + w, mean + w * np.array(z)
            for i in np.flatnonzero(~begins):
                steps[z[i - 1], z[i]] += w
        p, got = toxic_crf.marginals(gain, begins, begin, step, pairs=True)
        assert p == pytest.approx(mean / total) and got == pytest.approx(steps / total, abs=1e-12)


def test_marginals_of_long_and_certain_chains():
    gain = np.concatenate([np.full(5000, 30.0), np.full(5000, -30.0)])
    begins = np.zeros(10_000, bool)
    begins[[0, 5000]] = True
    p = toxic_crf.marginals(gain, begins, np.zeros(2), np.array([[2.0, -2.0], [-2.0, 2.0]]))
    assert np.isfinite(p).all() and p[:5000].min() > 0.999 and p[5000:].max() < 0.001


def test_features_know_letters_and_case():
    data, at = tx.utf8(pa.array(["(Stupid!) stupidly, ... x"]))
    starts, ends, _ = tx.words(data, at)
    f, begin, end = toxic_crf.features(data, starts, ends)
    cut = [bytes(data[a:b]) for a, b in zip(begin, end)]
    assert cut == [b"Stupid", b"stupidly", b"...", b"x"]
    assert (f[0, :4] == f[1, :4]).all() and f[0, 4] == -1 and f[0, 5] != f[1, 5] and (f[3, :5] == -1).all()


def corpus():
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(rng.choice(plain, 40))
        toxic = i % 4 == 0
        if toxic:
            for k in rng.choice(40, 4, replace=False):
                w[k] = str(rng.choice(["Grobian", "grobianly,", "(vermin)", "é-vermin"]))
        elif i % 8 == 1:
            w[0] = "grobiano"  # once in a clean document
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_tags_words_and_scores(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS + ", toxic int").selectExpr("*", "'s' AS score", "1 AS p", "'x' AS t")
    model = toxic_crf.fit(df, df.select("doc_id", "toxic"))
    got = toxic_crf.tag(df, model).collect()
    assert len(got) == len(rows) and "t" in got[0].asDict()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in got]) > 0.99
    for r in got[:40:4]:
        tagged = [r.text[s.start : s.stop] for s in r.toxic_spans]
        assert tagged and all("grobian" in t.lower() or "vermin" in t for t in tagged)


def test_bounds_on_the_sample(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS + ", toxic int")
    seen = []
    monkeypatch.setattr(toxic_crf.Field, "fit", lambda self, bags, y: seen.append((len(bags), sum(map(len, bags)))) or self)
    toxic_crf.fit(df.unionAll(df), df, max_fit_docs=50)
    toxic_crf.fit(df, df, max_fit_words=1000)
    assert seen == [(50, 2000), (25, 1000)]


def test_odd_rows_and_labels(spark):
    df = spark.createDataFrame(ODD, DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxic_crf.fit(df, none)
    got = toxic_crf.tag(df, model).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5} and not any(r.toxic_spans for r in got)
    assert toxic_crf.tag(df.limit(0), model).count() == 0
    rows = corpus()
    both = spark.createDataFrame([*((i, t) for i, t, _ in rows), *((1000 + k, t) for k, (_, t) in enumerate(ODD))], DOCS)
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (0, None), (3, 7), (None, 1), (1000, 1), (1001, 0)], "doc_id long, toxic int")
    model = toxic_crf.fit(both, labels)
    scores = {(r.doc_id, r.text): r.score for r in toxic_crf.tag(df, model).collect()}
    assert max(scores.values()) < 0.5 and scores[(1, None)] == scores[(2, "")] == scores[(3, " \n\t")]
    repeated = spark.createDataFrame([*((i, y) for i, _, y in rows)] * 2, "doc_id long, toxic int")
    assert toxic_crf.fit(both, repeated).constant is None


@pytest.mark.parametrize(("sf", "least"), [("0.001", 0.9), ("0.01", 0.92)])
def test_held_out_accuracy(spark, sf, least):
    folder = f"/root/testdata/sf{sf}"
    got = queries.op13_toxic_crf(spark, folder).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id").query("held_out")
    assert (held.predicted == held.toxic).mean() > least
