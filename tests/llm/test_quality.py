import zlib

import numpy as np
import pytest

from tessera.llm import quality as q

GOOD = "The rain came in the night and it was gone by the morning of the next day. "
DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def test_statistics_are_finite_and_zero_for_nothing():
    assert q.statistics("") == q.statistics(" \n") == [0.0] * len(q.STATISTICS)
    for t in ("a", "|" * 9, "é" * 50_000, "x y " * 50_000, "\x00", "\n\n."):
        x = q.statistics(t)
        assert len(x) == len(q.STATISTICS) and np.isfinite(x).all()


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        raw, label = rng.integers(0, 12, 40) / 10, rng.integers(0, 2, 40)
        knots, values = q.isotonic(raw, label)
        xs = np.unique(raw)
        sums = np.array([label[raw == x].sum() for x in xs]), np.array([(raw == x).sum() for x in xs])
        # the maximum over starts of the minimum over ends of the means between them
        fit = np.array([max(min(sums[0][i : j + 1].sum() / sums[1][i : j + 1].sum() for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))])
        assert len(knots) == len(np.unique(fit.round(12)))
        assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all() and values.min() >= 0 and values.max() <= 1


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, (GOOD * (1 + i % 5)) if i % 3 else "junk | junk | ### " * (1 + i % 7), None) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], LABELS)
    return docs, labels, q.fit_quality(docs, labels)


def test_scores_and_filter(spark, fitted):
    docs, _, model = fitted
    for r in q.score_documents(docs, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) == int(r.doc_id % 3 > 0)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    odd = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, GOOD, "c"), (2, GOOD, "c")], DOCS)
    assert q.score_documents(odd, model).count() == 4
    kept = q.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.filter("score = 'c'").count() == 2
    assert q.score_documents(odd.limit(0), model).collect() == []


def test_held_out_labels_are_never_read(spark, fitted):
    docs, labels, model = fitted
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    again = q.fit_quality(docs, flipped)
    assert np.array_equal(again.ridge, model.ridge) and np.array_equal(again.values, model.values)


def test_without_labels_or_with_one(spark, fitted):
    docs = fitted[0]
    assert q.fit_quality(docs, spark.createDataFrame([], LABELS)).base == 0.5
    assert q.fit_quality(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)).score(["a", ""]).tolist() == [1.0, 1.0]


def test_held_out_accuracy(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in q.op6_quality(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_query_equals_plain_numpy(spark, sf_dir):
    """The query's scores against ridge regression by least squares and isotonic regression by its min-max formula."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    parts = labels.selectExpr("doc_id", "quality", f"pmod(xxhash64(7, doc_id), 1000) < {int(1000 * q.CALIBRATION)} as calibrates").collect()
    rows = sorted((r.doc_id, r.quality, r.calibrates) for r in parts if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5)
    x = np.array([q.statistics(docs[d]) for d, _, _ in rows], float)
    y, late = np.array([v for _, v, _ in rows], float), np.array([c for _, _, c in rows])
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    rng = np.random.default_rng(7)
    d = x.shape[1]
    model = q.QualityModel(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, q.FEATURES)), rng.uniform(0, 2 * np.pi, q.FEATURES), None, None, None)
    phi = model.features(x)
    fit, n = phi[~late], int((~late).sum())
    root = np.sqrt(np.append(np.full(q.FEATURES, q.RIDGE * n + 1e-9), 1e-9))
    ridge = np.linalg.lstsq(np.vstack([fit, np.diag(root)]), np.append(y[~late], np.zeros(q.FEATURES + 1)), rcond=None)[0]
    raw, label = phi[late] @ ridge, y[late]
    order = np.argsort(raw, kind="stable")
    raw, label = raw[order], label[order]
    sums = np.append(0, np.cumsum(label))
    value = [max(min((sums[k] - sums[j]) / (k - j) for k in range(i + 1, len(raw) + 1)) for j in range(i + 1)) for i in range(len(raw))]
    blocks = [np.flatnonzero(np.abs(np.array(value) - v) < 1e-12) for v in sorted(set(np.round(value, 12)))]
    knots = np.array([raw[b].mean() for b in blocks])
    levels = np.maximum.accumulate([(label[b].sum() + label.mean()) / (len(b) + 1) for b in blocks])
    want = {k: float(np.clip(np.interp(model.features(np.array([q.statistics(t)], float)) @ ridge, knots, levels)[0], 0, 1)) for k, t in docs.items()}
    got = {r.doc_id: r.score for r in q.op6_quality(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-4
