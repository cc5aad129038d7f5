import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import quality

SF = "/root/testdata/sf0.1"


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(5)
    for _ in range(20):
        y, w = rng.random(12), rng.integers(1, 9, 12).astype(float)
        centre, value = quality.isotonic(np.arange(12.0), y, w)
        # min-max formula of the isotonic fit
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(sorted(set(np.round(want, 9))), np.round(value, 9))
        assert (np.diff(centre) > 0).all() and (np.diff(value) > 0).all()


def test_fourier_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    phi = quality.fourier(x, np.zeros(4), np.ones(4), 20_000, 0.5)[:, :-1]
    want = np.exp(-0.125 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(phi @ phi.T - want).max() < 0.05


def test_statistics_of_odd_texts():
    for text in (None, b"", b" ", b"\n", b"a", b"!", b"\xc3\xa9", b"a b\nc " * 50_000):
        found = quality.statistics(text)
        assert len(found) == len(quality.STATISTICS) and np.isfinite(found).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(docs, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").select("score", "predicted", "quality").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert len(rows) > 500 and right > 0.85
    # ranks too: a random good text above a random bad one
    good, bad = (np.array([r.score for r in rows if r.quality == k]) for k in (1, 0))
    assert ((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])).mean() > 0.9


def test_nulls_repeats_and_clashing_columns(spark):
    texts = {i: ("fine words stand here in good order. " * 5 if i % 2 else "x!!! 999 @@ x!!! 999 @@ ") for i in range(60)}
    rows = [(i, t, "x", 0.5, True) for i, t in texts.items()] + [(None, "a b c", "x", 0.5, True), (61, None, "x", 0.5, True), (62, "", "x", 0.5, True), (3, texts[3], "x", 0.5, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 1), (7, None), (None, 1)], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert all(r.predicted == r.doc_id % 2 for r in found if r.doc_id is not None and r.doc_id < 60)
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {None, *range(1, 60, 2)} and kept.where("doc_id < 60 and doc_id % 2 = 0").count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality_scores(docs, labels).collect()] == [0.5, 0.5]
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert quality.quality_scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 2
