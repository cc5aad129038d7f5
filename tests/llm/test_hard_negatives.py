import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import assert_same
from tidemill.llm import hard_negatives as H
from tidemill.llm import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

SCHEMA = "vec_id long, label int, embedding array<float>, row string, score long"


def slow(rows, positives=5, negatives=10, low=30, high=90):
    """Rows of the contract by plain loops; rows are told apart by their place."""
    kept = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: (i is None, i or 0)
    out = []
    for n, (a, y, v) in enumerate(kept):
        if a is None or a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), key(i), m, i, z) for m, (i, z, w) in enumerate(kept)]
        for s, _, _, i, _ in sorted(x for x in scored if x[4] == y and x[2] != n)[:positives]:
            fit = sorted(x for x in scored if x[4] != y and -low * s <= -100 * x[0] <= -high * s)[:negatives]
            out += [(a, i, k + 1, x[3], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(map(str, out))


def vectors(seed, n, dims, labels, spread=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (labels, dims))
    rows = []
    for i in range(n):
        y = int(rng.integers(labels)) if rng.random() < 0.6 else 0  # a hot label
        rows.append((i * 10, y, [float(np.float32(x)) for x in np.round(centre[y] * 0.5 + 0.3 * centre.mean(0) + rng.normal(0, spread, dims), 2)]))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(str(tuple(r)) for r in H.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect())


@pytest.mark.parametrize("seed,dims,labels,sizes", [(1, 8, 3, {}), (2, 10, 4, {"anchors_a_block": 3, "rows_a_block": 7, "strip": 2, "chunk": 3}), (3, 5, 90, {"rows_a_block": 20, "chunk": 2})])
def test_equals_plain_loops(spark, seed, dims, labels, sizes):
    rows = vectors(seed, 150, dims, labels)
    want = slow(rows)
    assert want or labels == 90
    assert found(spark, rows, **sizes) == want


def test_pairs_of_blocks_meet_over_many_partitions(spark):
    rows = vectors(9, 300, 8, 6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, rows_a_block=20, anchors_a_block=4, chunk=3) == slow(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_ties_repeats_nulls_and_lengths(spark):
    rows = vectors(4, 40, 6, 2, spread=0.0) * 2  # equal vectors: ties everywhere, every row twice
    rows += [(None, 1, [0.5] * 6), (1000, None, [0.5] * 6), (1100, 0, None), (1200, 0, [0.1, None]), (1300, 1, [float("nan")]), (1400, 0, [float("inf")] * 6), (1500, 1, [0.9] * 9), (1600, 0, []), (1700, 0, [0.3])]
    padded = [(i, y, v if v is None or any(x is None for x in v) else v + [0.0] * (9 - len(v))) for i, y, v in rows]
    assert found(spark, rows, rows_a_block=16, chunk=4) == slow(padded)


def test_empty_and_no_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, 1, [0.1]), (7, 1, [0.2])]) == []
    assert found(spark, [(100, 1, [0.1])]) == []


def test_product_is_exact_or_raises():
    a = np.array([[1 << 26, -(1 << 25)]])
    assert H.product(a, a)[0, 0] == (1 << 52) + (1 << 50)
    with pytest.raises(ValueError):
        H.product(a << 4, a << 4)


def test_query_equals_its_sql(spark):
    assert_same(queries.op11_hard_negatives(spark, SF), queries.oracle_sql()["op11_hard_negatives"], SF)
