import hashlib
import math
import os

import numpy as np
import pytest

from compare import assert_same
from tidemill.llm import vector_codes as V
from tidemill.llm import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

SCHEMA = "vec_id long, label int, embedding array<float>, code string, id string"


def slow(rows, parts=16, entries=64, rounds=2):
    kept = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for *_, v in kept) // parts))
    kept = [(i, y, v + [0] * (parts * width - len(v))) for i, y, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for *_, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        now = [[near(v, p)[1] for p in range(parts)] for *_, v in kept]
        for p in range(parts):
            for e in range(len(first)):
                mine = [cut(v, p) for (*_, v), code in zip(kept, now) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    told = [(i, y, [near(v, p) for p in range(parts)]) for i, y, v in kept]
    label = {}
    for _, y, n in told:
        label[y] = label.get(y, 0) + sum(d for d, _ in n)
    return sorted(str((i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), label[y], digest)) for i, y, n in told)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(str(tuple(r)) for r in V.compress(df, **options).collect())


def vectors(seed, n, dims, digits=2):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(3)) if rng.random() < 0.9 else None, [float(np.float32(x)) for x in np.round(rng.normal(0, 0.2, dims), digits)]) for i in rng.permutation(n)]


@pytest.mark.parametrize("seed,n,dims,options", [(1, 150, 32, {}), (2, 120, 12, {"parts": 4, "entries": 9, "rounds": 4}), (3, 90, 16, {"entries": 5, "rounds": 1}), (4, 30, 8, {"parts": 2, "rounds": 0})])
def test_equals_plain_loops(spark, seed, n, dims, options):
    rows = vectors(seed, n, dims, 1 if seed == 3 else 2)  # few values: many ties
    assert found(spark, rows, **options) == slow(rows, **options)


def test_nulls_lengths_repeats_and_empty(spark):
    rows = vectors(5, 70, 10, 1) + [(None, None, [0.5] * 7), (3, 1, None), (4, 2, [0.1, None]), (5, 0, [float("nan")]), (6, 0, [float("-inf")]), (7, 1, []), (7, 1, [0.25] * 40)]
    rows += rows[:30]
    assert found(spark, rows) == slow(rows)
    assert found(spark, []) == [] and found(spark, [(1, 1, None)]) == []
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, 1, [1e30])])


def test_bounds_prune_and_never_decide_wrongly():
    rng = np.random.default_rng(6)
    x, book = rng.integers(-80, 80, (4000, 4)), rng.integers(-80, 80, (64, 4))
    book[7] = book[3]  # equal entries
    code, d, lower = V.assign_all(x, book)
    upper = V.root_up(d)
    for _ in range(4):
        new = book + rng.integers(-2, 3, book.shape)
        moved = V.root_up(((new - book) ** 2).sum(1))
        book = new
        lower, upper = np.maximum(lower.astype(np.int64) - moved, 0), upper + moved[code]
        code, upper, lower, computed = V.assign_by_bounds(x, book, code, upper, lower)
        d = V.squares(x, book)
        assert (code == d.argmin(1)).all() and computed < 0.25 * d.size
        assert (upper**2 >= d[np.arange(len(x)), code]).all() and (lower**2 <= d).all()


def test_roots():
    x = np.array([0, 1, 2, 3, 4, 8, 9, 10, (1 << 60) - 1, 1 << 60, (1 << 60) + 1])
    assert V.root_down(x).tolist() == [math.isqrt(int(v)) for v in x]
    assert V.root_up(x).tolist() == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in x]


def test_query_equals_its_sql(spark):
    assert_same(queries.op13_vector_codes(spark, SF), queries.oracle_sql()["op13_vector_codes"], SF)
