"""Hard-negative mining by a two-dimensional block matrix product.

Anchors times all rows is a matrix product.  Rows are dealt to blocks, vectors
are cut into chunks of dimensions, and Spark joins each anchor block with each
row block chunk by chunk.  A task multiplies one pair of blocks; the partial
int64 tiles are shuffled by their place and added, and each whole tile is
reduced at once to the top rows per anchor (first product, same label) or per
anchor and positive (second product, other labels).  No task holds more than a
pair of blocks or the chunks of one strip of a tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut, forget, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 30, 90
#: Anchors and rows of a block, about; anchors of one strip of a tile; dimensions of a chunk.
ANCHORS, ROWS, STRIP, CHUNK = 512, 2048, 64, 32
#: Labels are dealt to so many groups, and blocks are of one group.
GROUPS = 64
LEAST = np.iinfo(np.int64).min + 1


def whole_vectors(vectors: DataFrame, vector_col: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as an array of long."""
    return F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(F.lit(scale) * x.cast("double")))


def finite(vector_col: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = F.col(f"`{vector_col}`")
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(False))


# ---- blocks ------------------------------------------------------------------------------------

_BLOCK = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32()), ("about", pa.binary()), ("part", pa.binary())])
_BLOCK_DDL = "block long, chunk int, n int, about binary, part binary"


def _packed(chunks: int, chunk: int):
    """applyInArrow function: the rows of one block as one row for each chunk of dimensions.

    Rows are in the order in which ties are settled: by id, nulls last, then by row number.  ``about`` has, of
    each row, the row number, the id, whether the id is missing, the label, and the scores of its positives.
    """

    def run(table: pa.Table) -> pa.Table:
        row, label = table["row"].to_numpy(), table["label"].to_numpy()
        missing = np.asarray(table["id"].is_null()).astype(np.int64)
        ids = table["id"].fill_null(0).to_numpy()
        order = np.lexsort((row, ids, missing))
        lists = table["v"].combine_chunks()
        size = np.asarray(lists.value_lengths())
        dense = np.zeros((len(row), chunks * chunk), np.int64)
        dense[np.repeat(np.arange(len(row)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten())
        told = [row, ids, missing, label]
        if "wanted" in table.column_names:
            told += list(np.array(table["wanted"].to_pylist(), np.int64).reshape(len(row), -1).T)
        about = np.stack(told)[:, order].astype(np.int64)
        parts = [np.ascontiguousarray(dense[order, k * chunk : (k + 1) * chunk]).tobytes() for k in range(chunks)]
        made = [[int(table["block"][0].as_py())] * chunks, list(range(chunks)), [len(row)] * chunks, [about.tobytes(), *[None] * (chunks - 1)], parts]
        return pa.table([pa.array(x, f.type) for x, f in zip(made, _BLOCK)], schema=_BLOCK)

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly; raises where sums may leave 64 bits."""
    most = max(1, a.shape[1]) * (int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)))
    if most < 1 << 53:  # whole numbers of this size are exact as doubles
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 56:
        raise ValueError("scores of these vectors may leave 64 bits")
    return a @ b.T


def _partial(chunk: int, strip: int):
    """applyInArrow function: one pair of blocks, one chunk; strips of the partial tile."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("strip", pa.int32()), ("na", pa.int32()), ("nb", pa.int32()), ("tile", pa.binary()), ("anchors", pa.binary()), ("others", pa.binary())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            one, two = left.to_pylist()[0], right.to_pylist()[0]
            a = np.frombuffer(one["part"], np.int64).reshape(one["n"], chunk)
            b = np.frombuffer(two["part"], np.int64).reshape(two["n"], chunk)
            about = np.frombuffer(one["about"], np.int64).reshape(-1, one["n"]) if one["about"] else None
            for at in range(0, len(a), strip):
                tile = product(a[at : at + strip], b)
                rows.append((one["pa"], two["pb"], at // strip, len(tile), len(b), tile.tobytes(), about[:, at : at + strip].tobytes() if about is not None else None, two["about"]))
        return pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)

    return run, "a long, b long, strip int, na int, nb int, tile binary, anchors binary, others binary"


def _added(table: pa.Table, chunks: int):
    """The whole strip of a tile from its partial ones, and what is known of its anchors and rows."""
    if table.num_rows != chunks:
        raise RuntimeError(f"{table.num_rows} of {chunks} partial tiles")
    tile, anchors, others = 0, None, None
    for k in range(table.num_rows):
        na, nb = table["na"][k].as_py(), table["nb"][k].as_py()
        tile = tile + np.frombuffer(table["tile"][k].as_py(), np.int64).reshape(na, nb)
        if table["anchors"][k].is_valid:
            anchors = np.frombuffer(table["anchors"][k].as_py(), np.int64).reshape(-1, na)
            others = np.frombuffer(table["others"][k].as_py(), np.int64).reshape(-1, nb)
    return tile, anchors, others


_FOUND = pa.schema([("row", pa.int64()), ("nth", pa.int32()), ("other", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "row long, nth int, other long, other_id long, score long"


def _found(anchor, nth, other, others, score):
    ids = pa.array(others[1][other], pa.int64(), mask=others[2][other] == 1)
    return pa.table([pa.array(anchor, pa.int64()), pa.array(nth, pa.int32()), pa.array(others[0][other], pa.int64()), ids, pa.array(score, pa.int64())], schema=_FOUND)


def top_same(tile, anchors, others, k: int):
    """Of each anchor the first k other rows of its label."""
    fit = (anchors[3][:, None] == others[3]) & (anchors[0][:, None] != others[0])
    masked = np.where(fit, tile, LEAST)
    order = np.argsort(-masked, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(masked, order, 1)
    i, j = np.nonzero(np.take_along_axis(fit, order, 1))
    return _found(anchors[0][i], np.zeros(len(i)), order[i, j], others, score[i, j])


def top_windows(tile, anchors, others, k: int, low: int, high: int):
    """Of each anchor and positive the first k rows of other labels whose score is in the positive's window."""
    wanted = anchors[4:].T  # scores of positives; -1 where there is none, or its window is empty
    masked = np.where(anchors[3][:, None] != others[3], tile, LEAST)
    order = np.argsort(-masked, axis=1, kind="stable")
    falling = -np.take_along_axis(masked, order, 1)
    most, least = wanted * high // 100, -(-wanted * low // 100)
    first = np.stack([np.searchsorted(falling[i], -most[i]) for i in range(len(wanted))])
    place = first[:, :, None] + np.arange(k)
    inside = place < tile.shape[1]
    place = np.minimum(place, tile.shape[1] - 1)
    score = -np.take_along_axis(falling[:, None, :], place, 2)
    i, p, j = np.nonzero(inside & (wanted >= 0)[:, :, None] & (score >= least[:, :, None]))
    at = place[i, p, j]
    return _found(anchors[0][i], p, order[i, at], others, score[i, p, j])


def _tiles(anchors: DataFrame, rows: DataFrame, chunks: int, chunk: int, strip: int, reduce) -> DataFrame:
    """Blocks with partners (``to``) multiplied chunk by chunk, partial tiles added, whole ones reduced."""
    to = F.explode(F.col("to").cast("array<long>"))  # cogroup deals by hash, so keys are of one type on both sides
    left = anchors.select(F.col("block").alias("pa"), to.alias("pb"), "chunk", "n", "about", "part")
    right = rows.select(F.col("block").alias("pb"), to.alias("pa"), "chunk", "n", "about", "part")
    keys = ["pa", "pb", "chunk"]
    run, ddl = _partial(chunk, strip)
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, ddl)
    return partial.groupBy("a", "b", "strip").applyInArrow(lambda table: reduce(*_added(table, chunks)), _FOUND_DDL)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, anchors_a_block: int = ANCHORS, rows_a_block: int = ROWS, strip: int = STRIP, chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of the vectors' components floor(scale * x).
    Higher scores come first, ties by smaller id (null last).  ``is_anchor``
    chooses anchors; an anchor's positives are its first rows of the same label
    but for itself; a positive's negatives are the first rows of other labels
    whose scores are from ``low`` to ``high`` percent of the positive's.

    Rows whose label, vector or any component is null or not finite take no
    part.  Rows that repeat an id are rows of their own: each may be an anchor,
    and each other's positive.  Vectors that are shorter than others count as
    followed by zeros.  ``id_col`` and ``label_col`` are whole numbers.  Other
    columns are ignored.  No rows, anchors or positives: no rows.  Raises if
    scores may leave 64 bits (components beyond some 2^25).
    """
    kept = vectors.where(F.col(f"`{label_col}`").isNotNull() & finite(vector_col)).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), whole_vectors(vectors, vector_col, scale).alias("v"),
    )
    rows, path = stored(kept.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")))
    told = rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), (F.min("label") == F.max("label")).alias("pure"), F.max(F.size("v")).alias("dims")).collect()
    chunks = max(1, math.ceil(max([0, *(r.dims for r in told)]) / chunk))
    own, mine, pure, n_own, n_mine = {}, {}, {}, 0, 0
    for r in sorted(told):  # at most GROUPS of them
        own[r.group] = (n_own, math.ceil(r.n / rows_a_block))
        mine[r.group] = (n_mine, math.ceil(r.anchors / anchors_a_block))
        pure[r.group], n_own, n_mine = r.pure, n_own + own[r.group][1], n_mine + mine[r.group][1]

    def of_group(values: dict, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(values.get(g)).cast(kind) for g in range(GROUPS))), F.col("group") + 1)

    def blocks(df: DataFrame, within: dict) -> DataFrame:
        first, count = of_group({g: x[0] for g, x in within.items()}, "long"), of_group({g: max(1, x[1]) for g, x in within.items()}, "long")
        dealt = df.withColumn("block", first + F.pmod(F.xxhash64("row"), count))
        return dealt.groupBy("block").applyInArrow(_packed(chunks, chunk), _BLOCK_DDL)

    def partners(packed: DataFrame, within: dict, beyond: dict, total: int, same: bool) -> DataFrame:
        """With column ``to``: blocks of the same group, or all but those of the same label."""
        spans = []
        for g, (at, count) in within.items():
            start, many = beyond[g]
            whole = [(start, start + many)] if same else [(0, start), (start + many, total)] if pure[g] else [(0, total)]
            spans += [F.when(F.col("block").between(at, at + count - 1), F.flatten(F.array(*(F.sequence(F.lit(x), F.lit(y - 1)) for x, y in whole if y > x))))] if count and any(y > x for x, y in whole) else []
        return packed.withColumn("to", F.coalesce(*spans, F.lit(None).cast("array<int>")))

    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_mine:
        forget(rows.sparkSession, path)
        return rows.sparkSession.createDataFrame([], columns)
    chosen = rows.where("anchor")
    all_blocks, block_path = stored(blocks(rows, own))
    first = _tiles(partners(blocks(chosen, mine), mine, own, n_own, True), partners(all_blocks, own, mine, n_mine, True), chunks, chunk, strip, lambda *x: top_same(*x, positives))
    order = (F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other")
    near = cut(first.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= positives))
    scores = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.greatest("score", F.lit(-1).cast("long")).alias("score")))).alias("scores"))
    wanted = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(F.element_at("scores", k), F.lit(-1).cast("long")))
    hunting = chosen.join(scores, "row").withColumn("wanted", wanted).drop("scores")
    second = _tiles(partners(blocks(hunting, mine), mine, own, n_own, False), partners(all_blocks, own, mine, n_mine, False), chunks, chunk, strip, lambda *x: top_windows(*x, negatives, low, high))
    hard = second.withColumn("rank", F.row_number().over(Window.partitionBy("row", "nth").orderBy(*order))).where(F.col("rank") <= negatives)
    hard = cut(hard.select("row", (F.col("nth") + 1).alias("nth"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")))
    positive = near.select("row", F.col("rank").alias("nth"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = cut(chosen.select("row", F.col("id").alias("anchor_id")))
    for done in (path, block_path):
        forget(rows.sparkSession, done)
    return hard.join(positive, ["row", "nth"]).join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
