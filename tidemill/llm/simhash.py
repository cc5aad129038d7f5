"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the leaves of a binary trie.  The self-join walks pairs of
trie nodes together, adds up the bits in which their paths differ, and drops a
pair as soon as the Hamming budget is exceeded.  Spark deals out the pairs of
upper trie nodes; a task walks below one pair and returns a spanning forest of
the links it finds, so a group of n mutually similar texts costs n rows, not n².
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import cut, free_name, per_row

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Distinct fingerprints below one upper trie node, about; nodes with more than CROWDED times as many are split further.
NODE_SIZE = 1 << 18
CROWDED = 4
#: Levels by which crowded pairs of nodes are split at a time.
LEVELS = 3


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one UTF-8 text; 0 if it has no words."""
    words = (text or b"").lower().split()  # bytes: ASCII case and ASCII space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        first, last = [0], [len(line)]
    else:
        first, last = [0, *(ends[:-shingle] + 1).tolist()], ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(first), 65_536):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[k : k + 65_536], last[k : k + 65_536])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint's 64 bits as a signed long.

    Null or blank text: 0.  Fewer words than a shingle: the whole sequence.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def rows(doc_id, text):
        fp = fingerprint(text, shingle)
        yield (doc_id.decode() if isinstance(doc_id, bytes) else doc_id), fp - (1 << 64) if fp >> 63 else fp

    return per_row(source, ["doc_id", "text"], f"doc_id {kind}, fp long", rows)


# ---- the walk below one pair of upper nodes -----------------------------------------------------


class Forest:
    """Union-find over 0..n-1 on whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _pairs(lo_a, n_a, lo_b, n_b):
    """All index pairs of small node pairs, as two flat arrays."""
    size = n_a * n_b
    start = np.cumsum(size) - size
    k = np.arange(size.sum()) - np.repeat(start, size)
    width = np.repeat(n_b, size)
    return np.repeat(lo_a, size) + k // width, np.repeat(lo_b, size) + k % width


def walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, differ: int, budget: int, found, small: int = 64, block: int = 1 << 17) -> None:
    """Traverse pairs of nodes of two sorted fingerprint arrays; ``found(i, j)`` gets linked indexes.

    Each entry of a frontier is a pair of index ranges (nodes) at one depth and
    the number of differing bits so far.  Memory: one block per open depth.
    """
    whole = np.array([[0, len(a), 0, len(b), differ]], np.int64).T
    stack = [(depth, whole)]
    while stack:
        d, front = stack.pop()
        if front.shape[1] > block:
            stack += [(d, front[:, k : k + block]) for k in range(0, front.shape[1], block)]
            continue
        a0, a1, b0, b1, diff = front
        ready = (a1 - a0) * (b1 - b0) <= (small if d < 64 else 1 << 62)
        if ready.any():
            r = front[:, ready]
            i, j = _pairs(r[0], r[1] - r[0], r[2], r[3] - r[2])
            hit = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                hit &= i < j
            found(i[hit], j[hit])
            a0, a1, b0, b1, diff = front[:, ~ready]
        if not len(a0):
            continue
        bit = np.uint64(1 << (63 - d))
        above = np.uint64(((1 << d) - 1) << (64 - d) if d else 0)
        ma = np.clip(np.searchsorted(a, (a[a0] & above) | bit), a0, a1)
        mb = np.clip(np.searchsorted(b, (b[b0] & above) | bit), b0, b1)
        twin = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        children = [
            np.stack([a0, ma, b0, mb, diff]),
            np.stack([ma, a1, mb, b1, diff]),
            np.stack([a0, ma, mb, b1, diff + 1]),
            np.stack([ma, a1, b0, mb, diff + 1])[:, ~twin],
        ]
        below = np.concatenate(children, axis=1)
        keep = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget)
        stack.append((d + 1, below[:, keep]))


def _unit(budget: int, depth: int):
    """applyInArrow function: all links below one pair of upper nodes, as (fp, root) stars."""

    def run(table: pa.Table) -> pa.Table:
        fp, side = table["fp"].to_numpy().view(np.uint64), table["side"].to_numpy()
        path = table["path"].to_numpy().view(np.uint64)
        order = np.argsort(path)
        fp, side, path = fp[order], side[order], path[order]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        forest = Forest(len(fp))
        if not len(right):
            walk(path[left], path[left], True, depth, 0, budget, lambda i, j: forest.add(left[i], left[j]))
        elif len(left):
            top = np.bitwise_count((path[left[0]] ^ path[right[0]]) >> np.uint64(64 - depth))
            walk(path[left], path[right], False, depth, int(top), budget, lambda i, j: forest.add(left[i], right[j]))
        linked = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pa.table({"u": fp[linked].view(np.int64), "v": fp[forest.root[linked]].view(np.int64)})

    return run


def link_forest(prints: DataFrame, budget: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (u, v) that connect what all links of at most ``budget`` bits connect.

    ``prints``: distinct fingerprints in column ``fp``.  The trie tests the most
    evenly split bits first; the order of bits does not change a distance.  Pairs
    of upper nodes below which too many fingerprints lie are split further, they
    alone, so that near copies of one text never fill one task.
    """
    ones = prints.agg(F.count("*").alias("n"), *(F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64))).first()
    n = ones["n"]
    balance = sorted(range(64), key=lambda i: (abs(2 * (ones[f"b{i}"] or 0) - n), i))
    depth = min(20, max(3 if n > 4096 else 0, math.ceil(math.log2(max(1, n) / node_size))))
    path = F.lit(0).cast("long")
    for to, bit in enumerate(balance):
        path = path.bitwiseOR(F.shiftleft(F.shiftright("fp", bit).bitwiseAND(F.lit(1).cast("long")), 63 - to))
    zero = F.lit(0).cast("long")
    rows = prints.select("fp", path.alias("path"), zero.alias("lo"), zero.alias("hi"), F.lit(0).alias("side"), F.lit(budget).alias("left"))
    if depth:
        rows = _deeper(rows, 0, depth, budget)
    links = None
    while True:
        sizes = rows.groupBy("lo", "hi").agg(F.greatest(F.sum("side"), F.sum(1 - F.col("side"))).alias("most"))
        crowded = sizes.where(F.col("most") > CROWDED * node_size).select(F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
        if depth + LEVELS > 62 or crowded.isEmpty():
            found = rows.groupBy("lo", "hi").applyInArrow(_unit(budget, depth), "u long, v long")
            return links.union(found) if links is not None else found
        crowded = cut(crowded)
        same = (F.col("lo") == F.col("lo1")) & (F.col("hi") == F.col("hi1"))
        found = rows.join(crowded, same, "left_anti").groupBy("lo", "hi").applyInArrow(_unit(budget, depth), "u long, v long")
        links = links.union(found) if links is not None else found
        rows = cut(_deeper(rows.join(crowded, same).drop("lo1", "hi1"), depth, LEVELS, budget))
        depth += LEVELS


def _deeper(rows: DataFrame, depth: int, levels: int, budget: int) -> DataFrame:
    """Rows of pairs of nodes (lo, hi) at ``depth``, dealt to the pairs of nodes ``levels`` below within the budget that is left."""
    masks = sorted({sum(1 << b for b in c) for k in range(min(budget, levels) + 1) for c in _choose(levels, k)})
    known = F.filter(F.lit(masks).cast("array<long>"), lambda m: F.bit_count(m) <= F.col("left"))
    own = F.shiftrightunsigned("path", 64 - depth - levels).bitwiseAND(F.lit((1 << levels) - 1).cast("long"))
    dealt = rows.withColumn("mask", F.explode(known)).withColumn("own", own).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    twin, first = F.col("lo") == F.col("hi"), F.col("side") == 0
    lo = F.when(twin, F.least("own", "other")).when(first, F.col("own")).otherwise(F.col("other"))
    hi = F.when(twin, F.greatest("own", "other")).when(first, F.col("other")).otherwise(F.col("own"))
    return dealt.select(
        "fp", "path", (F.shiftleft("lo", levels) + lo).alias("lo"), (F.shiftleft("hi", levels) + hi).alias("hi"),
        F.when(twin, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side")).alias("side"), (F.col("left") - F.bit_count("mask")).alias("left"),
    )


def _choose(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for each node with a link: root is the component's smallest node.

    Alternating large and small stars (Kiveris et al. 2014), each a grouped
    minimum and a join; two numbers a round come to the driver.  Nodes may be
    of any type that has an order.  Raises if ``rounds`` do not suffice.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            made = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return made.where(F.col("u") != F.col("v")).distinct()

    edges, before = cut(links.where(F.col("u") != F.col("v")).select("u", "v").distinct()), None
    for _ in range(rounds):
        edges = cut(star(star(edges, True), False))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = MAX_BITS, shingle: int = SHINGLE, node_size: int = NODE_SIZE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Repeated rows and equal texts share a fingerprint and so a component.  A
    null doc_id is never a component's id unless the component has no other.
    Other columns of ``docs`` are ignored.  Empty input: no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_forest(nodes.select("fp"), budget, node_size))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, one for each SimHash group: the smallest doc_id's.

    Rows that repeat an id are reduced to one.  Columns stay as they are.
    """
    groups = simhash_groups(docs, id_col, text_col, **options)
    ids, n = free_name(docs, "stay_id"), free_name(docs, "stay_n")
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = docs.join(cut(stay.select(F.col("doc_id").alias(ids), F.col("n").alias(n))), docs[id_col].eqNullSafe(F.col(ids)))
    once = kept.where(F.col(n) == 1).select(*docs.columns)
    again = kept.where(F.col(n) > 1).select(*docs.columns).dropDuplicates([id_col])
    return once.unionByName(again)
