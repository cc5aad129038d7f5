"""Exact substring deduplication with suffix arrays.

Every byte of a 200-byte string that starts at two places is removed.  Windows
of 200 bytes are dealt into shards by their minimizer (the least hash among the
64-byte strings inside), so equal windows meet; neighbouring windows with one
minimizer travel as one piece of text.  Pieces whose minimizer occurs once are
settled at once, as are pieces all of whose rivals are identical.  The rest is
sorted, shard by shard, by external induced sorting (see ``induced``), and
neighbouring suffixes that share 200 bytes are repeated.  Should one minimizer
have more pieces than a task ought to sort, as where countless texts go on
differently after one passage, the windows of those pieces are counted by
128-bit hashes instead, which no hot group slows down.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced
from ._base import as_bytes, cut, per_row, release, text_key, with_hashes

WINDOW = 200
MINIMIZER = 64
#: Bytes of text in one suffix array, about; one minimizer's pieces stay together.
SHARD_BYTES = 2 << 20
#: Pieces of one minimizer that take more than so many shards' bytes are settled window by window.
CROWDED = 16
#: Bytes of queues that a sort holds in memory before it uses its scratch file.
QUEUE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
#: Windows handled at once: places must fit the low 24 bits of a key.
_STRETCH = 1 << 20


def _hashes(text: np.ndarray, size: int) -> np.ndarray:
    """Mixed 64-bit hash of the ``size`` (a power of two) bytes from each position."""
    h, width = text.astype(np.uint64) + np.uint64(1), 1
    while width < size:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive keys."""
    width = 1
    while 2 * width <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = span - width
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def pieces(text: bytes, window: int = WINDOW, size: int = MINIMIZER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimizer hash) of runs of windows with one minimizer."""
    n = len(text) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first, hashes = [], []
    raw = np.frombuffer(text, np.uint8)
    for a in range(0, n, _STRETCH):
        b = min(n, a + _STRETCH)
        h = _hashes(raw[a : b + window - 1], size)
        low = _least(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), window - size + 1)
        at = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        first.append(at + a)
        hashes.append(h[(low[at] & _PLACE).astype(np.int64)])
    first = np.concatenate(first)
    return first, np.diff(np.append(first, n)), np.concatenate(hashes).view(np.int64)


def _anchors(window: int, size: int):
    """Arrow map over texts: (anchor, n) of each text's pieces, n up to 2."""

    def run(batches):
        for batch in batches:
            held = []
            for text in as_bytes(batch.column("text")):
                anchor, n = np.unique(pieces(text, window, size)[2], return_counts=True)
                held.append((anchor, np.minimum(n, 2)))
            if held:
                anchor, n = (np.concatenate(v) for v in zip(*held))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    return run


def _occurrences(window: int, size: int):
    """Arrow map over (key, text): different pieces of each text as (anchor, key, digest, places).

    A place packs first window and windows.
    """

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), as_bytes(batch.column("text"))):
                first, count, anchor = pieces(text, window, size)
                if not len(first):
                    continue
                hash_of = xxhash.xxh3_64_intdigest
                digest = np.array([hash_of(text[a : a + c + window - 1]) for a, c in zip(first.tolist(), count.tolist())], np.uint64).view(np.int64)
                order = np.argsort(digest, kind="stable")
                digest = digest[order]
                begin = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
                held.append((anchor[order][begin], np.full(len(begin), key), digest[begin], np.diff(np.append(begin, len(order))), (first << 24 | count)[order]))
                rows += len(order)
            if rows > 100_000:
                yield pack(held)
                held, rows = [], 0
        if held:
            yield pack(held)

    def pack(held):
        anchor, key, digest, n, places = (np.concatenate(v) for v in zip(*held))
        ends = np.append(0, np.cumsum(n)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key), pa.array(digest), pa.ListArray.from_arrays(ends, places)], names=["anchor", "key", "digest", "places"])

    return run


def _sorter(window: int, queue_bytes: int):
    """Arrow map over one shard's (anchor, digest, piece): repeated windows as runs [from, to)."""

    def run(batches):
        rows = [(a, d, p) for batch in batches for a, d, p in zip(batch.column("anchor").to_pylist(), batch.column("digest").to_pylist(), batch.column("piece").to_pylist())]
        if not rows:
            return
        out = []
        for (anchor, digest, _), hit in zip(rows, induced.repeated_windows([p for _, _, p in rows], window, queue_bytes)):
            turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            out += [(anchor, digest, a, b) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist())]
        for k in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out[k : k + 100_000])], names=["anchor", "digest", "from", "to"])

    return run


def _windows(window: int):
    """Arrow map over (anchor, digest, piece): (anchor, digest, from, hash) of each window of the pieces."""

    def run(batches):
        for batch in batches:
            for anchor, digest, piece in zip(batch.column("anchor").to_pylist(), batch.column("digest").to_pylist(), batch.column("piece").to_pylist()):
                n = len(piece) - window + 1
                for a in range(0, n, 50_000):
                    at = range(a, min(n, a + 50_000))
                    hashes = pa.array([xxhash.xxh3_128_digest(piece[i : i + window]) for i in at], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([anchor] * len(at)), pa.array([digest] * len(at)), pa.array(at, pa.int64()), hashes], names=["anchor", "digest", "from", "hash"])

    return run


def _covered(text: bytes, ranges, window: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows in ranges of window starts [from, to)."""
    edge = np.zeros(len(text) + 1, np.int64)
    for r in ranges or ():
        if r["to"] > r["from"] and r["to"] + window - 1 <= len(text):
            edge[r["from"]] += 1
            edge[r["to"] + window - 1] -= 1
    turn = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def repeated_ranges(keyed: DataFrame, window: int = WINDOW, size: int = MINIMIZER, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES, crowded: int = CROWDED) -> DataFrame:
    """(key, ranges) from (doc_id, key, text): for each distinct text the starts [from, to) of repeated windows.

    The join that cuts pieces from texts takes the columns and the partitioning
    that the caller's last join takes, so that Spark moves the texts once for both.
    """
    often = keyed.select("text").mapInArrow(_anchors(window, size), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    found = keyed.select("key", "text").mapInArrow(_occurrences(window, size), "anchor long, key long, digest long, places array<long>")
    shared = cut(found.join(often, "anchor"))
    rivals = shared.groupBy("anchor").agg((F.min("digest") != F.max("digest")).alias("mixed")).where("mixed").select("anchor")
    kinds = shared.join(rivals, "anchor").groupBy("anchor", "digest").agg(F.sum(F.size("places")).alias("total"), F.min(F.struct("key", F.col("places")[0].alias("place"))).alias("one"))
    kinds = cut(kinds.select("anchor", "digest", (F.col("total") > 1).alias("twice"), "one.key", "one.place"))
    del often, found, rivals
    release(keyed.sparkSession)

    def slices(doc_id, key, text, wanted):
        for w in wanted:
            first, count = w["place"] >> 24, w["place"] & 0xFFFFFF
            piece = text[first : first + count + window - 1]
            if xxhash.xxh3_64_intdigest(piece) == w["digest"] % (1 << 64):
                yield w["anchor"], w["digest"], piece

    volumes = kinds.groupBy("anchor").agg(F.sum(F.col("place").bitwiseAND(F.lit(0xFFFFFF)) + (window - 1)).alias("volume"))
    volume, most = volumes.agg(F.sum("volume"), F.max("volume")).first()
    volume, most = volume or 0, most or 0
    wanted = kinds.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "place")).alias("wanted"))
    texts = per_row(keyed.join(wanted, "key"), ["doc_id", "key", "text", "wanted"], "anchor long, digest long, piece binary", slices)
    texts = texts.groupBy("anchor", "digest").agg(F.first("piece").alias("piece"))  # copies of a text give a piece more than once
    counted = None
    if most > crowded * shard_bytes:
        heavy = cut(volumes.where(F.col("volume") > crowded * shard_bytes).select("anchor"))
        texts = cut(texts)
        windows = texts.join(heavy, "anchor").mapInArrow(_windows(window), "anchor long, digest long, `from` long, hash binary")
        again = windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        counted = windows.join(again, "hash").select("anchor", "digest", "from", (F.col("from") + 1).alias("to"))
        texts = texts.join(heavy, "anchor", "left_anti")
    sorted_ = texts.repartition(max(1, -(-volume // shard_bytes)), "anchor").mapInArrow(_sorter(window, queue_bytes), "anchor long, digest long, `from` long, `to` long")

    if counted is not None:
        sorted_ = sorted_.union(counted)
    first, count = F.shiftright("place", 24), F.col("place").bitwiseAND(F.lit(0xFFFFFF))
    single = kinds.where(~F.col("twice")).select("key", "place", "anchor", "digest").join(sorted_, ["anchor", "digest"]).select("key", (first + F.col("from")).alias("from"), (first + F.col("to")).alias("to"))
    open_ = kinds.where(~F.col("twice")).select("anchor", "digest")
    whole = shared.join(open_, ["anchor", "digest"], "left_anti").select("key", F.explode("places").alias("place"))
    ranges = whole.select("key", first.alias("from"), (first + count).alias("to")).union(single)
    return ranges.groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain).

    Each byte under a ``window``-byte string that also starts anywhere else, in
    this text or another, is removed, judged on the input.  Null is an empty
    text; a text shorter than ``window`` keeps all; repeated rows are copies of
    each other, so they lose every byte if they are long enough.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = with_hashes(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")))
    named = hashed.select("doc_id", text_key(hashed).alias("key"), "text")
    ranges = repeated_ranges(named, window, **options)
    kind = dict(named.dtypes)["doc_id"]

    def rows(doc_id, key, text, found):
        runs, keep, at = _covered(text, found, window), [], 0
        for a, b in runs:
            keep.append(text[at:a])
            at = b
        kept = b"".join([*keep, text[at:]])
        yield doc_id.decode() if isinstance(doc_id, bytes) else doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept

    joined = named.join(ranges, "key", "left")
    return per_row(joined, ["doc_id", "key", "text", "ranges"], f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", rows)
