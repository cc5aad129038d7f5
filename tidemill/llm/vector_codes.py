"""Vector codes: one small codebook for each part of a vector, fitted by Elkan's Lloyd rounds.

A round reads every row with the bounds that the round before stored: of each
part an upper bound of the distance to its entry, and a lower bound of the
distance to every entry.  Bounds move with the entries; entries that the
triangle inequality rules out strictly are not looked at, and all others are
compared by exact integer distances, so ties go to the lower index.  The
codebooks (parts x entries x width numbers) are all that comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import forget, shared_folder
from .hard_negatives import finite, whole_vectors

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components of larger size are refused: squared distances would leave 64 bits.
MOST = 1 << 28
TOP = np.iinfo(np.uint16).max


def root_down(x: np.ndarray) -> np.ndarray:
    """floor(sqrt(x)) of whole numbers, exactly."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def root_up(x: np.ndarray) -> np.ndarray:
    """ceil(sqrt(x)) of whole numbers, exactly."""
    r = root_down(x)
    return r + (r * r < x)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all entries, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else np.int64  # whole numbers below 2^53 are exact as doubles
    a, b = x.astype(kind), book.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def assign_all(x: np.ndarray, book: np.ndarray):
    """(code, squared distance, lower bounds) of the rows of one part, without bounds to start from."""
    d = squares(x, book)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code], np.minimum(root_down(d), TOP)


def assign_by_bounds(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(code, upper, lower, distances computed): nearest entries of one part, given valid bounds.

    An entry is left out only where a bound proves it strictly farther than
    the present one: lower > upper, or half the distance of the two entries
    > upper.  All else is decided by whole squared distances and the index.
    """
    between = root_down(squares(book, book))
    apart = between + np.where(np.eye(len(book), dtype=bool), np.iinfo(np.int32).max, 0)
    open_ = np.flatnonzero(2 * upper >= apart.min(axis=1)[code])  # else every other entry is strictly farther
    if not len(open_):
        return code, upper, lower, 0
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    own = code[open_]
    d = ((x[open_] - book[own]) ** 2).sum(axis=1)
    upper[open_] = root_up(d)
    lower[open_, own] = np.minimum(root_down(d), TOP)
    may = (lower[open_] <= upper[open_, None]) & (between[own] <= 2 * upper[open_, None])
    may[np.arange(len(open_)), own] = False
    i, e = np.nonzero(may)
    found = ((x[open_[i]] - book[e]) ** 2).sum(axis=1)
    lower[open_[i], e] = np.minimum(root_down(found), TOP)
    at = np.unique(i)
    if len(at):
        all_ = np.full((len(at), len(book)), np.iinfo(np.int64).max)
        all_[np.searchsorted(at, i), e] = found
        all_[np.arange(len(at)), own[at]] = d[at]
        best = all_.argmin(axis=1)
        code[open_[at]] = best
        upper[open_[at]] = root_up(all_[np.arange(len(at)), best])
    return code, upper, lower, len(open_) + len(i)


# ---- rounds over stored rows --------------------------------------------------------------------


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Rows of lists of long as a matrix, shorter ones followed by zeros."""
    length = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), size), np.int64)
    out[np.repeat(np.arange(len(lists)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = np.asarray(lists.flatten())
    if len(out) and np.abs(out).max() > MOST:
        raise ValueError("components of these vectors are too large")
    return out


def _bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _rows(column: pa.Array, kind, shape) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


_STATE = "id {kind}, label {label}, v array<long>, code binary, upper binary, lower binary"


def _round(books: np.ndarray, moved: np.ndarray | None, names: list[str]):
    """mapInArrow function: the next assignment, from scratch or from the bounds of the last one."""
    parts, entries, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["v"], parts * width).reshape(-1, parts, width)
            n = len(x)
            code, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64), np.zeros((n, parts, entries), np.uint16)
            if moved is not None:
                code, upper = _rows(batch["code"], np.uint8, (parts,)).copy(), _rows(batch["upper"], np.int64, (parts,)).copy()
                lower = _rows(batch["lower"], np.uint16, (parts, entries)).copy()
            for p in range(parts):
                if moved is None:
                    own, d, low = assign_all(x[:, p], books[p])
                    up = root_up(d)
                else:
                    own = code[:, p].astype(np.int64)
                    low = np.maximum(lower[:, p].astype(np.int64) - moved[p], 0)
                    own, up, low, _ = assign_by_bounds(x[:, p], books[p], own, upper[:, p] + moved[p][own], low)
                code[:, p], upper[:, p], lower[:, p] = own, up, low
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), _bytes(code), _bytes(upper), _bytes(lower.reshape(n, -1))], [*names, "code", "upper", "lower"])

    return run


def _sums(parts: int, entries: int, width: int):
    """mapInArrow function: a task's sums and counts of the parts of each entry, in long form (pos -1: the count)."""

    def run(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch["v"], parts * width).reshape(-1, parts, width)
            code = _rows(batch["code"], np.uint8, (parts,))
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        whole = np.concatenate([count[:, :, None], total], axis=2)
        p, e, k = (a.ravel() for a in np.indices(whole.shape))
        used = np.repeat(count.ravel() > 0, width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(a[used], t) for a, t in ((p, pa.int32()), (e, pa.int32()), (k - 1, pa.int32()), (whole.ravel(), pa.int64()))], ["part", "entry", "pos", "value"])

    return run


def _errors(books: np.ndarray):
    """mapInArrow function: codes as hex digits and the exact squared distance over all parts."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            x = _matrix(batch["v"], parts * width).reshape(-1, parts, width)
            code = _rows(batch["code"], np.uint8, (parts,))
            error = ((x - books[np.arange(parts), code]) ** 2).sum(axis=(1, 2)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def _put(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, compressed well, as bounds are many and small."""
    path = f"{shared_folder(df.sparkSession)}/bounds-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def fit(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """(stored rows with codes and bounds, codebooks as an array (part, entry, position), path); see ``compress``."""
    kept = vectors.where(finite(vector_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), whole_vectors(vectors, vector_col, scale).alias("v"))
    spark, kind = kept.sparkSession, dict(kept.dtypes)
    rows, path = _put(kept)
    first = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, math.ceil(dims / parts))
    books = np.zeros((parts, max(1, len(first)), width), np.int64)
    for e, v in enumerate(first):
        books[:, e] = np.pad(np.array(v, np.int64), (0, parts * width - len(v))).reshape(parts, width)
    schema = _STATE.format(kind=kind["id"], label=kind["label"])
    names, moved = ["id", "label", "v"], None
    for k in range(rounds + 1):
        after, new_path = _put(rows.mapInArrow(_round(books, moved, names), schema))
        forget(spark, path)
        rows, path = after, new_path
        if k == rounds:
            break
        told = rows.select("v", "code").mapInArrow(_sums(*books.shape), "part int, entry int, pos int, value long")
        new = books.copy()
        count, total = np.zeros(books.shape[:2], object), np.zeros(books.shape, object)
        for p, e, at, value in told.groupBy("part", "entry", "pos").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
            if at < 0:
                count[p, e] = int(value)
            else:
                total[p, e, at] = int(value)
        for p, e in np.argwhere(count > 0):
            new[p, e] = [x // count[p, e] for x in total[p, e]]
        moved, books = root_up(((new - books) ** 2).sum(axis=2)), new
    return rows, books[:, : len(first)], path


def compress(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(the id, code, error, label_error, codebooks_sha256) of each row whose vector is whole.

    Components become floor(scale * x); vectors are cut into ``parts`` equal
    parts.  The codebooks start as the parts of the rows of smallest id (nulls
    last, equal ids by vector), and each of ``rounds`` rounds replaces an entry
    by the floor of its parts' mean; entries without parts stay.  ``code`` has
    two hex digits a part; ``error`` is the squared distance to the entries,
    ``label_error`` its sum over rows of the label, nulls together.

    Rows with a null vector or a component that is null or not finite are left
    out.  Rows that repeat an id count each.  Fewer rows than ``entries``: as
    many entries as rows.  Shorter vectors, and lengths that are no multiple of
    ``parts``, count as followed by zeros.  Other columns are ignored.  No rows:
    no rows.  Raises for components beyond 2^28.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    rows, books, path = fit(vectors, id_col, label_col, vector_col, parts, entries, rounds, scale)
    kind = dict(rows.dtypes)
    full = books if books.shape[1] else np.zeros((parts, 1, books.shape[2]), np.int64)
    coded, out_path = _put(rows.select("id", "label", "v", "code").mapInArrow(_errors(full), f"id {kind['id']}, label {kind['label']}, code string, error long"))
    forget(rows.sparkSession, path)
    label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
