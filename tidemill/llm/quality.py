"""Quality classifier: ridge regression on random Fourier features, calibrated.

Each text gives a few statistics.  Random Fourier features of the standardised
statistics approximate a Gaussian kernel; every partition sums its part of the
normal equations, Spark adds the parts, and the driver solves one small system
whose size depends on the number of features alone.  Isotonic regression on
rows kept from the fit turns ridge scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import crc_mod, cut, free_name, per_row, stored

#: Statistics of one text, in this order.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "distinct_per_root", "top_word", "repeats", "upper", "digit", "punctuation",
    "double_punctuation", "non_ascii", "space", "entropy", "line_words", "distinct_lines", "marked_words", "short_words",
)
FEATURES = 192
SCALE = 0.25
RIDGE = 1e-3
SEED = 11
#: Score bins in which calibration rows are counted.
BINS = 1024

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 4
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a whole UTF-8 text; of a null or empty text, zeros."""
    text = text or b""
    if not text:
        return [0.0] * len(STATISTICS)
    n, kinds = len(text), _KIND[np.frombuffer(text, np.uint8)]
    share = np.bincount(kinds, minlength=6) / n
    odd = kinds == 5
    doubled = float((odd[1:] & odd[:-1]).mean()) if n > 1 else 0.0
    marked = int((odd[:-1] & (kinds[1:] == 1)).sum()) + int(odd[-1])
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    seen = seen[seen > 0] / n
    words = text.split()
    m = len(words)
    counted = Counter(words)
    lines = text.split(b"\n")
    return [
        np.log1p(n),
        np.log1p(m),
        np.log1p(n / max(m, 1)),
        len(counted) / max(m, 1),
        len(counted) / max(m, 1) ** 0.5 / 10,
        max(counted.values(), default=0) / max(m, 1),
        sum(map(eq, words, words[1:])) / max(m, 1),
        share[2],
        share[3],
        share[5],
        doubled,
        share[4],
        share[1],
        float(-(seen * np.log(seen)).sum()),
        np.log1p(m / len(lines)),
        len(set(lines)) / len(lines),
        marked / max(m, 1),
        sum(map(int.__gt__, [4] * m, map(len, words))) / max(m, 1),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name = lambda v: v.decode() if isinstance(v, bytes) else v
    return per_row(source, ["doc_id", "text"], f"doc_id {dict(source.dtypes)['doc_id']}, x array<double>", lambda doc_id, text: [(name(doc_id), [float(v) for v in statistics(text)])])


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, features: int, scale: float) -> np.ndarray:
    """cos(Wz + b) of standardised statistics z, and a constant; W and b follow from SEED."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, scale, (x.shape[1], features)), rng.uniform(0, 2 * np.pi, features)
    z = np.clip((x - mean) / spread, -6, 6)
    return np.hstack([np.cos(z @ w + b) * (2 / features) ** 0.5, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


def isotonic(positions: np.ndarray, means: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre, value) of each block, values rising."""
    blocks: list[list[float]] = []
    for p, v, w in zip(positions, means, weights):
        blocks.append([p * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _binned(stats: DataFrame, predict) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(predict(_matrix(batch)), -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw + 0.5) * BINS / 2).astype(np.int32)), batch.column("y")], names=["bin", "y"])

    return stats.mapInArrow(run, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n"))


def fit(labelled: DataFrame, features: int = FEATURES, scale: float = SCALE, ridge: float = RIDGE):
    """A function from a matrix of statistics to scores, learned from (doc_id, x, y).

    A fifth of the rows, by crc32 of the id, calibrates; the rest fits.  No
    labelled row: every score is 0.5.
    """
    d = len(STATISTICS)
    rows = labelled.withColumn("fold", F.coalesce(crc_mod("doc_id", 1000), F.lit(0)) >= 800)
    part = rows.where(~F.col("fold"))
    moments = part.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments["n"]:
        return lambda x: np.full(len(x), 0.5)
    mean = np.array([moments[f"m{i}"] for i in range(d)])
    spread = np.array([max(moments[f"s{i}"], 1e-6) for i in range(d)])
    width = features + 2

    def normal(batches):
        total = np.zeros((features + 1, width))
        for batch in batches:
            if batch.num_rows:
                phi = fourier(_matrix(batch), mean, spread, features, scale)
                total += phi.T @ np.hstack([phi, batch.column("y").to_numpy()[:, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(features + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = part.select("x", "y").mapInArrow(normal, "i int, row array<double>")
    sums = parts.groupBy("i").agg(*(F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(width))).orderBy("i").collect()
    whole = np.array([list(r)[1:] for r in sums])
    gram, target = whole[:, :-1], whole[:, -1]
    weights = np.linalg.solve(gram + ridge * moments["n"] / (features + 1) * np.eye(features + 1), target)

    def raw(x):
        return fourier(x, mean, spread, features, scale) @ weights

    bins = sorted((r["bin"], r["y"], r["n"]) for r in _binned(rows.where("fold").select("x", "y"), raw).collect())
    if not bins:  # too few labelled rows to keep any: calibrate on the fit
        bins = sorted((r["bin"], r["y"], r["n"]) for r in _binned(part.select("x", "y"), raw).collect())
    at, mean_y, n = (np.array(v, float) for v in zip(*bins))
    centre, value = isotonic((at + 0.5) * 2 / BINS - 0.5, mean_y, n)
    return lambda x: np.clip(np.interp(np.clip(raw(x), -0.5, 1.5), centre, value), 0, 1)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Learns from labelled rows whose crc32(id) mod 3 is not 1; an id labelled
    more than once counts by its mean label; null labels are ignored.  Null and
    empty texts have the statistics 0 and are scored like any other.  A null id
    is not held out.  Ids are of any type.  Without labels every score is 0.5.
    """
    stats = cut(document_statistics(docs, id_col, text_col))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    kind = dict(stats.dtypes)["doc_id"]
    known = labels.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    model = fit(cut(stats.where(~held_out).join(known, "doc_id")))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.withColumn("held_out", held_out).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, columns unchanged.

    Rows with a null id stay: there is nothing by which to reject them.  Rows
    that share an id go only if each of their texts is rejected.  The rejected
    ids are a written table, so Spark knows its size before it plans the join:
    a small one is broadcast and no text is shuffled.
    """
    scored = quality_scores(docs, labels, id_col, text_col)
    name = free_name(docs, "rejected_id")
    rejected = scored.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0").select(F.col("doc_id").alias(name))
    rejected, _ = stored(rejected)
    return docs.join(rejected, docs[id_col] == F.col(name), "left_anti")
