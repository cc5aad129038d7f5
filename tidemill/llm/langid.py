"""Language identification by rank-order profiles of n-grams.

A language's profile is its most frequent n-grams of one to three letters, in
order.  A text is given the language whose profile is nearest by out-of-place
distance: for each of the text's own most frequent n-grams, how far its rank is
from its rank in the profile, or the profile's length if it is missing.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import as_bytes, crc_mod

#: N-grams in a profile of a language or a text.
PROFILE = 400
UNKNOWN = "und"
_BLANK = 32


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a blank."""
    codes = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), codes, _BLANK).astype(np.uint64)


def ngrams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of a whole text, n-grams ascending; each packs three 21-bit code points.

    Words are lower-cased runs of letters with a blank at either end; n-grams
    do not cross words.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    codes = _letters()[np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate([[np.uint64(_BLANK)], codes, [np.uint64(_BLANK)]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
    codes = codes[keep]
    if len(codes) < 3:
        return none
    two = codes[:-1] << np.uint64(21) | codes[1:]
    three = (two[:-1] << np.uint64(21) | codes[2:])[codes[1:-1] != _BLANK]
    grams = np.sort(np.concatenate([codes[codes != _BLANK], two, three]))
    start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[start], np.diff(np.append(start, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent n-grams, ties by code points."""
    if len(counts) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of each language's profile; n-grams of all labelled texts are counted.

    Rows with a null language or text teach nothing.
    """

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
                parts = held.setdefault(lang, [])
                parts.append(ngrams(text))
                if len(parts) >= 400:
                    held[lang] = [_merge(parts)]
        for lang, parts in held.items():
            grams, n = _merge(parts)
            for k in range(0, len(grams), 100_000):
                g = grams[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n[k : k + 100_000])], names=["lang", "gram", "n"])

    known = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = counted.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)  # a group limit before the shuffle
    return first.select("lang", "gram", (F.col("nth") - 1).alias("rank"))


class Ranker:
    """Distances of a text to every profile."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        by: dict[str, list[tuple[int, int]]] = {}
        for lang, gram, rank in rows:
            by.setdefault(lang, []).append((gram, rank))
        self.langs = sorted(by)
        self.tables = [tuple(np.array(v) for v in zip(*sorted(by[lang]))) for lang in self.langs]

    def predict(self, text: bytes | None) -> tuple[str, float]:
        own = ranked(*ngrams(text), self.size).view(np.int64)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        place, distance = np.arange(len(own)), []
        for grams, ranks in self.tables:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            distance.append(np.where(grams[at] == own, np.minimum(np.abs(ranks[at] - place), self.size), self.size).sum())
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (1 - distance / largest distance).

    Learns from rows whose crc32(id) mod 4 is not 2 and whose language is known.
    A null text, one without letters, or nothing learned: ``und`` with score 0.
    A null id is not held out.  Ties go to the first language by code point.
    """
    held_out = F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))
    learned = [tuple(r) for r in profiles(docs.where(~held_out), lang_col, text_col, size).collect()]  # size rows a language
    source = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        ranker = Ranker(learned, size)
        for batch in batches:
            made = [ranker.predict(t) for t in as_bytes(batch.column("text"))]
            lang, score = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
