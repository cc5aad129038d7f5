"""Benchmark decontamination by one Aho-Corasick automaton.

Words of benchmark items become windows of 13; the automaton of all windows
reads each normalised text once, word by word, and the words that it hits are
mapped back to places in the original text.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import as_bytes, free_name, pa_schema, to_batch

WINDOW = 13
#: Bytes of item text in one automaton (its nodes take some 200 bytes for each of them), and of texts that a task holds.
GROUP_BYTES = 2_000_000
BLOCK_BYTES = 8_000_000

#: Digits, lower-cased letters and all bytes of non-ASCII characters are word bytes; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows(text: bytes | None, size: int = WINDOW) -> set[bytes]:
    """The windows of one item: ``size`` consecutive words, or all of fewer."""
    w = words(text)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


class Machine:
    """Aho-Corasick automaton over the word numbers of all windows of some items."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        owners: dict[bytes, set] = {}
        for item_id, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).add(item_id)
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in owners.items():
            key = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w.split())
            self.automaton.add_word(key, (len(key), tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs [from, to) of hit words, ids of items that occur."""
        if not w or not self.numbers:
            return [], set()
        number = self.numbers.get
        hits = list(self.automaton.iter(tuple([number(x, 0) for x in w])))
        if not hits:
            return [], set()
        edge, ids = np.zeros(len(w) + 1, np.int64), set()
        for last, (n, owners) in hits:
            edge[last + 1 - n] += 1
            edge[last + 1] -= 1
            ids.update(owners)
        covered = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)
        turn = np.flatnonzero(np.diff(covered))
        return list(zip(turn[::2].tolist(), turn[1::2].tolist())), ids


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as byte ranges of the original text."""
    is_word = np.concatenate([[0], np.frombuffer(text.translate(_FOLD), np.uint8) != 32, [0]]).astype(np.int8)
    turn = np.flatnonzero(np.diff(is_word))
    return [(int(turn[2 * a]), int(turn[2 * b - 1])) for a, b in runs]


def _groups(items: DataFrame, limit: int):
    """Benchmark items in groups of at most ``limit`` bytes, or of one item; one group at a time is held."""
    group, weight = [], 0
    for row in items.toLocalIterator():
        text = (row["text"] or "").encode()
        if group and weight + len(text) > limit:
            yield group
            group, weight = [], 0
        group.append((row["item_id"], text))
        weight += len(text)
    yield group


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _pack(pairs):
    return [{"from": a, "to": b} for a, b in pairs]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limit: int = GROUP_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, runs (hit word ranges), spans (their byte ranges), item_ids.

    Null texts have no words; an empty benchmark hits nothing; items with a null
    id or no words are ignored; equal rows give equal results.  Items go out in
    groups of at most ``limit`` bytes (or one item), each a broadcast of its
    own.  A task holds ``block`` bytes of texts, one automaton and, while that is
    built, one group's items: it scans the texts with the automaton of each group
    in turn, so a benchmark of any size is one pass over the table; with one group
    the automaton is built once.
    """
    kind, span = dict(docs.dtypes)[id_col], "array<struct<`from`: long, `to`: long>>"
    context = docs.sparkSession.sparkContext
    groups = [context.broadcast(group) for group in _groups(benchmark.select("item_id", "text").where("item_id is not null"), limit)]
    schema = f"doc_id {kind}, n_words long, runs {span}, spans {span}, item_ids array<string>"
    out = pa_schema(docs.sparkSession, schema)

    def run(batches):
        built: list[Machine] = []

        def machines():
            for group in groups:
                if len(groups) > 1 or not built:
                    built.clear()  # one automaton at a time
                    built.append(Machine(group.value, window))
                    vars(group).pop("_value", None)  # a worker that lives on holds no items; its next use reads them from the executor again
                yield built[0]

        def scanned(held):
            found = [([], set()) for _ in held]
            split = [words(text) for _, text in held]
            for machine in machines():
                for (runs, ids), w in zip(found, split):
                    more, owners = machine.scan(w)
                    runs += more
                    ids |= owners
            rows = []
            for (doc_id, text), (runs, ids), w in zip(held, found, split):
                runs = _union(runs)
                rows.append((doc_id, len(w), _pack(runs), _pack(original_spans(text, runs) if runs else []), sorted(map(str, ids))))
            return to_batch(rows, out)

        held, weight = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                held.append((doc_id, text))
                weight += 64 + len(text or b"")
                if weight > block:
                    yield scanned(held)
                    held, weight = [], 0
        if held:
            yield scanned(held)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A text is contaminated if it has hit words and they are a twentieth or more.
    """
    hits = benchmark_hits(docs, benchmark, **options)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["to"] - r["from"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose id has no contaminated text; columns unchanged, null ids stay."""
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    name = free_name(docs, "bad_id")
    bad = found.where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs[id_col] == F.col(name), "left_anti")
