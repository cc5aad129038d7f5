"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised and cut in one pass.  What the plan needs of them is a
histogram of piece lengths, at most ``limit`` counters whatever the corpus: an
index of single, pair and triple sums of the lengths at hand is asked for
combinations that fill a gap exactly, these are consumed as often as their
counts allow, and what is left is packed by best fit.  Pieces find their places
in the plan by their rank among pieces of their length, which each task counts
for itself and small counts by (task, length) make global.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import free_name, pa_schema, stored, to_batch

LIMIT = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a task remembers; longer ones are not remembered.
REMEMBERED, LONGEST = 1 << 20, 64


# ---- tokens ------------------------------------------------------------------------------------


class Run(Exception):
    """A cut would fall into a run of white space."""


class Words(dict):
    """Token ids (little-endian 32-bit) of a space and a word, remembered up to REMEMBERED words.

    A key that starts with a line end stands for itself, without the space.  Ids
    are those of ``tokenizers``.  If a vocabulary has its ids in the order of
    its merges, as byte-level ones have, tiktoken's encoder gives the same ids
    of short words in a quarter of the time, and is used for these.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # control strings of a text are ordinary text
        self.short = _by_ranks(path)

    def encode(self, text: str) -> bytes:
        if self.short and len(text) <= LONGEST:
            return array("I", self.short.encode_ordinary(text)).tobytes()
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        line = word[:1] == "\n"
        if not word[line:] or word[line].isspace():
            raise Run
        ids = self.encode(word if line else " " + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


def _by_ranks(path: str):
    """tiktoken's encoder of a byte-level vocabulary whose merge k makes id 256 + k; None for any other."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    vocab, merges = told["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in told["model"].get("merges", [])]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes that byte-level vocabularies show as themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    plain = (told.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not told["pre_tokenizer"].get("add_prefix_space") and told.get("normalizer") is None
    if not plain or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or sorted(vocab.get(c, -1) for c in byte_of) != list(range(256)):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_CUT = re.compile(r" (?=\S)")


@lru_cache(maxsize=2)
def _loaded(path: str) -> Words:
    """A worker's memory of words, kept from task to task."""
    return Words(path)


def token_bytes(words: Words, text: str) -> bytes:
    """Ids of a whole text.

    Byte-level pretokens end before the last of the white space that stands
    before a visible character.  So a text may be cut before each space and
    line end that a visible character follows; the ids of the cuts, one after
    another, are the ids of the text.
    """
    try:
        cuts = text.replace("\n", " \n").split(" ")
        return words.encode(cuts[0]) + b"".join(map(words.__getitem__, cuts[1:]))
    except Run:
        cuts = _CUT.split(text)
        return words.encode(cuts[0]) + b"".join(map(words.__getitem__, cuts[1:]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """(the id, piece, start, length, ids) of each document's tokens with ``end`` behind them.

    ``ids`` are little-endian unsigned 32-bit.  Only documents of more than
    ``limit`` tokens are cut: into pieces of ``limit``, but for the first, which
    has what is over.  Null text: empty, so one piece of one token.
    ``vocabulary`` is a path on every machine; None: the public byte-level BPE
    where each task finds it.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, piece int, start long, length long, ids binary"
    out, tail = pa_schema(docs.sparkSession, schema), np.array([end], "<u4").tobytes()

    def run(batches):
        words = _loaded(vocabulary or default_vocabulary())
        held, weight = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                whole, doc_id = token_bytes(words, text.as_py() or "") + tail, doc_id.as_py()
                n = len(whole) // 4
                ends = range((n - 1) % limit + 1, n + 1, limit)
                for k, stop in enumerate(ends):
                    start = ends[k - 1] if k else 0
                    held.append((doc_id, k, start, stop - start, whole[4 * start : 4 * stop]))
                weight += len(whole) + 100
                if weight > 8_000_000:
                    yield to_batch(held, out)
                    held, weight = [], 0
        if held:
            yield to_batch(held, out)

    made = source.mapInArrow(run, schema)
    return made.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids")


# ---- the plan ----------------------------------------------------------------------------------


class Sums:
    """Which sums of one, two or three of the lengths at hand there are, under their counts."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.limit = counts.astype(np.int64), len(counts) - 1
        self.pairs = np.zeros(2 * len(counts), np.int32)  # unordered pairs of different lengths for each sum
        for x in np.flatnonzero(self.counts):
            self.pairs[x + np.flatnonzero(self.counts[:x])] += 1

    def take(self, lengths: list[int], times: int = 1) -> None:
        """Use up these lengths ``times`` times; pairs of a length that is gone leave the index."""
        for x in lengths:
            self.counts[x] -= times
        gone = [x for x in set(lengths) if not self.counts[x]]
        for k, x in enumerate(gone):
            self.pairs[x + np.flatnonzero(self.counts)] -= 1
            for y in gone[k + 1 :]:
                self.pairs[x + y] -= 1

    def fits(self, lengths: list[int]) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, but: int = 0) -> list[int] | None:
        """Two lengths of this sum, the larger as large as can be; ``but`` is one that is taken once besides."""
        if total < 2 or not (self.pairs[total] or total % 2 == 0 and self.counts[total // 2] > 1):
            return None
        large = np.arange(min(total - 1, self.limit), (total + 1) // 2 - 1, -1)
        for a in large[(self.counts[large] > 0) & (self.counts[total - large] > 0)]:
            found = [int(a), int(total - a)]
            if self.fits([*found, but] if but else found):
                return found
        return None

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three lengths of this sum, the fewest, or None."""
        if gap <= self.limit and self.counts[gap]:
            return [gap]
        if found := self.pair(gap):
            return found
        first = np.arange(min(gap - 2, self.limit), 0, -1)
        rest = gap - first
        there = (self.counts[first] > 0) & ((self.pairs[rest] > 0) | (rest % 2 == 0) & (self.counts[rest // 2] > 1))
        for a in first[there]:
            if found := self.pair(int(gap - a), int(a)):
                return [int(a), *found]
        return None

    def largest(self, gap: int) -> int:
        """The largest length of at most ``gap``, or 0."""
        there = np.flatnonzero(self.counts[1 : min(gap, self.limit) + 1])
        return int(there[-1]) + 1 if len(there) else 0


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, how often) that use up ``counts[length]`` pieces of each length.

    The longest piece at hand opens a sequence.  Its gap is filled exactly by
    one, two or three others if their sums are in the index; if not, the longest
    piece that fits goes in and the rest of the gap is asked for.  A pattern is
    used as often as the counts allow, so each takes a length (nearly) away.
    """
    sums, made, limit = Sums(counts), [], len(counts) - 1
    while longest := sums.largest(limit):
        lengths, gap = [longest], limit - longest
        sums.take([longest])
        while gap:
            found = sums.exact(gap)
            if found is None:
                next_ = sums.largest(gap)
                if not next_:
                    break
                found = [next_]
            sums.take(found)
            lengths += found
            gap -= sum(found)
        more = min(int(sums.counts[x]) // lengths.count(x) for x in lengths)
        if more:
            sums.take(lengths, more)
        made.append((lengths, 1 + more))
    return made


# ---- places ------------------------------------------------------------------------------------


def _numbered(limit: int, n: str, part: str):
    """mapInArrow function: adds the task and a piece's number among the task's pieces of its length."""

    def run(batches):
        seen, task = np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            length = batch["length"].to_numpy()
            order = np.argsort(length, kind="stable")
            start = np.searchsorted(length[order], length[order])
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - start + seen[length[order]]
            seen += np.bincount(length, minlength=limit + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(np.full(len(length), task, np.int32))], [*batch.schema.names, n, part])

    return run


def place(given: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``given`` (column ``length``, 1 to ``limit``) with sequence_id and offset; other columns are carried along.

    A pattern's place j takes as many pieces of its length, one after another by
    rank, as the pattern is used.  The plan's intervals of ranks go to all tasks:
    their number is bounded by ``limit``, not by the input.
    """
    nth, part = free_name(given, "nth"), free_name(given, "task")
    schema = given.withColumns({nth: F.lit(0).cast("long"), part: F.lit(0)}).schema
    rows, _ = stored(given.mapInArrow(_numbered(limit, nth, part), schema))
    counts = rows.groupBy(F.col(part).alias("t"), F.col("length").alias("l")).agg(F.count("*").alias("n"))
    before = counts.select("t", "l", F.coalesce(F.sum("n").over(Window.partitionBy("l").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    histogram = np.zeros(limit + 1, np.int64)
    for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect():
        histogram[r.l] = r.n
    slots, used, sequence = [], np.zeros(limit + 1, np.int64), 0
    for lengths, times in plan(histogram):
        offset = 0
        for x in lengths:
            slots.append((x, int(used[x]), sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    slots = np.array(sorted(slots), np.int64).reshape(-1, 4)
    names = given.columns
    out = [*names, "sequence_id", "offset"]

    def run(batches):
        span = int(used.max(initial=0)) + 1
        keys = slots[:, 0].astype(object) * span + slots[:, 1] if limit * span >= 1 << 62 else slots[:, 0] * span + slots[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch[nth].to_numpy() + batch["before"].to_numpy()
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            found = [pa.array(slots[at, 2] + rank - slots[at, 1], pa.int64()), pa.array(slots[at, 3], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *found], out)

    ranked = rows.join(before, (F.col(part) == F.col("t")) & (F.col("length") == F.col("l"))).drop("t", "l")
    return ranked.mapInArrow(run, given.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """(the id, piece, start, length, ids, sequence_id, offset): all documents in sequences of at most ``limit`` tokens.

    Pieces of a sequence lie one behind another from offset 0; sequence ids are
    0, 1, ...  Repeated rows are documents of their own.  Other columns of
    ``docs`` are ignored.  No rows: no rows.
    """
    return place(pieces(docs, id_col, text_col, vocabulary, limit, end), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, length, ids) of packed pieces: the training sequences themselves."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    return rows.select("sequence_id", F.size("parts").alias("n_pieces"), "length", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
