"""Fuzzy repeated passages by collinear chaining.

Sampled k-mers of words are seeds, at all their places.  The places of a seed
are matched with each other if they are few.  Those of a frequent seed are
sorted by the frequent seeds that follow, and again by those that precede, and
neighbours are matched: a seed at n places gives some 2n matches, not n², and
texts that go on alike are neighbours, whatever others hold pieces of their
passage.  The matches of two texts are chained in order, with a cost for gaps,
through a Fenwick tree; the words between chained matches are aligned, and
aligned stretches that are long and similar enough are passages.  Passages
linked by alignments are one class.  Runs of one seed, as long as a passage,
are matched with the longest run of it.

Neighbours are not all pairs.  So every two places of a frequent seed that are
not of one class by then are compared, block by block: if the words around
them have enough word pairs in common for a passage, and few enough edits, all
seeds that their texts share are matched, chained and aligned.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut, forget, pa_schema, per_row, release, stored, text_key, to_batch, with_hashes
from .simhash import components

SEED_WORDS = 5
#: One seed at least in so many successive k-mers.
SAMPLE = 4
#: Words of a passage, and the share of them that must agree.
LEAST_WORDS = 50
SIMILARITY = 0.8
GAP_COST = 0.05
#: Least score of a chain, and least words of a chain that is one block.
CHAIN_SCORE = 6.0
ALONE = 10
#: Places of a seed that are all matched with each other.
FEW = 9
#: Bytes of text that are split into words at once; seeds that a task deals to buckets at once, and seeds of a bucket on average.
SLICE, DEALT, BUCKET = 4 << 20, 1 << 20, 1 << 17
#: What blocks of rows hold.
SEEDS = {"seed": np.int64, "key": np.int64, "place": np.int32}
PAIRS = {"rep": np.int64, "key": np.int64, "r": np.int32, "p": np.int32}
CONTEXTS = {"seed": np.int64, "side": np.int8, "context": np.int64, "key": np.int64, "place": np.int32}
#: Frequent seeds after a place and before it that make its context, and words between two of them at most.
CONTEXT = 8
RUN_GAP = 24
#: Texts of which one is looked at for hot seeds, hot seeds at most, places there of the least one, parts into which they are dealt.
HOT_TEXTS, HOT_SEEDS, HOT_LEAST, SALTS = 32, 10_000, 64, 64
#: A gap with more edits ends a passage; words around a chain in which its ends may lie.
BREAK_EDITS = 16
MARGIN = 96
#: Words before and after a place that are compared, and word pairs that they must have in common: 50 words with 10 edits have 29 at least.
AROUND, SHARED = 64, 29
#: Places of a seed in a block: any two blocks are compared in one group of rows. Of a run of one seed, one place in so many and the last are taken.
BLOCK, RUN_STEP = 4096, 64
#: What words before a place are changed by, so that they have no word pairs in common with words after one.
BEFORE = 0xA5A5
#: Codes of the words of a window's side.
SLOTS = 4096


def word_hashes(text: bytes | None, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Hash of each word: ASCII lower case, split at ASCII space."""
    known = {} if known is None else known
    if len(known) > 500_000:
        known.clear()
    words = (text or b"").lower().split()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w) >> 1
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts, one text after another, and the number of each text's; split as ``word_hashes`` does."""
    column = pc.ascii_trim_whitespace(pc.fill_null(column, ""))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    words, count = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    there = pc.binary_length(words).to_numpy() > 0
    if not there.all():  # texts without a word
        count = np.bincount(np.repeat(np.arange(len(count)), count)[there], minlength=len(count))
        words = words.filter(pa.array(there))
    return words, count


def word_counts(column: pa.Array) -> np.ndarray:
    """The number of each text's words."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(column.buffers()[2], np.uint8)[edge[0] : edge[-1]] if len(column) and edge[-1] > edge[0] else np.zeros(0, np.uint8)
    edge = edge - edge[0] if len(column) else edge
    word = (text != 32) & ((text - np.uint8(9)) > 4)
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    first = edge[:-1][np.diff(edge) > 0]
    begin[first] = word[first]
    held = np.concatenate([[0], np.cumsum(begin, dtype=np.int64)])
    return np.diff(held[edge]) if len(column) else np.zeros(0, np.int64)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of a column's texts, one after another, and where each text begins and the last one ends."""
    words, count = split_words(column)
    coded = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    return (hashes >> np.uint64(1)).view(np.int64)[coded.indices.to_numpy()], np.concatenate([[0], np.cumsum(count)])


def sliced(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> list[pa.RecordBatch]:
    """Parts of a batch with some ``size`` bytes in a column of texts, or one text more."""
    if not len(batch):
        return []
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    edge = np.flatnonzero(np.diff((np.cumsum(length) - length) // size)) + 1
    return [batch.slice(a, b - a) for a, b in itertools.pairwise([0, *edge.tolist(), len(batch)])]


def kmers(words: np.ndarray, k: int = SEED_WORDS) -> np.ndarray:
    n = len(words) - k + 1
    w, h = words.view(np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def seeds(words: np.ndarray, k: int = SEED_WORDS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of the sampled k-mers of a text, in the order of their places."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = kmers(words.astype(np.int64), k)
    least, width = h, 1
    span = min(sample, n)
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    # a k-mer is sampled if it is the least of any window around it
    reach = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    width, top = 1, reach
    while 2 * width <= span:
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    if span > width:
        top = np.maximum(top[: len(top) - (span - width)], top[span - width :])
    at = np.flatnonzero(top == h)
    return h[at].view(np.int64), at


def seeds_of(words: np.ndarray, edge: np.ndarray, k: int = SEED_WORDS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, place): ``seeds`` of each of the texts of ``words_of``."""
    size = np.diff(edge)
    made = []
    for t in np.flatnonzero((size >= k) & (size < k + sample - 1)).tolist():  # shorter than a window
        seed, place = seeds(words[edge[t] : edge[t + 1]], k, sample)
        made.append((seed, np.full(len(seed), t), place))
    n = len(words) - k - sample + 2
    if n > 0:
        text = np.repeat(np.arange(len(size)), size)
        h = kmers(words, k)
        least = h[:n].copy()
        for i in range(1, sample):
            np.minimum(least, h[i : i + n], out=least)
        least[text[:n] != text[k + sample - 2 :]] = 0  # no window of one text
        top = np.zeros(len(h), np.uint64)
        for i in range(sample):
            np.maximum(top[i : i + n], least, out=top[i : i + n])
        at = np.flatnonzero((top == h) & (text[: len(h)] == text[k - 1 :]))
        made.append((h[at].view(np.int64), text[at], at - edge[text[at]]))
    if not made:
        return (np.zeros(0, np.int64),) * 3
    seed, text, place = (np.concatenate(v) for v in zip(*made))
    order = np.argsort(text, kind="stable") if len(made) > 1 else slice(None)
    return seed[order], text[order], place[order]


class Fenwick:
    """Largest (value, item) among ranks up to a bound."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, value: float, item: int) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank][0]:
                self.best[rank] = (value, item)
            rank += rank & -rank

    def most(self, rank: int) -> tuple[float, int]:
        """Over ranks below ``rank``."""
        found = (float("-inf"), -1)
        while rank > 0:
            if self.best[rank][0] > found[0]:
                found = self.best[rank]
            rank -= rank & -rank
        return found


def chain(r: np.ndarray, p: np.ndarray, k: int = SEED_WORDS, cost: float = GAP_COST, least: float = CHAIN_SCORE, alone: int = ALONE) -> list[list[tuple[int, int, int]]]:
    """Chains of blocks (place in one text, in the other, words) from matches sorted by (p - r, r).

    Matches next to each other on a diagonal are one block.  Of the chains with
    a score of at least ``least``, the best comes first and owns its blocks; one
    block is a chain if it has ``alone`` words.
    """
    jump = (np.diff(r) != np.diff(p)) | (np.diff(r) > SAMPLE)
    begin = np.concatenate([[0], np.flatnonzero(jump) + 1])
    end = np.append(begin[1:], len(r)) - 1
    r0, p0, rl, pl = r[begin].tolist(), p[begin].tolist(), r[end].tolist(), p[end].tolist()
    m = len(r0)
    size = [rl[j] - r0[j] + k for j in range(m)]
    if m == 1:
        return [[(r0[0], p0[0], size[0])]] if size[0] >= max(least, alone) else []
    places = sorted(set(pl))
    rank = {x: i for i, x in enumerate(places)}
    tree, score, before = Fenwick(len(places)), [0.0] * m, [-1] * m
    ends = sorted(range(m), key=rl.__getitem__)
    done = 0
    for j in sorted(range(m), key=r0.__getitem__):
        while done < m and rl[ends[done]] < r0[j]:
            i = ends[done]
            tree.put(rank[pl[i]], score[i] + cost * (rl[i] + pl[i]), i)
            done += 1
        value, i = tree.most(int(np.searchsorted(places, p0[j])))
        gain = value - cost * (r0[j] + p0[j])
        score[j] = size[j] + max(0.0, gain)
        before[j] = i if gain > 0 else -1
    used, out = [False] * m, []
    for j in sorted(range(m), key=score.__getitem__, reverse=True):
        if used[j] or score[j] < least:
            continue
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append((r0[j], p0[j], size[j]))
            j = before[j]
        if sum(b[2] for b in path) >= (least if len(path) > 1 else max(least, alone)):
            out.append(path[::-1])
    return out


def hopeful(edge: np.ndarray, r: np.ndarray, p: np.ndarray, k: int = SEED_WORDS, cost: float = GAP_COST, least: float = CHAIN_SCORE, alone: int = ALONE) -> np.ndarray:
    """Which pairs, with matches from edge[i] to edge[i + 1], sorted as for ``chain``, may have a chain of ``least`` words.

    Pairs of two matches are judged as ``chain`` would; one match has none.
    """
    size = np.diff(edge)
    out = size > 2
    two = np.flatnonzero(size == 2)
    a = edge[two]
    dr, dp = r[a + 1] - r[a], p[a + 1] - p[a]
    joined = (dr == dp) & (dr <= SAMPLE)
    gap = np.abs(dr) + np.abs(dp)
    ordered = (np.sign(dr) == np.sign(dp)) & (dr != 0)
    single = np.where(joined, k + dr, k)
    out[two] = ordered & ~joined & (2 * k - cost * gap >= least - 1e-9) | (single >= max(least, alone))
    return out


def edits(a: list[int], b: list[int]) -> int:
    """Edit distance of two word lists (bit-parallel, Myers 1999, in Hyyrö's form)."""
    x, y = 0, min(len(a), len(b))
    while x < y and a[x] == b[x]:  # what they begin and end with alike costs nothing
        x += 1
    y -= x
    z = 0
    while z < y and a[-1 - z] == b[-1 - z]:
        z += 1
    a, b = a[x : len(a) - z], b[x : len(b) - z]
    if len(a) < 2 and len(b) < 2 or not a or not b:
        return max(len(a), len(b))
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for x in b:
        eq = places.get(x, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & mask, up & zero
        score += 1 if plus & high else -1 if minus & high else 0
        plus, minus = (plus << 1 | 1) & mask, minus << 1 & mask
        up, down = minus | ~(zero | plus) & mask, plus & zero
    return score


def _stretch(a: np.ndarray, b: np.ndarray, drop: int = 6) -> tuple[int, int]:
    """Words by which an alignment goes on along its diagonal, and the edits among them."""
    n, score, best, most, bad, found = min(len(a), len(b)), 0, 0, 0, 0, 0
    for k in range(0, n, 64):
        for i, same in enumerate((a[k : min(k + 64, n)] == b[k : min(k + 64, n)]).tolist(), k + 1):
            if same:
                score += 1
                if score >= best and score > 0:  # of equals the longest
                    best, most, found = score, i, bad
            else:
                score, bad = score - 1, bad + 1
                if best - score > drop:
                    return most, found
    return most, found


def passages(a: np.ndarray, b: np.ndarray, blocks: list[tuple[int, int, int]], least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """Aligned stretches (from, to in a, from, to in b) along one chain of blocks.

    A stretch that has too many edits as a whole gives its longest parts that have not.
    """
    out, now, parts = [], None, []

    def close():
        if now is None:
            return
        r0, r1, p0, p1, bad = now
        more, worse = _stretch(a[r1:], b[p1:])
        less, worst = _stretch(a[:r0][::-1], b[:p0][::-1])
        if min(r1 - r0, p1 - p0) + less + more < least:
            return
        n = max(r1 - r0, p1 - p0) + less + more
        if bad + worse + worst <= (1 - similarity) * n:
            out.append((r0 - less, r1 + more, p0 - less, p1 + more))
        else:
            out.extend(_parts(a, b, [(r0 - less, p0 - less, less, 0), *parts, (r1, p1, more, 0)], least, similarity))

    for r, p, n in blocks:
        if now is not None:
            over = max(0, now[1] - r, now[3] - p)
            r, p, n = r + over, p + over, n - over
            if n <= 0:
                continue
        n = min(n, len(a) - r, len(b) - p)
        bad = int(np.count_nonzero(a[r : r + n] != b[p : p + n]))
        if now is not None:
            gap = edits(a[now[1] : r].tolist(), b[now[3] : p].tolist()) if max(r - now[1], p - now[3]) <= 20 * BREAK_EDITS else BREAK_EDITS + 1
            if gap <= BREAK_EDITS:
                now = (now[0], r + n, now[2], p + n, now[4] + gap + bad)
                parts.append((r, p, n, gap))
                continue
            close()
        now, parts = (r, r + n, p, p + n, bad), [(r, p, n, 0)]
    close()
    return out


def _parts(a: np.ndarray, b: np.ndarray, blocks: list[tuple[int, int, int, int]], least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """The longest parts of a stretch with few enough edits, none within another.

    Blocks are (place in a, in b, words, edits of the gap before).  Parts begin
    and end with equal words; a gap between blocks is in a part or out as a whole.
    """
    runs, cost = [], 0  # (from, to in a, from, to in b, edits up to the run) of equal words
    for r, p, n, gap in blocks:
        cost += gap
        same = np.concatenate([[False], a[r : r + n] == b[p : p + n], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        seen = 0
        for x, y in edge.tolist():
            cost += x - seen
            runs.append((r + x, r + y, p + x, p + y, cost))
            seen = y
        cost += n - seen
    if not runs:
        return []
    r0, r1, p0, p1, bad = (np.array(v) for v in zip(*runs))
    last = np.full(len(runs), -1)
    for begin, end in ((r0, r1), (p0, p1)):  # few enough edits of the longer side: of one of the two
        share = 1 - similarity
        most = np.maximum.accumulate((share * end - bad)[::-1])[::-1]  # falls along the runs
        last = np.maximum(last, np.searchsorted(-most, -(share * begin - bad) + 1e-9, side="right") - 1)
    out, reach = [], -1
    for i, j in enumerate(last.tolist()):
        if j > reach:
            reach = j
            if min(r1[j] - r0[i], p1[j] - p0[i]) >= least:
                out.append((int(r0[i]), int(r1[j]), int(p0[i]), int(p1[j])))
    return out


# ---- Spark --------------------------------------------------------------------------------------


def per_text(df: DataFrame, names: list[str], schema: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``per_row``, with the word hashes of column ``text`` in its place."""
    out = pa_schema(df.sparkSession, schema)

    def run(batches):
        held, weight = [], 0
        for part in itertools.chain.from_iterable(map(sliced, batches)):
            words, edge = words_of(part.column("text"))
            texts = (words[a:b] for a, b in itertools.pairwise(edge.tolist()))
            for values in zip(*(texts if name == "text" else part.column(name).to_pylist() for name in names)):
                for made in rows(*values):
                    held.append(made)
                    weight += 64 + sum(len(x) for x in made if isinstance(x, bytes))
                    if weight > 8_000_000:
                        yield to_batch(held, out)
                        held, weight = [], 0
        if held:
            yield to_batch(held, out)

    return df.select(*names).mapInArrow(run, schema)


def _text_seeds(batches):
    """(seed, key, place) of the texts of (key, text), as arrays; copies within a task give their seeds once."""
    done: set[int] = set()
    for batch in batches:
        fresh = [key not in done and not done.add(key) for key in batch.column("key").to_pylist()]
        for part in sliced(batch.filter(pa.array(fresh, pa.bool_()))):
            seed, text, place = seeds_of(*words_of(part.column("text")))
            yield seed, part.column("key").to_numpy()[text], place


def _seed_rows(batches):
    for columns in _text_seeds(batches):
        for k in range(0, len(columns[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 200_000]) for v in columns], names=["seed", "key", "place"])


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among some that are sorted."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _blocks(rows, kinds, deal):
    """Blocks (part, bucket, and a binary for each of ``kinds``) of rows that come as lists of arrays.

    A block holds those of some DEALT rows that are of one part and bucket, as
    ``deal`` tells them from the columns: so Spark deals out and sorts blocks, not rows.
    """
    held, n = [], 0
    for columns in itertools.chain(rows, [None]):
        if columns is not None and len(columns[0]):
            held.append(columns)
            n += len(columns[0])
        if not n or columns is not None and n < DEALT:
            continue
        columns = [np.concatenate(v) for v in zip(*held)]
        held, n = [], 0
        part, bucket = deal(*columns)
        group = bucket.astype(np.int64) * 4 + part
        order = np.argsort(group.astype(np.uint16) if group.max() < 1 << 16 else group, kind="stable")
        group = group[order]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        first = group[edge[:-1]]
        made = [pa.array(first % 4), pa.array(first // 4)]
        for values, kind in zip(columns, kinds.values()):
            values = values[order].astype(kind)
            made.append(pa.array([values[x:y].tobytes() for x, y in itertools.pairwise(edge.tolist())], pa.binary()))
        made = pa.RecordBatch.from_arrays(made, names=["part", "bucket", *kinds])
        yield from (made.slice(k, 1024) for k in range(0, len(made), 1024))


def _unpacked(batches, kinds):
    """The rows of each bucket, as a list of arrays, of a partition of ``_blocks`` sorted by bucket; one bucket is held."""
    now, held = None, []
    for batch in itertools.chain(batches, [None]):
        for bucket, *block in zip(*(batch.column(c).to_pylist() for c in ("bucket", *kinds))) if batch is not None else [(None,)]:
            if held and bucket != now:
                columns = [np.concatenate([np.frombuffer(x, kind) for x in v]) for v, kind in zip(zip(*held), kinds.values())]
                yield [c.astype(np.int64) for c in columns]
                held = []
            now = bucket
            held.append(block)


def _batch(names, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=list(names))


def _columns(batches, names):
    return ([batch.column(c).to_numpy() for c in names] for batch in batches)


def _sorted_seeds(batches, hot):
    """(seed, key, place), sorted by these, of each bucket; seeds with one place are left out, as they match nothing."""
    for seed, key, place in _unpacked(batches, SEEDS):
        order = np.argsort(seed)
        same = np.diff(seed[order]) == 0
        kept = order[np.append(same, False) | np.append(False, same) | among(seed[order], hot)]
        seed, key, place = seed[kept], key[kept], place[kept]
        order = np.lexsort((place, key, seed))
        yield _batch(SEEDS, [v[order] for v in (seed, key, place)])


def _sorted_places(batches):
    """(seed, key, place), sorted by (key, place), of each bucket of a table's part 1."""
    for seed, key, place, _ in _unpacked(batches, PAIRS):
        order = np.lexsort((place, key))
        yield _batch(SEEDS, [v[order] for v in (seed, key, place)])


def _sorted_contexts(batches):
    for columns in _unpacked(batches, CONTEXTS):
        order = np.lexsort(columns[::-1])
        yield _batch(CONTEXTS, [v[order] for v in columns])


def _sorted_pairs(batches):
    """(rep, key, r, p), sorted by (rep, key, p - r, r), of each bucket; pairs with one match are left out, as they have no chain."""
    for rep, key, r, p in _unpacked(batches, PAIRS):
        pair = mixed(rep, key)
        order = np.argsort(pair)
        same = np.diff(pair[order]) == 0
        kept = order[np.append(same, False) | np.append(False, same)]
        rep, key, r, p = rep[kept], key[kept], r[kept], p[kept]
        order = np.lexsort((r, p - r, key, rep))
        yield _batch(PAIRS, [v[order] for v in (rep, key, r, p)])


def _deal_seeds(seed, key, place, buckets, hot):
    """A seed is of one bucket, a hot one of as many as its texts are dealt to."""
    return 0, np.where(among(seed, hot), key, seed).view(np.uint64) % np.uint64(buckets)


def _deal_pairs(rep, key, r, p, buckets):
    """Matches are part 0, dealt by their pair of texts; places of frequent seeds are part 1, dealt by text."""
    return (p < 0).astype(np.int64), np.where(p < 0, key.view(np.uint64), mixed(rep, key)) % np.uint64(buckets)


def _deal_contexts(seed, side, context, key, place, buckets, hot):
    """Runs are part 0, places of hot seeds part 2, dealt by text too, others part 1."""
    prefix, is_hot = context >> 56, among(seed, hot)
    bucket = mixed(seed, side, prefix, np.where(is_hot, key % SALTS, 0))
    return np.where(side == 2, 0, np.where(is_hot, 2, 1)), bucket % np.uint64(buckets)


def _firsts(batches, hot):
    """The first place of each hot seed, side, context and salt."""
    for seed, side, context, key, place in _unpacked(batches, CONTEXTS):
        at = np.flatnonzero(among(seed, hot))
        salt = key[at] % SALTS
        order = np.lexsort((place[at], key[at], salt, context[at], side[at], seed[at]))
        at, salt = at[order], salt[order]
        if len(at):
            new = np.concatenate([[True], (np.diff(seed[at]) != 0) | (np.diff(side[at]) != 0) | (np.diff(context[at]) != 0) | (np.diff(salt) != 0)])
            yield [v[at[new]] for v in (seed, side, context, key, place)]


def _matches(batches, hot=np.zeros(0, np.int64)):
    """Matches (rep, key, r, p) of a partition of (seed, key, place) sorted by these; a seed may lie across batches.

    A seed of FEW places or less has all its places matched with each other.
    The places of a more frequent one, or one of ``hot``, are told as (seed, key, place, -1).
    """
    names = ["seed", "key", "place"]
    held, open_big = [np.zeros(0, np.int64)] * 3, False
    for batch in itertools.chain(batches, [None]):
        seed, key, place = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names)] if batch is not None else held
        if not len(seed):
            continue
        again = np.concatenate([[False], (np.diff(seed) == 0) & (np.diff(key) == 0) & (np.diff(place) == 0)])  # copies of a text
        seed, key, place = (v[~again] for v in (seed, key, place))
        n = len(seed)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(seed)) + 1])
        size = np.diff(np.append(begin, n))
        big = (size > FEW) | np.isin(seed[begin], hot)
        big[0] |= open_big
        ready = np.ones(len(begin), bool)
        ready[-1] = batch is None or big[-1]
        start = np.repeat(begin, size)
        one, two = [], []
        now = np.flatnonzero(np.repeat(ready & ~big & (size > 1), size))
        for j in range(FEW - 1):
            now = now[now - start[now] > j]
            one.append(start[now] + j)
            two.append(now)
        one, two = np.concatenate(one), np.concatenate(two)
        told = np.flatnonzero(np.repeat(ready & big, size))
        told = told[1:] if open_big else told  # the row that was held has been told
        made = [(key[one], key[two], place[one], place[two]), (seed[told], key[told], place[told], np.full(len(told), -1))]
        if len(one) + len(told):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*made)], names=["rep", "key", "r", "p"])
        open_big = bool(big[-1])
        keep = slice(n - 1, n) if open_big else slice(begin[-1], n)
        held = [v[keep] for v in (seed, key, place)]


def runs(seed: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one seed of LEAST_WORDS words or more begin, among rows sorted by (key, place), and their words.

    The step of a run is its period, up to SAMPLE words: of the seeds of a
    period the least alone is sampled.
    """
    on = (np.diff(key) == 0) & (np.diff(seed) == 0) & (np.diff(place) <= SAMPLE)
    begin = np.flatnonzero(np.concatenate([[True], ~on]))
    size = place[np.append(begin[1:], len(seed)) - 1] - place[begin] + SEED_WORDS
    return begin[size >= LEAST_WORDS], size[size >= LEAST_WORDS]


def _contexts(batches):
    """Frequent seeds with what follows and what precedes them, (seed, side, context, key, place), of a partition of (seed, key, place) sorted by (key, place).

    A context holds a byte of each of the next CONTEXT frequent seeds, the
    nearest first, as far as none is more than RUN_GAP words from the one
    before; a place with none on a side is not told for that side.  A run of a
    seed at every word, or every second, third or fourth, is told as side 2 if
    it has LEAST_WORDS words or more, with their number as its context.
    """
    held = [np.zeros(0, np.int64)] * 3
    for batch in itertools.chain(batches, [None]):
        seed, key, place = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("seed", "key", "place"))] if batch is not None else held
        n = len(seed) if batch is None else int(np.searchsorted(key, key[-1])) if len(key) else 0
        held = [v[n:] for v in (seed, key, place)]
        seed, key, place = seed[:n], key[:n], place[:n]
        if not n:
            continue
        near = (np.diff(key) == 0) & (np.diff(place) <= RUN_GAP)
        byte = (seed.view(np.uint64) >> np.uint64(24)) % np.uint64(255) + np.uint64(1)
        made = []
        for side in (0, 1):
            b, ok = (byte, near) if side == 0 else (byte[::-1], near[::-1])
            context, go = np.zeros(n, np.uint64), np.ones(n, bool)
            for j in range(1, min(CONTEXT, n - 1) + 1):
                go[: n - j] &= ok[j - 1 :]
                go[n - j :] = False
                context[: n - j] |= np.where(go[: n - j], b[j:], np.uint64(0)) << np.uint64(8 * (CONTEXT - j))
            context = context if side == 0 else context[::-1]
            at = np.flatnonzero(context)
            made.append((seed[at], np.full(len(at), side), context[at].view(np.int64), key[at], place[at]))
        at, size = runs(seed, key, place)
        made.append((seed[at], np.full(len(at), 2), size, key[at], place[at]))
        for columns in made:
            for k in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 200_000]) for v in columns], names=["seed", "side", "context", "key", "place"])


def _neighbours(batches):
    """Matches (rep, key, r, p) of a partition sorted by (seed, side, context, key, place): of what stands next to each other.

    Texts that go on alike for longest after a seed (before it, for side 1) are
    neighbours, whatever other texts hold the seed.  A text's places with one
    context are matched in turn, and the first of them with the next text.
    """
    names = ["seed", "side", "context", "key", "place"]
    held = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        seed, side, context, key, place = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names)]
        n, old = len(seed), len(held[0])
        if not n:
            continue
        same = np.concatenate([[False], (np.diff(seed) == 0) & (np.diff(side) == 0) & (context[1:] >> 56 == context[:-1] >> 56)])
        inner = same & np.concatenate([[False], (np.diff(context) == 0) & (np.diff(key) == 0)])
        head = np.flatnonzero(~inner)
        rows = np.flatnonzero(inner)
        rows = rows[rows > 1] if old == 2 else rows
        next_ = head[1:][same[head[1:]]]
        one, two = np.concatenate([rows - 1, head[:-1][same[head[1:]]]]), np.concatenate([rows, next_])
        swap = (key[one] > key[two]) | (key[one] == key[two]) & (place[one] > place[two])
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        if len(one):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key[one], key[two], place[one], place[two])], names=["rep", "key", "r", "p"])
        keep = np.unique([head[-1], n - 1])
        held = [v[keep] for v in (seed, side, context, key, place)]


def _chains(batches):
    """Chains of a partition sorted by (rep, key, p - r, r); a pair may lie across batches."""
    left = None

    def take(rep, key, r, p, last):
        edge = np.concatenate([[0], np.flatnonzero((np.diff(rep) != 0) | (np.diff(key) != 0)) + 1, [len(rep)]])
        said, size, made = [], [], []
        for k in np.flatnonzero(hopeful(edge, r, p)[: None if last else -1]).tolist():
            a, b = edge[k], edge[k + 1]
            for blocks in chain(r[a:b], p[a:b]):
                said.append(a)
                size.append(len(blocks))
                made.extend(blocks)
        return [rep[said], key[said], size, made] if said else None, edge[-2]

    def told(rows):
        rep, key, size, made = rows
        made = np.array(made, np.int64)
        blocks = pa.StructArray.from_arrays([pa.array(made[:, i]) for i in range(3)], names=["r", "p", "n"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(key), pa.ListArray.from_arrays(offsets, blocks)], names=["rep", "key", "blocks"])

    for batch in batches:
        now = [batch.column(c).to_numpy() for c in ("rep", "key", "r", "p")]
        if left is not None:
            now = [np.concatenate([a, b]) for a, b in zip(left, now)]
        if not len(now[0]):
            continue
        rows, rest = take(*now, False)
        left = [c[rest:] for c in now]
        if rows:
            yield told(rows)
    if left is not None and len(left[0]):
        rows, _ = take(*left, True)
        if rows:
            yield told(rows)


def _unlike(batches):
    """Places of frequent seeds, (seed, key, place, label, before, gap), of a partition of (key, place, seed, label) sorted by (key, place).

    before and gap: the frequent seed before the place and the words between, 0
    for the first of a text.  Within a run of one seed, not more than SAMPLE
    words apart, one place in RUN_STEP and the last are told.
    """
    names = ["seed", "key", "place", "label"]
    held = [np.zeros(0, np.int64)] * 4
    for batch in itertools.chain(batches, [None]):
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names)] if batch is not None else held
        n = len(rows[0]) if batch is None else int(np.searchsorted(rows[1], rows[1][-1])) if len(rows[1]) else 0
        held = [v[n:] for v in rows]
        seed, key, place, label = (v[:n] for v in rows)
        if not n:
            continue
        inner = np.concatenate([[False], np.diff(key) == 0])
        before = np.where(inner, np.roll(seed, 1), 0)
        gap = np.where(inner, place - np.roll(place, 1), 0)
        by = np.lexsort((place, seed, key))
        on = np.concatenate([[False], (np.diff(key[by]) == 0) & (np.diff(seed[by]) == 0) & (np.diff(place[by]) <= SAMPLE)])
        first = np.flatnonzero(~on)
        at = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        kept = np.sort(by[(at % RUN_STEP == 0) | ~np.append(on[1:], False)])
        for k in range(0, len(kept), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[kept[k : k + 200_000]]) for v in (seed, key, place, label, before, gap)], names=[*names, "before", "gap"])


def word_pairs(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the word pairs of windows (16 bits a word); the k-th of equal pairs of a window is a column of its own."""
    words = [np.frombuffer(w, np.uint16).astype(np.int64) for w in windows]
    pair = [w[:-1] << 16 | w[1:] for w in words]
    row, pair = np.repeat(np.arange(len(pair)), [len(x) for x in pair]), np.concatenate(pair)
    both = np.sort(row << 32 | pair)
    row, pair = both >> 32, both & 0xFFFFFFFF
    first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(pair) != 0)])) if len(row) else row
    again = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row, np.unique(pair << 20 | again, return_inverse=True)[1]


def alike(windows: list[bytes], label: np.ndarray, split: int, least: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Windows i < j, of different labels or none (0), with ``least`` word pairs in common; with ``split``, i is below it and j is not.

    Word pairs of many windows are counted by a product of matrices, the others
    by the windows that hold them.
    """
    n = len(windows)
    row, column = word_pairs(windows)
    often = np.bincount(column, minlength=1)
    common = (often > 1) & (often * 16 > n)
    dense = np.zeros((n, int(common.sum())), np.float32)
    dense[row[common[column]], (np.cumsum(common) - 1)[column[common[column]]]] = 1
    kept = (often[column] > 1) & ~common[column]
    row, column = row[kept], column[kept]
    holders = row[np.argsort(column, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(often)))])
    begin, end = start[column], start[column + 1]
    edge = np.searchsorted(row, np.arange(n + 1))
    rare = np.diff(edge)
    one, two = [], []
    top = split or n
    for a in range(0, top, 256):
        b = min(a + 256, top)
        low = split or a  # windows before it are no second ones
        same = len(set(label[a:b].tolist())) == 1 and label[a] != 0
        others = low + np.flatnonzero(label[low:] != label[a]) if same else np.arange(low, n)
        if not len(others):
            continue
        shared = dense[a:b] @ dense[others].T
        where = np.full(n, -1)
        where[others] = np.arange(len(others))
        for i in (a + np.flatnonzero((rare[a:b] > 0) & (shared.max(1) + rare[a:b] >= least))).tolist():  # the others cannot come to ``least``
            met = where[np.concatenate([holders[x:y] for x, y in zip(begin[edge[i] : edge[i + 1]].tolist(), end[edge[i] : edge[i + 1]].tolist())])]
            shared[i - a] += np.bincount(met[met >= 0], minlength=len(others))
        x, y = np.nonzero(shared >= least)
        x, y = x + a, others[y]
        ok = (x < y) & ((label[x] != label[y]) | (label[x] == 0))
        one.append(x[ok])
        two.append(y[ok])
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64),) * 2


def fewest_edits(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Edits between the first i words of a column of ``a`` and a beginning of that of ``b``, the fewest if both end with one word; and of all words with any beginning.

    The other way round too.  Columns are pairs of texts, rows i from 0 on.
    Diagonals of all pairs' tables are filled at once.
    """
    n, pairs = a.shape
    back, high = np.ascontiguousarray(b[::-1]), np.uint8(255)
    before, last, now = (np.full((n + 1, pairs), high) for _ in range(3))
    one, two = np.full((n + 1, pairs), high), np.full((n + 1, pairs), high)
    last[0] = one[0] = two[0] = 0
    whole = np.full((2, pairs), high)
    for k in range(1, 2 * n + 1):  # cells (i, k - i)
        x, y = max(k - n, 1), min(n, k - 1)
        if x <= y:
            cell, other = now[x : y + 1], (a[x - 1 : y] != back[n - k + x : n - k + y + 1]).view(np.uint8)
            same = np.maximum(before[x - 1 : y], np.negative(other))  # 255 if the words differ
            np.minimum(one[x : y + 1], same, out=one[x : y + 1])
            np.minimum(two[k - y : k - x + 1], same[::-1], out=two[k - y : k - x + 1])
            np.add(before[x - 1 : y], other, out=cell)
            np.minimum(cell, np.minimum(last[x - 1 : y], last[x : y + 1]) + np.uint8(1), out=cell)
        if k <= n:
            now[0] = now[k] = k
        if k >= n:
            np.minimum(whole, now[[n, k - n]], out=whole)
        before, last, now = last, now, before
    return (one, whole[0]), (two, whole[1])


def may_match(sides: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs may have few enough edits, by words of one that the other has not on the same side, or not so often; see ``few_edits``.

    Each of these is an edit at least, so no pair with few enough edits is left out.
    """
    _, n, count = sides.shape
    codes, held = [], np.zeros((2, count, SLOTS + 1), bool)
    for side, words in zip(held, sides):
        words = np.ascontiguousarray(words.T)
        order = np.argsort(words, axis=1, kind="stable")
        row = np.arange(count)[:, None]
        ordered = words[row, order]
        new = np.concatenate([np.ones((count, 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
        again = np.empty_like(order)
        again[row, order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1)
        code = np.where(words < 0, SLOTS, (words + again * 25931) % SLOTS)
        side[row, code] = True
        side[:, SLOTS] = False
        codes.append((code, np.where(words < 0, SLOTS, words % SLOTS)))
    lacks = [(~side).view(np.uint8).ravel() for side in held]
    share, step = (1 - SIMILARITY) / SIMILARITY, np.arange(n + 1, dtype=np.float32)[:, None]
    rest, most = np.maximum(LEAST_WORDS - SEED_WORDS - np.arange(n + 1), 0), AROUND + SEED_WORDS - 1 - SHARED
    out = np.zeros(len(one), bool)
    for k in range(0, len(one), 512):
        i, j = one[k : k + 512], two[k : k + 512]
        within, beyond = [], np.zeros(len(i), bool)
        for at, to in ((i, j), (j, i)):
            found = []
            base = (to * (SLOTS + 1))[:, None]
            for (code, any_), side in zip(codes, lacks):
                missed = np.zeros((n + 1, len(at)), np.float32)
                missed[1:] = np.cumsum(side.take((code[at] + base).T), axis=0, dtype=np.uint8)
                whole = np.where(code[at, -1] == SLOTS, 1e6, missed[-1])
                missed[1:] += side.take((any_[at] + base).T) * np.float32(1e6)  # no passage ends there
                found.append((missed - share * step, whole, missed))
            (less, lowest, before), (more, highest, after) = found
            best = np.minimum.accumulate(more[::-1])[::-1]
            within.append((less + best[rest] <= share * SEED_WORDS + 1e-3).any(0))
            beyond |= np.minimum((2 * before - step).min(0) + 2 * highest, (2 * after - step).min(0) + 2 * lowest) <= most
            beyond |= 2 * (lowest + highest) - AROUND <= most
        out[k : k + 512] = beyond | within[0] & within[1]
    return out


def few_edits(windows: list[bytes], place: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of windows around one seed may have a passage there that aligns their two places.

    A passage within the windows begins and ends with words that agree, has
    LEAST_WORDS words in either text and edits up to a share of 1 - SIMILARITY
    of the longer side, which is a fourth of the other at most.  One that goes
    on beyond them may have more edits here, as long as SHARED word pairs have none.
    """
    sides = np.full((2, AROUND, len(windows)), -1, np.int32)  # words before each place, from the place on, and after it
    for i in np.unique(np.concatenate([one, two])).tolist():
        words, at = np.frombuffer(windows[i], np.uint16), min(int(place[i]), AROUND)
        sides[0, :at, i] = words[:at][::-1]
        after = words[at + SEED_WORDS :][:AROUND]
        sides[1, : len(after), i] = after
    used, both = np.unique(np.concatenate([one, two]), return_inverse=True)
    kept = np.flatnonzero(may_match(sides[:, :, used], both[: len(one)], both[len(one) :]))
    step, out, good = np.arange(AROUND + 1, dtype=np.float32)[:, None], np.zeros(len(kept), bool), np.zeros(len(one), bool)
    one, two = one[kept], two[kept]
    rest = np.maximum(LEAST_WORDS - SEED_WORDS - np.arange(AROUND + 1), 0)
    far = lambda edits: np.where(edits == 255, 1e6, edits).astype(np.float32)
    for k in range(0, len(one), 512):
        i, j = one[k : k + 512], two[k : k + 512]
        found = [fewest_edits(x[:, i], np.where(x[:, j] < 0, -2, x[:, j])) for x in sides]
        within, beyond = [], np.zeros(len(i), bool)
        for n, at in enumerate((i, j)):
            (less, lowest), (more, highest) = ((far(f[n][0]), np.where(x[-1, at] < 0, 1e6, f[n][1])) for x, f in zip(sides, found))
            for share in (1 - SIMILARITY, (1 - SIMILARITY) / SIMILARITY):
                best = np.minimum.accumulate((more - share * step)[::-1])[::-1]  # after the place, of so many words or more
                within.append((less - share * step + best[rest] <= share * SEED_WORDS + 1e-3).any(0))
            most = AROUND + SEED_WORDS - 1 - SHARED
            beyond |= np.minimum((2 * less - step).min(0) + 2 * highest, (2 * more - step).min(0) + 2 * lowest) <= most
            beyond |= 2 * (lowest + highest) - AROUND <= most
        out[k : k + 512] = beyond | within[0] & within[3] | within[1] & within[2]
    good[kept] = out
    return good


def _compared(batches):
    """Pairs of texts (rep, key) that are alike around a place, of a partition of (seed, lo, hi, block, label, key, place, words) sorted by these.

    Rows of one seed, lo and hi are two blocks of its places, or one; one such
    group is held.
    """
    names, numbers = ["seed", "lo", "hi", "block", "label", "key", "place"], 7
    told = [np.zeros(0, np.uint64)]  # hashes of the pairs told so far
    met: list[tuple] = []  # (windows, place, key, one, two) of groups whose edits are not counted yet

    def take(columns, words):
        seed, lo, hi, block, label, key, place = columns
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(place) != 0) | (np.diff(block) != 0)])  # copies of a text
        at = np.flatnonzero(new)
        if len(at) < 2:
            return
        split = int(np.searchsorted(block[at], hi[0])) if lo[0] != hi[0] else 0
        if lo[0] != hi[0] and split in (0, len(at)):
            return
        one, two = alike([words[k] for k in at.tolist()], label[at], split)
        if len(one):
            used, both = np.unique(np.concatenate([one, two]), return_inverse=True)
            at = at[used]
            met.append(([words[k] for k in at.tolist()], place[at], key[at], both[: len(one)], both[len(one) :]))

    def counted():
        start = np.cumsum([0] + [len(m[0]) for m in met])
        windows = [w for m in met for w in m[0]]
        place, key = (np.concatenate([m[k] for m in met]) for k in (1, 2))
        one, two = (np.concatenate([m[k] + x for m, x in zip(met, start)]) for k in (3, 4))
        met.clear()
        a, b = np.minimum(key[one], key[two]), np.maximum(key[one], key[two])
        pair = mixed(a, b)
        found = []
        for once in (True, False):  # of a pair of texts that is told, no other places are looked at
            left = np.flatnonzero(~among(pair, told[0]))
            at = left[np.unique(pair[left], return_index=True)[1]] if once else left
            if len(at):
                found.append(at[few_edits(windows, place, one[at], two[at])])
                told[0] = np.union1d(told[0], pair[found[-1]])
        found = np.concatenate([np.zeros(0, np.int64), *found])
        pairs = np.unique(np.stack([a[found], b[found]]), axis=1)
        for k in range(0, pairs.shape[1], 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 200_000]) for v in pairs], names=["rep", "key"])

    held, said = [np.zeros(0, np.int64)] * numbers, []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names)]
            said = said + batch.column("words").to_pylist()
        if said:
            edge = np.concatenate([[0], np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1]).tolist()
            for a, b in itertools.pairwise([*edge, len(said)] if batch is None else edge):
                take([v[a:b] for v in held], said[a:b])
                if sum(len(m[3]) for m in met) >= 2048:
                    yield from counted()
            held, said = [v[edge[-1] :] for v in held], said[edge[-1] :]
    if met:
        yield from counted()


def sorted_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of a text, in this order; of a run of one seed as in ``_unlike``."""
    seed, place = seeds(words)
    by = np.lexsort((place, seed))
    seed, place = seed[by], place[by]
    on = np.concatenate([[False], (np.diff(seed) == 0) & (np.diff(place) <= SAMPLE)])[: len(seed)]
    first = np.flatnonzero(~on)
    at = np.arange(len(seed)) - np.repeat(first, np.diff(np.append(first, len(seed))))
    kept = (at % RUN_STEP == 0) | ~np.append(on[1:], False)[: len(seed)]
    return seed[kept], place[kept]


def all_matches(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the seeds that two texts (their ``sorted_seeds``) share, sorted for ``chain``."""
    (s, r), (t, p) = one, two
    begin, end = np.searchsorted(t, s), np.searchsorted(t, s, side="right")
    size = end - begin
    r = np.repeat(r, size)
    p = p[np.repeat(begin, size) + np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)]
    if itself:
        r, p = r[r < p], p[r < p]
    order = np.lexsort((r, p - r))
    return r[order], p[order]


def hot_seeds(keyed: DataFrame) -> list[int]:
    """Seeds that hold over 1 / HOT_SEEDS of all places in one text of HOT_TEXTS, so HOT_SEEDS at most.

    They are frequent for certain; which of the frequent ones are known to be
    hot decides only how places are dealt to tasks, not what is matched.
    """
    places = keyed.where(F.pmod("key", F.lit(HOT_TEXTS)) == 0).mapInArrow(_seed_rows, "seed long, key long, place long")
    counted = cut(places.select("seed").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST))
    least = places.count() / HOT_SEEDS if counted.limit(HOT_SEEDS + 1).count() > HOT_SEEDS else 0
    return [r.seed for r in counted.where(F.col("n") > least).select("seed").collect()]


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("bucket").sortWithinPartitions("bucket")


def _kept_as(kinds: dict) -> str:
    return "part long, bucket long, " + ", ".join(f"{c} binary" for c in kinds)


def _seed_matches(keyed: DataFrame, hot: np.ndarray, buckets: int) -> tuple[DataFrame, str]:
    """What ``_matches`` tells of all seeds, stored in blocks (see ``_deal_pairs``)."""
    found = keyed.mapInArrow(lambda batches: _blocks(_text_seeds(batches), SEEDS, partial(_deal_seeds, buckets=buckets, hot=hot)), _kept_as(SEEDS))

    def matched(batches):
        return _blocks(_columns(_matches(_sorted_seeds(batches, hot), hot), PAIRS), PAIRS, partial(_deal_pairs, buckets=buckets))

    return stored(_dealt(found).mapInArrow(matched, _kept_as(PAIRS)))


def _run_chains(told: DataFrame) -> DataFrame:
    """(rep, key, blocks): runs of a seed, each with the longest run of it, from (seed, words, key, place).

    Two runs of a seed are alike for as long as the shorter one is.
    """
    longest = told.groupBy("seed").agg(F.max(F.struct("words", "key", "place")).alias("most"))
    beside = told.join(longest, "seed").where("key != most.key or place != most.place")
    return beside.select(F.col("most.key").alias("rep"), "key", F.array(F.struct(F.col("most.place").alias("r"), F.col("place").alias("p"), F.col("words").alias("n"))).alias("blocks"))


def _context_matches(matches: DataFrame, hot: np.ndarray, buckets: int) -> tuple[DataFrame, DataFrame, str]:
    """Matches of frequent seeds' places with their neighbours, in blocks, chains of runs, and the path of what both are read from.

    Places of a hot seed are salted by text and matched salt by salt; the first
    place of each salt and context is then a neighbour of the others.
    """

    def told(batches):
        return _blocks(_columns(_contexts(_sorted_places(batches)), CONTEXTS), CONTEXTS, partial(_deal_contexts, buckets=buckets, hot=hot))

    def beside(batches):
        return _blocks(_columns(_neighbours(_sorted_contexts(batches)), PAIRS), PAIRS, partial(_deal_pairs, buckets=buckets))

    def firsts(batches):
        return _blocks(_firsts(batches, hot), CONTEXTS, partial(_deal_contexts, buckets=buckets, hot=np.zeros(0, np.int64)))

    def runs_told(batches):
        return (_batch(("seed", "words", "key", "place"), (seed, words, key, place)) for seed, _, words, key, place in _unpacked(batches, CONTEXTS))

    contexts, path = stored(_dealt(matches.where("part = 1")).mapInArrow(told, _kept_as(CONTEXTS)))
    chains = _run_chains(contexts.where("part = 0").mapInArrow(runs_told, "seed long, words long, key long, place long"))
    by_context = _dealt(contexts.where("part > 0"))
    found = by_context.mapInArrow(beside, _kept_as(PAIRS))
    if len(hot):
        found = found.union(_dealt(by_context.mapInArrow(firsts, _kept_as(CONTEXTS))).mapInArrow(beside, _kept_as(PAIRS)))
    return found, chains, path


def chained_pairs(keyed: DataFrame, words: int) -> tuple[DataFrame, DataFrame, str]:
    """(rep, key, blocks): the chains of texts of (key, text), of so many words in all; the places of frequent seeds, (seed, key, place), and the path of their table."""
    spark, hot = keyed.sparkSession, np.array(sorted(hot_seeds(keyed)), np.int64)
    buckets = max(1, math.ceil(2 * words / (SAMPLE + 1) / BUCKET))
    matches, path = _seed_matches(keyed, hot, buckets)
    release(spark)
    beside, lasting, second = _context_matches(matches, hot, buckets)
    both = _dealt(matches.where("part = 0").union(beside))
    chains = both.mapInArrow(lambda batches: _chains(_sorted_pairs(batches)), "rep long, key long, blocks array<struct<r: long, p: long, n: long>>")
    chains = cut(chains.union(lasting))
    forget(spark, second)

    def places(batches):
        return (_batch(SEEDS, columns[:3]) for columns in _unpacked(batches, PAIRS))

    return chains, matches.where("part = 1").mapInArrow(places, "seed long, key long, place long"), path


def label_of(spans: list[dict] | None, place: int, words: int) -> set[int]:
    """Label of the passage in which so many words from a place lie, or none."""
    return {s["label"] for s in spans or [] if s["from"] <= place and place + words <= s["to"]}


def rest_chains(keyed: DataFrame, places: DataFrame, islands: DataFrame) -> DataFrame:
    """(rep, key, blocks) of the texts of (key, text) that are alike around two places of a frequent seed and not of one class there.

    ``islands`` has the passages known so far, (key, from, to, root).  A seed
    whose places are all of one class has nothing to compare, nor has one that
    always follows another at one distance, with no word between: a passage
    goes on from it to the other.  The others' places are dealt to blocks by text, and
    any two blocks are compared, so the work grows with the square of the
    places of a seed, a task's memory does not.
    """
    spark = keyed.sparkSession
    passed = islands.select(F.col("key").alias("of"), "from", "to", F.xxhash64("root").alias("label"))
    inside = (F.col("key") == F.col("of")) & (F.col("place") >= F.col("from")) & (F.col("place") + SEED_WORDS <= F.col("to"))
    labelled = places.join(passed, inside, "left").select("seed", "key", "place", F.coalesce("label", F.lit(0).cast("long")).alias("label"))
    by_key = labelled.repartition(F.xxhash64("key"))  # by the key itself, Spark would rely on the join, whose parts it may split or read as they lie
    told = by_key.sortWithinPartitions("key", "place").mapInArrow(_unlike, "seed long, key long, place long, label long, before long, gap long")
    told, path = stored(told)
    ends = [f(c).alias(f"{n}_{c}") for c in ("label", "before", "gap") for f, n in ((F.min, "least"), (F.max, "most"))]
    counted = told.groupBy("seed").agg(F.count("*").alias("n"), *ends).where("n > 1 and (least_label != most_label or least_label = 0)")
    follows = (F.col("least_gap") > 0) & (F.col("most_gap") <= SEED_WORDS) & (F.col("least_gap") == F.col("most_gap")) & (F.col("least_before") == F.col("most_before")) & (F.col("least_before") != F.col("seed"))
    wanted = told.join(counted.where(~follows).select("seed", "n"), "seed").groupBy("key").agg(F.collect_list(F.struct("seed", "place", "label", "n")).alias("wanted"))
    done: set[int] = set()

    def windows(key, words, wanted):
        if key in done:
            return
        done.add(key)
        words = words.astype(np.uint16)
        sides = [(words ^ np.uint16(BEFORE)).tobytes(), words.tobytes()]
        for w in wanted:
            at = 2 * w["place"]
            yield key, w["seed"], w["place"], w["label"], w["n"], sides[0][max(at - 2 * AROUND, 0) : at] + sides[1][at : at + 2 * (SEED_WORDS + AROUND)]

    around = per_text(keyed.join(wanted, "key"), ["key", "text", "wanted"], "key long, seed long, place long, label long, n long, words binary", windows)
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = around.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("key"), blocks)}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("seed", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "label", "key", "place", "words")
    order = ["seed", "lo", "hi", "block", "label", "key", "place"]
    pairs = cut(dealt.repartition("seed", "lo", "hi").sortWithinPartitions(*order).mapInArrow(_compared, "rep long, key long").distinct())
    forget(spark, path)
    release(spark)
    held = islands.groupBy("key").agg(F.collect_list(F.struct("from", "to", F.xxhash64("root").alias("label"))).alias("spans"))
    texts = keyed.join(pairs.select("key").union(pairs.select("rep")).distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).join(held, "key", "left")
    both = pairs.join(texts.select(F.col("key").alias("rep"), F.col("text").alias("first"), F.col("spans").alias("first_spans")), "rep").join(texts, "key")

    known: dict[bytes, int] = {}
    met: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # seeds of some texts that were met
    n_met = [0]

    def found(key, text):
        if key not in met:
            if n_met[0] >= DEALT:
                met.clear()
                n_met[0] = 0
            met[key] = sorted_seeds(word_hashes(text, known))
            n_met[0] += len(met[key][0])
        return met[key]

    def chains(rep, key, first, first_spans, text, spans):
        r, p = all_matches(found(rep, first), found(key, text), rep == key)
        for blocks in chain(r, p) if len(r) else []:
            if not all(label_of(first_spans, x, z) & label_of(spans, y, z) for x, y, z in blocks):  # else nothing new
                yield rep, key, [{"r": x, "p": y, "n": z} for x, y, z in blocks]

    return cut(per_row(both, ["rep", "key", "first", "first_spans", "text", "spans"], "rep long, key long, blocks array<struct<r: long, p: long, n: long>>", chains))


def passage_pairs(keyed: DataFrame, chains: DataFrame) -> DataFrame:
    """(rep, rep_from, rep_to, key, from, to) from (key, text), with one key for equal texts, and chains: aligned passages, in words.

    Words around chains travel as 32 bits of their hashes.
    """
    release(keyed.sparkSession)
    first, last = F.element_at("blocks", 1), F.element_at("blocks", -1)
    side = lambda key, c: chains.select(F.col(key).alias("key"), F.greatest(first[c] - MARGIN, F.lit(0)).alias("from"), (last[c] + last["n"] + MARGIN).alias("to"))
    wanted = side("rep", "r").union(side("key", "p")).groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("wanted"))

    done: set[int] = set()

    def slices(key, words, wanted):
        if key in done:
            return
        done.add(key)
        words = words.astype(np.int32)
        for w in wanted:
            yield key, w["from"], w["to"], words[w["from"] : w["to"]].tobytes()

    cuts = per_text(keyed.join(wanted, "key"), ["key", "text", "wanted"], "key long, `from` long, `to` long, words binary", slices)
    cuts, path = stored(cuts.groupBy("key", "from", "to").agg(F.first("words").alias("words")))
    release(keyed.sparkSession)
    named = lambda n: cuts.select(F.col("key").alias(f"k{n}"), F.col("from").alias(f"f{n}"), F.col("to").alias(f"t{n}"), F.col("words").alias(f"w{n}"))
    placed = chains.withColumns({"a": F.greatest(first["r"] - MARGIN, F.lit(0)), "b": last["r"] + last["n"] + MARGIN, "c": F.greatest(first["p"] - MARGIN, F.lit(0)), "d": last["p"] + last["n"] + MARGIN})
    both = placed.join(named(1), (F.col("rep") == F.col("k1")) & (F.col("a") == F.col("f1")) & (F.col("b") == F.col("t1"))).join(named(2), (F.col("key") == F.col("k2")) & (F.col("c") == F.col("f2")) & (F.col("d") == F.col("t2")))

    found = cut(both.select("rep", "key", "blocks", "a", "c", "w1", "w2").mapInArrow(_aligned, "rep long, rep_from long, rep_to long, key long, `from` long, `to` long"))
    forget(keyed.sparkSession, path)
    return found


def _aligned(batches):
    """The passages along chains, from (rep, key, blocks, a, c, w1, w2): the words of both texts from places a and c on."""
    for batch in batches:
        made = []
        blocks = batch.column("blocks")
        flat, edge = blocks.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(blocks).to_numpy())]).tolist()
        rows = list(zip(*(flat.field(n).to_numpy().tolist() for n in ("r", "p", "n"))))
        whole = [batch.column(c).to_numpy().tolist() for c in ("rep", "key", "a", "c")]
        words = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("w1", "w2")]
        for x, y, rep, key, a, c, w1, w2 in zip(edge, edge[1:], *whole, *words):
            for r0, r1, p0, p1 in passages(np.frombuffer(w1, np.int32), np.frombuffer(w2, np.int32), [(r - a, p - c, n) for r, p, n in rows[x:y]]):
                made.append((rep, r0 + a, r1 + a, key, p0 + c, p1 + c))
        if made:
            yield _batch(("rep", "rep_from", "rep_to", "key", "from", "to"), np.array(made, np.int64).T)


def _islands(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, from, to, root): maximal stretches of overlapping passages, with one root for a class, from ``passage_pairs`` and the texts that have copies."""
    pairs = cut(found.withColumn("pair", F.monotonically_increasing_id()))

    none = F.lit(None).cast("long")
    spans = pairs.select("key", "from", "to", "pair").union(pairs.select("rep", "rep_from", "rep_to", "pair"))
    whole = classes.where((F.col("copies") > 1) & (F.col("words") >= LEAST_WORDS)).select("key", F.lit(0).cast("long"), "words", none)
    order = Window.partitionBy("key").orderBy("from", "to", "pair")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = spans.union(whole).withColumn("reach", reach).withColumn("island", F.sum(F.coalesce((F.col("from") > F.col("reach")).cast("long"), F.lit(1))).over(order))
    placed = cut(placed.select(F.struct("key", "island").alias("node"), "from", "to", "pair"))
    islands = cut(placed.groupBy("node").agg(F.min("from").alias("from"), F.max("to").alias("to")))
    ends = placed.where("pair is not null").groupBy("pair").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u != v").select("u", "v")
    return cut(islands.join(components(ends), "node", "left").select("node.key", "from", "to", F.coalesce("root", "node").alias("root")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs`` with a passage of LEAST_WORDS words or more that stands elsewhere too, in another row or in itself.

    Columns: doc_id, n_words, n_repeated (words in passages), n_passages
    (maximal runs of such words), n_links (other rows in the classes of its
    passages, class by class), class_id (smallest doc_id of these classes),
    partner_id (the smallest other doc_id there, or its own), passages (from,
    to, class_id, members of each).  Passages that were aligned with each other
    or overlap are of one class, so a class of n is told by n rows, not n².
    Rows that repeat a text are each other's passages from end to end.  Null
    and short texts have none.  A passage that a text holds twice counts at
    both places.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kind = dict(named.dtypes)["doc_id"]
    keyed = with_hashes(named)

    def counted(batches):
        for batch in batches:
            count = [word_counts(part.column("text")) for part in sliced(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate([np.zeros(0, np.int64), *count]))], names=["doc_id", "h1", "h2", "n_words"])

    sized = cut(keyed.select("doc_id", "h1", "h2", "text").mapInArrow(counted, f"doc_id {kind}, h1 long, h2 long, n_words long"))
    key = text_key(sized)
    sized = sized.select("doc_id", key.alias("key"), "n_words")
    classes = cut(sized.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("n_words").alias("words")))
    texts = keyed.select(key.alias("key"), "text")
    chains, places, path = chained_pairs(texts, sized.agg(F.sum("n_words")).first()[0] or 0)
    pairs = passage_pairs(texts, chains)
    rooted = _islands(pairs, classes)
    more = rest_chains(texts, places, rooted)
    forget(docs.sparkSession, path)
    if not more.isEmpty():
        rooted = _islands(pairs.union(passage_pairs(texts, more)), classes)
    members = rooted.select("root", "key").distinct().join(classes, "key").groupBy("root").agg(F.sum("copies").alias("members"), F.min("least").alias("least"), F.max("most").alias("most"))
    held = rooted.join(members, "root").withColumn("again", F.row_number().over(Window.partitionBy("key", "root").orderBy("from")) > 1)
    told = held.groupBy("key").agg(
        F.sum(F.col("to") - F.col("from")).alias("n_repeated"), F.count("*").alias("n_passages"),
        F.sum(F.when(F.col("again"), 0).otherwise(F.col("members") - 1)).alias("n_links"), F.min("least").alias("class_id"), F.max("most").alias("most"),
        F.sort_array(F.collect_list(F.struct("from", "to", F.col("least").alias("class_id"), "members"))).alias("passages"),
    )
    partner = F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.col("most")).otherwise(F.col("class_id"))
    return sized.join(told, "key").select("doc_id", "n_words", "n_repeated", "n_passages", "n_links", "class_id", partner.alias("partner_id"), "passages")
