"""External induced sorting of suffixes with common-prefix values.

Suffixes wait in priority queues keyed by first character; a queue's contents
go to an anonymous scratch file of the task when memory is short.  Tuples are
(position, length of the prefix shared with the tuple before it).  L suffixes
are induced upwards from the sorted S* suffixes, then S suffixes downwards from
the L suffixes; the same two scans first sort the S* substrings, whose names
form a shorter string that is sorted recursively.

Prefix values are exact up to ``cap``; suffixes that agree on ``cap``
characters may come in either order.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples handled at once.
BLOCK = 1 << 18
FAR = np.iinfo(np.int32).max


class Queues:
    """Tuples by first character, in order of arrival, beyond ``memory`` bytes on disk."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file, self.end = memory, 0, None, 0
        self.parts: dict[int, list] = {}

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(c, []).append(np.stack([pos, lcp]).astype(np.int32))
        self.held += 8 * len(pos)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for parts in self.parts.values():
            loose = [p for p in parts if isinstance(p, np.ndarray)]
            if loose:
                whole = np.concatenate(loose, axis=1)
                self.file.write(np.ascontiguousarray(whole.T).tobytes())
                parts[:] = [p for p in parts if not isinstance(p, np.ndarray)] + [(self.end, whole.shape[1])]
                self.end += 8 * whole.shape[1]
        self.held = 0

    def _read(self, part, a: int, b: int) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part[:, a:b]
        self.file.seek(part[0] + 8 * a)
        return np.frombuffer(self.file.read(8 * (b - a)), np.int32).reshape(-1, 2).T

    def _blocks(self, parts: list, backwards: bool):
        for part in reversed(parts) if backwards else parts:
            n = part.shape[1] if isinstance(part, np.ndarray) else part[1]
            starts = range(0, n, BLOCK)
            for a in reversed(starts) if backwards else starts:
                yield self._read(part, a, min(n, a + BLOCK))

    def pop(self, c: int):
        """Blocks of what waits at ``c`` now; what arrives meanwhile waits for the next call."""
        parts = self.parts.pop(c, [])
        self.held -= sum(8 * p.shape[1] for p in parts if isinstance(p, np.ndarray))
        loose = [p for p in parts if isinstance(p, np.ndarray)]
        if len(loose) > 8:  # many small arrivals: join neighbours
            parts = [p for p in parts if not isinstance(p, np.ndarray)] + [np.concatenate(loose, axis=1)]
        yield from self._blocks(parts, False)

    def backwards(self, c: int):
        yield from self._blocks(self.parts.pop(c, []), True)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Push:
    """Sends the predecessors of sorted blocks to their queues, with the prefix they share.

    Two predecessors with the same character share one character more than
    their origins, whose shared prefix is the least value between them; origins
    with different first characters share nothing.
    """

    def __init__(self, s: np.ndarray, top: int, queues: Queues, cap: int):
        self.s, self.queues, self.cap = s, queues, cap
        self.value, self.block, self.origin = np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64), np.full(top + 1, -1, np.int64)
        self.least: list[int] = []
        self.now = -1

    def begin(self, c: int) -> None:
        self.now, self.least = c, []

    def __call__(self, pos: np.ndarray, lcp: np.ndarray, keep) -> None:
        """``keep``: of the predecessors' characters, which to send."""
        if not len(pos):
            return
        at = np.flatnonzero(pos > 0)
        x = self.s[pos[at] - 1]
        good = keep(x)
        at, x = at[good], x[good]
        if len(at):
            self._send(pos, lcp, at, x)
        self.least.append(int(lcp.min()))

    def _send(self, pos, lcp, at, x) -> None:
        order = np.argsort(x, kind="stable")
        at, x = at[order], x[order]
        first = np.concatenate([[True], x[1:] != x[:-1]])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(x))
        shared = np.empty(len(at), np.int64)
        later = np.flatnonzero(~first)
        if len(later):
            shared[later] = range_min(lcp, at[later - 1] + 1, at[later])
        heads = x[begin]
        prefix = np.minimum.accumulate(lcp)
        since = np.append(np.minimum.accumulate(np.array(self.least[::-1], np.int64))[::-1], FAR) if self.least else np.array([FAR])
        known = np.minimum(np.minimum(self.value[heads], since[np.minimum(self.block[heads] + 1, len(since) - 1)]), prefix[at[begin]])
        shared[begin] = np.where(self.origin[heads] == self.now, known, np.where(self.origin[heads] < 0, -1, 0))
        suffix = np.append(np.minimum.accumulate(lcp[::-1])[::-1], FAR)
        self.value[heads] = suffix[at[end - 1] + 1]
        self.block[heads] = len(self.least)
        self.origin[heads] = self.now
        target, shared = pos[at] - 1, np.minimum(shared + 1, self.cap)
        for a, b, c in zip(begin.tolist(), end.tolist(), heads.tolist()):
            self.queues.push(c, target[a:b], shared[a:b])


def range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a..b], both inclusive, for arrays of ranges."""
    power = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out, table, k = np.empty(len(a), values.dtype), values, 0
    while True:
        now = np.flatnonzero(power == k)
        out[now] = np.minimum(table[a[now]], table[b[now] - (1 << k) + 1])
        k += 1
        if k > power.max(initial=0):
            return out
        half = 1 << (k - 1)
        table = np.minimum(table[:-half], table[half:])


class Text:
    """A string of integers above 0; an end smaller than all of them follows."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        self.s = s
        bounds = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [n]])  # where runs of one character begin
        self.until = np.repeat(bounds[1:].astype(np.int32), np.diff(bounds))  # where the run at a position ends
        rising = np.append(s[bounds[1:-1]] > s[bounds[:-2]], False)  # of each run: is the next character larger
        self.up = np.repeat(rising, np.diff(bounds))  # S type
        self.star = np.flatnonzero(self.up[1:] & ~self.up[:-1]) + 1  # S*

    def run(self, p):
        """How often the character at p is repeated from p on."""
        return self.until[p] - p


def induce(text: Text, seeds: np.ndarray, shared: np.ndarray, cap: int, memory: int):
    """From the sorted S* suffixes: blocks (positions, shared, is S) of all suffixes, largest first.

    ``shared``: prefix lengths between neighbours, of ``seeds`` in rising order;
    of the result in falling order.
    """
    s, n = text.s, len(text.s)
    alphabet = np.unique(s)
    top = int(alphabet[-1])
    waiting, kept = Queues(memory), Queues(memory)
    push = Push(s, top, waiting, cap)
    push.queues.push(int(s[n - 1]), np.array([n - 1]), np.array([0]))
    push.origin[s[n - 1]] = top + 1  # pushed by the end, before all buckets
    edges = np.searchsorted(s[seeds], np.append(alphabet, top + 1))
    for k, c in enumerate(alphabet.tolist()):
        push.begin(c)
        last = None
        while c in waiting.parts:
            for pos, lcp in waiting.pop(c):
                kept.push(c, pos, lcp)
                last = pos[-1]
                push(pos, lcp, lambda x: x >= c)
        for a in range(edges[k], edges[k + 1], BLOCK):
            b = min(a + BLOCK, edges[k + 1])
            lcp = shared[a:b].astype(np.int32)
            if a == edges[k]:
                lcp[0] = 0 if last is None else min(int(text.run(last)), int(text.run(seeds[a])), cap)
            push(seeds[a:b], lcp, lambda x: x > c)
    push = Push(s, top, waiting, cap)
    for c in alphabet[::-1].tolist():
        push.begin(c)
        last = None
        while c in waiting.parts:
            for pos, lcp in waiting.pop(c):
                last = pos[-1]
                yield pos, lcp, True
                push(pos, lcp, lambda x: x <= c)
        link = None
        for pos, lcp in kept.backwards(c):
            pos = pos[::-1]
            if link is None:
                link = 0 if last is None else min(int(text.run(last)), int(text.run(pos[0])), cap)
            down = np.append(link, lcp[:0:-1]).astype(np.int32)
            link = int(lcp[0])
            yield pos, down, False
            push(pos, down, lambda x: x < c)
    waiting.close()
    kept.close()


def _collected(blocks, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rising order of (the wanted of) falling blocks, with shared prefixes."""
    found, shared, carry = [], [], FAR
    for pos, lcp, _ in blocks:
        hit = np.flatnonzero(wanted[pos]) if wanted is not None else np.arange(len(pos))
        if len(hit):
            low = np.empty(len(hit), np.int64)
            low[0] = min(carry, int(lcp[: hit[0] + 1].min()))
            if len(hit) > 1:
                low[1:] = range_min(lcp, hit[:-1] + 1, hit[1:])
            found.append(pos[hit])
            shared.append(low)
            rest = lcp[hit[-1] + 1 :]
            carry = int(rest.min()) if len(rest) else FAR
        elif len(lcp):
            carry = min(carry, int(lcp.min()))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, low = np.concatenate(found)[::-1], np.concatenate(shared)
    return pos.astype(np.int64), np.append(0, low[:0:-1])


def _in_memory(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and shared prefixes of a short string, by prefix doubling up to ``cap`` names."""
    m = len(names)
    levels, rank = [], np.append(np.unique(names, return_inverse=True)[1] + 1, 0)
    h = 1
    while True:
        levels.append((h, rank.astype(np.int32)))
        if h >= cap or rank.max() == m:
            break
        ahead = np.zeros(m, np.int64)
        ahead[: max(0, m - h)] = rank[h:m]
        key = rank[:m].astype(np.int64) * (m + 1) + ahead
        rank = np.append(np.unique(key, return_inverse=True)[1] + 1, 0)
        h *= 2
    order = np.argsort(rank[:m], kind="stable")
    i, j = order[1:].copy(), order[:-1].copy()
    length = np.zeros(max(0, m - 1), np.int64)
    for h, r in reversed(levels):
        while True:  # the deepest level may apply more than once
            same = (r[np.minimum(i + length, m)] == r[np.minimum(j + length, m)]) & (i + length < m) & (j + length < m) & (length < cap)
            length[same] += h
            if h != levels[-1][0] or not same.any():
                break
    return order, np.append(0, np.minimum(length, cap))


def suffix_blocks(s: np.ndarray, cap: int, memory: int = 64 << 20, base: int = 4 << 20):
    """Blocks (positions, shared) of all suffixes of ``s`` (integers above 0), largest first.

    Strings of names of at most ``base`` characters are sorted in memory.
    """
    if not len(s):
        return
    text = Text(s)
    star = text.star
    if len(star):
        is_star = np.zeros(len(s), bool)
        is_star[star] = True
        # S* substrings: their last characters as seeds, longer runs first, as they do among S suffixes
        run = text.run(star)
        seeds = np.lexsort((-run, s[star]))
        seeds, run = star[seeds], run[seeds]
        shared = np.append(0, np.where(s[seeds[1:]] == s[seeds[:-1]], np.minimum(run[1:], run[:-1]), 0))
        order, low = _collected(induce(text, seeds, shared, FAR - 1, memory), is_star)
        number = np.empty(len(s), np.int32)
        number[star] = np.arange(len(star), dtype=np.int32)
        at = number[order]
        del number
        length = np.append(np.diff(star) + 1, FAR)[at]
        new = np.append(True, (length[1:] != length[:-1]) | (low[1:] < length[1:]) | (length[1:] == FAR))
        name = np.cumsum(new)
        low = np.minimum(low, cap)
        if name[-1] < len(star):
            names = np.empty(len(star), np.int64)
            names[at] = name
            if len(names) <= base:
                at, same = _in_memory(names, cap)
            else:
                at, same = _collected(((p, q, True) for p, q in suffix_blocks(names, cap, memory, base)), None)
            # from names to characters: the equal names' extent, then what two different names share
            # (the last character of a substring starts a run of which the name tells nothing: left out here, added below)
            whole = length[new]
            between = np.minimum(low[new], np.minimum(whole, np.append(FAR, whole[:-1])) - 1)
            i, j, ends = at[1:] + same[1:], at[:-1] + same[1:], np.append(star, len(s))
            low = np.append(0, ends[np.minimum(i, len(star))] - star[at[1:]])
            inner = np.flatnonzero((i < len(star)) & (j < len(star)))
            a, b = names[i[inner]], names[j[inner]]
            differ = a != b
            inner, a, b = inner[differ], a[differ], b[differ]
            more = range_min(between, np.minimum(a, b), np.maximum(a, b) - 1)
            p, q = star[i[inner]] + more, star[j[inner]] + more
            level = np.flatnonzero((p < len(s)) & (q < len(s)))
            level = level[s[p[level]] == s[q[level]]]
            more[level] += np.minimum(text.run(p[level]), text.run(q[level]))
            low[inner + 1] += more
            low = np.minimum(low, cap)
            order = star[at]
    else:
        order, low = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for pos, lcp, _ in induce(text, order, low, cap, memory):
        yield pos, lcp


def repeated_windows(strings: list[bytes], window: int, memory: int = 64 << 20, base: int = 4 << 20) -> list[np.ndarray]:
    """For each string: at which of its windows' starts the same ``window`` bytes start elsewhere in the shard too."""
    lengths = np.array([len(x) for x in strings], np.int64)
    whole = np.frombuffer(b"".join(strings), np.uint8)
    s = np.ones(len(whole) + len(strings), np.int16)  # 1 ends a string
    begin = np.cumsum(lengths + 1) - lengths - 1
    inside = np.ones(len(s), bool)
    inside[begin + lengths] = False
    s[inside] = whole.astype(np.int16) + 2
    marked, before = np.zeros(len(s), bool), -1
    for pos, lcp in suffix_blocks(s, window, memory, base):
        hit = np.flatnonzero(lcp >= window)
        marked[pos[hit]] = True
        marked[pos[hit[hit > 0] - 1]] = True
        if len(hit) and hit[0] == 0:
            marked[before] = True
        before = pos[-1]
    return [marked[a : a + max(0, n - window + 1)] for a, n in zip(begin.tolist(), lengths.tolist())]
