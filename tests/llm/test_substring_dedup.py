import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import substring_dedup as sd


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 4, int(rng.integers(0, 90))).tolist() for _ in range(2))
        assert sd.edits(a, b) == slow_edits(a, b)


def test_fenwick_equals_brute_force():
    rng = np.random.default_rng(1)
    tree, seen = sd.Fenwick(50), []
    for item in range(300):
        rank, value = int(rng.integers(50)), float(rng.random())
        tree.put(rank, value, item)
        seen.append((rank, value))
        bound = int(rng.integers(51))
        assert tree.most(bound)[0] == max((v for r, v in seen if r < bound), default=float("-inf"))


def test_chain_score_equals_quadratic_programming():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        r = np.sort(rng.choice(3000, n, replace=False))
        p = np.where(rng.random(n) < 0.7, r + rng.integers(0, 3, n) * 50, rng.integers(0, 3000, n))
        order = np.lexsort((p, r))
        r, p = r[order], p[order]
        jump = (np.diff(r) != np.diff(p)) | (np.diff(r) > sd.SAMPLE)
        begin = np.concatenate([[0], np.flatnonzero(jump) + 1])
        end = np.append(begin[1:], n) - 1
        size = r[end] - r[begin] + sd.SEED_WORDS
        score = [0.0] * len(begin)
        for j in range(len(begin)):
            gains = [score[i] - sd.GAP_COST * (r[begin[j]] - r[end[i]] + p[begin[j]] - p[end[i]]) for i in range(len(begin)) if r[end[i]] < r[begin[j]] and p[end[i]] < p[begin[j]]]
            score[j] = size[j] + max(0.0, max(gains, default=0.0))
        found = sd.chain(r, p, least=0.0, alone=0)
        best = max(found, key=lambda path: sum(b[2] for b in path))
        value = lambda path: sum(b[2] for b in path) - sd.GAP_COST * sum(y[0] - (x[0] + x[2] - sd.SEED_WORDS) + y[1] - (x[1] + x[2] - sd.SEED_WORDS) for x, y in zip(path, path[1:]))
        assert np.isclose(max(map(value, found)), max(score)) and best


def test_a_seed_lies_in_every_stretch():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 60, 500)
    _, at = sd.seeds(words)
    assert np.diff(np.sort(at)).max() <= sd.SAMPLE and at.min() < sd.SAMPLE
    a, b = sd.seeds(words[100:260]), sd.seeds(words)
    inner = {int(s) for s, p in zip(*b) if 100 + sd.SAMPLE <= p < 260 - sd.SAMPLE - sd.SEED_WORDS}
    assert inner <= set(a[0].tolist())


def corpus(seed):
    """(rows, planted): pairs of texts that share a passage of 60 words or more, some words changed."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 5000, k)]
    rows, planted = [], set()
    for i in range(120):
        rows.append(word(int(rng.integers(60, 300))))
    for i in range(0, 60, 2):
        passage = word(int(rng.integers(60, 120)))
        changed = list(passage)
        for k in rng.choice(np.arange(8, len(passage) - 8), i // 12, replace=False):
            changed[k] = "changed"
        if i % 4:
            del changed[30]
        rows[i] = rows[i][:20] + passage + rows[i][20:]
        rows[i + 1] = rows[i + 1][:50] + changed + rows[i + 1][50:]
        planted |= {i, i + 1}
    return [(i, " ".join(w)) for i, w in enumerate(rows)], planted


@pytest.mark.parametrize("seed", range(2))
def test_planted_passages_are_found_and_clean_texts_left(spark, seed):
    rows, planted = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, n_words string")
    found = {r.doc_id: r for r in sd.repeated_passages(df).collect()}
    assert set(found) == planted
    for i in planted:
        assert found[i].partner_id == i ^ 1 and found[i].n_links == 1 and found[i].n_passages == 1
        assert 55 <= found[i].n_repeated <= 135


def test_copies_nulls_and_empty(spark):
    text = " ".join(f"a{k}" for k in range(80))
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "short text"), (6, "short text"), (None, text), (1, text)], "doc_id long, text string")
    found = sd.repeated_passages(df).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "None"]
    assert all(r.n_repeated == 80 and r.n_passages == 1 and r.n_links == 3 for r in found)
    assert sd.repeated_passages(df.limit(0)).collect() == []


def test_good_parts_of_a_bad_stretch_are_kept():
    rng = np.random.default_rng(5)
    for _ in range(60):
        halves = [(int(rng.integers(5, 90)), int(rng.integers(1, 17))) for _ in range(int(rng.integers(2, 7)))]
        a, b, blocks = [], [], []
        for n, gap in halves:
            same = rng.integers(0, 1 << 40, n).tolist()
            blocks.append((len(a), len(b), n))
            a += same + rng.integers(0, 1 << 40, gap).tolist()
            b += same + rng.integers(0, 1 << 40, gap).tolist()
        found = sd.passages(np.array(a), np.array(b), blocks)
        want = set()
        for i, (r, _, _) in enumerate(blocks):
            for j in range(i, len(blocks)):
                end = blocks[j][0] + blocks[j][2]
                if end - r >= sd.LEAST_WORDS and 5 * sum(g for _, g in halves[i:j]) <= end - r:
                    want |= set(range(r, end))
        assert {x for r0, r1, _, _ in found for x in range(r0, r1)} == want
    shared = [(60, 16), (25, 16), (25, 16), (25, 0)]
    ends = np.cumsum([0] + [n + g for n, g in shared]).tolist()
    a, b = np.arange(ends[-1]), np.arange(ends[-1]) + 1000
    for at, (n, _) in zip(ends, shared):
        b[at : at + n] = a[at : at + n]
    assert sd.passages(a, b, [(at, at, n) for at, (n, _) in zip(ends, shared)]) == [(0, 101, 0, 101)]


def test_passages_within_a_text_and_at_later_places_are_found(spark):
    rng = np.random.default_rng(6)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 10**6, k)]
    own, line, shared = word(70), word(12), word(70)
    body = shared[:30] + line + shared[30:]
    texts = {
        1: word(40) + own + word(40) + own + word(20),  # within itself only
        2: word(20) + body + word(90) + body + word(5),  # twice here, once in 3, where a part stands early too
        3: line + word(50) + line + word(50) + body,
        4: word(200),
        5: line + word(30),
    }
    found = {r.doc_id: r for r in sd.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    assert {i: (r.n_repeated, r.n_passages, r.n_links, r.partner_id) for i, r in found.items()} == {1: (140, 2, 0, 1), 2: (164, 2, 1, 3), 3: (82, 1, 1, 2)}


def batched(rows, size, names):
    import pyarrow as pa

    return iter([pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size])], names=names) for k in range(0, len(rows), size)])


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_matches_do_not_depend_on_batches(size):
    rng = np.random.default_rng(7)
    rows = np.concatenate([rng.integers(0, [40, 9, 5], (300, 3)), rng.integers([50, 0, 0], [52, 20, 40], (200, 3))])
    rows = sorted(map(tuple, rows.tolist()))
    found = [tuple(r.values()) for b in sd._matches(batched(rows, size, ["seed", "key", "place"])) for r in b.to_pylist()]
    want = []
    for seed in {r[0] for r in rows}:
        at = sorted({(k, p) for s, k, p in rows if s == seed})
        if len(at) > sd.FEW:
            want += [(seed, k, p, -1) for k, p in at]
        else:
            want += [(a[0], b[0], a[1], b[1]) for i, b in enumerate(at) for a in at[:i]]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_neighbours_equal_brute_force(size):
    rng = np.random.default_rng(10)
    rows = [(int(rng.integers(1, 4)) * 0x9E3779B97F4A7C15 % (1 << 63), k, int(p)) for k in range(12) for p in np.cumsum(rng.choice([1, 5, 40], int(rng.integers(1, 40)), p=[0.5, 0.4, 0.1]))]
    byte = lambda s: (s >> 24) % 255 + 1
    want = []
    for i, (seed, key, place) in enumerate(rows):
        for side, step in ((0, 1), (1, -1)):
            context, j = [], i
            while len(context) < sd.CONTEXT and 0 <= j + step < len(rows) and rows[j + step][1] == key and abs(rows[j + step][2] - rows[j][2]) <= sd.RUN_GAP:
                j += step
                context.append(byte(rows[j][0]))
            if context:
                packed = int.from_bytes(bytes(context + [0] * (sd.CONTEXT - len(context))), "big", signed=True)
                want.append((seed, side, packed, key, place))
    found = [tuple(r.values()) for b in sd._contexts(batched(rows, size, ["seed", "key", "place"])) for r in b.to_pylist()]
    assert sorted(found) == sorted(want)
    want.sort()
    pairs = []
    for i in range(1, len(want)):
        (s0, d0, c0, k0, p0), (s1, d1, c1, k1, p1) = want[i - 1], want[i]
        if (s0, d0, c0 >> 56) != (s1, d1, c1 >> 56):
            continue
        if (c0, k0) != (c1, k1):  # the first place of the text before, not its last
            p0 = next(w[4] for w in want if w[:4] == (s0, d0, c0, k0))
        pairs.append((k0, k1, p0, p1) if (k0, p0) <= (k1, p1) else (k1, k0, p1, p0))
    got = [tuple(r.values()) for b in sd._neighbours(batched(want, size, ["seed", "side", "context", "key", "place"])) for r in b.to_pylist()]
    assert sorted(got) == sorted(pairs) and len(pairs) > 100


def test_hopeful_agrees_with_chain():
    rng = np.random.default_rng(11)
    rows = sorted({(int(k), int(d), int(r)) for k, d, r in zip(rng.integers(0, 3000, 6000), rng.integers(-60, 60, 6000), rng.integers(0, 90, 6000))})
    key, d, r = (np.array(c) for c in zip(*rows))
    edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    hope = sd.hopeful(edge, r, r + d)
    for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        some = bool(sd.chain(r[a:b], (r + d)[a:b])) and b - a > 1
        assert hope[i] or not some
        assert some or not hope[i] or b - a > 2 or sd.chain(r[a:b], (r + d)[a:b], least=sd.CHAIN_SCORE - 1e-6)


def test_a_passage_is_found_among_texts_that_hold_pieces_of_it(spark):
    rng = np.random.default_rng(12)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 10**6, k)]
    shared = word(120)
    fuzzy = [w if rng.random() > 0.1 else "else" for w in shared]
    rows = [word(30) + shared + word(30), word(9) + shared + word(40), word(15) + fuzzy + word(15)]
    for _ in range(1500):
        at = int(rng.integers(0, 109))
        rows.append(word(6) + shared[at : at + 11] + word(6))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r for r in sd.repeated_passages(df).collect()}
    assert set(found) == {0, 1, 2} and all(r.n_links == 2 and r.class_id == 0 and r.n_passages == 1 for r in found.values())
    assert found[0].n_repeated == found[1].n_repeated == 120


@pytest.mark.parametrize("hot", [False, True])
def test_a_class_of_many_near_copies_loses_none(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(sd, "HOT_TEXTS", 2)
    rng = np.random.default_rng(13)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 10**6, k)]
    shared = word(70)
    rows = [word(int(rng.integers(5, 40))) + [w if rng.random() > 0.05 else "else" for w in shared] + word(10) for _ in range(300)]
    rows += [["ha"] * 400, ["ha"] * 300 + word(20), word(50)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    monkeypatch.setattr(sd, "HOT_LEAST", 64 if hot else 10**9)
    assert bool(sd.hot_seeds(df.select(F.xxhash64("text").alias("key"), "text"))) == hot
    found = {r.doc_id: (r.class_id, r.n_links) for r in sd.repeated_passages(df).collect()}
    assert found == {i: (0, 299) for i in range(300)} | {300: (300, 1), 301: (300, 1)}


def test_passages_of_frequent_phrases_are_found(spark):
    rng = np.random.default_rng(9)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 10**6, k)]
    one, two = word(40), word(40)
    rows = [word(30) + one + word(30) for _ in range(60)] + [word(30) + two + word(30) for _ in range(60)]
    rows += [word(20) + one + two + word(25) for _ in range(2)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: (r.n_repeated, r.n_links, r.partner_id) for r in sd.repeated_passages(df).collect()}
    assert found == {120: (80, 1, 121), 121: (80, 1, 120)}


@pytest.mark.parametrize("words,least", [(60, 0.7), (120, 0.9)])
def test_recall_near_the_least_similarity(words, least):
    rng = np.random.default_rng(words)
    some = lambda k: rng.integers(0, 1 << 50, k)
    for sixth in (True, False):
        hits = 0
        for _ in range(60):
            one = some(words)
            two, at = one.copy(), np.arange(5, words - 1, 6) if sixth else 1 + rng.choice(words - 2, int(words * 0.18), replace=False)
            two[at] = some(len(at))
            a, b = np.concatenate([some(100), one, some(100)]), np.concatenate([some(60), two, some(90)])
            (s, p), (t, q) = sd.seeds(a), sd.seeds(b)
            match = sorted((int(y) - int(x), int(x)) for u, x in zip(s, p) for y in q[t == u])
            r, off = np.array([m[1] for m in match]), np.array([m[0] for m in match])
            found = [x for blocks in (sd.chain(r, r + off) if len(match) > 1 else []) for x in sd.passages(a, b, blocks)]
            hits += any(r0 <= 110 and r1 >= 90 + words and r1 - r0 <= words + 4 for r0, r1, _, _ in found)
        assert hits >= least * 60


def test_a_pair_whose_shared_seeds_are_frequent_and_stand_among_others_is_found(spark):
    rng = np.random.default_rng(21)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 10**6, k)]
    pieces, phrases = [word(16) for _ in range(5)], [word(9) for _ in range(40)]
    rows, edges = [], []
    for one, two in ((phrases[0], phrases[1]), (phrases[2], phrases[3])):  # 80 words in common of 96, each gap its own and frequent too
        gaps = [word(4) for _ in range(4)]
        rows.append(word(20) + one + sum((p + g for p, g in zip(pieces, [*gaps, []])), []) + two + word(20))
        edges += [p[-8:] + g + q[:8] for p, g, q in zip(pieces, gaps, pieces[1:])]
    for piece in pieces:
        for _ in range(150):
            rows.append(word(6) + phrases[rng.integers(40)] + piece + phrases[rng.integers(40)] + word(6))
    rows += [word(9) + e + word(9) for e in edges for _ in range(11)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r for r in sd.repeated_passages(df).collect()}
    assert {i: (r.n_repeated, r.n_links, r.class_id, r.partner_id) for i, r in found.items()} == {0: (96, 1, 0, 1), 1: (96, 1, 0, 0)}


@pytest.mark.parametrize("n,split", [(40, 0), (700, 0), (700, 300)])
def test_alike_equals_brute_force(n, split):
    from collections import Counter

    rng = np.random.default_rng(n + split)
    common = rng.integers(0, 1 << 16, 20)
    near = [np.concatenate([rng.integers(0, 1 << 16, 30), common, rng.integers(0, [3, 1 << 16][i % 2], 30)]).astype(np.uint16) for i in range(9)]
    windows = []
    for _ in range(n):
        w = near[rng.integers(9)].copy()
        w[rng.choice(len(w), int(rng.integers(0, 12)), replace=False)] = rng.integers(0, 1 << 16)
        windows.append(w[: int(rng.integers(40, 81))].tobytes())
    label = rng.integers(0, 3, n)
    label[260:520] = 2
    pairs = [Counter(itertools.pairwise(np.frombuffer(w, np.uint16).tolist())) for w in windows]
    want = {(i, j) for i in range(split or n) for j in range(max(i + 1, split), n) if (label[i] != label[j] or not label[i]) and (pairs[i] & pairs[j]).total() >= sd.SHARED}
    one, two = sd.alike(windows, label, split)
    assert sorted(zip(one.tolist(), two.tolist())) == sorted(want) and len(want) > n / 2


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_compared_blocks_do_not_depend_on_batches(size):
    rng = np.random.default_rng(22)
    texts = [rng.integers(0, 60, 90).astype(np.uint16) for _ in range(6)]
    rows = []
    for seed, lo, hi in ((1, 0, 0), (1, 0, 1), (1, 1, 1), (2, 0, 1), (3, 0, 0)):
        for key in range(24):
            block = key % 2
            if block in (lo, hi) and (seed != 2 or not block):
                rows += [(seed, lo, hi, block, key % 3, key, 5, texts[key % 6].tobytes())] * (1 + key % 2)
    rows.sort()
    names = ["seed", "lo", "hi", "block", "label", "key", "place", "words"]
    made = (pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[k : k + size])], names=names) for k in range(0, len(rows), size))
    found = {tuple(r.values()) for b in sd._compared(made) for r in b.to_pylist()}
    assert found == {(a, b) for a in range(24) for b in range(a + 1, 24) if a % 6 == b % 6 and a % 3 == 0}


def test_all_matches_equal_brute_force():
    rng = np.random.default_rng(23)
    for n in (3, 5, 60, 200):
        a, b = rng.integers(0, 3, n), rng.integers(0, 3, 2 * n)
        for two, itself in ((b, False), (a, True)):
            (s, p), (t, q) = sd.seeds(a), sd.seeds(two)
            told = [{(u, x) for u, x in zip(*v) if not any(w == u and 0 < x - y <= sd.SAMPLE for w, y in zip(*v)) or not any(w == u and 0 < y - x <= sd.SAMPLE for w, y in zip(*v))} for v in ((s, p), (t, q))]
            want = sorted((int(y) - int(x), int(x)) for u, x in told[0] for w, y in told[1] if u == w and (not itself or x < y))
            r, p = sd.all_matches(sd.sorted_seeds(a), sd.sorted_seeds(two), itself)
            assert list(zip((p - r).tolist(), r.tolist())) == want
    runs = [sd.sorted_seeds(np.zeros(n, np.int64)) for n in (500, 70)]
    assert [len(x) for x in sd.all_matches(*runs, False)] == [27, 27]


def test_label_of_a_stretch_within_passages():
    spans = [{"from": 10, "to": 30, "label": 7}, {"from": 40, "to": 60, "label": 9}]
    assert [sd.label_of(spans, p, 10) for p in (9, 10, 20, 21, 45, 51)] == [set(), {7}, {7}, set(), {9}, set()]
    assert sd.label_of(None, 3, 5) == set()


def test_fewest_edits_equal_brute_force():
    rng = np.random.default_rng(24)
    a = rng.integers(0, 6, (sd.AROUND, 24))
    b = np.where(rng.random(a.shape) < 0.2, 9, a)
    b[:-1, :8] = b[1:, :8]
    b[:, 18:] = rng.integers(0, 9, (sd.AROUND, 6))
    found = sd.fewest_edits(a.astype(np.int32), b.astype(np.int32))
    for p in range(a.shape[1]):
        for x, y, (ended, whole) in ((a[:, p], b[:, p], found[0]), (b[:, p], a[:, p], found[1])):
            table = [list(range(len(y) + 1))]
            want = [0]
            for i, w in enumerate(x.tolist(), 1):
                row = [i]
                for j, v in enumerate(y.tolist(), 1):
                    row.append(min(row[-1] + 1, table[-1][j] + 1, table[-1][j - 1] + (w != v)))
                want.append(min((table[-1][j] for j, v in enumerate(y.tolist()) if v == w), default=255))
                table.append(row)
            assert ended[:, p].tolist() == want and whole[p] == min(table[-1])


def test_windows_with_a_passage_are_kept_and_shorter_ones_left():
    rng = np.random.default_rng(25)
    word = lambda k: rng.integers(0, 1 << 16, k).astype(np.uint16)
    for trial in range(300):
        long = trial % 2 == 0
        n = int(rng.integers(50, 130)) if long else 47
        at = int(rng.integers(0, n - sd.SEED_WORDS + 1))  # where the seed stands in the passage
        one = word(n)
        two = one.copy()
        if long:
            free = [k for k in range(1, n - 1) if not at <= k < at + sd.SEED_WORDS]
            for k in sorted(rng.choice(free, int(0.2 * n), replace=False).tolist(), reverse=True) if n <= 60 else []:
                two[k] = word(1)[0]
        windows, place = [], []
        for body in (one, two):
            before, after = int(rng.integers(0, 90)), int(rng.integers(0, 90))
            text, spot = np.concatenate([word(before), body, word(after)]), before + at
            windows.append(text[max(spot - sd.AROUND, 0) : spot + sd.SEED_WORDS + sd.AROUND].tobytes())
            place.append(spot)
        assert sd.few_edits(windows, np.array(place), np.array([0]), np.array([1])).tolist() == [long]


def test_seeds_that_follow_another_do_not_depend_on_how_labels_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(26)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 10**6, k)]
    phrase = word(40)
    rows = [(i, " ".join(word(30) + phrase + word(30))) for i in range(60)]
    texts = spark.createDataFrame(rows, "key long, text string").repartition(6)
    places = sd.cut(texts.mapInArrow(sd._seed_rows, "seed long, key long, place long"))
    frequent = places.groupBy("seed").count().where(F.col("count") > sd.FEW).select("seed")
    places = sd.cut(places.join(frequent, "seed"))
    islands = sd.cut(texts.select("key", F.lit(0).cast("long").alias("from"), F.lit(9).cast("long").alias("to"), F.struct("key").alias("root")))
    told, keep = [], sd.stored

    def stored(df):
        out = keep(df)
        told.extend(out[0].collect())
        return out

    monkeypatch.setattr(sd, "stored", stored)
    sd.rest_chains(texts, places, islands)
    first = {r.key: r.place for r in sorted(told, key=lambda r: -r.place)}
    assert len(told) > 60 * 8 and all((r.gap == 0) == (r.place == first[r.key]) for r in told)


def test_words_and_seeds_of_a_column_are_those_of_each_text():
    rng = np.random.default_rng(21)
    texts = [None, "", " ", "  a  ", "\t\n a b\x0bc\x0c d\r e f", "A b C d e f g h", "x " * 9, "a b c d e", "  é É a", "\x1c a \x1f b"]
    texts += [" ".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 30, 60)]
    for column in (pa.array(texts), pa.array(texts).slice(3, 20), pa.array([None, ""]), pa.array([], pa.string())):
        own = [sd.word_hashes(None if t is None else t.encode()) for t in column.to_pylist()]
        words, edge = sd.words_of(column)
        assert [words[a:b].tolist() for a, b in itertools.pairwise(edge)] == [w.tolist() for w in own]
        assert sd.word_counts(column).tolist() == [len(w) for w in own]
        found = [(s, t, p) for t, w in enumerate(own) for s, p in zip(*(v.tolist() for v in sd.seeds(w)))]
        assert list(zip(*(v.tolist() for v in sd.seeds_of(words, edge)))) == found


def test_blocks_give_back_their_rows_by_bucket(monkeypatch):
    monkeypatch.setattr(sd, "DEALT", 50)
    rng = np.random.default_rng(22)
    rows = [[rng.integers(-9, 9, n), rng.integers(-(2**62), 2**62, n), rng.integers(0, 2**31, n)] for n in (0, 30, 80, 1)]
    deal = lambda seed, key, place: (seed % 2, key.view(np.uint64) % np.uint64(5))
    blocks = [b.slice(k, 1) for b in sd._blocks(rows, sd.SEEDS, deal) for k in range(len(b))]
    assert len(blocks) < 40
    found = []
    for part in (0, 1):
        mine = sorted((b for b in blocks if b.column("part")[0].as_py() == part), key=lambda b: b.column("bucket")[0].as_py())
        for columns in sd._unpacked(mine, sd.SEEDS):
            assert set((columns[0] % 2).tolist()) == {part} and len(set((columns[1].view(np.uint64) % np.uint64(5)).tolist())) == 1
            found += zip(*(c.tolist() for c in columns))
    assert sorted(found) == sorted(zip(*(np.concatenate(v).tolist() for v in zip(*rows))))


def test_edits_of_short_runs_of_a_word_are_not_counted(monkeypatch):
    rng = np.random.default_rng(23)
    run = [np.insert(np.arange(93) + 100 * k + 100, [64] * 40, 7).astype(np.uint16) for k in range(30)]
    mixed = [rng.integers(0, 4 if k % 2 else 60, 133).astype(np.uint16) for k in range(30)]
    for k in range(0, 30, 3):
        mixed[k + 1] = np.where(rng.random(133) < (0.1, 0.2, 0.3)[k % 3], 61, mixed[k])
    one, two = np.triu_indices(60, 1)
    counted, exact = [], sd.fewest_edits
    monkeypatch.setattr(sd, "fewest_edits", lambda a, b: counted.append(a.shape[1]) or exact(a, b))
    windows = [w.tobytes() for w in run]
    few = two < 30
    assert not sd.few_edits(windows, np.full(30, 64), one[few], two[few]).any()
    assert sum(counted) * 4 < 2 * few.sum()  # of either side; a word's code may be another's by chance
    windows += [w.tobytes() for w in mixed]
    good = sd.few_edits(windows, np.full(60, 64), one, two)
    monkeypatch.setattr(sd, "may_match", lambda sides, one, two: np.ones(len(one), bool))
    assert good.any() and (good == sd.few_edits(windows, np.full(60, 64), one, two)).all()
