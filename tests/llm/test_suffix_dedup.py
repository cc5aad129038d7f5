import hashlib
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import induced, suffix_dedup


def slow(texts, window):
    """Per text: (n_bytes, n_removed, n_spans, kept) by counting every window."""
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def texts_with_repeats(seed, n, longest=400, alphabet=6):
    rng = np.random.default_rng(seed)
    word = lambda k: bytes(rng.integers(97, 97 + alphabet, k, dtype=np.uint8))
    passages = [word(int(k)) for k in rng.integers(10, 120, 6)]
    out = []
    for _ in range(n):
        parts = [word(int(rng.integers(0, longest // 3))) if rng.random() < 0.5 else passages[int(rng.integers(6))] for _ in range(4)]
        out.append(b"".join(parts))
    return out + [b"", b"a" * 90, b"ab" * 70, b"ab" * 70, out[0]]


def shared_prefix(a, b, cap):
    n = 0
    while n < min(len(a), len(b), cap) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("memory,base", [(1 << 20, 1 << 20), (256, 1 << 20), (1 << 20, 1), (256, 1)])
def test_suffix_order_and_prefixes(memory, base):
    rng = np.random.default_rng(9)
    cases = [rng.integers(1, 1 + k, n) for k in (1, 2, 3, 8, 200) for n in (1, 2, 3, 17, 120, 700)] + [np.array([1, 2] * 200), np.array([2, 1] * 200), np.array([3, 1, 2] * 99 + [3])]
    for s in cases:
        s = s.astype(np.int16)
        blocks = list(induced.suffix_blocks(s, 10_000, memory, base))
        order = np.concatenate([p for p, _ in blocks])[::-1]
        lcp = np.concatenate([q for _, q in blocks])  # of each suffix with the next larger one yielded before it
        raw = s.tolist()
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        falling = order[::-1]
        want = [shared_prefix(raw[a:], raw[b:], 10_000) for a, b in zip(falling[:-1], falling[1:])]
        assert lcp[1:].tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows_of_one_shard(seed):
    texts = texts_with_repeats(seed, 25)
    seen = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
    found = induced.repeated_windows(texts, 20, memory=4096 if seed % 2 else 1 << 20, base=50 if seed % 2 else 1 << 20)
    for t, hit in zip(texts, found):
        assert hit.tolist() == [seen[t[i : i + 20]] > 1 for i in range(len(t) - 19)]


@pytest.mark.parametrize("seed,crowded", [(0, 16), (1, 16), (2, 0), (3, 0.2)])
def test_removal_equals_brute_force(spark, seed, crowded):
    texts = [t.decode() for t in texts_with_repeats(seed, 60)]
    texts += ["é" * 40 + texts[1], "x" + "é" * 40, None, "short"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in suffix_dedup.remove_repeats(df, window=24, size=8, shard_bytes=2000, queue_bytes=4096, crowded=crowded).collect()}
    want = slow([(t or "").encode() for t in texts], 24)
    assert got == {i: (*w, hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(want)}


def test_production_parameters_on_the_small_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = slow([(r.text or "").encode() for r in rows], 200)
    found = suffix_dedup.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found} == {r.doc_id: w for r, w in zip(rows, want)}


def test_nulls_repeats_and_empty(spark):
    t = "0123456789" * 30
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [("1", 300, 300), ("1", 300, 300), ("2", 0, 0), ("3", 0, 0), ("None", 300, 300)]
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []
