import numpy as np
import xxhash

from tidemill.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def slow_components(fps, ids, budget=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_equals_definition():
    for text in [None, "", " \n", "One", "a b c", "A b c d", "é É x y z w q", "the cat sat on the mat and the cat sat on the mat\tagain" * 9]:
        assert simhash.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def check_walk(fps, depth=0):
    a = np.sort(np.unique(fps))
    seen = set()
    simhash.walk(a, a, True, 0, 0, 4, lambda i, j: seen.update(zip(i.tolist(), j.tolist())), small=4, block=64)
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 4}
    assert seen == want


def test_walk_finds_every_link():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)])
    check_walk(np.concatenate([base, near, np.array([0, 1, 3, (1 << 64) - 1], np.uint64)]))


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(60):
        words = list(rng.choice(vocab, 80))
        texts.append(" ".join(words))
        for _ in range(k % 4):
            words[int(rng.integers(80))] = "changed"
            texts.append(" ".join(words))
    texts += [None, "", "  ", "one", "ONE", texts[0], texts[0]]
    rows = [(i, t, "extra", "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(df, node_size=20).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(fps, list(range(len(texts))))
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}
    kept = simhash.drop_near_duplicates(df, node_size=20)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_empty_nulls_and_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert [r.component_id for r in simhash.simhash_groups(df).collect()] == [1, 1, 1]
    assert [r.doc_id for r in simhash.drop_near_duplicates(df).collect()] == [1]


def test_crowded_nodes_are_split(spark):
    rng = np.random.default_rng(4)
    hot = rng.integers(0, 1 << 62) & ~0xFFFF  # many fingerprints that differ in few places
    fps = sorted({int(hot | (int(x) & 0xFFFF)) for x in rng.integers(0, 1 << 16, 1500)} | {int(x) for x in rng.integers(0, 1 << 62, 300)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.link_forest(df, 2, node_size=20).collect()
    want = slow_components(fps, fps, 2)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[max(find(u), find(v))] = min(find(u), find(v))
    assert [find(f) for f in fps] == want
