from itertools import product

import pytest

from tidemill.operators import words


def splits(run):
    """All ways to cut a run."""
    for marks in product((0, 1), repeat=max(0, len(run) - 1)):
        cut, out = 0, []
        for k, m in enumerate(marks):
            if m:
                out.append(run[cut : k + 1])
                cut = k + 1
        yield [*out, run[cut:]]


def test_best_path_equals_all_segmentations():
    import random

    rng = random.Random(1)
    for _ in range(200):
        weights = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        run, unknown = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))), -40
        trie = words.Trie(weights, unknown)
        starts = {i for i in range(len(run)) if any(run.startswith(w, i) for w in weights)}

        def value(parts):
            at, total = 0, 0
            for p in parts:
                if p not in weights and (len(p) > 1 or at in starts):
                    return None
                total, at = total + weights.get(p, unknown), at + len(p)
            return total

        scored = [(v, [len(p) for p in parts], parts) for parts in splits(run) if (v := value(parts)) is not None]
        if not scored:  # a start whose words all lead to ends that are starts of nothing cannot occur: single characters fill in
            continue
        best = max(v for v, *_ in scored)
        path, got = trie.best(run)
        assert got == best and "".join(path) == run
        assert [len(p) for p in path] == max(lengths for v, lengths, _ in scored if v == best)


def test_every_word_and_rest():
    trie = words.Trie({"ab": -1, "abc": -1, "cd": -1, "e": -1}, -9)
    assert trie.every("abcdex") == ["ab", "abc", "cd", "e", "x"]
    assert words.cut(trie, "abcdex", every=True)[0] == ["ab", "abc", "cd", "ex"]
    assert words.cut(trie, "ab-cd\r\nzz 我e")[0] == ["ab", "-", "cd", "\r\n", "zz", " ", "我", "e"]


def test_tokens_join_to_the_text_and_odd_rows(spark):
    texts = [(1, "thecatsat, on\tthe_mat"), (2, None), (3, ""), (4, "的人民 x9"), (1, "thecatsat, on\tthe_mat"), (5, "abc" * 50_000)]
    df = spark.createDataFrame([(*t, "old", 7) for t in texts], "id long, text string, tokens string, n long")
    dictionary = spark.createDataFrame([("the", 9), ("cat", 3), ("cats", 1), ("sat", 4), ("at", 2), ("人民", 5), (None, 4), ("", 3), ("gone", 0), ("abc", 2), ("bca", 9)], "word string, n long")
    out = words.segment(df, dictionary)
    assert out.columns == ["id", "text", "n", "tokens", "score"]
    rows = out.collect()
    assert len(rows) == 6 and all((r.tokens is None) == (r.text is None) and "".join(r.tokens or []) == (r.text or "") for r in rows)
    by = {r.id: r for r in rows}
    assert by[1].tokens == ["the", "cat", "sat", ",", " ", "on", "\t", "the", "_", "m", "at"] and by[4].tokens == ["的", "人民", " ", "x9"]
    assert words.segment(df.limit(0), dictionary).collect() == []
    assert {tuple(r.tokens) for r in words.segment(df.where("id = 1"), dictionary.limit(0)).collect()} == {("thecatsat", ",", " ", "on", "\t", "the", "_", "mat")}
    with pytest.raises(ValueError):
        words.segment(df, dictionary, max_words=3)
