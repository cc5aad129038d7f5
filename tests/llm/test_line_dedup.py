from collections import Counter

import numpy as np
import pytest

from tidemill.llm import line_dedup


def chunks_of(lines):
    return line_dedup.chunks(line_dedup.line_marks(lines))


def slow(rows):
    """In order of (id, null first; text key; line): a chunk stays where it is first, and elsewhere goes with the equal lines around it."""
    order = sorted({(r[0] is not None, r[0] or 0, line_dedup._key(r[1].encode()), r[1]) for r in rows if r[1] is not None})
    first, out = {}, {}
    for nth, (known, doc_id, _, text) in enumerate(order):
        lines, gone = text.encode().split(b"\n"), set()
        for a, n in chunks_of(lines):
            owner, other, b = first.setdefault(b"\n".join(lines[a : a + n]), (nth, lines, a))
            if (owner, b) == (nth, a):
                continue
            gone |= set(range(a, a + n))
            for step, here, there in ((-1, a - 1, b - 1), (1, a + n, b + n)):
                for k in range(line_dedup.REACH):
                    i, j = here + k * step, there + k * step
                    if min(i, j) < 0 or i >= len(lines) or j >= len(other) or lines[i] != other[j]:
                        break
                    gone.add(i)
        kept = b"\n".join(line for k, line in enumerate(lines) if k not in gone)
        out[doc_id if known else None, text] = (kept.decode(), len(lines), len(gone), sum(k - 1 not in gone for k in gone))
    return out


def texts(seed, n=60):
    rng = np.random.default_rng(seed)
    line = lambda: " ".join(f"w{k}" for k in rng.integers(0, 50, 5))
    blocks = [[line() for _ in range(int(k))] for k in rng.integers(3, 25, 5)]
    out = []
    for _ in range(n):
        lines = [line() for _ in range(int(rng.integers(0, 12)))]
        for _ in range(int(rng.integers(0, 3))):
            lines[len(lines) // 2 : len(lines) // 2] = blocks[int(rng.integers(5))]
        out.append("\n".join(lines))
    return out


def corpus(seed):
    return [(i, t) for i, t in enumerate(texts(seed))] + [(None, "a\nb\nc\nd\ne\nf\ng"), (900, None), (901, ""), (902, "\n\n\n\n\n\n"), (3, texts(seed)[3]), (3, "other\ntext"), (903, "a\nb\nc\nd\ne\nf\ng"), (904, "a\nb")]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, digest int, key string")
    want = slow(rows)
    found = line_dedup.deduplicate_lines(df).collect()
    expect = Counter((i, *want[i, t]) if t is not None else (i, None, 0, 0, 0) for i, t in rows)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_chunks) for r in found) == expect
    assert sum(r.n_chunks for r in found) > 5


def test_equal_digests_remove_only_equal_lines(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(i, t) for i, t in rows if t is not None], "doc_id long, text string")
    found = line_dedup.deduplicate_lines(df, digest=lambda chunk: b"same").collect()
    kept = {line for r in found for line in r.text.split("\n")}
    assert len(found) == len(rows) - 1 and all(line in kept for _, t in rows if t for line in t.split("\n"))


def test_string_ids_and_hot_block(spark):
    block = "\n".join(f"shared {k}" for k in range(6))
    rows = [(f"d{i:04}", f"own {i}\n{block}\nend {i}") for i in range(900)] + [(None, block)]
    found = line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id string, text string").repartition(5)).collect()
    assert {(r.n_removed, r.n_chunks) for r in found if r.doc_id} == {(6, 1)}
    assert [r.text for r in found if r.doc_id is None] == [block] and all(r.text == f"own {int(r.doc_id[1:])}\nend {int(r.doc_id[1:])}" for r in found if r.doc_id)


def test_boundaries_resist_shifts():
    rng = np.random.default_rng(8)
    lines = [f"line {k}".encode() for k in rng.integers(0, 10**6, 400)]
    cut = lambda ls: {b"\n".join(ls[a : a + n]) for a, n in chunks_of(ls)}
    before, after = cut(lines), cut(lines[:57] + [b"new"] + lines[57:])
    assert len(before - after) <= 12 < len(before) / 20


def test_rolling_hash_is_that_of_its_window():
    marks = line_dedup.line_marks([b"%d" % k for k in range(40)])
    for window in (1, 2, 5):
        got = line_dedup.rolls(marks, window)
        assert all(line_dedup.rolls(marks[i - window + 1 : i + 1], window)[-1] == got[i] for i in range(window - 1, 40))


def test_chunks_have_two_or_three_lines_and_cover_the_text():
    rng = np.random.default_rng(4)
    for lines in ([b""], [b"", b""], [b"a"] * 500, [b"x", b"y", b"z"], [b"%d" % k for k in rng.integers(0, 9, 300)]):
        found = chunks_of(lines)
        assert {n for _, n in found} <= {2, 3}
        assert {k for a, n in found for k in range(a, a + n)} == (set(range(len(lines))) if len(lines) > 1 else set())


def test_columns_counts_and_empty(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf", "s", 11), (2, "a\nb\nc\nd\ne\nf", "s", 11), (3, None, "s", None)], "doc_id long, text string, source string, n_chars long")
    out = line_dedup.without_repeated_lines(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "a\nb\nc\nd\ne\nf" and got[2].text == "" and got[3].text is None and got[3].n_chars is None
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)
    assert line_dedup.deduplicate_lines(df.limit(0)).collect() == []


def test_planted_blocks_of_five_lines_and_more_go_whole():
    rng = np.random.default_rng(11)
    lines = lambda k: ["line %d" % x for x in rng.integers(0, 1 << 60, k)]
    share = {}
    for n in range(2, 13):
        gone = []
        for _ in range(600):
            block = lines(n)
            one, two = ("\n".join(lines(int(rng.integers(1, 9))) + block + lines(int(rng.integers(1, 9)))) for _ in range(2))
            gone.append(slow([(1, one), (2, two)])[2, two][2])
        share[n] = float(np.mean(gone)) / n
        assert max(gone) <= n and (n < 5 or min(gone) == n)
    print({n: round(s, 2) for n, s in share.items()})
    assert share[4] > 0.6 and share[3] > 0.2


def test_long_texts(spark):
    rng = np.random.default_rng(12)
    lines = [f"line {x} " + "y" * 80 for x in rng.integers(0, 1 << 60, 60_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["new", *lines[1000:59_000], "end"])), (3, "z" * 6_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.deduplicate_lines(df).select("doc_id", "n_removed", "n_chunks", "n_lines").collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_chunks, got[2].n_lines, got[3].n_removed) == (0, 58_000, 1, 58_002, 0)


def test_columns_of_other_case_are_replaced(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, "x")], "doc_id long, text string, N_LINES int, N_Removed string")
    out = line_dedup.deduplicate_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed", "n_chunks"] and out.select("doc_id", "n_lines", "n_removed").first() == (1, 2, 0)
