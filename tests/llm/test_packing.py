import os
import random
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemill.llm import packing as K
from tidemill.llm import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def model():
    made = Tokenizer.from_file(K.default_vocabulary())
    made.encode_special_tokens = True
    return made


def test_ids_are_the_tokenizers(model):
    words = K.Words(K.default_vocabulary())
    assert words.short is not None
    rng = random.Random(5)
    marks = " \n\t\r\x0b\x1c\x85\xa0 　ab1'.,$é三😀"
    texts = ["", " ", "\n", "a  b", " a", "a ", "a\n\nb", "a\n \nb", "it's  'd <|endoftext|>x <|endoftext|>", "x" * 500 + " " + "y" * 70, "a\x00 b"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    for text in texts:
        assert np.frombuffer(K.token_bytes(words, text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_index_of_sums_equals_all_combinations():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = rng.integers(0, 3, 25) * (rng.random(25) < 0.4)
        counts[0] = 0
        sums = K.Sums(counts)
        for _ in range(6):  # as lengths are used up
            there = [x for x in range(1, 25) if sums.counts[x]]
            fits = lambda c: all(sums.counts[x] >= c.count(x) for x in c)  # noqa: B023, E731
            for gap in range(1, 25):
                got = sums.exact(gap)
                fewest = next((k for k in (1, 2, 3) if any(sum(c) == gap and fits(c) for c in combinations_with_replacement(there, k))), None)
                assert (got is None) == (fewest is None)
                if got:
                    assert sum(got) == gap and len(got) == fewest and fits(got)
            if got := sums.exact(24) or ([there[0]] if there else None):
                sums.take(got)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    for limit, n in ((2048, 5000), (2048, 40), (30, 3000), (7, 100), (1, 9)):
        for size in (0.2, 0.9):
            lengths = np.clip(rng.exponential(size * limit, n).astype(int), 1, limit)
            counts = np.bincount(lengths, minlength=limit + 1)
            for factor in (1, 10**9):
                made = K.plan(counts * factor)
                used = np.zeros(limit + 1, int)
                for pattern, times in made:
                    assert sum(pattern) <= limit
                    np.add.at(used, pattern, times)
                assert (used == counts * factor).all() and len(made) <= 12 * limit + 12
                if n >= 1000 and size == 0.2:
                    assert sum(t for _, t in made) <= 1.002 * (counts @ np.arange(limit + 1)) * factor / limit + 1
    assert K.plan(np.zeros(10, int)) == []


def check(rows, model, docs, limit):
    """Pieces are the documents' tokens, and sequences are gapless and within the limit."""
    by, place = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text in docs:
        want[i].append([*model.encode(text or "", add_special_tokens=False).ids, 0])
    assert set(by) == set(want)
    for i, texts in want.items():
        pieces = []
        for ids in texts:
            first = (len(ids) - 1) % limit + 1
            cuts = [0, *range(first, len(ids) + 1, limit)]
            pieces += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == sorted(pieces)
    for at in place.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= limit
    return len(place)


def test_query_packs_the_whole_table(spark, model):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r.asDict() for r in queries.op12_packed_sequences(spark, SF).collect()]
    n = check(rows, model, docs, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 3


def test_small_limits_nulls_repeats_and_clashing_columns(spark, model):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta\n", "γ", "  "]) for _ in range(rng.randint(0, 90)))) for i in range(60)] + [(None, "no id"), (7, "again"), (7, "again"), (99, None), (98, ""), (97, "w " * 20_000)]
    df = spark.createDataFrame([(*d, 1, "x", 5) for d in docs], "doc_id long, text string, length int, ids string, nth int").repartition(5)
    packed = K.pack(df, limit=50)
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(r.ids)} for r in packed.collect()]
    check(rows, model, docs, 50)
    whole = {r.sequence_id: r for r in K.sequences(packed).collect()}
    assert {i: (r.length, r.n_pieces) for i, r in whole.items()} == {i: (sum(r["length"] for r in rows if r["sequence_id"] == i), sum(r["sequence_id"] == i for r in rows)) for i in whole}
    for r in rows:
        assert whole[r["sequence_id"]].ids[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert K.pack(df.limit(0)).collect() == []


def test_carried_columns_keep_their_names(spark):
    df = spark.createDataFrame([(3, "a", 1), (5, "b", 2), (3, "c", 3)], "length long, nth string, task int")
    out = K.place(df, 8)
    assert out.columns == ["length", "nth", "task", "sequence_id", "offset"]
    assert sorted((r.length, r.nth, r.task) for r in out.collect()) == [(3, "a", 1), (3, "c", 3), (5, "b", 2)]
