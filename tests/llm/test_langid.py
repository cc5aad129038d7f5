import zlib

import numpy as np

from tidemill.llm import langid

SF = "/root/testdata/sf0.01"


def slow_profile(texts, size):
    counts = {}
    for text in texts:
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = f" {word} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    gram = padded[i : i + n]
                    if gram != " ":
                        counts[gram] = counts.get(gram, 0) + 1
    return counts


def packed(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def test_ngrams_equal_brute_force():
    for text in ("Hello, World", "a", "a b", "ÀÉ x1y  zz\n", "日本語 text", "ab" * 300, "İi"):
        grams, n = langid.ngrams(text.encode())
        assert dict(zip(grams.tolist(), n.tolist())) == {packed(g): k for g, k in slow_profile([text], 0).items()}
    for text in (None, b"", b"12 ! \n"):
        assert not len(langid.ngrams(text)[0])


def test_distance_equals_brute_force():
    profile = {"x": list(np.unique(np.random.default_rng(2).integers(0, 500, 60)))[:40], "y": list(range(40))}
    ranker = langid.Ranker([(lang, int(g), k) for lang, grams in profile.items() for k, g in enumerate(grams)], 40)
    text = "some words of a text, some more"
    own = langid.ranked(*langid.ngrams(text.encode()), 40).tolist()
    want = {}
    for lang, grams in profile.items():
        at = {g: k for k, g in enumerate(grams)}
        want[lang] = sum(min(abs(at[g] - k), 40) if g in at else 40 for k, g in enumerate(own))
    lang, score = ranker.predict(text.encode())
    assert lang == min(want, key=lambda x: (want[x], x)) and np.isclose(score, 1 - min(want.values()) / (40 * len(own)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.93


def test_nulls_odd_texts_and_columns(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", None), (None, "the mat", None), (3, "the cat sat", "en"), (103, "die katze " * 100_000, None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, held_out int")
    found = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(df).collect()}
    assert {(i, p) for i, p, _ in found} >= {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "de")}
    assert all(0 <= s <= 1 for _, _, s in found) and langid.identify(df).count() == len(rows)
    assert langid.identify(df.limit(0)).collect() == []
    blank = df.withColumn("lang", df.lang.substr(100, 1)).where("false").union(df.selectExpr("doc_id", "text", "cast(null as string)", "lang_pred", "held_out"))
    assert {r.lang_pred for r in langid.identify(blank).collect()} == {"und"}
