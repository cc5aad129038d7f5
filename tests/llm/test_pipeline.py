import numpy as np

import corpus_pipeline
from compare import assert_same
from tidemill.llm import decontaminate, line_dedup, mixing, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if "quality" in name:
            good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
            assert ids(out) == [i for i in ids(docs) if i in good] and len(good) > 100
        elif "line" in name:
            want = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(docs).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == want
        elif "simhash" in name:
            groups = simhash.simhash_groups(docs).collect()
            assert ids(out) == sorted({r.component_id for r in groups})
        elif "benchmark" in name:
            bad = {r.doc_id for r in decontaminate.contamination(docs, benchmark).where("contaminated").collect()}
            assert ids(out) == [i for i in ids(docs) if i not in bad] and bad
        else:
            want = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
            assert ids(out) == sorted(np.repeat(list(want), list(want.values())).tolist())
        if "mixing" not in name:
            assert out.columns == docs.columns
        docs = out


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[-1] == "copy"


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_chat_query_equals_its_sql(spark):
    assert_same(queries.op9_reply_trees(spark, "/root/testdata/sf0.01"), queries.OP9_SQL, "/root/testdata/sf0.01")


def test_stages_keep_columns_of_any_name(spark):
    names = "held_out score predicted y n_lines n_removed n_chunks doubt own id key r digest fingerprint fp component_id rejected_id bad_id stay_id stay_n runs copies copy size rate target h nth source_size".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.select("*", *((docs.doc_id + k).alias(n) for k, n in enumerate(names)), docs.text.alias("__text"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == [*docs.columns, *["copy_"] * ("mixing" in name)]
        rows = out.collect()
        assert rows and all(r[n] == r.doc_id + k for r in rows for k, n in enumerate(names))
        assert {(r.doc_id, r["__text"]) for r in rows} <= {(r.doc_id, r.text) for r in docs.collect()}
