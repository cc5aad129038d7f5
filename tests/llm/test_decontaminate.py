import hashlib
import re

from compare import assert_same
from tidemill.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    wins = [(i, w[k : k + 13]) for i, t in items if i is not None for w in [words(t)] for k in range(max(1, len(w) - 12)) if w]
    out = []
    for _, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(str(i))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


LONG = "The Quick brown FOX jumps over the lazy dog and then it sleeps under a tall old tree"
ITEMS = [(1, LONG), (10, "What is é?"), (2, "forty-two"), (3, None), (4, " ... "), (None, "never"), (5, LONG), (6, "two")]
DOCS = [
    (1, f"before {LONG.upper()}! after"), (2, "he said: what---is  É?"), (3, "what is é"), (4, "the answer: FORTY two"), (5, None), (6, ""), (7, "..."), (8, LONG.replace("lazy", "busy")),
    (9, "word " * 2000 + LONG), (10, "never"), (None, "forty two"), (1, "clean text here"), (11, "quick brown fox jumps over the lazy dog and then it sleeps under"), (12, "two two two"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*d, [], "x") for d in DOCS], "doc_id long, text string, runs array<int>, item_ids string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(str, zip((d[0] for d in DOCS), slow(DOCS, ITEMS))))
    for limit in (4_000_000, 60):  # one automaton, and one for each item
        got = [(r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in decontaminate.contamination(docs, items, limit=limit).collect()]
        assert sorted(map(str, got)) == want
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {d[0] for d, w in zip(DOCS, slow(DOCS, ITEMS)) if w[4] and d[0] is not None}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in DOCS if d[0] not in bad)


def test_spans_point_at_the_original(spark):
    docs = spark.createDataFrame([(1, f"é — Before: {LONG.upper()}! After.")], "doc_id long, text string")
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    row = decontaminate.benchmark_hits(docs, items).first()
    text = docs.first().text.encode()
    assert [text[s["from"] : s["to"]].decode() for s in row.spans] == [LONG.upper()]


def test_equals_sql_on_whole_tables(spark):
    assert_same(queries.op6_benchmark_contamination(spark, SF), queries.OP6_SQL, SF)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_workers_hold_no_group_of_items_that_they_have_used(spark):
    """Twenty groups go through one worker, which is then asked what its broadcasts hold."""
    items = spark.createDataFrame([(k, f"item {k} " + f"word{k} " * 30) for k in range(20)], "item_id long, text string")
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "concat('see item ', id % 20, ' ', repeat(concat('word', id % 20, ' '), 30)) AS text")
    hits = decontaminate.benchmark_hits(docs, items, limit=60, block=500)

    def held(batches):
        import gc

        import pyarrow as pa
        from pyspark.core.broadcast import Broadcast

        for batch in batches:
            found = batch.column("n_words").to_pylist()
            alive = sum("_value" in vars(b) for b in gc.get_objects() if isinstance(b, Broadcast))
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(found)], pa.int64()), "alive": pa.array([alive], pa.int64())})

    rows = hits.mapInArrow(held, "rows long, alive long").collect()
    assert sum(r.rows for r in rows) == 40 and max(r.alive for r in rows) == 0
    assert all(len(r.item_ids) == 1 for r in hits.collect())
