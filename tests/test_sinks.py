import subprocess
import sys
import tempfile
from pathlib import Path

from tidemill.sources import sinks


def test_append_above_the_mark(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    rows = lambda *r: spark.createDataFrame(list(r), "code string, ts int")
    assert sinks.append_new(rows(("a", 1), ("b", 5)), path, "code", "ts") == 2
    assert sinks.append_new(rows(("a", 1), ("a", 2), ("b", 4), ("c", 1)), path, "code", "ts") == 2
    assert sinks.append_new(rows(("a", 2)), path, "code", "ts") == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("a", 2), ("b", 5), ("c", 1)]


def test_last_write_wins(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    rows = lambda *r: spark.createDataFrame(list(r), "code string, x int, y int")
    sinks.upsert(rows(("a", 1, None), ("b", 2, 2)), path, ["code"], 1)
    out = sinks.upsert(rows(("a", None, 7), ("c", 3, 3)), path, ["code"], 2)
    assert sorted(map(tuple, out.collect()), key=str) == [("a", None, 7), ("b", 2, 2), ("c", 3, 3)]


def test_text_forms(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([("a", 1), ("b", None)], "code string, x int")
    sinks.write_csv(df, f"{base}/c")
    sinks.write_json(df, f"{base}/j")
    assert spark.read.option("header", True).csv(f"{base}/c").count() == spark.read.json(f"{base}/j").count() == 2
    assert sorted(r.json for r in sinks.as_json(df).collect()) == ['{"code":"a","x":1}', '{"code":"b"}']


def test_entry_without_the_training_data_part():
    """Without its subpackage and the pipeline, the entry still imports and lists the other queries."""
    top = str(Path(__file__).resolve().parents[1])
    code = (
        f"import sys; sys.path.insert(0, {top!r}); sys.modules['tidemill.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tempfile.mkdtemp(prefix="spark-"))
