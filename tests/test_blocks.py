import struct
import tempfile

import pytest

from tidemill.sources import blocks


@pytest.fixture()
def folder():
    return f"{tempfile.mkdtemp(prefix='spark-')}/blocks"


def test_round_trip_of_names_beyond_ascii_and_large_blocks(spark, folder):
    rows = [("银行", 2, f"{k:06d}") for k in range(1000)] + [("房地产", 2, "600000"), ("银行", 3, "600000"), ("a", 1, "1")]
    members = spark.createDataFrame(rows + rows[:5] + [(None, 1, "2"), ("b", 1, None)], "block string, kind int, code string")
    blocks.write_blocks(members, folder)
    for records in (1, 3, 2_000):
        got = blocks.read_blocks(spark, folder, records)
        assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(rows)
    sizes = blocks.read_blocks(spark, folder).where("block = '银行' and kind = 2").groupBy("record").count().collect()
    assert sorted(r["count"] for r in sizes) == [200, 400, 400]
    blocks.write_blocks(members.where("block = 'a'"), folder)  # takes the place of what was there
    assert [tuple(r)[:3] for r in blocks.read_blocks(spark, folder).collect()] == [("a", 1, "1")]


def test_filters_reach_the_reader(spark, folder):
    blocks.write_blocks(spark.range(300).selectExpr("concat('b', id % 30) AS block", "1 AS kind", "cast(id AS string) AS code"), folder)
    got = blocks.read_blocks(spark, folder).where("block IN ('b3', 'b7') AND code > '2'")
    assert {r.block for r in got.collect()} == {"b3", "b7"} and got.count() == sum(str(k) > "2" for k in range(300) if k % 30 in (3, 7))
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = blocks._Reader({"path": folder})
    left = list(reader.pushFilters([In(("block",), ("b3", "b7")), GreaterThan(("code",), "2"), EqualTo(("block",), "b7")]))
    assert left == [GreaterThan(("code",), "2")] and reader.blocks == {"b7"}
    assert {row[0] for part in reader.partitions() for row in reader.read(part)} == {"b7"}


def test_records_by_hand_and_refusals(spark, folder):
    record = "钢铁".encode("gbk").ljust(9, b"\0") + struct.pack("<HH", 2, 5) + (b"600019\0" + b"000898\0").ljust(2800, b"\0")
    assert blocks.packed("钢铁", 5, ["600019", "000898"]) == record and blocks.unpacked(record) == ("钢铁", 5, ["600019", "000898"])
    for bad in (("五个汉字长", 1, []), ("a", 1, ["12345678"]), ("a", 1, ["1"] * 401)):
        with pytest.raises(ValueError):
            blocks.packed(*bad)
    import os

    os.makedirs(folder)
    with open(f"{folder}/short.dat", "wb") as f:
        f.write(bytes(384) + struct.pack("<H", 2) + record)
    with pytest.raises(ValueError):
        blocks._Reader({"path": folder}).partitions()


def test_empty_table(spark, folder):
    blocks.write_blocks(spark.createDataFrame([], "block string, kind int, code string"), folder)
    assert blocks.read_blocks(spark, folder).collect() == []
