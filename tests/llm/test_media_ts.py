import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import media_ts


@pytest.mark.parametrize("n", [0, 1, 150, 575, 576, 577, 1152, media_ts.UNIT - 1, media_ts.UNIT, media_ts.UNIT + 1, 9 * media_ts.UNIT + 700, 1_000_003])
def test_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    payload = media_ts.pad(data)
    assert len(payload) % 576 == 0 and len(payload) >= max(576, n) and len(payload) < n + 577
    stream = media_ts.mux(payload)
    assert len(stream) % 188 == 0 and stream[::188] == b"\x47" * (len(stream) // 188)
    read = media_ts.demux(stream)
    assert read["payload"] == payload and read["gaps"] == 0 and read["streams"] == {media_ts.STREAM_PID: media_ts.STREAM_TYPE}
    units = -(-len(payload) // media_ts.UNIT)
    assert read["times"] == [media_ts.FIRST_TIME + k * media_ts.STEP for k in range(units)]
    assert read["entries"] == [k % media_ts.ACCESS_EVERY == 0 for k in range(units)]


def test_checksum_of_a_known_section():
    # a section followed by its own checksum leaves no remainder
    body = b"\x00\xb0\x0d\x00\x01\xc1\x00\x00\x00\x01\xf0\x00"
    assert media_ts.crc_mpeg(body + media_ts.crc_mpeg(body).to_bytes(4, "big")) == 0
    assert media_ts.crc_mpeg(b"123456789") == 0x0376E6E7  # published check value of CRC-32/MPEG-2


def test_a_lost_packet_is_a_gap_and_damage_is_noticed():
    stream = media_ts.mux(media_ts.pad(b"x" * 40_000))
    lost = stream[: 20 * 188] + stream[21 * 188 :]
    assert media_ts.demux(lost)["gaps"] == 1
    with pytest.raises(ValueError):
        media_ts.demux(b"\x00" + stream[1:])
    with pytest.raises(ValueError):
        media_ts.demux(stream[:8] + b"\x55" + stream[9:])


def test_digests_and_columns(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 9000), (5, "hello"), (None, "x" * 300_000), (1, "hello")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, media string, n_bytes int")
    found = media_ts.digests(df).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        text = {i: (t or "").encode() for i, t in rows}[r.doc_id]
        payload = media_ts.pad(text)
        media = media_ts.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        by.setdefault(text, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by.values())
    assert media_ts.digests(df.limit(0)).collect() == []


def test_stored_column_and_its_index(spark):
    df = spark.createDataFrame([(1, "a" * 20_000), (2, None)], "doc_id long, text string")
    media = media_ts.store(df)
    rows = media_ts.index(media).orderBy("doc_id", "unit").collect()
    assert [(r.doc_id, r.unit, r.entry) for r in rows] == [(1, 0, True), (1, 1, False), (1, 2, False), (2, 0, True)]
    assert media.agg(F.sum("n_bytes")).first()[0] == 20_000


def test_index_of_null_streams_and_text_ids(spark):
    media = media_ts.store(spark.createDataFrame([("a", "x" * 5000), ("b", None)], "doc_id string, text string"))
    assert media_ts.index(media).groupBy("doc_id").count().count() == 2
    assert media_ts.index(media.withColumn("media", F.lit(None).cast("binary"))).count() == 0
