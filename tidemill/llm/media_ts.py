"""Media columns as MPEG transport streams.

A payload is cut into access units; each becomes one elementary packet with a
presentation time, dealt over 188-byte transport packets behind program tables.
Reading parses the tables, checks continuity counters, reassembles the
elementary packets and lists times and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import per_row

PACKET, BLOCK = 188, 576
UNIT = 16 * BLOCK
#: 90 kHz ticks: the first unit's time, the step between units.
FIRST_TIME, STEP = 90_000, 2_160
#: One unit in so many can be entered at random; tables are repeated before it.
ACCESS_EVERY = 8
PMT_PID, STREAM_PID, PROGRAM = 0x1000, 0x0100, 1
#: private_stream_1 in elementary packets, stream type "PES private data".
STREAM_ID, STREAM_TYPE = 0xBD, 0x06


@cache
def _crc_table() -> tuple[int, ...]:
    table = []
    for c in range(256):
        r = c << 24
        for _ in range(8):
            r = (r << 1 ^ (0x04C11DB7 if r >> 31 else 0)) & 0xFFFFFFFF
        table.append(r)
    return tuple(table)


def crc_mpeg(data: bytes) -> int:
    r, table = 0xFFFFFFFF, _crc_table()
    for c in data:
        r = (r << 8 & 0xFFFFFFFF) ^ table[r >> 24 ^ c]
    return r


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


@cache
def _tables() -> np.ndarray:
    """PAT and PMT packets, counters 0."""
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    made = [(bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s).ljust(PACKET, b"\xff") for pid, s in ((0, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(made), np.uint8).reshape(2, PACKET)


def pad(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of BLOCK."""
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))


def _time_field(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 255 | 1, t >> 7 & 255, t << 1 & 255 | 1])


def _packets(unit: bytes, time: int, entry: bool, counter: int) -> np.ndarray:
    """Transport packets of one access unit."""
    data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time_field(time) + unit
    clock = time - STEP
    lead = b"\x07\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big") if entry else b""
    first = PACKET - 4 - len(lead)
    n = 1 + max(0, -(-(len(data) - first) // (PACKET - 4)))
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    if lead:
        out[0, 3] |= 0x20
        out[0, 4 : 4 + len(lead)] = np.frombuffer(lead, np.uint8)
    body = np.frombuffer(data, np.uint8)
    if n > 1:
        out[0, 4 + len(lead) :] = body[:first]
        out[1:-1, 4:] = body[first : first + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
        rest, used = body[first + (n - 2) * (PACKET - 4) :], 0
    else:
        rest, used = body, len(lead)
    stuffing = PACKET - 4 - used - len(rest)
    if stuffing and used:  # widen the field that is there
        out[-1, 4] += stuffing
        out[-1, 4 + used : 4 + used + stuffing] = 0xFF
    elif stuffing:
        out[-1, 3] |= 0x20
        out[-1, 4 : 4 + stuffing] = 0xFF
        out[-1, 4] = stuffing - 1
        if stuffing > 1:
            out[-1, 5] = 0
    out[-1, PACKET - len(rest) :] = rest
    return out


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload; equal payloads, equal bytes."""
    parts, counter, tables = [], 0, 0
    for k, a in enumerate(range(0, len(payload), UNIT)):
        if k % ACCESS_EVERY == 0:
            head = _tables().copy()
            head[:, 3] |= tables & 15
            tables += 1
            parts.append(head)
        made = _packets(payload[a : a + UNIT], FIRST_TIME + k * STEP, k % ACCESS_EVERY == 0, counter)
        counter += len(made)
        parts.append(made)
    return np.concatenate(parts).tobytes() if parts else b""


def _streams(packets: np.ndarray, pid: np.ndarray, start: np.ndarray) -> dict[int, int]:
    """Elementary PIDs and stream types, from the program tables."""

    def section(row):
        packet = packets[row].tobytes()
        at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
        at += 1 + packet[at]
        length = 3 + (int.from_bytes(packet[at + 1 : at + 3], "big") & 0xFFF)
        if crc_mpeg(packet[at : at + length]):
            raise ValueError("program table with a wrong checksum")
        return packet[at : at + length]

    found = {}
    for row in np.flatnonzero((pid == 0) & start)[:1]:
        pat = section(row)
        for at in range(8, len(pat) - 4, 4):
            number, table = int.from_bytes(pat[at : at + 2], "big"), int.from_bytes(pat[at + 2 : at + 4], "big") & 0x1FFF
            for r in np.flatnonzero((pid == table) & start)[:1] if number else ():
                pmt = section(r)
                at2 = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
                while at2 < len(pmt) - 4:
                    found[int.from_bytes(pmt[at2 + 1 : at2 + 3], "big") & 0x1FFF] = pmt[at2]
                    at2 += 5 + (int.from_bytes(pmt[at2 + 3 : at2 + 5], "big") & 0xFFF)
    return found


def demux(stream: bytes) -> dict:
    """payload, times and entry flags of its units, packets, gaps (breaks of continuity), streams."""
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("packet without a sync byte")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    start = packets[:, 1] & 0x40 > 0
    streams = _streams(packets, pid, start)
    gaps = 0
    for p in np.unique(pid):
        counter = packets[pid == p, 3] & 15
        gaps += int(((counter[1:].astype(int) - counter[:-1]) % 16 != 1).sum())
    own = np.flatnonzero(pid == min(streams, default=-1))
    rows, begins = packets[own], start[own]
    field = rows[:, 3] & 0x20 > 0
    offset = 4 + np.where(field, 1 + rows[:, 4].astype(int), 0)
    entry = (field & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0))[begins]
    data = rows[np.arange(PACKET) >= offset[:, None]]
    size = PACKET - offset
    at = (np.cumsum(size) - size)[begins]
    if len(at) and (data[at[:, None] + np.arange(3)] != (0, 0, 1)).any():
        raise ValueError("unit without a start code")
    head = 9 + data[at + 8].astype(int)
    t = data[at[:, None] + 9 + np.arange(5)].astype(np.int64) if len(at) else np.zeros((0, 5), np.int64)
    times = (t[:, 0] >> 1 & 7) << 30 | t[:, 1] << 22 | t[:, 2] >> 1 << 15 | t[:, 3] << 7 | t[:, 4] >> 1
    edge = np.zeros(len(data) + 1, np.int8)
    edge[at] += 1
    edge[at + head] -= 1
    return {"payload": data[np.cumsum(edge[:-1]) == 0].tobytes(), "times": times.tolist(), "entries": entry.tolist(), "packets": len(packets), "gaps": gaps, "streams": streams}


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (the transport stream of the padded UTF-8 text; null: empty)."""
    kind = dict(docs.dtypes)[id_col]

    def rows(doc_id, text):
        yield doc_id.decode() if isinstance(doc_id, bytes) else doc_id, len(text or b""), mux(pad(text or b""))

    return per_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], f"doc_id {kind}, n_bytes long, media binary", rows)


def index(media: DataFrame) -> DataFrame:
    """One row for each unit of (doc_id, media): doc_id, unit, time, entry (can be entered at random).

    A null stream has no units; a damaged one raises.
    """
    kind = dict(media.dtypes)["doc_id"]

    def rows(doc_id, stream):
        if stream is None:
            return
        doc_id = doc_id.decode() if isinstance(doc_id, bytes) else doc_id
        read = demux(stream)
        for k, (time, entry) in enumerate(zip(read["times"], read["entries"])):
            yield doc_id, k, time, entry

    return per_row(media, ["doc_id", "media"], f"doc_id {kind}, unit int, time long, entry boolean", rows)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: sizes and digests of the payload read back from ``store``'s column and of the stored stream, and features.

    A null text is empty and stored as one padded block.  Each row stands for
    itself, so repeated rows repeat and equal texts have equal values.
    """
    media = store(docs, id_col, text_col)
    kind = dict(media.dtypes)["doc_id"]

    def rows(doc_id, n_bytes, stream):
        read = demux(stream)
        payload = read["payload"]
        feature = f"streams={','.join(f'{p}:{t}' for p, t in sorted(read['streams'].items()))} packets={read['packets']} gaps={read['gaps']} units={len(read['times'])} entries={sum(read['entries'])} from={read['times'][0]} to={read['times'][-1]}"
        yield (
            doc_id.decode() if isinstance(doc_id, bytes) else doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature,
        )

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return per_row(media, ["doc_id", "n_bytes", "media"], schema, rows)
