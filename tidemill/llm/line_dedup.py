"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides where chunks end,
on two scales: a line ends a chunk of the first scale if its rolling hash is no
larger than that of a line beside it, and of the second if no smaller.  So ends
move only near an edit, of two lines in a row one is an end, and chunks have two
or three lines.  A chunk that stands earlier in the corpus is matched there, and
the match goes on line by line to both sides.  Lines whose bytes equal those at
the earlier place are removed.

Of two texts that share five lines in a row or more, the later one loses them
all: some chunk lies within those lines on one of the scales and begins and ends
at most two lines from theirs.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._base import forget, per_row, release, stored

#: Lines under the rolling hash.
WINDOW = 2
#: Lines by which a match is continued to either side; two are enough for blocks of five lines and more.
REACH = 4
#: Parts into which the places of one chunk are dealt to be joined with the first of them.
SALTS = 8

_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def rolls(marks: list[int], window: int = WINDOW) -> list[int]:
    """Rolling hash of each line and the ``window`` - 1 before it, from hashes of lines."""
    out, roll, drop = [], 0, pow(_BASE, window, 1 << 64)
    for i, mark in enumerate(marks):
        roll = (roll * _BASE + mark - (marks[i - window] * drop if i >= window else 0)) & _MASK
        out.append(roll)
    return out


def chunks(marks: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Chunks of both scales as (first line, lines); those of one scale may share a line."""
    last, found = len(marks) - 1, set()
    values = rolls(marks, window)
    for sign in (1, -1):
        v = [sign * x for x in values]
        ends = [i for i in range(last) if v[i] <= v[i + 1] or (i and v[i] <= v[i - 1])] + [last]
        begins = [0, *(e + 1 for e in ends[:-1])]
        for j, begin in enumerate(begins):
            end = next((e for e in ends[j : j + 2] if e > begin), None)
            if end is not None:
                found.add((begin, end - begin + 1))
    return sorted(found)


def line_marks(lines: list[bytes]) -> list[int]:
    return [xxhash.xxh64_intdigest(line) for line in lines]


def _key(text: bytes) -> int:
    """What Spark's xxhash64 gives: tells the texts of one id apart."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def _digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _short(marks: list[int]) -> bytes:
    """Four bytes of each mark."""
    return b"".join((m & 0xFFFFFFFF).to_bytes(4, "big") for m in marks)


def _alike(a: bytes, b: bytes) -> int:
    """Number of leading marks that are equal."""
    n = 0
    while 4 * n < min(len(a), len(b)) and a[4 * n : 4 * n + 4] == b[4 * n : 4 * n + 4]:
        n += 1
    return n


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=_digest) -> DataFrame:
    """``docs`` with text_col reduced and columns n_lines, n_removed (lines), n_chunks (runs of removed lines).

    Columns of ``docs`` with these names, in any case, are replaced; the others stay as they are.
    The place kept of a repeated chunk is the one with the smallest id (null
    first), then text key, then position.  Rows that share id and text are one
    document and get the same result.  A null text stays null with no lines; an
    empty text is one line; a text of one line has no chunk.  A line goes only
    if it has the bytes of the earlier line that its chunk was matched with, so
    equal digests of different bytes remove nothing that is not repeated.

    The matches are written to the session's shared folder; the table of lines
    to compare stays there as long as the result may be read.
    """
    spark = docs.sparkSession
    source = docs.select(F.struct(F.col(id_col).alias("id")).alias("who"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    claims, path = stored(_claims(source, digest))
    release(spark)
    doubt, _ = stored(_doubt(source, claims))
    forget(spark, path)
    release(spark)

    out = _reduced(docs, doubt, id_col, text_col)
    counts = {c: F.col(f"r.{c}") for c in ("n_lines", "n_removed", "n_chunks")}
    own = [F.col("r.text").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns if c.lower() not in counts]
    return out.select(*own, *(v.alias(c) for c, v in counts.items()))


def _claims(source: DataFrame, digest) -> DataFrame:
    """who, key, line of lines that seem repeated, and (from_who, from_key, from_line), an earlier place of theirs.

    A place is compared with the first of its chunk only, so a chunk's places are
    never paired; they are dealt to parts for the join.
    """
    kind = dict(source.dtypes)["doc_id"]
    name = lambda v: v.decode() if isinstance(v, bytes) else v

    def places(doc_id, text):
        if text is not None:
            lines = text.split(b"\n")
            marks, key = line_marks(lines), _key(text)
            for a, n in chunks(marks):
                before, after = _short(marks[max(0, a - REACH) : a][::-1]), _short(marks[a + n : a + n + REACH])
                yield digest(b"\n".join(lines[a : a + n])), name(doc_id), key, a, n, before, after

    def lines_of(doc_id, key, a, n, before, after, from_id, from_key, from_a, from_before, from_after):
        for line in range(a - _alike(before, from_before), a + n + _alike(after, from_after)):
            yield name(doc_id), key, line, name(from_id), from_key, line - a + from_a

    schema = f"digest binary, doc_id {kind}, key long, a int, n int, before binary, after binary"
    seen = per_row(source, ["doc_id", "text"], schema, places)
    repeated = (
        seen.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "key", "a", "before", "after")).alias("first"), F.max(F.struct("doc_id", "key", "a")).alias("last"))
        .where(~F.struct("first.doc_id", "first.key", "first.a").eqNullSafe(F.col("last")))
        .select("digest", *(F.col(f"first.{c}").alias("from_" + c) for c in ("doc_id", "key", "a", "before", "after")))
        .withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    )
    here = F.col("doc_id").eqNullSafe(F.col("from_doc_id")) & (F.col("key") == F.col("from_key")) & (F.col("a") == F.col("from_a"))
    matched = seen.withColumn("salt", F.pmod(F.xxhash64("key", "a"), F.lit(SALTS)).cast("int")).join(repeated, ["digest", "salt"]).where(~here)
    names = "doc_id key a n before after from_doc_id from_key from_a from_before from_after".split()
    lines = per_row(matched, names, f"doc_id {kind}, key long, line int, from_id {kind}, from_key long, from_line int", lines_of)
    who, from_who = F.struct(F.col("doc_id").alias("id")).alias("who"), F.struct(F.col("from_id").alias("id")).alias("who")
    return lines.groupBy(who, "key", "line").agg(F.min(F.struct(from_who, F.col("from_key").alias("key"), F.col("from_line").alias("line"))).alias("first"))


def _doubt(source: DataFrame, claims: DataFrame) -> DataFrame:
    """who, key, and for each line in doubt the bytes of the earlier line."""
    wanted = claims.select("first.*").distinct().groupBy("who", "key").agg(F.collect_set("line").alias("lines"))
    texts = source.where(F.contains("text", F.lit("\n"))).select("who", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    asked = texts.join(wanted, ["who", "key"]).select("who", "key", F.explode(picked("text", "lines")).alias("found"))
    given = asked.select("who", "key", "found.*").dropDuplicates(["who", "key", "line"])
    own = claims.select("first", F.struct("who", "key", "line").alias("own"))
    same = [own[f"first.{c}"] == given[c] for c in ("who", "key", "line")]
    return own.join(given, same).groupBy("own.who", "own.key").agg(F.collect_list(F.struct("own.line", "bytes")).alias("doubt"))


def picked(text, lines):
    @arrow_udf("array<struct<line: int, bytes: binary>>")
    def run(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        made = []
        for text, numbers in zip(texts, wanted):
            split = text.as_py().split(b"\n")
            made.append([{"line": k, "bytes": split[k]} for k in numbers.as_py() if k < len(split)])
        return pa.array(made, pa.list_(pa.struct([("line", pa.int32()), ("bytes", pa.binary())])))

    return run(text, lines)


def _reduced(docs: DataFrame, doubt: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own, r): each row and its text without the lines that have the very bytes of an earlier place."""
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.struct(F.col(id_col).alias("id")).alias("who"), F.xxhash64(F.col(text_col)).alias("key"))
    return wide.join(doubt, ["who", "key"], "left").select("own", rewrite(F.col("own")[text_col], F.col("doubt")).alias("r"))


def _rewrite(text: bytes | None, doubt) -> tuple[bytes | None, int, int, int]:
    if text is None:
        return None, 0, 0, 0
    lines = text.split(b"\n")
    if not doubt:
        return text, len(lines), 0, 0
    gone = {d["line"] for d in doubt if d["line"] < len(lines) and lines[d["line"]] == d["bytes"]}
    runs = sum(k - 1 not in gone for k in gone)
    return b"\n".join(line for k, line in enumerate(lines) if k not in gone), len(lines), len(gone), runs


def rewrite(text, doubt):
    @arrow_udf("struct<text: string, n_lines: long, n_removed: long, n_chunks: long>")
    def run(texts: pa.Array, doubts: pa.Array) -> pa.Array:
        made = [_rewrite(t, d.as_py()) for t, d in zip(texts.cast(pa.binary()).to_pylist(), doubts)]
        text, lines, removed, n = zip(*made) if made else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(text, pa.binary()).cast(pa.string()), *(pa.array(v, pa.int64()) for v in (lines, removed, n))], names=["text", "n_lines", "n_removed", "n_chunks"])

    return run(text, doubt)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated chunks gone from the text, same columns; ``count_col``, if there, counts anew."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    out = deduplicate_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), own.alias("own")), "id", "text")
    text = F.col("text")
    made = {text_col: text, count_col: F.char_length(text).cast(dict(docs.dtypes).get(count_col, "long"))}
    return out.select(*(made.get(c, F.col("own")[c]).alias(c) for c in docs.columns))
