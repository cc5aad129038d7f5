"""Block files: fixed-width binary records of a block's name and its member codes, as a Spark data source.

A file has a head of 384 bytes, the number of its records (two bytes, little
end first), and records of 2813 bytes: a name of 9 bytes (GBK, zero-filled), the
number of members and a kind (two bytes each), and 400 places of 7 bytes for
codes.  A block with more members goes on in further records of its name.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

#: Fixed values of the format.
HEAD, NAME, CODE, MEMBERS = 384, 9, 7, 400
RECORD = NAME + 4 + MEMBERS * CODE
SCHEMA = "block string, kind int, code string, record long"
#: Records of one input partition.
RECORDS = 2_000


def packed(name: str, kind: int, codes: list[str]) -> bytes:
    """One record; names and codes that do not fit raise."""
    raw, members = name.encode("gbk"), [c.encode("ascii") for c in codes]
    if len(raw) > NAME or len(members) > MEMBERS or any(len(m) > CODE for m in members):
        raise ValueError(f"block {name!r} does not fit its record")
    return raw.ljust(NAME, b"\0") + struct.pack("<HH", len(members), kind) + b"".join(m.ljust(CODE, b"\0") for m in members).ljust(MEMBERS * CODE, b"\0")


def unpacked(record: bytes) -> tuple[str, int, list[str]]:
    n, kind = struct.unpack_from("<HH", record, NAME)
    places = (record[NAME + 4 + i * CODE : NAME + 4 + (i + 1) * CODE] for i in range(n))
    return record[:NAME].rstrip(b"\0").decode("gbk"), kind, [p.rstrip(b"\0").decode("ascii") for p in places]


def _opened(path: str):
    """(file system, path in it) of any path that pyarrow knows; plain paths are those of the machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records, self.blocks = options["path"], int(options.get("records", RECORDS)), None

    def pushFilters(self, filters: list) -> Iterator:
        """Equalities and lists of the block are met here, record by record, before any member is read."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("block",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.blocks = wanted if self.blocks is None else self.blocks & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path)
        parts = []
        for one in files:
            if one.is_file and one.base_name.endswith(".dat"):
                with system.open_input_file(one.path) as f:
                    n = struct.unpack("<H", f.read_at(2, HEAD))[0]
                if one.size < HEAD + 2 + n * RECORD:
                    raise ValueError(f"{one.path}: {n} records announced, but the file ends before")
                parts += [_Part(one.path, i, min(n, i + self.records)) for i in range(0, n, self.records)]
        return parts

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        if partition is None:  # no records at all
            return
        system, _ = _opened(self.path)
        names = None if self.blocks is None else {b.encode("gbk").ljust(NAME, b"\0") for b in self.blocks if b is not None}
        with system.open_input_file(partition.path) as f:
            for i in range(partition.first, partition.last):
                at = HEAD + 2 + i * RECORD
                if names is not None and f.read_at(NAME, at) not in names:
                    continue
                block, kind, codes = unpacked(f.read_at(RECORD, at))
                for code in codes:
                    yield block, kind, code, i


class _Message(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    """A task's rows become files of its own; tasks that run again leave whole files under other names, removed at the end."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from uuid import uuid4

        system, path = _opened(self.path)
        system.create_dir(path)
        message, held, name, kind, codes = _Message(), [], None, None, []
        message.files = []

        def file_of(records):
            to = f"{path}/{uuid4().hex}.dat"
            with system.open_output_stream(to) as f:
                f.write(bytes(HEAD) + struct.pack("<H", len(records)) + b"".join(records))
            message.files.append(to)

        for row in rows:
            if codes and ((row.block, row.kind) != (name, kind) or len(codes) == MEMBERS):
                held.append(packed(name, kind, codes))
                codes = []
                if len(held) == RECORDS:
                    file_of(held)
                    held = []
            name, kind = row.block, row.kind
            codes.append(row.code)
        if codes:
            held.append(packed(name, kind, codes))
        if held:
            file_of(held)
        return message

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, path = _opened(self.path)
        kept = {os.path.basename(f) for m in messages if m for f in m.files}
        for one in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if one.base_name.endswith(".dat") and one.base_name not in kept:
                system.delete_file(one.path)

    def abort(self, messages: list) -> None:
        system, _ = _opened(self.path)
        for m in messages:
            for f in m.files if m else []:
                system.delete_file(f)


class BlockFiles(DataSource):
    """``spark.read.format("block_files").load(path)``: a file or a folder of ``.dat`` files."""

    @classmethod
    def name(cls) -> str:
        return "block_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_blocks(members: DataFrame, path: str) -> None:
    """(block, kind, code) written as block files; ``path`` holds them and nothing else afterwards.  Nulls are left out."""
    spark = members.sparkSession
    spark.dataSource.register(BlockFiles)
    rows = members.select("block", "kind", "code").where("block is not null and code is not null and kind is not null").distinct()
    rows.repartition("block").sortWithinPartitions("block", "kind", "code").selectExpr("*", "0L AS record").write.format("block_files").mode("overwrite").save(path)


def read_blocks(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """(block, kind, code, record) of block files, ``records`` records a task.

    Filters on the block skip records unread.  This switches on the session's
    pushing of filters to Python sources, without which Spark refuses a source
    that takes filters.
    """
    spark.dataSource.register(BlockFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("block_files").option("records", str(records)).load(path)
