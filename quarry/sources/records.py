"""The source of record: registered paths in a SQLite file, read in batch or as a stream of new ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id long, path string, hash string, nar_size long, sigs string, ca string"
COLUMNS = ("id", "path", "hash", "narSize", "sigs", "ca")


class SchemaDrift(RuntimeError):
    """The source has not the columns that it was opened for."""


def opened(path: str) -> closing[sqlite3.Connection]:
    """A read-only connection, after its columns were checked."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    have = {r[1] for r in con.execute("pragma table_info(ValidPaths)")}
    if not set(COLUMNS) <= have:
        con.close()
        raise SchemaDrift(f"ValidPaths lacks {sorted(set(COLUMNS) - have)}")
    return closing(con)


def rows_between(path: str, low: int, high: int) -> Iterator[tuple]:
    with opened(path) as con:
        yield from con.execute(f"select {', '.join(COLUMNS)} from ValidPaths where id > ? and id <= ? order by id", (low, high))


def greatest(path: str) -> int:
    """The table's own greatest id, 0 if it is empty."""
    with opened(path) as con:
        return con.execute("select coalesce(max(id), 0) from ValidPaths").fetchone()[0]


def ids_only_grow(path: str) -> bool:
    """Whether ids are never given twice; otherwise only full scans are safe."""
    with opened(path) as con:
        (ddl,) = con.execute("select sql from sqlite_master where name = 'ValidPaths'").fetchone()
    return "autoincrement" in ddl.lower()


class Slice(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def sliced(low: int, high: int, n: int) -> list[Slice]:
    step = max(1, -(-(high - low) // n))
    return [Slice(at, min(at + step, high)) for at in range(low, high, step)] or [Slice(high, high)]


class Reader(DataSourceReader):
    """Slices of ids, read side by side; option `since` skips what is known."""

    def __init__(self, options):
        self.path, self.since, self.slices = options["path"], int(options.get("since", 0)), int(options.get("slices", 8))

    def partitions(self):
        return sliced(self.since, greatest(self.path), self.slices)

    def read(self, partition):
        yield from rows_between(self.path, partition.low, partition.high)


class StreamReader(DataSourceStreamReader):
    """New rows since the last offset, the offset being the table's greatest id; read in slices, never by the driver."""

    def __init__(self, options):
        self.path, self.slices = options["path"], int(options.get("slices", 8))

    def initialOffset(self):
        return {"id": 0}

    def latestOffset(self):
        return {"id": greatest(self.path)}

    def partitions(self, start, end):
        return sliced(start["id"], end["id"], self.slices)

    def read(self, partition):
        yield from rows_between(self.path, partition.low, partition.high)


class RecordSource(DataSource):
    @classmethod
    def name(cls):
        return "records"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def candidates(rows: DataFrame) -> DataFrame:
    """Well-formed rows: content in hex, signatures as an array, '' as null; rows without size or known hash are skipped."""
    from quarry.functions.codecs import hash_column

    sigs = F.filter(F.split(F.coalesce("sigs", F.lit("")), r"\s+"), lambda x: x != "")
    out = rows.select("id", "path", hash_column("hash").alias("content"), F.col("nar_size").alias("size"), sigs.alias("sigs"), F.when(F.col("ca") != "", F.col("ca")).alias("ca"))
    return out.where("content is not null and size is not null")


def by_part(rows: DataFrame, store: str, part: str) -> DataFrame:
    """The row whose path begins with the 32-character key: a range, so statistics prune; none for an odd key."""
    if len(part) != 32 or not part.isalnum():
        return rows.limit(0)
    return rows.where((F.col("path") >= f"{store}/{part}-") & (F.col("path") < f"{store}/{part}.")).orderBy("path").limit(1)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
