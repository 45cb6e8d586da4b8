"""What the operators of this subpackage share: the shared folder, reliable cuts of lineage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: a cut of lineage that lost executors cannot undo."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a stored table once all that was made of it is stored too."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_text(run: Callable[[pa.Array], pa.Array], kind: str, text: str = "text") -> Column:
    """A column from batches of a text column: only the texts go to the workers and only the result comes back, so rows stay
    where they are; what the batches took is given back when they are through.
    """

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield run(b)
        pa.default_memory_pool().release_unused()

    each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, kind)(F.col(text))


def lean(run: Callable) -> Callable:
    """run over batches, giving back at its end what they took: workers are used again, and keep it otherwise."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return each


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session has; the operator's own hash ranges follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_side(df: DataFrame, rows: int, most_mb: float = 32.0, row_bytes: int = 64) -> DataFrame:
    """df marked for broadcast if `rows`, its counted size, stays under most_mb; else as it is, to be shuffled."""
    return F.broadcast(df) if rows * row_bytes <= most_mb * 1e6 else df


def spread_join(rows: DataFrame, side: DataFrame, key: str, unit: str, most: int = 100_000) -> DataFrame:
    """rows left-joined with side, of one row a key; a key of more than `most` rows is dealt to several tasks by `unit`.

    The keys that have so many are at most one for every `most` rows.
    """
    hot = stored(rows.groupBy(key).agg(F.ceil(F.count("*") / most).alias("salts_")).where("salts_ > 1"), "hot")
    hot = small_side(hot, hot.count())
    salts = F.coalesce("salts_", F.lit(1).cast("long"))
    left = rows.join(hot, key, "left").withColumn("salt_", F.pmod(F.xxhash64(unit), salts)).drop("salts_")
    right = side.join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts_")
    return left.join(right, [key, "salt_"], "left").drop("salt_")


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, dst) longs to (node, label), the label being the smallest node that edges lead to.

    Contraction: each round every node takes the smallest label next to it, edges are drawn between these
    labels, and repeated ones and loops go. Hubs are met by partial minima before the shuffle; no node's
    neighbours are ever gathered. The tables of each round are stored, so a lost executor costs no rerun.
    """
    live = stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    levels: list[DataFrame] = []
    for _ in range(rounds):
        both = live.select("src", "dst").unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
        levels.append(near)
        left = near.select(F.col("node").alias("src"), F.col("label").alias("a"))
        right = near.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        left_over = live.join(left, "src").join(right, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        before, live = live, stored(left_over, "edges")
        discard(before)
        if live.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    out = levels[-1]
    for lower in reversed(levels[:-1]):
        up = out.select(F.col("node").alias("label"), F.col("label").alias("top"))
        before, out = out, stored(lower.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        discard(before)
    return out
