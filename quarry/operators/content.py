"""Segments, spans and ranges of content: what is fetched once, what is replayed, and where a byte lies.

Nulls: a segment without hash or tree takes no part; a tree without segments has none of their bytes. Segments are in
order of tree and position; rows that repeat both are as good as each other. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

MERGE_GAP = 64 << 10


def occurrences(segments: DataFrame) -> DataFrame:
    """hash, n, first_tree, last_tree, len of each distinct segment."""
    return segments.groupBy("hash").agg(F.count("*").alias("n"), F.min("tree").alias("first_tree"), F.max("tree").alias("last_tree"), F.min_by("len", F.struct("tree", "ord")).alias("len"))


def first_later(segments: DataFrame) -> DataFrame:
    """segments with `later`: whether the hash came before, in order of tree and position.

    The first place of a hash is a partial minimum. The join with it sends a common segment's rows to one task, which
    adaptive execution splits by its size, the other side being one row a hash.
    """
    first = segments.groupBy("hash").agg(F.min(F.struct("tree", "ord")).alias("first"))
    return segments.join(first, "hash").withColumn("later", F.struct("tree", "ord") > F.col("first")).drop("first")


def coalesced(spans: DataFrame, gap: int = MERGE_GAP) -> DataFrame:
    """tree, start, end, spans: ranges to fetch, merged over gaps of at most `gap`; spans(tree, off, len)."""
    w = W.partitionBy("tree").orderBy("off")
    ends = F.max(F.col("off") + F.col("len")).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce((F.col("off") - ends > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("tree", "island").agg(F.min("off").alias("start"), F.max(F.col("off") + F.col("len")).alias("end"), F.count("*").alias("spans")).drop("island")


def offsets(parts: DataFrame, by: str, order: list[str]) -> DataFrame:
    """parts with `off`, the running length before each."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("off", F.coalesce(F.sum("len").over(w), F.lit(0).cast("long")))


def resolved(segments: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """tree, ord, start, end: the parts of [start, end) in each segment, of any length.

    Both sides meet on (tree, width-sized bucket), a segment in every bucket that it reaches into, so a range meets
    only segments next to it; a pair that meets in several buckets counts in the first of them.
    """
    reach = lambda a, z: F.explode(F.sequence(F.floor(a / width), F.floor((z - 1) / width)))
    r = ranges.where("end > start").withColumn("bucket", reach(F.col("start"), F.col("end")))
    s = segments.where("len > 0").withColumn("bucket", reach(F.col("off"), F.col("off") + F.col("len")))
    hit = s.join(r, ["tree", "bucket"]).where("off < end and off + len > start").where(F.col("bucket") == F.floor(F.greatest("off", "start") / width))
    return hit.select("tree", "ord", F.greatest("off", "start").alias("start"), F.least(F.col("off") + F.col("len"), "end").alias("end"))


def floor_lookup(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """probe, entry: of each probe (key, at, probe) the last entry (key, at, entry) not after it, or null.

    One sort of both sides together; no pair is ever built.
    """
    rows = probes.select("key", "at", F.lit(1).alias("side"), "probe", F.lit(None).cast("long").alias("entry")).unionByName(entries.select("key", "at", F.lit(0).alias("side"), F.lit(None).cast("long").alias("probe"), "entry"))
    w = W.partitionBy("key").orderBy("at", "side", "entry").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("found", F.last("entry", ignorenulls=True).over(w)).where("side = 1").select("probe", F.col("found").alias("entry"))


def integrity(trees: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """tree, segments, expected, bytes_ok, gap_free, ok: a manifest against its tree's size; trees(tree, size)."""
    w = W.partitionBy("tree").orderBy("ord")
    follows = F.col("off") == F.coalesce(F.lag(F.col("off") + F.col("len")).over(w), F.lit(0))
    got = segments.withColumn("follows", follows & (F.col("len") > 0)).groupBy("tree").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"), F.min("follows").alias("follows"))
    rows = trees.join(got, "tree", "left")
    n, expected = F.coalesce("n", F.lit(0).cast("long")), F.expr(f"(size + {width - 1}) div {width}")
    size_ok, free = F.coalesce("bytes", F.lit(0)) == F.col("size"), F.coalesce("follows", F.lit(True))
    return rows.select("tree", n.alias("segments"), expected.alias("expected"), size_ok.alias("bytes_ok"), free.alias("gap_free"), ((n == expected) & size_ok & free).alias("ok"))


def lengths_disagree(segments: DataFrame) -> DataFrame:
    """hash: segments that claim more than one length."""
    return segments.groupBy("hash").agg(F.min("len").alias("a"), F.max("len").alias("b")).where("a <> b").select("hash")


def accounting(segments: DataFrame, width: int) -> DataFrame:
    """tree, remote, replayed, literal: bytes fetched, replayed from earlier ones, and short enough to send along."""
    short = F.col("len") < width
    return first_later(segments).groupBy("tree").agg(
        F.sum(F.when(~short & ~F.col("later"), F.col("len")).otherwise(0)).alias("remote"),
        F.sum(F.when(~short & F.col("later"), F.col("len")).otherwise(0)).alias("replayed"),
        F.sum(F.when(short, F.col("len")).otherwise(0)).alias("literal"),
    )


def pieces(ranges: DataFrame, most: int) -> DataFrame:
    """Ranges (tree, ord, start, end) cut into reads of at most `most`."""
    return ranges.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(most).cast("long")))).select("tree", "ord", F.col("at").alias("start"), F.least(F.col("at") + most, "end").alias("end"))
