"""What a user asks a replica for, as functions over its tables: each names the operators that answer it.

A lookup that finds nothing gives an empty DataFrame, never an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions import codecs as X
from quarry.operators import catalog, content, manifest as manifests, replication, state
from quarry.sources import records
from quarry.sources.settings import Config


def lookup_source(rows: DataFrame, store: str, part: str) -> DataFrame:
    """The source's row whose path begins with the 32 characters, by a range that statistics prune."""
    return records.by_part(rows, store, part)


def resolve(facts: DataFrame, holdings: DataFrame, origins: DataFrame, part: str | None = None) -> DataFrame:
    """path, content, sources, tier, info: of each path (or of one hash part) the believable fact with most live sources of the
    lowest tier that has any, rendered; ties go to the smaller content.

    facts(hash_part, path, content, size, refs, sigs, ca, verified); holdings(origin, content); origins(origin, tier, live).
    """
    asked = facts.where(F.col("hash_part") == part) if part is not None else facts
    good = asked.where(catalog.well_formed(F.col("content"), F.col("path"), F.col("hash_part"), F.coalesce("ca", F.lit("")), F.size("sigs") > 0) & ((F.coalesce("ca", F.lit("")) != "") | F.coalesce("verified", F.lit(False))))
    usable = catalog.resolve(holdings.join(good.select("content").distinct(), "content", "left_semi"), origins)
    rows = good.join(usable, "content")
    info = X.info_text(F.col("path"), F.col("content"), F.col("size"), F.col("refs"), F.lit(None).cast("string"), F.array_sort("sigs"), F.col("ca"))
    best = rows.groupBy("path").agg(F.min(F.struct((-F.col("holders")).alias("less"), "content", "tier", "holders", info.alias("info"))).alias("b"))
    return best.select("path", "b.content", F.col("b.holders").alias("sources"), "b.tier", "b.info")


def resolve_range(segments: DataFrame, tree: object, start: int, end: int, width: int) -> DataFrame:
    """tree, ord, start, end: the parts of [start, end) of a tree, segment by segment."""
    spark = segments.sparkSession
    asked = spark.createDataFrame([(start, end)], "start long, end long").withColumn("tree", F.lit(tree).cast(segments.schema["tree"].dataType))
    return content.resolved(segments.where(F.col("tree") == tree), asked, width)


def manifest(nodes: DataFrame, tree: object, segment: int) -> DataFrame:
    """tree, manifest: a tree's manifest as JSON."""
    return manifests.documents(nodes.where(F.col("tree") == tree), segment)


def plan_transfer(trees: DataFrame, segments: DataFrame, gap: int = content.MERGE_GAP) -> tuple[DataFrame, DataFrame]:
    """What each tree's transfer fetches (tree, plan, spans, bytes), and the ranges asked for, merged over gaps.

    segments (tree, ord, off, len, hash) of trees with a manifest: a hash is fetched once; others are fetched whole.
    """
    fetch = content.first_later(segments).where("not later")
    return manifests.planned(trees, fetch.select("tree", "len")), content.coalesced(fetch.select("tree", "off", "len"), gap)


def respond(requests: DataFrame, clocks: DataFrame, journal: DataFrame, held: DataFrame, budget: int = 24 << 20, cap: int = 8 << 20) -> DataFrame:
    """How a peer's clocks are answered: suffixes, snapshots, and what the budget defers."""
    return replication.responses(requests, clocks, journal, held, budget, cap)


def status(peers: DataFrame, **counts: DataFrame) -> DataFrame:
    """One JSON document of peers and counts."""
    return state.status(peers, **counts)


def check(config: Config) -> list[str]:
    """What is wrong with a configuration; nothing, if it can be used."""
    return config.problems()
