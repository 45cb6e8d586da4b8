"""Small persistent state and what a replica says of itself: meta values, learned weights, layout, status, limits.

Nulls: a key or peer that is null takes no part; a weight or loss that is null or not finite is restored to its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators.folds import WEIGHT_FLOOR

HALF_LIFE = 86_400.0  # seconds in which a stored weight moves half way back to 1


def latest(rows: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """key, value: the last value put, by version; of one version the greatest."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, value)).alias("m")).select(key, f"m.{value}")


def saved(stored: DataFrame, weights: DataFrame, now: int) -> DataFrame:
    """peer, weight, loss, seen, updated: stored state after a save. weights (peer, weight, loss, seen) replace those that have seen no more; all with one time."""
    old = stored.select("peer", F.col("weight").alias("w0"), F.col("loss").alias("l0"), F.col("seen").alias("n0"), F.col("updated").alias("u0"))
    both = old.join(weights, "peer", "full_outer")
    new = F.col("seen").isNotNull() & (F.col("n0").isNull() | (F.col("seen") > F.col("n0")))
    pick = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b))
    return both.select("peer", pick("weight", "w0").alias("weight"), pick("loss", "l0").alias("loss"), pick("seen", "n0").alias("seen"), F.when(new, F.lit(now).cast("long")).otherwise(F.col("u0")).alias("updated"))


def pruned(stored: DataFrame, peers: DataFrame) -> DataFrame:
    """What is stored of the peers (peer) that are still configured."""
    return stored.join(peers.select("peer").distinct(), "peer", "left_semi")


def shifted(stored: DataFrame, by: int) -> DataFrame:
    """Stored times moved back by so many seconds, not below 0."""
    return stored.withColumn("updated", F.greatest(F.col("updated") - by, F.lit(0).cast("long")))


def finite(x: Column, other: float) -> Column:
    """x, or another number where it is null, infinite or none."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), other).otherwise(x)


def restored(stored: DataFrame, now: int) -> DataFrame:
    """peer, weight, loss: stored state brought back: clamped, and the older the nearer to the start (weight 1, loss 0)."""
    weight = F.least(F.greatest(finite(F.col("weight"), 1.0), F.lit(WEIGHT_FLOOR)), F.lit(1.0))
    loss = F.least(F.greatest(finite(F.col("loss"), 0.0), F.lit(0.0)), F.lit(1.0))
    part = F.pow(F.lit(0.5), F.greatest(F.lit(now) - F.col("updated"), F.lit(0)) / HALF_LIFE)
    return stored.select("peer", (1.0 + (weight - 1.0) * part).alias("weight"), (loss * part).alias("loss"))


def laid_out(rows: DataFrame, markers: DataFrame, layout: int, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows of stores whose marker (by, layout) is the one wanted, and the stores (by) that have to be rebuilt."""
    m = markers.select(by, F.coalesce(F.col("layout") == layout, F.lit(False)).alias("good"))
    return rows.join(m.where("good").select(by), by, "left_semi"), m.where("not good").select(by)


def last_states(rows: DataFrame, key: str, *state: str) -> DataFrame:
    """key and its state as of its last row (t, id)."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("t", "id", *state)).alias("m")).select(key, *[f"m.{s}" for s in state])


def least_known(*limits: Column) -> Column:
    """The smallest limit that is set; null if none is."""
    return F.least(*limits) if len(limits) > 1 else limits[0]


def table_budget(available: Column, most: int = 256 << 20) -> Column:
    """Bytes for the tables: a tenth of what is available, within `most`."""
    return F.least(F.floor(available / 10), F.lit(most)).cast("long")


def level(encoding: Column, current: Column) -> Column:
    """zstd level asked of a peer: none for `none`, a pinned one for `zstd:n`, else the present one."""
    pinned = F.regexp_extract(encoding, "^zstd:(.*)$", 1)
    return F.when(encoding == "none", F.lit(None)).when(F.coalesce(encoding.startswith("zstd:"), F.lit(False)), pinned.try_cast("int")).otherwise(current).cast("long")


def capped(length: Column, announced: Column, most: int) -> Column:
    """What becomes of a body: refused by its announced length, cut off while it comes, or taken."""
    return F.when(announced > most, "refused").when(length > most, "cut").otherwise("taken")


def micros(header: Column) -> Column:
    """Microseconds of a header, 0 if it says none."""
    return F.coalesce(F.when(header.rlike("^[0-9]+$"), header).try_cast("long"), F.lit(0).cast("long"))


def pulls(rows: DataFrame, by: str) -> DataFrame:
    """by, ok, err, released: pulls that succeeded and failed, and the leases that failures let go."""
    good = F.coalesce("ok", F.lit(False))
    return rows.groupBy(by).agg(F.sum(good.cast("long")).alias("ok"), F.sum((~good).cast("long")).alias("err"), F.sum(F.when(good, 0).otherwise(F.coalesce("leases", F.lit(0)))).cast("long").alias("released"))


#: How a transfer can end.
ENDS = ("completed", "client_gone", "stall", "streak", "min_bandwidth", "hash_mismatch", "other")


def transfers(rows: DataFrame, by: str) -> DataFrame:
    """by, started, each of ENDS, active, remote, wire, replayed, literal: how transfers ended, and their bytes (rows: outcome, null while they run)."""
    ends = [F.count_if(F.coalesce(F.col("outcome") == e, F.lit(False))).alias(e) for e in ENDS]
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("remote", "wire", "replayed", "literal")]
    return rows.groupBy(by).agg(F.count("*").alias("started"), *ends, F.count_if(F.col("outcome").isNull()).alias("active"), *sums)


def status(peers: DataFrame, **counts: DataFrame) -> DataFrame:
    """status: one JSON document of the peers' rows, sorted by name, and of tables of one number each; peers are the configured ones."""
    out = peers.agg(F.array_sort(F.collect_list(F.struct(*peers.columns))).alias("peers"))
    for name, df in counts.items():
        out = out.join(F.broadcast(df.select(F.col(df.columns[0]).alias(name))))  # one row
    return out.select(F.to_json(F.struct("peers", *counts)).alias("status"))
