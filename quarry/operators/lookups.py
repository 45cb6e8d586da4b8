"""Points and slices of the catalog and the source of record: by content, by path, by prefix, by origin, and what changed.

Nulls never match a probe; a probe that is found nowhere has no row. Ties go to the smallest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions.codecs import base32


def by_content(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """content, path: for each probed content (hex) the smallest path whose hash column, in either encoding, says so.

    rows(path, hash): hash is sha256: with hex or base32. Both encodings of the probe are joined on the column as it is
    stored, so no row's hash is parsed.
    """
    asked = probes.select("content").where("content is not null").distinct()
    forms = asked.select("content", F.explode(F.array(F.concat(F.lit("sha256:"), F.col("content")), F.concat(F.lit("sha256:"), base32("content")))).alias("hash"))
    return rows.select("path", "hash").join(forms.where("hash is not null"), "hash").groupBy("content").agg(F.min("path").alias("path"))


def by_path(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """The rows of probed paths (path), each once."""
    return rows.join(probes.select("path").distinct(), "path", "left_semi")


def prefix_scan(rows: DataFrame, key: str, prefix: str, most: int) -> DataFrame:
    """The first `most` rows by key whose key starts with the prefix: a range that statistics prune, and no more is kept of it than asked."""
    return rows.where(F.col(key).startswith(prefix)).orderBy(key).limit(most)


def claims(facts: DataFrame) -> DataFrame:
    """path, content, sigs: what a differ reads of a fact, and nothing else."""
    return facts.select("path", "content", "sigs")


def possession(held: DataFrame, origin: int | str) -> DataFrame:
    """content: all that one origin holds."""
    return held.where(F.col("origin") == origin).select("content").distinct()


def changed(now: DataFrame, seen: DataFrame) -> DataFrame:
    """source, version: the sources whose version (source, version) is not the one seen after the last pass that succeeded."""
    return now.join(seen.select("source", F.col("version").alias("seen")), "source", "left").where(~F.col("version").eqNullSafe(F.col("seen"))).select("source", "version")


def named(rows: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """rows with `index`, the place of their name among the configured ones in order; null for others."""
    from pyspark.sql.window import Window as W

    place = (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(by)) - 1).cast("long")  # the configured names
    return rows.join(names.select(by).where(F.col(by).isNotNull()).distinct().withColumn("index", place), by, "left")


def described(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """path, size, refs, problem: rows (id, path, size) with the sorted paths that they name (referrer, reference); a missing size is an error here."""
    names = rows.select(F.col("id").alias("reference"), F.col("path").alias("ref"))
    refs = edges.distinct().join(names, "reference").groupBy(F.col("referrer").alias("id")).agg(F.array_sort(F.collect_set("ref")).alias("refs"))  # a path's references
    out = rows.join(refs, "id", "left")
    return out.select("path", "size", F.array_join(F.coalesce("refs", F.array().cast("array<string>")), ",").alias("refs"), F.when(F.col("size").isNull(), "no size").alias("problem"))


def most_available(rows: DataFrame, live: DataFrame) -> DataFrame:
    """path, content, sources: of each path's rows (path, content, origin) the content with most live origins, ties to the smallest content."""
    usable = rows.join(live.select("origin").distinct(), "origin", "left_semi")
    n = rows.select("path", "content").distinct().join(usable.groupBy("path", "content").agg(F.count_distinct("origin").alias("n")), ["path", "content"], "left")
    best = n.groupBy("path").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("less"), "content")).alias("b"))
    return best.select("path", "b.content", (-F.col("b.less")).cast("long").alias("sources"))
