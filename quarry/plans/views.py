"""The logical tables that the operators work on, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.codecs import fact_hash, half, leaf_of

SEGMENT = 64  # characters of a content segment


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, tier, live: suppliers, their nation's region, and whether their balance is not negative."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("origin"), F.col("n_regionkey").alias("tier"), (F.col("s_acctbal") >= 0).alias("live"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, content: each pair of supplier and part once."""
    return lines_held(spark, sf_dir).distinct()


def lines_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, content of every line: the pairs of holdings, as often as they occur."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("origin"), F.col("l_partkey").alias("content"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, hash_part, content, path, size, ca of documents."""
    d = table(spark, sf_dir, "documents")
    part = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32)
    return d.select(
        "doc_id", part.alias("hash_part"), F.sha2("text", 256).alias("content"), F.concat(F.lit("/store/"), part, F.lit("-"), F.col("source")).alias("path"),
        F.col("n_chars").alias("size"), F.when(F.col("lang") == "en", F.concat(F.lit("fixed:"), F.col("lang"))).otherwise("").alias("ca"),
    )


def hashed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts with leaf, hi and lo of their hash."""
    f = facts(spark, sf_dir).withColumn("hash", fact_hash("hash_part", "content", "path", "size", "ca"))
    return f.withColumns({"leaf": leaf_of("hash"), "hi": half("hash", 0), "lo": half("hash", 1)}).drop("hash")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, seq, op, content, bytes of events; a user's events are numbered in order of event_id."""
    from pyspark.sql.window import Window as W

    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("view", "click"), "have").when(F.col("event_type") == "error", "drop").otherwise("attest")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select(F.col("user_id").alias("origin"), seq.alias("seq"), op.alias("op"), F.get_json_object("props", "$.k").cast("long").alias("content"), F.length("props").cast("long").alias("bytes"))


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peer, origin, seq: orders of a customer by priority, counted."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("peer"), F.col("o_custkey").alias("origin")).agg(F.count("*").alias("seq"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, ord, off, len, hash: documents cut into segments of SEGMENT characters."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tree"), F.posexplode(F.expr(f"regexp_extract_all(text, '(?s).{{1,{SEGMENT}}}', 0)")).alias("ord", "part"))
    return d.select("tree", "ord", (F.col("ord") * SEGMENT).cast("long").alias("off"), F.length("part").cast("long").alias("len"), F.sha2("part", 256).alias("hash"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peer, t (microseconds), id, value, ok of events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("peer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), "value", (F.col("event_type") != "error").alias("ok"), F.col("user_id").alias("set"))
