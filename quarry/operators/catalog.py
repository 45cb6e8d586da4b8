"""Who holds which content, what is believed about it, and which copies can be used.

Nulls: an origin, content or path that is null takes no part in joins; facts that lack a field are not well formed.
Ties go to the smallest value named; repeated rows count once where a set is meant; empty tables give no rows (a root
gives zero).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def resolve(holdings: DataFrame, origins: DataFrame) -> DataFrame:
    """content, tier, holders, first: the live holders of the lowest tier that has any; without one, no row.

    holdings(origin, content), in which pairs may repeat: only those of live origins are made distinct. origins(origin,
    tier, live); a null origin or content takes no part, ties go to the smallest origin.
    """
    live = holdings.where("content is not null").join(origins.where("live").select("origin", "tier").distinct(), "origin").select("content", "tier", "origin").distinct()
    by_tier = live.groupBy("content", "tier").agg(F.count("*").alias("holders"), F.min("origin").alias("first"))
    return by_tier.groupBy("content").agg(F.min(F.struct("tier", "holders", "first")).alias("best")).select("content", "best.*")


def holders(holdings: DataFrame) -> DataFrame:
    """content, holders: sorted origins, joined; bounded by the number of origins."""
    return holdings.groupBy("content").agg(F.array_join(F.transform(F.array_sort(F.collect_set("origin")), lambda x: x.cast("string")), ",").alias("holders"))


def widest(rows: DataFrame) -> DataFrame:
    """path, content, holders: of each path the content with most rows, ties to the smallest content."""
    n = rows.groupBy("path", "content").agg(F.count("*").alias("holders"))
    best = n.groupBy("path").agg(F.min(F.struct((-F.col("holders")).alias("least"), "content")).alias("b"))
    return best.select("path", "b.content", (-F.col("b.least")).alias("holders"))


def well_formed(content: Column, path: Column, part: Column, ca: Column, signed: Column) -> Column:
    return (F.length(content) == 64) & path.startswith("/") & (F.length(part) == 32) & ((ca != "") | signed)


def feasible(facts: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """facts that are well formed and either content-addressed or verified (by key)."""
    seen = verified.select(key).distinct().withColumn("verified_", F.lit(True))
    rows = facts.join(seen, key, "left").withColumn("verified_", F.coalesce("verified_", F.lit(False)))
    form = well_formed(F.col("content"), F.col("path"), F.col("hash_part"), F.col("ca"), F.col("verified_"))
    return rows.where(form & ((F.col("ca") != "") | F.col("verified_"))).drop("verified_")


def aliases(rows: DataFrame) -> DataFrame:
    """content, paths, sources: rows with the content, and their sources in first-seen order.

    rows(content, seen, source); bounded by the number of sources.
    """
    first = rows.groupBy("content", "source").agg(F.min("seen").alias("seen"), F.count("*").alias("n"))
    return first.groupBy("content").agg(
        F.sum("n").alias("paths"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "source"))), lambda x: x["source"]), ",").alias("sources")
    )


def merge_body(rows: DataFrame, key: list[str], body: list[str]) -> DataFrame:
    """The greatest body of each identity: associative, commutative and idempotent."""
    return rows.groupBy(*key).agg(F.max(F.struct(*body)).alias("b")).select(*key, "b.*")


def merge_signatures(rows: DataFrame, key: str, signature: Column) -> DataFrame:
    """key, sigs: the union of signatures, sorted and joined; each is shuffled once."""
    return rows.select(key, signature.alias("sig")).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("sig")), ",").alias("sigs"))


def merge_changes(old: DataFrame, new: DataFrame, key: list[str], body: list[str]) -> DataFrame:
    """The identities that a merge of new into old adds or changes, each once, with their body after it."""
    after = merge_body(old.select(*key, *body).unionByName(new.select(*key, *body)), key, body)
    before = merge_body(old, key, body)
    return after.join(before, [*key, *body], "left_anti")


def replaced(holdings: DataFrame, clocks: DataFrame, snapshots: DataFrame, held: DataFrame) -> DataFrame:
    """Possession after snapshots: a snapshot below its origin's clock is refused, else it replaces the set.

    clocks, snapshots (origin, generation, seq); held(origin, content) of the snapshots.
    """
    c = clocks.select("origin", F.struct("generation", "seq").alias("now"))
    taken = snapshots.join(c, "origin", "left").where(F.col("now").isNull() | (F.struct("generation", "seq") >= F.col("now"))).select("origin")
    return holdings.join(taken, "origin", "left_anti").select("origin", "content").unionByName(held.join(taken, "origin", "left_semi").select("origin", "content").distinct())


def advance(marks: DataFrame) -> DataFrame:
    """peer, origin, seq: acknowledgements only rise."""
    return marks.groupBy("peer", "origin").agg(F.max("seq").alias("seq"))


def retained(rows: DataFrame, keep: DataFrame, *columns: str) -> DataFrame:
    """rows whose every given column is among the kept origins; others go as a whole."""
    for c in columns:
        rows = rows.join(keep.select(F.col("origin").alias(c)).distinct(), c, "left_semi")
    return rows


def keyset_page(rows: DataFrame, keys: list[str], after: tuple, n: int) -> DataFrame:
    """The n rows next after the key."""
    past, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, after, strict=True):
        past = past | (same & (F.col(k) > F.lit(v)))
        same = same & (F.col(k) == F.lit(v))
    return rows.where(past).orderBy(*keys).limit(n)


def references(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """referrer, refs: the sorted paths that each referrer names, one hop."""
    named = edges.distinct().join(paths, "reference").select("referrer", "path").distinct()
    return named.groupBy("referrer").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("refs"))


def fact_root(facts: DataFrame) -> DataFrame:
    """hi, lo: exclusive or of all hashes; zero for none."""
    return facts.agg(F.coalesce(F.bit_xor("hi"), F.lit(0).cast("long")).alias("hi"), F.coalesce(F.bit_xor("lo"), F.lit(0).cast("long")).alias("lo"))


def fact_leaves(facts: DataFrame) -> DataFrame:
    """node, hi, lo of the 65,536 leaves that have facts."""
    return facts.groupBy(F.col("leaf").alias("node")).agg(F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"))


def fact_coarse(leaves: DataFrame) -> DataFrame:
    """node, hi, lo of the 256 upper nodes, from the leaves."""
    return leaves.groupBy(F.shiftright("node", 8).alias("node")).agg(F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"))


def maintained(tree: DataFrame, out: DataFrame, into: DataFrame) -> DataFrame:
    """The leaves after facts went out and came in; a node that comes to zero is absent."""
    rows = tree.unionByName(fact_leaves(out)).unionByName(fact_leaves(into))
    return rows.groupBy("node").agg(F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo")).where("hi <> 0 or lo <> 0")


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """node: where two trees differ, an absent node counting as zero."""
    x, y = a.select("node", F.col("hi").alias("h1"), F.col("lo").alias("l1")), b.select("node", F.col("hi").alias("h2"), F.col("lo").alias("l2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.join(y, "node", "full_outer").where((zero("h1") != zero("h2")) | (zero("l1") != zero("l2"))).select("node")


def missing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Their facts that we lack: differing upper nodes, in these differing leaves, of these the facts."""
    a, b = fact_leaves(ours), fact_leaves(theirs)
    upper = tree_diff(fact_coarse(a), fact_coarse(b)).withColumnRenamed("node", "upper")
    within = lambda t: t.withColumn("upper", F.shiftright("node", 8)).join(upper, "upper", "left_semi").drop("upper")
    leaves = tree_diff(within(a), within(b)).withColumnRenamed("node", "leaf")
    return theirs.join(leaves, "leaf", "left_semi").join(ours.select("leaf", "hi", "lo"), ["leaf", "hi", "lo"], "left_anti")


def byte_prefix(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Of each group the first rows while their bytes stay within `most`, but never none; and whether rows are left."""
    w = W.partitionBy(*by).orderBy(*order)
    sofar = F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0))
    all_ = F.count("*").over(W.partitionBy(*by))
    rows = rows.withColumns({"sofar_": sofar, "k_": F.row_number().over(w), "all_": all_}).where((F.col("sofar_") <= most) | (F.col("k_") == 1))
    return rows.withColumn("truncated", F.col("all_") > F.count("*").over(W.partitionBy(*by))).drop("sofar_", "k_", "all_")


def exports(facts: DataFrame) -> DataFrame:
    """facts with `op`: a have for each, and an attest for those that can be believed, being content-addressed or signed."""
    believable = F.coalesce((F.col("ca") != "") | F.col("signed"), F.lit(False))
    ops = F.when(believable, F.array(F.lit("attest"), F.lit("have"))).otherwise(F.array(F.lit("have")))
    return facts.withColumn("op", F.explode(ops))


def tree_check(leaves: DataFrame, facts: DataFrame) -> DataFrame:
    """leaves, coarse_ok, rows_ok: whether the root of a tree's leaves is that of its upper nodes, and that of the facts themselves."""
    named = lambda df, name: df.select(F.struct("hi", "lo").alias(name))
    roots = named(fact_root(leaves), "a").join(F.broadcast(named(fact_root(fact_coarse(leaves)), "b"))).join(F.broadcast(named(fact_root(facts), "c")))  # one row each
    n = leaves.agg(F.count("*").alias("leaves"))
    return roots.join(F.broadcast(n)).select("leaves", (F.col("a") == F.col("b")).alias("coarse_ok"), (F.col("a") == F.col("c")).alias("rows_ok"))


def adjacent(rows: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """rows with `again`: whether the name is that of the row before it in byte order, within `by`."""
    before = F.lag(name).over(W.partitionBy(*by).orderBy(name, *order))
    return rows.withColumn("again", F.coalesce(before == F.col(name), F.lit(False)))
