"""What replicas tell each other: clock vectors, acknowledgements, requests, catch-up, repair, fact dumps, generations.

Nulls: a row without origin or peer takes no part; a missing clock or acknowledgement counts zero. Ties go to the
smaller name, and repeated rows count once where a set is meant. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from quarry.operators import catalog

FAR = 50_000  # events that a peer keeps at least; who is further behind starts over
STRIKES = 3
COARSE, WHOLESALE, TARGETS = 32, 32, 64  # upper nodes looked into a round, leaves from which a bucket is taken whole, subtrees a round


def clock_vector(origins: DataFrame, clocks: DataFrame) -> DataFrame:
    """origin, generation, seq of every origin (origin), zero where nothing was heard of it."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return origins.select("origin").where("origin is not null").distinct().join(clocks.select("origin", "generation", "seq"), "origin", "left").select("origin", zero("generation"), zero("seq"))


def gate(size: Column, decodable: Column, requester: Column, known: list[str], own: str, most: int) -> Column:
    """What becomes of a request: too large, malformed, from nobody known, from ourselves, or accepted."""
    return (
        F.when(F.coalesce(size, F.lit(0)) > most, "too_large").when(~F.coalesce(decodable, F.lit(False)), "malformed").when(F.coalesce(requester == own, F.lit(False)), "self")
        .when(~F.coalesce(requester.isin(known), F.lit(False)), "unknown").otherwise("accepted")
    )


def recorded_acks(claims: DataFrame, clocks: DataFrame) -> DataFrame:
    """peer, origin, seq: the acknowledgements that requests (peer, origin, generation, seq) carry, for known origins of the same generation."""
    same = claims.where("peer is not null").join(clocks.select("origin", "generation").distinct(), ["origin", "generation"], "left_semi")
    return same.groupBy("peer", "origin").agg(F.max("seq").alias("seq"))


def reminted(ours: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """origin, generation, seq, tail_seq, reminted: own origins of which a peer reports a future get a new generation, above
    all reported ones and not before `now`; the sequence goes on, and dumps start again.
    """
    future = reports.select("origin", F.struct("generation", "seq").alias("r")).join(ours.select("origin", F.struct("generation", "seq").alias("o")), "origin").where("r > o")
    floor = future.groupBy("origin").agg(F.max("r.generation").alias("floor"))
    got = ours.join(floor, "origin", "left")
    return got.select("origin", F.when(F.col("floor").isNull(), F.col("generation")).otherwise(F.greatest(F.lit(now).cast("long"), F.col("floor") + 1)).alias("generation"), "seq", "tail_seq", F.col("floor").isNotNull().alias("reminted"))


def opened(clocks: DataFrame, known: DataFrame, own: DataFrame, now: int) -> DataFrame:
    """origin, generation, seq, tail_seq after a start: origins that are no longer known go, and an own one (origin) that never
    had a generation is given one.
    """
    kept = catalog.retained(clocks, known.select("origin").unionByName(own.select("origin")), "origin").select("origin", "generation", "seq", "tail_seq")
    fresh = own.select("origin").distinct().join(kept, "origin", "left_anti")
    zero = F.lit(0).cast("long")
    return kept.unionByName(fresh.select("origin", F.lit(now).cast("long").alias("generation"), zero.alias("seq"), zero.alias("tail_seq")))


def matched(asks: DataFrame, replies: DataFrame) -> DataFrame:
    """origin, after, until, matched, covered: each ask with the furthest reply to it, by origin and start alone."""
    best = replies.groupBy("origin", "after").agg(F.max("covered").alias("covered"))
    return asks.select("origin", "after", "until").join(best, ["origin", "after"], "left").withColumn("matched", F.col("covered").isNotNull()).select("origin", "after", "until", "matched", "covered")


def caught_up(backlog: DataFrame, replies: DataFrame, strikes: int = STRIKES, far: int = FAR) -> DataFrame:
    """origin, status, cursor, retries, missing of a round of catch-up.

    backlog(origin, cursor, target); replies(origin, after, until, covered), in order of `after`, covered being null for
    a failure. What is contiguous from the cursor is applied; what an ask lacks is asked again first. An origin whose
    target is further than `far` beyond its cursor is cancelled, one with `strikes` failures in a row is handed back.
    """
    r = replies.join(backlog, "origin").withColumn("covered_", F.coalesce("covered", "after"))
    order = W.partitionBy("origin").orderBy("after")
    r = r.withColumns({
        "broken": F.coalesce(F.max((F.col("covered_") < F.col("until")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "good": F.sum(F.col("covered").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)),
    })
    runs = r.where("covered is null").groupBy("origin", "good").agg(F.count("*").alias("run")).groupBy("origin").agg(F.max("run").alias("run"))
    done = r.groupBy("origin").agg(
        F.max(F.when(F.col("broken") == 0, F.col("covered_"))).alias("head"), F.sum((F.col("covered_") < F.col("until")).cast("long")).alias("retries"), F.sum(F.col("until") - F.col("covered_")).alias("missing")
    )
    out = backlog.join(done, "origin", "left").join(runs, "origin", "left")
    cursor = F.greatest("cursor", F.coalesce("head", "cursor"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    status = F.when(F.col("target") > F.col("cursor") + far, "cancelled").when(F.coalesce("run", F.lit(0)) >= strikes, "handed_back").when(cursor >= F.col("target"), "finished").otherwise("running")
    return out.select("origin", status.alias("status"), F.when(status == "cancelled", F.col("cursor")).otherwise(cursor).alias("cursor"), zero("retries"), zero("missing"))


def dump_page(facts: DataFrame, keys: list[str], cursor: tuple | None, most: int, least: int) -> DataFrame:
    """The next page of a dump in order of its keys: rows (keys, bytes) after the cursor while their bytes stay within `most`,
    but never none; `resume` marks the row whose keys are the next cursor, if rows are left.

    No fact is shorter than `least` bytes, so a page is among the first most / least + 2 rows, and only these are sorted out.
    """
    few = catalog.keyset_page(facts, keys, cursor, most // least + 2) if cursor else facts.orderBy(*keys).limit(most // least + 2)
    w = W.partitionBy(F.lit(1)).orderBy(*keys)
    rows = few.withColumns({"sofar_": F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)), "turn_": F.row_number().over(w), "all_": F.count("*").over(W.partitionBy(F.lit(1)))})
    rows = rows.where((F.col("sofar_") <= most) | (F.col("turn_") == 1))
    last = F.max("turn_").over(W.partitionBy(F.lit(1)))
    return rows.withColumn("resume", (F.col("turn_") == last) & (F.col("all_") > last)).drop("sofar_", "turn_", "all_")


def _split(leaves: DataFrame) -> DataFrame:
    return leaves.select(F.shiftright("node", 8).alias("upper"), "node", "hi", "lo")


def repair_targets(ours: DataFrame, theirs: DataFrame, coarse: int = COARSE, wholesale: int = WHOLESALE, most: int = TARGETS) -> DataFrame:
    """turn, kind, node: what a round of repair fetches, from the leaves (node, hi, lo) of both trees.

    Equal trees: nothing. An empty own tree: the root, all at once. Else of the differing upper nodes the first `coarse`:
    those that we have nothing under as whole buckets, then node by node the others, as a bucket if `wholesale` of its
    leaves differ, else leaf by leaf; of all these the first `most`. The rest is the next round's.
    """
    both = catalog.tree_diff(catalog.fact_coarse(ours), catalog.fact_coarse(theirs))
    first = both.orderBy("node").limit(coarse).withColumnRenamed("node", "upper")
    held = _split(ours).select("upper").distinct().withColumn("held", F.lit(True))
    first = first.join(held, "upper", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    own, other = (_split(t).join(first.where("held").select("upper"), "upper", "left_semi").drop("upper") for t in (ours, theirs))
    leaves = catalog.tree_diff(own, other).withColumn("upper", F.shiftright("node", 8))
    counted = leaves.withColumn("n", F.count("*").over(W.partitionBy("upper")))
    buckets = first.where("not held").select(F.lit(0).alias("rank"), F.lit("bucket").alias("kind"), "upper", F.col("upper").alias("node"))
    whole = counted.where(F.col("n") >= wholesale).select(F.lit(1).alias("rank"), F.lit("bucket").alias("kind"), "upper", F.col("upper").alias("node")).distinct()
    single = counted.where(F.col("n") < wholesale).select(F.lit(1).alias("rank"), F.lit("leaf").alias("kind"), "upper", "node")
    some = buckets.unionByName(whole).unionByName(single).orderBy("rank", "upper", "node").limit(most)
    turn = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("rank", "upper", "node"))  # at most `most` rows
    some = some.select(turn.cast("long").alias("turn"), "kind", F.col("node").cast("long").alias("node"))
    empty = ours.agg((F.count("*") == 0).alias("empty"))
    root = both.limit(1).select(F.lit(1).cast("long").alias("turn"), F.lit("root").alias("kind"), F.lit(None).cast("long").alias("node")).join(F.broadcast(empty)).where("empty").drop("empty")  # one row each
    return some.join(F.broadcast(empty)).where("not empty").drop("empty").unionByName(root)


def node_children(leaves: DataFrame, prefixes: list[int]) -> DataFrame:
    """prefix, child, hi, lo: the 256 leaves below each of some upper nodes, zero where there are no facts."""
    spark = leaves.sparkSession
    every = spark.createDataFrame([(p,) for p in sorted(set(prefixes))], "prefix long").withColumn("child", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))))
    found = leaves.where(F.shiftright("node", 8).isin(prefixes)).select(F.shiftright("node", 8).cast("long").alias("prefix"), (F.col("node") % 256).cast("long").alias("child"), "hi", "lo")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.join(found, ["prefix", "child"], "left").select("prefix", "child", zero("hi"), zero("lo"))


def sweep(peers: DataFrame, turns: int) -> DataFrame:
    """turn, position, peer: in which order each turn of a sweep asks the peers: by name, starting one further each turn."""
    w = W.partitionBy(F.lit(1))  # the configured peers
    ranked = peers.select("peer").where("peer is not null").distinct().withColumns({"rank": F.row_number().over(w.orderBy("peer")) - 1, "n": F.count("*").over(w)})
    rows = ranked.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
    return rows.select("turn", F.pmod(F.col("rank") - F.col("turn"), F.col("n")).cast("long").alias("position"), "peer")


def pull_delay(known: Column, age: Column, calm: int = 60, eager: int = 5, young: int = 180) -> Column:
    """Seconds to the next pull: few while an origin is unknown and the process is young."""
    return F.when(~F.coalesce(known, F.lit(False)) & (age < young), eager).otherwise(calm).cast("long")


def hinted(edges: DataFrame, start: DataFrame, keep) -> DataFrame:
    """node, round: when a change that starts at some nodes has been hinted to each, over edges (src, dst), until nothing changes.

    keep cuts the lineage of each round's table; there are as many rounds as the longest way has edges.
    """
    seen = keep(start.select("node").distinct().withColumn("round", F.lit(0).cast("long")))
    new, turn = seen, 0
    while not new.isEmpty():
        turn += 1
        reached = edges.join(new.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = keep(reached.join(seen, "node", "left_anti").withColumn("round", F.lit(turn).cast("long")))
        seen = keep(seen.unionByName(new))
    return seen


def responses(requests: DataFrame, clocks: DataFrame, journal: DataFrame, held: DataFrame, budget: int, cap: int, row: int = 34) -> DataFrame:
    """origin, decision, rows, truncated: how a request's clocks (origin, generation, seq) are answered.

    clocks(origin, generation, seq, tail_seq); journal(origin, seq, bytes); held(origin, content). Suffixes are cut at
    `cap` bytes; a snapshot costs `row` bytes a content. Once `budget` bytes are answered, in order of name, the other
    origins get an empty truncated suffix.
    """
    from quarry.operators.journal import budgeted, decision

    d = decision(clocks, requests)
    since = requests.groupBy("origin").agg(F.max("seq").alias("since"))
    suffix = journal.join(d.where("decision = 'suffix'").select("origin"), "origin", "left_semi").join(since, "origin", "left").where(F.col("seq") > F.coalesce("since", F.lit(0)))
    sent = catalog.byte_prefix(suffix.select("origin", "seq", "bytes"), ["origin"], ["seq"], cap)
    sent = sent.groupBy("origin").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("truncated").alias("truncated"))
    contents = held.join(d.where("decision = 'snapshot'").select("origin"), "origin", "left_semi").groupBy("origin").agg(F.count("*").alias("held"))
    all_ = d.join(sent, "origin", "left").join(contents, "origin", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    cost = F.when(F.col("decision") == "suffix", zero("bytes")).when(F.col("decision") == "snapshot", zero("held") * row).otherwise(0)
    out = budgeted(all_.withColumn("cost", cost), "cost", budget)
    rows = F.when(F.col("decision") == "suffix", zero("n")).when(F.col("decision") == "snapshot", zero("held")).otherwise(0).cast("long")
    cut = (F.col("decision") == "deferred") | ((F.col("decision") == "suffix") & F.coalesce("truncated", F.lit(False)))
    return out.select("origin", "decision", rows.alias("rows"), cut.alias("truncated"))
