"""Per-origin journals: folds, gaps, replies, and what replication decides from clocks and acknowledgements.

Nulls: an event without origin or sequence takes no part, a missing clock or acknowledgement counts 0. Of events that
repeat a sequence one is as good as the other. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

BACKSTOP = 50_000  # events a slow peer may hold back at most


def fold(journal: DataFrame) -> DataFrame:
    """origin, content, seq: possession, each content's last have or drop deciding."""
    last = journal.where("op in ('have', 'drop')").groupBy("origin", "content").agg(F.max(F.struct("seq", "op")).alias("e"))
    return last.where("e.op = 'have'").select("origin", "content", "e.seq")


def gaps(journal: DataFrame) -> DataFrame:
    """origin, events, gaps, first_gap, applies: a suffix with any gap is refused as a whole."""
    before = F.lag("seq").over(W.partitionBy("origin").orderBy("seq"))
    rows = journal.withColumn("broken", F.col("seq") != F.coalesce(before, F.col("seq") - 1) + 1)
    return rows.groupBy("origin").agg(
        F.count("*").alias("events"), F.sum(F.col("broken").cast("long")).alias("gaps"), F.min(F.when(F.col("broken"), F.col("seq"))).alias("first_gap"), (~F.max("broken")).alias("applies")
    )


def decision(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """origin, decision: ours(origin, generation, seq, tail_seq), theirs(origin, generation, seq); missing counts 0."""
    t = theirs.select("origin", F.col("generation").alias("g"), F.col("seq").alias("s"))
    j = ours.join(t, "origin", "left").withColumns({"g": F.coalesce("g", F.lit(0)), "s": F.coalesce("s", F.lit(0))}).where("generation > 0 and g <= generation")
    same = F.col("g") == F.col("generation")
    return j.select("origin", F.when(same & (F.col("s") >= F.col("seq")), "up_to_date").when(same & (F.col("s") >= F.col("tail_seq")), "suffix").otherwise("snapshot").alias("decision"))


def budgeted(decisions: DataFrame, cost: str, budget: int) -> DataFrame:
    """Origins in order of name; once the bytes answered reach the budget, the rest are deferred (decision kept otherwise).

    One row an origin, the running sum over origins being the protocol's.
    """
    before = F.coalesce(F.sum(cost).over(W.partitionBy(F.lit(1)).orderBy("origin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return decisions.withColumn("decision", F.when((F.col("decision") != "up_to_date") & (before >= budget), "deferred").otherwise(F.col("decision")))


def range_asks(backlog: DataFrame, chunk: int, window: int) -> DataFrame:
    """origin, after, until, round: the backlog (origin, cursor, target) in chunks, `window` of them in flight at once."""
    steps = F.sequence(F.col("cursor"), F.col("target") - 1, F.lit(chunk).cast("long"))
    rows = backlog.where("target > cursor").select("origin", "target", F.posexplode(steps).alias("k", "after"))
    return rows.select("origin", "after", F.least(F.col("after") + chunk, "target").alias("until"), F.floor(F.col("k") / window).cast("int").alias("round"))


def range_replies(asks: DataFrame, clocks: DataFrame, journal: DataFrame, most: int) -> DataFrame:
    """origin, after, until, reachable, events, bytes: what (after, until] of the journal answers within `most` bytes.

    asks(origin, generation, after, until); clocks(origin, generation, tail_seq).
    """
    c = clocks.select("origin", F.col("generation").alias("g"), "tail_seq")
    a = asks.join(c, "origin", "left")
    a = a.withColumn("reachable", F.coalesce((F.col("generation") == F.col("g")) & (F.col("after") >= F.col("tail_seq")) & (F.col("after") < F.col("until")), F.lit(False)))
    j = journal.select("origin", "seq", "bytes")
    rows = a.where("reachable").join(j, "origin").where("seq > after and seq <= until")
    w = W.partitionBy("origin", "after", "until").orderBy("seq")
    rows = rows.withColumns({"sofar": F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)), "k": F.row_number().over(w)}).where((F.col("sofar") <= most) | (F.col("k") == 1))
    got = rows.groupBy("origin", "after", "until").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return a.select("origin", "after", "until", "reachable").join(got, ["origin", "after", "until"], "left").select("origin", "after", "until", "reachable", zero("events"), zero("bytes"))


def compaction_floor(clocks: DataFrame, acks: DataFrame, peers: DataFrame, backstop: int = BACKSTOP) -> DataFrame:
    """origin, floor: the least acknowledgement of all peers (0 without one), within the clock and the backstop; where it rises.

    clocks(origin, seq, tail_seq); acks(peer, origin, seq); peers(peer), a configured few.
    """
    n = peers.select("peer").distinct()
    best = acks.join(n, "peer", "left_semi").groupBy("origin", "peer").agg(F.max("seq").alias("seq")).groupBy("origin").agg(F.min("seq").alias("low"), F.count("*").alias("heard"))
    all_ = n.agg(F.count("*").alias("n"))
    rows = clocks.join(best, "origin", "left").join(F.broadcast(all_))  # one row
    low = F.when(F.col("heard") == F.col("n"), F.col("low")).otherwise(F.lit(0))
    return rows.select("origin", F.greatest(F.least("seq", low), F.col("seq") - backstop).alias("floor"), "tail_seq").where("floor > tail_seq").select("origin", "floor")


def compacted(journal: DataFrame, floors: DataFrame) -> DataFrame:
    """The journal above each origin's floor."""
    return journal.join(floors, "origin", "left").where(F.col("seq") > F.coalesce("floor", F.lit(0))).drop("floor")


def applied(journal: DataFrame, clocks: DataFrame, suffix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origin, outcome, applied) and the journal rows taken, for a batch of suffixes.

    clocks(origin, generation, seq), missing meaning never seen; suffix(origin, generation, seq, op, content).
    A lower generation is ignored, a higher one on a known clock or any gap needs a snapshot, replays are skipped.
    """
    c = clocks.select("origin", F.col("generation").alias("g"), F.col("seq").alias("s"))
    rows = suffix.join(c, "origin", "left").withColumns({"g": F.coalesce("g", F.lit(0)), "s": F.coalesce("s", F.lit(0))})
    fresh = rows.where("seq > s").withColumn("before", F.coalesce(F.lag("seq").over(W.partitionBy("origin").orderBy("seq")), F.col("s")))
    state = rows.groupBy("origin").agg(F.max("generation").alias("generation"), F.max("g").alias("g"))
    held = fresh.groupBy("origin").agg(F.max(F.col("seq") != F.col("before") + 1).alias("gap"), F.count("*").alias("n"))
    out = state.join(held, "origin", "left")
    outcome = (
        F.when(F.col("generation") < F.col("g"), "ignored").when((F.col("g") > 0) & (F.col("generation") > F.col("g")), "needs_snapshot")
        .when(F.coalesce("gap", F.lit(False)), "needs_snapshot").when(F.coalesce("n", F.lit(0)) == 0, "replayed").otherwise("applied")
    )
    out = out.withColumn("outcome", outcome)
    done = out.select("origin", "outcome", F.when(F.col("outcome") == "applied", F.col("n")).otherwise(0).alias("applied"))
    return done, fresh.join(done.where("outcome = 'applied'"), "origin", "left_semi").select(*suffix.columns)


def exported(facts: DataFrame, holds: DataFrame, last: int, chunk: int) -> DataFrame:
    """seq, batch, op, content: facts before holds, numbered on from `last` and cut into batches.

    Rows are counted by the first three characters of their content; the few counts give each prefix its first
    number, and rows are numbered within a prefix, so no sort spans all rows.
    """
    ops = facts.select(F.lit(0).alias("turn"), F.lit("attest").alias("op"), "content").unionByName(holds.select(F.lit(1).alias("turn"), "op", "content"))
    ops = ops.withColumn("prefix", F.substring("content", 1, 3))
    base = ops.groupBy("turn", "prefix").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("turn", "prefix").rowsBetween(W.unboundedPreceding, -1))
    base = base.select("turn", "prefix", F.coalesce(before, F.lit(0)).alias("base"))
    k = F.row_number().over(W.partitionBy("turn", "prefix").orderBy("content", "op"))
    seq = F.col("base") + F.col("k") + last
    return ops.withColumn("k", k).join(base, ["turn", "prefix"]).select(seq.alias("seq"), F.floor((seq - last - 1) / chunk).cast("int").alias("batch"), "op", "content")


def full_diff(local: DataFrame, held: DataFrame) -> DataFrame:
    """content, op: have what is local and not held, drop what is held and not local."""
    a, b = local.select("content").distinct(), held.select("content").distinct()
    return a.join(b, "content", "left_anti").withColumn("op", F.lit("have")).unionByName(b.join(a, "content", "left_anti").withColumn("op", F.lit("drop")))


def unexported(candidates: DataFrame, claims: DataFrame, key: list[str]) -> DataFrame:
    """Candidates without a claim of the same key whose signatures include theirs (arrays `sigs`)."""
    known = candidates.alias("c").join(claims.alias("k"), key).where(F.size(F.array_except("c.sigs", "k.sigs")) == 0).select(*key).distinct()
    return candidates.join(known, key, "left_anti")


def additions(source: DataFrame, since: int, id_: str, good: str) -> DataFrame:
    """Rows beyond the mark that are well formed, each with the table's own greatest id (0 if empty)."""
    top = source.agg(F.coalesce(F.max(id_), F.lit(0).cast("long")).alias("table_max"))
    return source.where(F.col(id_) > since).where(good).join(F.broadcast(top))  # one row


def retractions(misses: DataFrame, held: DataFrame) -> DataFrame:
    """content, op: a drop for each missed content that is still held."""
    return held.select("content").distinct().join(misses.select("content").distinct(), "content", "left_semi").withColumn("op", F.lit("drop"))
