"""Replication operators bound to the driver's tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import catalog, journal, replication as R
from quarry.plans import views as V
from quarry.queries.registry import clocks, query, their_clocks
from quarry.session import reliable


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("origin"))


@query("""
select c_custkey as origin, coalesce(generation, 0) as generation, coalesce(seq, 0) as seq from customer left join v_clocks on origin = c_custkey""")
def clock_vector(spark: SparkSession, sf: str) -> DataFrame:
    return R.clock_vector(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("origin")), clocks(spark, sf))


@query("select peer, origin, seq from v_acks where origin in (select s_suppkey from supplier)")
def known_origin_acks(spark: SparkSession, sf: str) -> DataFrame:
    """Acknowledgements of known origins only."""
    return catalog.retained(V.acks(spark, sf), _suppliers(spark, sf), "origin").select("peer", "origin", "seq")


@query("""
select peer, origin, seq from v_acks where origin in (select s_suppkey from supplier) and peer in ('1-URGENT', '2-HIGH')""")
def watermarks_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Acknowledgements whose peer and origin both stay configured."""
    peers = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "origin string")
    return catalog.retained(catalog.retained(V.acks(spark, sf), _suppliers(spark, sf), "origin"), peers, "peer").select("peer", "origin", "seq")


@query("""
select 'p' || (t.origin % 3) as peer, t.origin, max(t.seq) as seq from v_theirs t join v_clocks c on c.origin = t.origin and c.generation = t.generation group by 1, 2""")
def recorded_acks(spark: SparkSession, sf: str) -> DataFrame:
    claims = their_clocks(spark, sf).withColumn("peer", F.concat(F.lit("p"), (F.col("origin") % 3).cast("string")))
    return R.recorded_acks(claims, clocks(spark, sf))


@query("""
, f as (select c.origin, max(t.generation) as floor from v_theirs t join v_clocks c using (origin) where t.generation > c.generation or (t.generation = c.generation and t.seq > c.seq) group by 1)
select c.origin, case when floor is null then c.generation else greatest(6, floor + 1) end as generation, c.seq, c.tail_seq, floor is not null as reminted from v_clocks c left join f using (origin)""")
def generation_remint(spark: SparkSession, sf: str) -> DataFrame:
    return R.reminted(clocks(spark, sf), their_clocks(spark, sf), now=6)


@query("""
, o as (select s_suppkey + 100 as origin from supplier where s_suppkey % 10 = 0),
k as (select c.* from v_clocks c where origin in (select s_suppkey from supplier) or origin in (select origin from o))
select origin, generation, seq, tail_seq from k union all select origin, 9, 0, 0 from o where origin not in (select origin from k)""")
def store_opened(spark: SparkSession, sf: str) -> DataFrame:
    own = V.table(spark, sf, "supplier").where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 100).alias("origin"))
    return R.opened(clocks(spark, sf), _suppliers(spark, sf), own, now=9)


@query(r"""
, r as (select event_id, case when event_id % 10 = 0 then left(props, length(props) - 1) else props end as body, event_type as requester from events)
select event_id, case when length(body) > 9 then 'too_large' when not regexp_matches(body, '^\{.*\}$') then 'malformed' when requester = 'signup' then 'self'
  when requester not in ('click', 'view', 'purchase') then 'unknown' else 'accepted' end as outcome from r""")
def request_gate(spark: SparkSession, sf: str) -> DataFrame:
    body = F.expr("case when event_id % 10 = 0 then left(props, length(props) - 1) else props end")
    e = V.table(spark, sf, "events").select("event_id", body.alias("body"), "event_type")
    return e.select("event_id", R.gate(F.length("body"), F.col("body").rlike(r"^\{.*\}$"), F.col("event_type"), ["click", "view", "purchase"], "signup", 9).alias("outcome"))


BACKLOG = """
, b as (select c.origin, coalesce(a.seq, 0) as cursor, c.seq as target from v_clocks c left join (select origin, max(seq) as seq from v_acks group by 1) a using (origin)),
a as (select origin, unnest(range(0, (target - cursor + 3) // 4)) as k, cursor, target from b where target > cursor),
r as (select origin, cursor + 4 * k as after, least(cursor + 4 * k + 4, target) as until, k, cursor, target from a)"""


def _backlog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Origins with their cursor and target, and the asks between."""
    acked = V.acks(spark, sf).groupBy("origin").agg(F.max("seq").alias("cursor"))
    backlog = clocks(spark, sf).select("origin", F.col("seq").alias("target")).join(acked, "origin", "left").withColumn("cursor", F.coalesce("cursor", F.lit(0).cast("long")))
    return backlog, journal.range_asks(backlog, 4, 6)


@query(f"""{BACKLOG}
select origin, after, until, (after // 4 + origin) % 5 <> 0 as matched, case when (after // 4 + origin) % 5 <> 0 then least(after + 1 + origin % 4, until) end as covered from r""")
def reply_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Replies, some twice and the shorter one of no account, some missing, and some that nobody asked for."""
    _, asks = _backlog(spark, sf)
    replies = asks.where("(after div 4 + origin) % 5 <> 0").select("origin", "after", F.least(F.col("after") + 1 + F.col("origin") % 4, "until").alias("covered"))
    other = asks.select("origin", (F.col("after") + 1_000_000).alias("after"), F.col("until").alias("covered"))
    return R.matched(asks, replies.unionByName(replies.select("origin", "after", (F.col("after") + 1).alias("covered"))).unionByName(other))


CATCHUP = """
, c as (select *, case (k + origin) % 9 + case when origin % 4 = 1 then 9 else 0 end when 3 then after + 1 when 4 then null when 5 then null when 6 then case when origin % 4 = 0 then null else until end else until end as covered from r where origin % 3 <> 0 or k < 2),
d as (select *, coalesce(covered, after) as got from c),
w as (select *, coalesce(max((got < until)::int) over (partition by origin order by after rows between unbounded preceding and 1 preceding), 0) as broken,
  sum((covered is not null)::int) over (partition by origin order by after) as good from d),
f as (select origin, max(run) as run from (select origin, good, count(*) as run from w where covered is null group by 1, 2) group by 1),
g as (select origin, max(case when broken = 0 then got end) as head, sum((got < until)::int) as retries, sum(until - got) as missing from w group by 1),
s as (select b.origin, b.target, b.cursor, greatest(b.cursor, coalesce(head, b.cursor)) as now, retries, missing, coalesce(run, 0) as run from b left join g using (origin) left join f using (origin)),
t as (select *, case when target > cursor + 70 then 'cancelled' when run >= 3 then 'handed_back' when now >= target then 'finished' else 'running' end as status from s)"""


@query(f"""{BACKLOG}{CATCHUP}
select origin, status, case when status = 'cancelled' then cursor else now end as cursor, coalesce(retries, 0)::bigint as retries, coalesce(missing, 0)::bigint as missing from t""")
def catchup_round(spark: SparkSession, sf: str) -> DataFrame:
    """A round of catch-up with short replies and failures, of which three in a row hand an origin back."""
    backlog, asks = _backlog(spark, sf)
    first = backlog.select("origin", F.col("cursor").alias("first"))
    k = asks.join(first, "origin").withColumn("k", F.expr("(after - first) div 4")).where("origin % 3 <> 0 or k < 2")
    covered = F.expr("case (k + origin) % 9 + case when origin % 4 = 1 then 9 else 0 end when 3 then after + 1 when 4 then null when 5 then null when 6 then case when origin % 4 = 0 then null else until end else until end")
    return R.caught_up(backlog, k.select("origin", "after", "until", covered.alias("covered")), far=70)


@query("""
, r as (select hash_part, doc_id, 64 + size as bytes from v_facts where (hash_part, doc_id) > ('8', 0) order by hash_part, doc_id limit 1000),
s as (select *, sum(bytes) over (order by hash_part, doc_id) as sofar, row_number() over (order by hash_part, doc_id) as k, count(*) over () as n from r),
p as (select * from s where sofar <= 16384 or k = 1)
select hash_part, doc_id, bytes, k = max(k) over () and n > max(k) over () as resume from p""")
def fact_dump_page(spark: SparkSession, sf: str) -> DataFrame:
    """One page of the dump, 16 KiB from a stored cursor on."""
    f = V.facts(spark, sf).select("hash_part", "doc_id", (F.lit(64) + F.col("size")).alias("bytes"))
    return R.dump_page(f, ["hash_part", "doc_id"], ("8", 0), 16_384, 64)


@query("""
, ours as (select leaf, bit_xor(hi) as hi, bit_xor(lo) as lo from v_hash where doc_id in (select doc_id from labels) group by 1),
theirs as (select leaf, bit_xor(hi) as hi, bit_xor(lo) as lo from v_hash group by 1),
cd as (select coalesce(a.u, b.u) as u, a.u is not null as held from (select leaf // 256 as u, bit_xor(hi) as hi, bit_xor(lo) as lo from ours group by 1) a
  full join (select leaf // 256 as u, bit_xor(hi) as hi, bit_xor(lo) as lo from theirs group by 1) b using (u) where coalesce(a.hi, 0) <> coalesce(b.hi, 0) or coalesce(a.lo, 0) <> coalesce(b.lo, 0)),
f as (select * from cd order by u limit 32),
ld as (select coalesce(a.leaf, b.leaf) as leaf from ours a full join theirs b using (leaf) where coalesce(a.hi, 0) <> coalesce(b.hi, 0) or coalesce(a.lo, 0) <> coalesce(b.lo, 0)),
l as (select leaf, leaf // 256 as u, count(*) over (partition by leaf // 256) as n from ld where leaf // 256 in (select u from f where held)),
t as (select 0 as rank, 'bucket' as kind, u, u as node from f where not held union all select distinct 1, 'bucket', u, u from l where n >= 3 union all select 1, 'leaf', u, leaf from l where n < 3)
select row_number() over (order by rank, u, node) as turn, kind, node::bigint as node from t order by rank, u, node limit 64""")
def repair_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The subtrees that a round fetches for a replica that knows only labelled documents, buckets whole from three leaves on."""
    every = reliable(V.hashed_facts(spark, sf).select("doc_id", "leaf", "hi", "lo"))
    some = every.join(V.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return R.repair_targets(catalog.fact_leaves(some), catalog.fact_leaves(every), wholesale=3)


@query("""
, l as (select leaf, bit_xor(hi) as hi, bit_xor(lo) as lo from v_hash group by 1),
p as (select unnest([0, 17, 128, 255])::bigint as prefix), c as (select prefix, unnest(range(256)) as child from p)
select prefix, child, coalesce(hi, 0) as hi, coalesce(lo, 0) as lo from c left join l on leaf = prefix * 256 + child""")
def node_children(spark: SparkSession, sf: str) -> DataFrame:
    return R.node_children(catalog.fact_leaves(V.hashed_facts(spark, sf)), [255, 0, 17, 128])


@query("""
, p as (select distinct o_orderpriority as peer from orders), r as (select peer, row_number() over (order by peer) - 1 as rank, count(*) over () as n from p),
t as (select unnest(range(12)) as turn)
select turn, ((rank - turn) % n + n) % n as position, peer from r, t""")
def sweep_order(spark: SparkSession, sf: str) -> DataFrame:
    return R.sweep(V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("peer")), 12)


@query("select event_id, case when value <= 20 and event_id % 400 < 180 then 5 else 60 end::bigint as seconds from events")
def pull_cadence(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select("event_id", R.pull_delay(F.col("value") > 20, F.col("event_id") % 400).alias("seconds"))


@query("""
, e0 as (select distinct n_nationkey as a, (n_nationkey * 7 + 3) % 25 as b from nation union select n_nationkey, (n_nationkey + 1) % 25 from nation where n_nationkey % 4 = 0),
e as (select a as src, b as dst from e0 union select b, a from e0),
h(node, round) as (select 0::bigint, 0::bigint union select e.dst::bigint, h.round + 1 from h join e on e.src = h.node where h.round < 25)
select node, min(round) as round from h group by 1""")
def hint_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds until a change at the first nation's host is known at every host that hints lead to."""
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    e = n.select("a", ((F.col("a") * 7 + 3) % 25).alias("b")).unionByName(n.where("a % 4 = 0").select("a", ((F.col("a") + 1) % 25).alias("b"))).distinct()
    edges = e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return R.hinted(edges, n.where("a = 0").select(F.col("a").alias("node")), reliable)


@query("""
, d as (select c.origin, c.seq, t.seq as since, case when coalesce(t.generation, 0) = c.generation and coalesce(t.seq, 0) >= c.seq then 'up_to_date'
  when coalesce(t.generation, 0) = c.generation and coalesce(t.seq, 0) >= c.tail_seq then 'suffix' else 'snapshot' end as decision
from v_clocks c left join v_theirs t using (origin) where coalesce(t.generation, 0) <= c.generation),
held as (select origin, content from (select *, row_number() over (partition by origin, content order by seq desc) as k from v_journal where op <> 'attest') where k = 1 and op = 'have'),
j0 as (select d.origin, v.seq, v.bytes from d join v_journal v on v.origin = d.origin and v.seq > coalesce(d.since, 0) where decision = 'suffix'),
j1 as (select *, sum(bytes) over (partition by origin order by seq) as sofar, row_number() over (partition by origin order by seq) as k, count(*) over (partition by origin) as n from j0),
j as (select origin, count(*) as n, sum(bytes) as bytes, max(n) > count(*) as truncated from j1 where sofar <= 25 or k = 1 group by 1),
h as (select origin, count(*) as held from held where origin in (select origin from d where decision = 'snapshot') group by 1),
a as (select d.origin, decision, coalesce(j.n, 0) as n, coalesce(held, 0) as held, coalesce(truncated, false) as truncated,
  case decision when 'suffix' then coalesce(bytes, 0) when 'snapshot' then coalesce(held, 0) * 34 else 0 end as cost from d left join j using (origin) left join h using (origin)),
s as (select *, coalesce(sum(cost) over (order by origin rows between unbounded preceding and 1 preceding), 0) as before from a),
o as (select *, case when decision <> 'up_to_date' and before >= 40000 then 'deferred' else decision end as final from s)
select origin, final as decision, case final when 'suffix' then n when 'snapshot' then held else 0 end::bigint as rows, final = 'deferred' or (final = 'suffix' and truncated) as truncated from o""")
def sync_response(spark: SparkSession, sf: str) -> DataFrame:
    """The whole answer to a peer's clocks: suffixes of 25 bytes, snapshots, and what the budget defers."""
    j = V.journal(spark, sf)
    return R.responses(their_clocks(spark, sf), clocks(spark, sf), j, journal.fold(j), budget=40_000, cap=25)


@query("""
, f as (select origin, greatest(seq - 3, tail_seq) as floor from v_clocks where origin % 2 = 0)
select v.origin, count(*) as events, max(coalesce(floor, 0)) as tail from v_journal v left join f using (origin) where v.seq > coalesce(floor, 0) group by 1""")
def journal_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """What compaction leaves of each journal, and its raised tail."""
    floors = clocks(spark, sf).where("origin % 2 = 0").select("origin", F.greatest(F.col("seq") - 3, "tail_seq").alias("floor"))
    left = journal.compacted(V.journal(spark, sf), floors).groupBy("origin").agg(F.count("*").alias("events"))
    return left.join(floors, "origin", "left").select("origin", "events", F.coalesce("floor", F.lit(0).cast("long")).alias("tail"))
