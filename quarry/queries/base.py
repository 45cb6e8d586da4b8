"""Catalog, journal, content, estimator and codec operators bound to the driver's tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from quarry.functions import codecs as X
from quarry.operators import catalog, content, folds, journal
from quarry.plans import views as V
from quarry.queries.registry import clocks, query, their_clocks
from quarry.session import reliable

@query("""
, live as (select content, tier, count(*) as holders, min(h.origin) as first from v_holdings h join v_origins o on h.origin = o.origin where live group by 1, 2)
select * from live l where tier = (select min(tier) from live m where m.content = l.content)""")
def resolve_min_tier(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.resolve(V.lines_held(spark, sf), V.origins(spark, sf))


@query("select content, string_agg(origin::varchar, ',' order by origin) as holders from v_holdings group by 1")
def holders_per_content(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.holders(V.holdings(spark, sf))


@query("""
, n as (select source as path, sha256(text) as content, count(*) as holders from documents group by 1, 2)
select path, content, holders from n qualify row_number() over (partition by path order by holders desc, content) = 1""")
def widest_content_per_path(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.widest(V.table(spark, sf, "documents").select(F.col("source").alias("path"), F.sha2("text", 256).alias("content")))


@query("""
select l_orderkey as referrer, string_agg(distinct p_name, ',' order by p_name) as refs from lineitem join part on l_partkey = p_partkey group by 1""")
def refs_sorted(spark: SparkSession, sf: str) -> DataFrame:
    edges = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("referrer"), F.col("l_partkey").alias("reference"))
    return catalog.references(edges, V.table(spark, sf, "part").select(F.col("p_partkey").alias("reference"), F.col("p_name").alias("path")))


@query("""
, f as (select v.*, doc_id in (select doc_id from labels) as verified from v_facts v)
select doc_id, hash_part, content, path, size, ca from f
where length(content) = 64 and starts_with(path, '/') and length(hash_part) = 32 and (ca <> '' or verified)""")
def facts_feasible(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.feasible(V.facts(spark, sf), V.table(spark, sf, "labels"), "doc_id").select("doc_id", "hash_part", "content", "path", "size", "ca")


@query("""
, f as (select sha256(text) as content, source, min(doc_id) as seen, count(*) as n from documents group by 1, 2)
select content, sum(n)::bigint as paths, string_agg(source, ',' order by seen, source) as sources from f group by 1""")
def content_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.aliases(V.table(spark, sf, "documents").select(F.sha2("text", 256).alias("content"), F.col("doc_id").alias("seen"), "source"))


@query("""
select l_orderkey, b.l_partkey, b.l_suppkey, b.l_linenumber from (
  select l_orderkey, max({'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_linenumber': l_linenumber}) as b from lineitem group by 1)""")
def fact_merge_body(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.merge_body(V.table(spark, sf, "lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"])


@query("select l_orderkey, string_agg(distinct l_returnflag || l_linestatus, ',' order by l_returnflag || l_linestatus) as sigs from lineitem group by 1")
def fact_merge_sigs(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.merge_signatures(V.table(spark, sf, "lineitem"), "l_orderkey", F.concat("l_returnflag", "l_linestatus"))


@query("""
, o as (select l_partkey, max({'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey}) as b from lineitem where l_linestatus = 'F' group by 1),
a as (select l_partkey, max({'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey}) as b from lineitem group by 1)
select a.l_partkey, a.b.l_orderkey as l_orderkey from a left join o using (l_partkey) where o.b is null or o.b <> a.b""")
def fact_merge_changes(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linestatus")
    return catalog.merge_changes(li.where("l_linestatus = 'F'"), li.where("l_linestatus <> 'F'"), ["l_partkey"], ["l_shipdate", "l_orderkey"]).select("l_partkey", "l_orderkey")


@query("select doc_id, leaf, hi, lo from v_hash")
def fact_hash(spark: SparkSession, sf: str) -> DataFrame:
    return V.hashed_facts(spark, sf).select("doc_id", "leaf", "hi", "lo")


@query("select leaf as node, bit_xor(hi) as hi, bit_xor(lo) as lo from v_hash group by 1")
def merkle_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.fact_leaves(V.hashed_facts(spark, sf))


@query("select leaf // 256 as node, bit_xor(hi) as hi, bit_xor(lo) as lo from v_hash group by 1")
def merkle_coarse(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.fact_coarse(catalog.fact_leaves(V.hashed_facts(spark, sf)))


@query("select coalesce(bit_xor(hi), 0) as hi, coalesce(bit_xor(lo), 0) as lo from v_hash")
def merkle_root(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.fact_root(V.hashed_facts(spark, sf))


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All facts' hashes, computed once and kept, and those of a replica that knows only labelled documents."""
    every = reliable(V.hashed_facts(spark, sf).select("doc_id", "leaf", "hi", "lo"))
    return every, every.join(V.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


@query("""
, a as (select leaf, bit_xor(hi) as hi, bit_xor(lo) as lo from v_hash group by 1),
b as (select leaf, bit_xor(hi) as hi, bit_xor(lo) as lo from v_hash where doc_id in (select doc_id from labels) group by 1)
select coalesce(a.leaf, b.leaf) as node from a full join b using (leaf) where coalesce(a.hi, 0) <> coalesce(b.hi, 0) or coalesce(a.lo, 0) <> coalesce(b.lo, 0)""")
def merkle_diff(spark: SparkSession, sf: str) -> DataFrame:
    every, some = _labelled(spark, sf)
    return catalog.tree_diff(catalog.fact_leaves(every), catalog.fact_leaves(some))


@query("""
, c as (select doc_id, leaf, hi, lo from v_hash where doc_id not in (select doc_id from labels))
select leaf as node, bit_xor(hi) as hi, bit_xor(lo) as lo from c group by 1 having bit_xor(hi) <> 0 or bit_xor(lo) <> 0""")
def merkle_maintained(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of all facts after the labelled ones went out."""
    every, some = _labelled(spark, sf)
    return catalog.maintained(catalog.fact_leaves(every), some, some.limit(0))


@query("select doc_id, leaf from v_hash where doc_id not in (select doc_id from labels)")
def anti_entropy_repair(spark: SparkSession, sf: str) -> DataFrame:
    every, some = _labelled(spark, sf)
    return catalog.missing(some, every).select("doc_id", "leaf")


@query("""
select origin, content, seq from (select *, row_number() over (partition by origin, content order by seq desc) as k from v_journal where op <> 'attest') where k = 1 and op = 'have'""")
def journal_fold(spark: SparkSession, sf: str) -> DataFrame:
    return journal.fold(V.journal(spark, sf))


@query("""
, j as (select v.origin, v.seq, v.bytes from v_journal v left join (select origin, max(seq) as acked from v_acks group by 1) a using (origin) where v.seq > coalesce(acked, 0)),
s as (select *, sum(bytes) over (partition by origin order by seq) as sofar, row_number() over (partition by origin order by seq) as k, count(*) over (partition by origin) as n from j),
p as (select * from s where sofar <= 600 or k = 1)
select origin, seq, bytes, n > count(*) over (partition by origin) as truncated from p""")
def journal_suffix_page(spark: SparkSession, sf: str) -> DataFrame:
    acked = V.acks(spark, sf).groupBy("origin").agg(F.max("seq").alias("acked"))
    rows = V.journal(spark, sf).join(acked, "origin", "left").where(F.col("seq") > F.coalesce("acked", F.lit(0))).select("origin", "seq", "bytes")
    return catalog.byte_prefix(rows, ["origin"], ["seq"], 600)


@query("select source, doc_id, n_chars from documents where (source, doc_id) > ('src12', 17) order by source, doc_id limit 100")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.keyset_page(V.table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source", "doc_id"], ("src12", 17), 100)


@query("""
, g as (select l_orderkey as origin, l_linenumber as seq, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) as before from lineitem)
select origin, count(*) as events, sum((seq <> coalesce(before, seq - 1) + 1)::int)::bigint as gaps, min(case when seq <> coalesce(before, seq - 1) + 1 then seq end) as first_gap,
  not bool_or(seq <> coalesce(before, seq - 1) + 1) as applies from g group by 1""")
def seq_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return journal.gaps(V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("origin"), F.col("l_linenumber").alias("seq")))


@query("""
select c.origin, case when coalesce(t.generation, 0) = c.generation and coalesce(t.seq, 0) >= c.seq then 'up_to_date'
  when coalesce(t.generation, 0) = c.generation and coalesce(t.seq, 0) >= c.tail_seq then 'suffix' else 'snapshot' end as decision
from v_clocks c left join v_theirs t using (origin) where coalesce(t.generation, 0) <= c.generation""")
def suffix_decision(spark: SparkSession, sf: str) -> DataFrame:
    return journal.decision(clocks(spark, sf), their_clocks(spark, sf))


@query("""
, d as (select c.origin, c.seq, case when coalesce(t.generation, 0) = c.generation and coalesce(t.seq, 0) >= c.seq then 'up_to_date'
  when coalesce(t.generation, 0) = c.generation and coalesce(t.seq, 0) >= c.tail_seq then 'suffix' else 'snapshot' end as decision
from v_clocks c left join v_theirs t using (origin) where coalesce(t.generation, 0) <= c.generation),
e as (select d.origin, decision, case when decision = 'up_to_date' then 0 else d.seq * 34 end as cost from d),
s as (select *, coalesce(sum(cost) over (order by origin rows between unbounded preceding and 1 preceding), 0) as before from e)
select origin, case when decision <> 'up_to_date' and before >= 20000 then 'deferred' else decision end as decision from s""")
def response_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = journal.decision(clocks(spark, sf), their_clocks(spark, sf)).join(clocks(spark, sf).select("origin", "seq"), "origin")
    d = d.withColumn("cost", F.when(F.col("decision") == "up_to_date", 0).otherwise(F.col("seq") * 34))
    return journal.budgeted(d, "cost", 20_000).select("origin", "decision")


@query("""
, b as (select c.origin, coalesce(a.seq, 0) as cursor, c.seq as target from v_clocks c left join (select origin, max(seq) as seq from v_acks group by 1) a using (origin)),
k as (select origin, target, unnest(range(0, (target - cursor + 3) // 4)) as k, cursor from b where target > cursor)
select origin, cursor + 4 * k as after, least(cursor + 4 * k + 4, target) as until, (k // 6)::int as round from k""")
def range_ask_plan(spark: SparkSession, sf: str) -> DataFrame:
    acked = V.acks(spark, sf).groupBy("origin").agg(F.max("seq").alias("cursor"))
    backlog = clocks(spark, sf).select("origin", F.col("seq").alias("target")).join(acked, "origin", "left").withColumn("cursor", F.coalesce("cursor", F.lit(0).cast("long")))
    return journal.range_asks(backlog, 4, 6)


@query("""
, a as (select origin, generation, greatest(seq - origin % 7, 0) as after, seq + 6 as until from v_theirs),
r as (select a.*, coalesce(a.generation = c.generation and a.after >= c.tail_seq and a.after < a.until, false) as reachable from a left join v_clocks c using (origin)),
j as (select r.origin, r.after, r.until, v.seq, v.bytes, sum(v.bytes) over (partition by r.origin order by v.seq) as sofar, row_number() over (partition by r.origin order by v.seq) as k
  from r join v_journal v on r.origin = v.origin and v.seq > r.after and v.seq <= r.until where reachable),
g as (select origin, count(*) as events, sum(bytes)::bigint as bytes from j where sofar <= 30 or k = 1 group by 1)
select r.origin, r.after, r.until, reachable, coalesce(events, 0) as events, coalesce(bytes, 0) as bytes from r left join g using (origin)""")
def range_reply(spark: SparkSession, sf: str) -> DataFrame:
    asks = their_clocks(spark, sf).select("origin", "generation", F.expr("greatest(seq - origin % 7, 0L)").alias("after"), (F.col("seq") + 6).alias("until"))
    return journal.range_replies(asks, clocks(spark, sf), V.journal(spark, sf), 30)


@query("""
, peers as (select distinct o_orderpriority as peer from orders),
m as (select c.origin, c.seq, c.tail_seq, min(coalesce(a.seq, 0)) as low from v_clocks c cross join peers p left join v_acks a on a.origin = c.origin and a.peer = p.peer group by 1, 2, 3)
select origin, greatest(least(seq, low), seq - 3) as floor from m where greatest(least(seq, low), seq - 3) > tail_seq""")
def compaction_floor(spark: SparkSession, sf: str) -> DataFrame:
    peers = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("peer")).distinct()
    return journal.compaction_floor(clocks(spark, sf), V.acks(spark, sf), peers, backstop=3)


@query("select o_orderpriority as peer, o_custkey as origin, max(o_orderkey) as seq from orders group by 1, 2")
def watermark_max(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.advance(V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("peer"), F.col("o_custkey").alias("origin"), F.col("o_orderkey").alias("seq")))


@query("select origin, count(*) as events from v_journal where origin in (select s_suppkey from supplier) group by 1")
def retain_origins(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.retained(V.journal(spark, sf), V.origins(spark, sf), "origin").groupBy("origin").agg(F.count("*").alias("events"))


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines held locally (of orders that 5 doesn't divide) and exported before (of orders that 7 doesn't divide), by order and part."""
    li = V.table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("content"))
    return li.where("l_orderkey % 5 <> 0").select("content"), li.where("l_orderkey % 7 <> 0").select("content")


CDC = ", c as (select distinct l_orderkey as o, l_orderkey || '-' || l_partkey as content from lineitem)"


@query(f"{CDC} select content from c where o % 5 <> 0 and o % 7 = 0")
def cdc_adds(spark: SparkSession, sf: str) -> DataFrame:
    return journal.full_diff(*_snapshots(spark, sf)).where("op = 'have'").select("content")


@query(f"{CDC} select content from c where o % 5 = 0 and o % 7 <> 0")
def cdc_drops(spark: SparkSession, sf: str) -> DataFrame:
    return journal.full_diff(*_snapshots(spark, sf)).where("op = 'drop'").select("content")


@query("""
, s as (select l_partkey as content, list(distinct l_linestatus || l_returnflag) as sigs from lineitem where l_quantity > 25 group by 1),
k as (select l_partkey as content, list(distinct l_linestatus || l_returnflag) as sigs from lineitem where l_quantity <= 25 group by 1)
select content from s where not exists (select 1 from k where k.content = s.content and len([x for x in s.sigs if not list_contains(k.sigs, x)]) = 0)""")
def cdc_subset_known(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("content"), F.concat("l_linestatus", "l_returnflag").alias("sig"), "l_quantity")
    sigs = lambda d: d.groupBy("content").agg(F.collect_set("sig").alias("sigs"))
    return journal.unexported(sigs(li.where("l_quantity > 25")), sigs(li.where("l_quantity <= 25")), ["content"]).select("content")


@query("""
select event_id, user_id, (select coalesce(max(event_id), 0) from events) as table_max from events
where event_id > (select max(o_orderkey) // 2 from orders) and props is not null and value >= 0""")
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    since = V.table(spark, sf, "orders").agg(F.expr("max(o_orderkey) div 2")).first()[0]
    return journal.additions(V.table(spark, sf, "events").select("event_id", "user_id", "props", "value"), since, "event_id", "props is not null and value >= 0").select("event_id", "user_id", "table_max")


@query("""
, h as (select distinct content from v_journal where op = 'have'), m as (select distinct content from v_journal where op = 'drop')
select content, 'drop' as op from h where content in (select content from m)""")
def retraction(spark: SparkSession, sf: str) -> DataFrame:
    j = V.journal(spark, sf)
    return journal.retractions(j.where("op = 'drop'"), j.where("op = 'have'"))


@query("""
, o as (select 0 as turn, 'attest' as op, content from v_facts union all select 1, 'have', sha256(text) from documents where lang = 'en'),
n as (select row_number() over (order by turn, content, op) as k, op, content from o)
select k + 7 as seq, ((k - 1) // 100)::int as batch, op, content from n""")
def journal_export(spark: SparkSession, sf: str) -> DataFrame:
    holds = V.table(spark, sf, "documents").where("lang = 'en'").select(F.lit("have").alias("op"), F.sha2("text", 256).alias("content"))
    return journal.exported(V.facts(spark, sf), holds, last=7, chunk=100)


@query("""
, taken as (select origin from v_theirs t left join v_clocks c using (origin) where c.origin is null or (t.generation, t.seq) >= (c.generation, c.seq)),
held as (select origin, content from (select *, row_number() over (partition by origin, content order by seq desc) as k from v_journal where op <> 'attest') where k = 1 and op = 'have')
select origin, content from held where origin not in (select origin from taken)
union all select distinct o_custkey, o_orderkey from orders where o_custkey in (select origin from taken)""")
def snapshot_replace(spark: SparkSession, sf: str) -> DataFrame:
    held = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("origin"), F.col("o_orderkey").alias("content"))
    return catalog.replaced(journal.fold(V.journal(spark, sf)), clocks(spark, sf), their_clocks(spark, sf), held)


@query("""
, s as (select t.origin, t.generation, unnest(range(t.seq + case when origin % 11 = 0 then 3 else 0 end, t.seq + 4 + case when origin % 11 = 0 then 3 else 0 end)) as seq, 'have' as op, 1 as content from v_theirs t),
r as (select s.*, coalesce(c.generation, 0) as g, coalesce(c.seq, 0) as cs from s left join v_clocks c using (origin)),
f as (select origin, seq, coalesce(lag(seq) over (partition by origin order by seq), cs) as before from r where seq > cs),
h as (select origin, bool_or(seq <> before + 1) as gap, count(*) as n from f group by 1),
o as (select origin, max(generation) as generation, max(g) as g from r group by 1),
d as (select o.origin, case when o.generation < g then 'ignored' when g > 0 and o.generation > g then 'needs_snapshot' when coalesce(gap, false) then 'needs_snapshot'
  when coalesce(n, 0) = 0 then 'replayed' else 'applied' end as outcome, n from o left join h using (origin))
select origin, outcome, case when outcome = 'applied' then n else 0 end as applied from d""")
def journal_apply(spark: SparkSession, sf: str) -> DataFrame:
    suffix = their_clocks(spark, sf).select("origin", "generation", F.explode(F.expr("sequence(seq + if(origin % 11 = 0, 3, 0), seq + 3 + if(origin % 11 = 0, 3, 0))")).alias("seq"), F.lit("have").alias("op"), F.lit(1).cast("long").alias("content"))
    return journal.applied(V.journal(spark, sf), clocks(spark, sf), suffix)[0]


@query("""
select hash, count(*) as n, min(tree) as first_tree, max(tree) as last_tree, min(len)::bigint as len from v_seg group by 1""")
def segment_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return content.occurrences(V.segments(spark, sf))


@query("select tree, ord::int as ord, row_number() over (partition by hash order by tree, ord) > 1 as later from v_seg")
def segment_first_later(spark: SparkSession, sf: str) -> DataFrame:
    return content.first_later(V.segments(spark, sf)).select("tree", "ord", "later")


@query("""
, f as (select *, row_number() over (partition by hash order by tree, ord) as k from v_seg),
s as (select tree, off, len, lag(off + len) over (partition by tree order by off) as before from f where k = 1),
i as (select *, sum(case when before is null or off - before > 128 then 1 else 0 end) over (partition by tree order by off) as island from s)
select tree, min(off) as start, max(off + len) as "end", count(*) as spans from i group by tree, island""")
def fetch_ranges_coalesced(spark: SparkSession, sf: str) -> DataFrame:
    return content.coalesced(content.first_later(V.segments(spark, sf)).where("not later").select("tree", "off", "len"), gap=128)


@query("""
, p as (select conv_id, turn, (length(text) + length(role) + 16)::bigint as len from conversations)
select conv_id, turn, len, coalesce(sum(len) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as off from p""")
def span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") + F.length("role") + 16).cast("long").alias("len"))
    return content.offsets(c, "conv_id", ["turn"])


@query("""
, r as (select doc_id as tree, length(text) // 3 as a, length(text) // 2 as z from documents)
select tree, ord::int as ord, greatest(off, a) as start, least(off + len, z) as "end" from v_seg join r using (tree) where off < z and off + len > a and z > a""")
def range_resolve(spark: SparkSession, sf: str) -> DataFrame:
    r = V.table(spark, sf, "documents").select(F.col("doc_id").alias("tree"), F.expr("cast(length(text) div 3 as bigint)").alias("start"), F.expr("cast(length(text) div 2 as bigint)").alias("end"))
    return content.resolved(V.segments(spark, sf), r, V.SEGMENT)


@query("""
, r as (select doc_id as tree, unnest(range(0, (length(text) + 999) // 1000)) as k, length(text) as n from documents)
select tree, 0 as ord, k * 1000 as start, least(k * 1000 + 1000, n) as "end" from r""")
def range_pieces(spark: SparkSession, sf: str) -> DataFrame:
    r = V.table(spark, sf, "documents").select(F.col("doc_id").alias("tree"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end")).where("end > 0")
    return content.pieces(r, 1000)


@query("""
, p as (select conv_id, turn, (length(text) + length(role) + 16)::bigint as len from conversations),
o as (select conv_id, turn, coalesce(sum(len) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as off from p)
select q.conv_id * 1000 + q.turn as probe, (select max_by(o.turn, (o.off, o.turn)) from o where o.conv_id = q.conv_id and o.off <= q.turn * 450 - 40) as entry from conversations q""")
def floor_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The turn in which each of some places of a conversation lies, none before its start."""
    c = V.table(spark, sf, "conversations")
    spans = content.offsets(c.select("conv_id", "turn", (F.length("text") + F.length("role") + 16).cast("long").alias("len")), "conv_id", ["turn"])
    probes = c.select(F.col("conv_id").alias("key"), (F.col("turn") * 450 - 40).alias("at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("probe"))
    return content.floor_lookup(probes, spans.select(F.col("conv_id").alias("key"), F.col("off").alias("at"), F.col("turn").alias("entry")))


BROKEN = """
, m as (select tree, ord, off, case when tree % 10 = 2 and ord = 0 then len + 1 when tree % 10 = 3 and ord = 1 then 0 else len end as len, hash from v_seg where not (tree % 10 = 1 and ord = 1))"""


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of manifests, some of which lack one, say a wrong length, or have an empty one."""
    s = V.segments(spark, sf).where("not (tree % 10 = 1 and ord = 1)")
    return s.withColumn("len", F.expr("case when tree % 10 = 2 and ord = 0 then len + 1 when tree % 10 = 3 and ord = 1 then 0 else len end"))


@query(f"""{BROKEN},
f as (select *, off = coalesce(lag(off + len) over (partition by tree order by ord), 0) and len > 0 as follows from m),
g as (select tree, count(*) as n, sum(len) as bytes, bool_and(follows) as follows from f group by 1),
r as (select doc_id as tree, coalesce(n, 0) as segments, (n_chars + 63) // 64 as expected, coalesce(bytes, 0) = n_chars as bytes_ok, coalesce(follows, true) as gap_free from documents left join g on doc_id = tree)
select *, segments = expected and bytes_ok and gap_free as ok from r""")
def integrity_checks(spark: SparkSession, sf: str) -> DataFrame:
    return content.integrity(V.table(spark, sf, "documents").select(F.col("doc_id").alias("tree"), F.col("n_chars").alias("size")), _broken(spark, sf), V.SEGMENT)


@query(f"{BROKEN} select hash from m group by 1 having min(len) <> max(len)")
def lengths_disagree(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that manifests give different lengths."""
    return content.lengths_disagree(_broken(spark, sf))


@query("""
, f as (select *, row_number() over (partition by hash order by tree, ord) > 1 as later from v_seg)
select tree, sum(case when len >= 64 and not later then len else 0 end)::bigint as remote, sum(case when len >= 64 and later then len else 0 end)::bigint as replayed,
  sum(case when len < 64 then len else 0 end)::bigint as literal from f group by 1""")
def byte_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return content.accounting(V.segments(spark, sf), V.SEGMENT)


@query("""
, r as (select peer, "set", value, row_number() over (partition by peer, "set" order by value) as k, count(*) over (partition by peer, "set") as n from v_obs)
select peer, "set", value as median from r where k = n // 2 + 1""")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    """The middle rate of each user and peer, of two the greater one."""
    w = W.partitionBy("peer", "set")
    rows = V.observations(spark, sf).where("value is not null").select("peer", "set", "value", F.row_number().over(w.orderBy("value")).alias("k"), F.count("*").over(w).alias("n"))
    return rows.where(F.expr("k = n div 2 + 1")).select("peer", "set", F.col("value").alias("median"))


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    """set, peer, share, floor_share, n: counts as weights among the peers of a set."""
    rows = V.observations(spark, sf).groupBy("set", "peer").agg(F.count("*").cast("double").alias("w"))
    total = F.sum("w").over(W.partitionBy("set"))
    return rows.select("set", "peer", (F.col("w") / total).alias("share"), (F.lit(folds.WEIGHT_FLOOR) / (F.lit(folds.WEIGHT_FLOOR) + F.greatest(total - F.col("w"), F.lit(0.0)))).alias("floor_share"), F.count("*").over(W.partitionBy("set")).alias("n"))


SHARES = """, s0 as (select "set", peer, count(*)::double as w from v_obs group by 1, 2),
s as (select "set", peer, w / sum(w) over (partition by "set") as share, 0.03::double / (0.03::double + greatest(sum(w) over (partition by "set") - w, 0)) as floor_share, count(*) over (partition by "set") as n from s0)"""


@query(f"""{SHARES} select "set", peer, share, floor_share from s""")
def share_within_set(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf).drop("n")


@query(f"""{SHARES} select "set", peer, case when 1.0::double / n - share <= 0 then 0.0 when 1.0::double / n - floor_share <= 0 then 1.0
  else pow(least(greatest((1.0::double / n - share) / (1.0::double / n - floor_share), 0), 1), 3) end::double as p from s""")
def hedge_prob(spark: SparkSession, sf: str) -> DataFrame:
    even = 1.0 / F.col("n")
    part = F.least(F.greatest((even - F.col("share")) / F.when(even != F.col("floor_share"), even - F.col("floor_share")), F.lit(0.0)), F.lit(1.0))
    p = F.when(even - F.col("share") <= 0, 0.0).when(even - F.col("floor_share") <= 0, 1.0).otherwise(F.pow(part, F.lit(3.0)))
    return _shares(spark, sf).select("set", "peer", p.alias("p"))


@query("""
, m as (select max(t) as now from v_obs)
select id, 1.0::double + (least(value / 100.0::double, 1) - 1) * pow(0.5::double, greatest((now - t) / 1000000.0::double, 0) / 86400.0::double) as w from v_obs, m""")
def staleness_decay(spark: SparkSession, sf: str) -> DataFrame:
    o = V.observations(spark, sf)
    now = o.agg(F.max("t").alias("now"))
    age = F.greatest((F.col("now") - F.col("t")) / F.lit(1_000_000.0), F.lit(0.0)) / 86400.0
    return o.join(F.broadcast(now)).select("id", (1.0 + (F.least(F.col("value") / 100.0, F.lit(1.0)) - 1) * F.pow(F.lit(0.5), age)).alias("w"))


@query("""select id, case when value * 10000 <= 0 then 4194304 else least(greatest((value * 10000 * 2)::double, 262144), 1048576) end::bigint as size from v_obs""".replace("(value * 10000 * 2)::double", "floor(value * 10000 * 2)"))
def chunk_size(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.col("value") * 10000
    return V.observations(spark, sf).select("id", F.when(rate <= 0, F.lit(4 << 20)).otherwise(F.least(F.greatest(F.floor(rate * 2), F.lit(256 << 10)), F.lit(1 << 20))).cast("long").alias("size"))


@query("""select id, case when value <= 0 then 20.0 else least(greatest(8.0::double * 1000 / value, 10.0), 300.0) end::double as seconds from v_obs""")
def chunk_deadline(spark: SparkSession, sf: str) -> DataFrame:
    return V.observations(spark, sf).select("id", F.when(F.col("value") <= 0, 20.0).otherwise(F.least(F.greatest(F.lit(8.0) * 1000 / F.when(F.col("value") > 0, F.col("value")), F.lit(10.0)), F.lit(300.0))).alias("seconds"))


RAMPS = """, s as (select id, value / 40 as own, case when id % 3 = 0 then value / 10 end as system, case when id % 4 = 0 then value / 100 end as fill, case when not ok then 1 - value / 100 end as available from v_obs),
r as (select id, least(1, greatest(0, (own - 0.5::double) / 4.5::double)) as a, least(1, greatest(0, (system - 2) / 18::double)) as b, least(1, greatest(0, (fill - 0.75::double) / (0.95::double - 0.75::double))) as c,
  least(1, greatest(0, (available - 0.10::double) / (0.05::double - 0.10::double))) as d from s)"""


@query(f"{RAMPS} select id, greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0), coalesce(d, 0))::double as severity from r")
def severity(spark: SparkSession, sf: str) -> DataFrame:
    """The worst of four signals, most of which can't always be read."""
    v, i = F.col("value"), F.col("id")
    signals = v / 40, F.when(i % 3 == 0, v / 10), F.when(i % 4 == 0, v / 100), F.when(~F.col("ok"), 1 - v / 100)
    return V.observations(spark, sf).select("id", X.severity(*signals).alias("severity"))


@query("""
, e as (select "set", t, 1 as d from v_obs union all select "set", t + 3600000000, -1 from v_obs),
s as (select "set", t, sum(d) over (partition by "set" order by t, d rows between unbounded preceding and current row) as n from e)
select "set", max(n)::bigint as most from s group by 1""")
def in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """Most of a user's observations in flight at once, each lasting an hour: a running sum of starts and ends."""
    o = V.observations(spark, sf)
    e = o.select("set", "t", F.lit(1).alias("d")).unionByName(o.select("set", (F.col("t") + 3_600_000_000).alias("t"), F.lit(-1).alias("d")))
    w = W.partitionBy("set").orderBy("t", "d").rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("n", F.sum("d").over(w)).groupBy("set").agg(F.max("n").alias("most"))


@query("""
, l as (select p_partkey, p_size || case p_partkey % 6 when 0 then '' when 1 then 'KiB' when 2 then 'MiB' when 3 then '.5GiB' when 4 then 'MB' else 'TiB' end as literal, p_size, p_partkey % 6 as u from part)
select p_partkey, literal, case u when 0 then p_size when 1 then p_size * 1024 when 2 then p_size * 1048576 when 3 then (p_size + 0.5) * 1073741824 when 4 then null else p_size * 1099511627776 end::bigint as bytes from l""")
def byte_size_parse(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("", "KiB", "MiB", ".5GiB", "MB", "TiB"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("literal")).withColumn("bytes", X.byte_size("literal"))


@query("""
, h as (select doc_id, n_chars as n, case doc_id % 6 when 0 then 'bytes=' || (n_chars // 3) || '-' || (n_chars // 2) when 1 then 'bytes=-' || (doc_id % 50) when 2 then 'bytes=' || (doc_id * 7) || '-'
  when 3 then 'bytes=1-2,4-5' when 4 then 'items=1' else 'bytes=0-99999999999999999999' end as header from documents),
r as (select *, doc_id % 6 as m, doc_id % 50 as tail from h)
select doc_id, header,
  case when m in (3, 4, 5) then 'full' when m = 0 then case when n // 3 > n // 2 or n // 3 >= n then 'unsatisfiable' else 'partial' end
    when m = 1 then case when tail = 0 or n = 0 then 'unsatisfiable' else 'partial' end else case when doc_id * 7 >= n then 'unsatisfiable' else 'partial' end end as kind,
  case when m = 0 and n > 0 then n // 3 when m = 1 and tail > 0 and n > 0 then greatest(n - tail, 0) when m = 2 and doc_id * 7 < n then doc_id * 7 end as start,
  case when m = 0 and n > 0 then least(n // 2 + 1, n) when m = 1 and tail > 0 and n > 0 then n when m = 2 and doc_id * 7 < n then n end as "end" from r""")
def range_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n"))
    header = F.expr("""case doc_id % 6 when 0 then 'bytes=' || (n div 3) || '-' || (n div 2) when 1 then 'bytes=-' || (doc_id % 50) when 2 then 'bytes=' || (doc_id * 7) || '-'
      when 3 then 'bytes=1-2,4-5' when 4 then 'items=1' else 'bytes=0-99999999999999999999' end""")
    return d.withColumn("header", header).withColumn("r", X.byte_range("header", "n")).select("doc_id", "header", "r.*")


@query("""
select doc_id, substr(regexp_extract(path, '[^/]*$'), 1, 32) as hash_part, replace(path, '/store/', '') as name from v_facts""")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    return V.facts(spark, sf).select("doc_id", X.hash_part("path").alias("hash_part"), X.basename("path", "/store").alias("name"))


B32 = "array_to_string([substr('0123456789abcdfghijklmnpqrsvwxyz', ((((('0x' || substr(content, 2 * (5 * n // 8) + 1, 2))::int >> (5 * n % 8)) | (coalesce(try_cast(('0x' || substr(content, 2 * (5 * n // 8) + 3, 2)) as int), 0) << (8 - 5 * n % 8))) & 31) + 1)::int, 1) for n in range(51, -1, -1)], '')"


@query(f"select doc_id, {B32} as encoded, content as decoded from v_facts")
def base32_codec(spark: SparkSession, sf: str) -> DataFrame:
    f = V.facts(spark, sf).select("doc_id", X.base32("content").alias("encoded"))
    return f.withColumn("decoded", X.unbase32("encoded"))


@query(f"select doc_id, '1;' || path || ';sha256:' || {B32} || ';' || size || ';a,z' as fingerprint from v_facts")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return V.facts(spark, sf).select("doc_id", X.fingerprint(F.col("path"), F.col("content"), F.col("size"), F.array(F.lit("z"), F.lit("a"))).alias("fingerprint"))


NL = "chr(10)"


@query(f"""
, b as (select *, {B32} as b32 from v_facts)
select doc_id, 'StorePath: ' || path || {NL} || 'URL: nar/' || b32 || '.nar' || {NL} || 'Compression: none' || {NL} || 'FileHash: sha256:' || b32 || {NL} || 'FileSize: ' || size || {NL}
  || 'NarHash: sha256:' || b32 || {NL} || 'NarSize: ' || size || {NL} || 'References: dep-a dep-b' || {NL} || 'Sig: k:' || hash_part || {NL} || case when ca <> '' then 'CA: ' || ca || {NL} else '' end as info from b""")
def narinfo_render(spark: SparkSession, sf: str) -> DataFrame:
    f = V.facts(spark, sf)
    return f.select("doc_id", X.info_text(F.col("path"), F.col("content"), F.col("size"), F.array(F.lit("dep-a"), F.lit("dep-b")), F.lit(None).cast("string"), F.array(F.concat(F.lit("k:"), F.col("hash_part"))), F.col("ca")).alias("info"))


@query("select doc_id, path, content, size, 'dep-a,dep-b' as refs, 'k:' || hash_part as sigs, case when ca <> '' then ca end as ca from v_facts")
def narinfo_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = narinfo_render(spark, sf).select("doc_id", X.parsed_info("info").alias("p"))
    return p.select("doc_id", "p.path", "p.content", "p.size", F.array_join("p.refs", ",").alias("refs"), F.array_join("p.sigs", ",").alias("sigs"), "p.ca")


@query("""
select peer, count(*) as total, sum(ok::int)::bigint as ok, sum((not ok)::int)::bigint as err, (select count(*) from v_holdings) as holdings, (select count(*) from v_journal) as journal from v_obs group by 1""")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    tally = V.observations(spark, sf).groupBy("peer").agg(F.count("*").alias("total"), F.sum(F.col("ok").cast("long")).alias("ok"), F.sum((~F.col("ok")).cast("long")).alias("err"))
    held = V.holdings(spark, sf).agg(F.count("*").alias("holdings"))
    events = V.journal(spark, sf).agg(F.count("*").alias("journal"))
    return tally.join(F.broadcast(held)).join(F.broadcast(events))  # one row each


@query("""
, m as (select max(t) - 86400000000 * 3 as now from v_obs),
b as (select "set", peer, max(case when value > 25 then t + 86400000000 * 4 end) as until from v_obs group by 1, 2)
select "set", case when bool_or(until is null or until <= now) then null else min(until) end as recovery from b, m group by 1""")
def soonest_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """When the first of a user's peers is free again, three days before the last event; none if one is free already."""
    o = V.observations(spark, sf)
    now = o.agg((F.max("t") - 3 * 86_400_000_000).alias("now"))
    b = o.groupBy("set", "peer").agg(F.max(F.when(F.col("value") > 25, F.col("t") + 4 * 86_400_000_000)).alias("until")).join(F.broadcast(now))
    free = F.col("until").isNull() | (F.col("until") <= F.col("now"))
    return b.groupBy("set").agg(F.when(~F.max(free), F.min("until")).alias("recovery"))


@query("""
, a as (select ts as abort, user_id from events where event_type = 'error')
select e.event_id, exists (select 1 from a where a.user_id = e.user_id and a.abort <= e.ts and e.ts < a.abort + interval 600 second) as roaming from events e""")
def roaming_epoch(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "error", F.col("ts"))).over(w)
    return e.select("event_id", F.coalesce(F.col("ts") < last + F.expr("interval 600 seconds"), F.lit(False)).alias("roaming"))


@query("""select event_id, value::double as own from events""")
def pressure_parse(spark: SparkSession, sf: str) -> DataFrame:
    """avg10 out of pressure texts made from the events' values."""
    text = F.concat(F.lit("full avg10=9.9 avg60=0\nsome avg10="), F.format_string("%.17f", F.col("value")), F.lit(" avg60=0.1 total=5"))
    return V.table(spark, sf, "events").select("event_id", X.pressure_avg10(text).alias("own"))
