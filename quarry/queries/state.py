"""State, status, source and predicate operators bound to the driver's tables, with SQL for the same rows."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from quarry.functions import codecs as X, signature
from quarry.operators import catalog, state as S
from quarry.plans import views as V
from quarry.queries.registry import clocks, query
from quarry.sources import settings


@query("""
select event_type || '/' || user_id as key, max_by(props, (event_id, props)) as value from events group by 1""")
def meta_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), F.col("event_id").alias("version"))
    return S.latest(e, "key", "value", "version")


WEIGHTS = """
, st as (select c_custkey as peer, case c_custkey % 50 when 3 then 'nan'::double when 4 then 'inf'::double when 5 then null else c_acctbal / 5000 end as weight, c_acctbal / 8000 as loss, c_custkey % 7 as seen, c_custkey * 100 as updated from customer),
nw as (select o_custkey as peer, 0.5::double as weight, 0.25::double as loss, count(*) as seen from orders group by 1)"""


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    """Stored weights of customers, some broken."""
    key = F.col("c_custkey")
    weight = F.when(key % 50 == 3, float("nan")).when(key % 50 == 4, float("inf")).when(key % 50 != 5, F.col("c_acctbal") / 5000)
    return V.table(spark, sf, "customer").select(key.alias("peer"), weight.alias("weight"), (F.col("c_acctbal") / 8000).alias("loss"), (key % 7).alias("seen"), (key * 100).alias("updated"))


@query(f"""{WEIGHTS}
select coalesce(st.peer, nw.peer) as peer, case when nw.seen > st.seen or st.peer is null then nw.loss else st.loss end as loss, case when nw.seen > st.seen or st.peer is null then nw.seen else st.seen end as seen,
  case when nw.seen > st.seen or st.peer is null then 777 else st.updated end as updated from st full join nw on st.peer = nw.peer""")
def weights_saved(spark: SparkSession, sf: str) -> DataFrame:
    new = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("peer")).agg(F.lit(0.5).alias("weight"), F.lit(0.25).alias("loss"), F.count("*").alias("seen"))
    return S.saved(_weights(spark, sf), new, now=777).select("peer", "loss", "seen", "updated")


@query(f"{WEIGHTS} select peer, loss, greatest(updated - 5000, 0) as updated from st where peer in (select s_suppkey from supplier)")
def weights_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of peers that are still there, moved back by 5,000 seconds."""
    peers = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("peer"))
    return S.shifted(S.pruned(_weights(spark, sf), peers), 5000).select("peer", "loss", "updated")


@query(f"""{WEIGHTS}, c as (select peer, least(greatest(case when weight is null or isnan(weight) or isinf(weight) then 1.0::double else weight end, 0.03::double), 1) as w, least(greatest(loss, 0), 1) as l, pow(0.5::double, greatest(100000 - updated, 0) / 86400.0::double) as part from st)
select peer, 1.0::double + (w - 1.0::double) * part as weight, l * part as loss from c""")
def weights_restored(spark: SparkSession, sf: str) -> DataFrame:
    return S.restored(_weights(spark, sf), now=100_000)


@query("""
select user_id as origin, count(*) as events, false as rebuilt from events where user_id % 4 = 2 group by 1
union all select distinct user_id, 0, true from events where user_id % 4 <> 2""")
def layout_check(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of stores whose layout marker is 2, and the stores that are built again."""
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("origin"))
    kept, rebuilt = S.laid_out(e, e.distinct().withColumn("layout", F.when(F.col("origin") % 4 != 0, F.col("origin") % 4)), 2, "origin")
    kept = kept.groupBy("origin").agg(F.count("*").alias("events")).withColumn("rebuilt", F.lit(False))
    return kept.unionByName(rebuilt.select("origin", F.lit(0).cast("long").alias("events"), F.lit(True).alias("rebuilt")))


@query("""
, o as (select peer, count(*) as total, sum(ok::int)::bigint as ok, sum((not ok)::int)::bigint as err, sum(case when ok then floor(value)::bigint else 0 end)::bigint as bytes from v_obs group by 1),
s as (select string_agg('{"peer":"' || peer || '","ok":' || ok || ',"err":' || err || ',"bytes":' || bytes || '}', ',' order by peer) as peers from o)
select '{"peers":[' || peers || '],"facts":' || (select count(*) from v_facts) || ',"holdings":' || (select count(*) from v_holdings) || ',"journal":' || (select count(*) from v_journal) || ',"origins":' || (select count(*) from v_clocks) || '}' as status from s""")
def status_json(spark: SparkSession, sf: str) -> DataFrame:
    o = V.observations(spark, sf)
    peers = o.groupBy("peer").agg(F.sum(F.col("ok").cast("long")).alias("ok"), F.sum((~F.col("ok")).cast("long")).alias("err"), F.sum(F.when(F.col("ok"), F.floor("value")).otherwise(0)).cast("long").alias("bytes"))
    n = lambda df: df.agg(F.count("*"))
    return S.status(peers, facts=n(V.facts(spark, sf)), holdings=n(V.holdings(spark, sf)), journal=n(V.journal(spark, sf)), origins=n(clocks(spark, sf)))


@query("""
, m as (select c_custkey as host, case when c_custkey % 9 <> 0 then c_custkey * 40000 * 1024 end as total, case when c_custkey % 3 = 0 then c_custkey * 30000000 end as most, case when c_custkey % 4 = 0 then c_custkey * 20000000 end as high from customer),
a as (select *, least(total, most, high) as available from m)
select host, available, least(floor(available / 10), 268435456)::bigint as tables from a""")
def memory_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Memory of hosts as their texts and limits say, and what their tables may take."""
    key = F.col("c_custkey")
    text = F.when(key % 9 != 0, F.concat(F.lit("MemFree:  5 kB\nMemTotal:   "), (key * 40000).cast("string"), F.lit(" kB\nBuffers: 1 kB"))).otherwise("none")
    rows = V.table(spark, sf, "customer").select(key.alias("host"), X.meminfo(text, "MemTotal").alias("total"), F.when(key % 3 == 0, key * 30_000_000).alias("most"), F.when(key % 4 == 0, key * 20_000_000).alias("high"))
    rows = rows.withColumn("available", S.least_known(F.col("total"), F.col("most"), F.col("high")))
    return rows.select("host", "available", S.table_budget(F.col("available")).alias("tables"))


@query("""
, e as (select event_id, case event_id % 5 when 0 then 'none' when 1 then 'zstd:' || (event_id % 22 + 1) when 2 then 'zstd:x' when 3 then 'auto' end as encoding, floor(value)::bigint as current from events)
select event_id, case when encoding = 'none' then null when starts_with(encoding, 'zstd:') then try_cast(substr(encoding, 6) as int) else current end::bigint as level from e""")
def zstd_levels(spark: SparkSession, sf: str) -> DataFrame:
    encoding = F.expr("case event_id % 5 when 0 then 'none' when 1 then 'zstd:' || (event_id % 22 + 1) when 2 then 'zstd:x' when 3 then 'auto' end")
    return V.table(spark, sf, "events").select("event_id", S.level(encoding, F.floor("value")).alias("level"))


@query("""
, r as (select event_id, length(props) * 100 as length, case when event_id % 3 = 0 then length(props) * 100 end as announced, case event_id % 4 when 0 then event_id::varchar when 1 then 'x1' when 2 then '' end as header from events)
select event_id, case when announced > 850 then 'refused' when length > 850 then 'cut' else 'taken' end as outcome, case when regexp_matches(header, '^[0-9]+$') then header::bigint else 0 end as micros from r""")
def body_caps(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("props") * 100
    header = F.expr("case event_id % 4 when 0 then cast(event_id as string) when 1 then 'x1' when 2 then '' end")
    return V.table(spark, sf, "events").select("event_id", S.capped(size, F.when(F.col("event_id") % 3 == 0, size), 850).alias("outcome"), S.micros(header).alias("micros"))


@query("""select "set", max_by(value, (t, id)) as value, max_by(ok, (t, id)) as ok from v_obs group by 1""")
def last_states(spark: SparkSession, sf: str) -> DataFrame:
    return S.last_states(V.observations(spark, sf), "set", "value", "ok")


@query("""
select "set", sum(ok::int)::bigint as ok, sum((not ok)::int)::bigint as err, sum(case when ok then 0 else id % 3 end)::bigint as released from v_obs group by 1""")
def pull_counters(spark: SparkSession, sf: str) -> DataFrame:
    return S.pulls(V.observations(spark, sf).withColumn("leases", F.col("id") % 3), "set")


@query("""
, r as (select user_id as peer, case event_id % 9 when 0 then null when 1 then 'client_gone' when 2 then 'stall' when 3 then 'streak' when 4 then 'min_bandwidth' when 5 then 'hash_mismatch' when 6 then 'other' else 'completed' end as outcome,
  floor(value * 100)::bigint as remote, floor(value * 60)::bigint as wire, floor(value * 30)::bigint as replayed, event_id % 100 as literal from events)
select peer, count(*) as started, sum((coalesce(outcome, '') = 'completed')::int)::bigint as completed, sum((coalesce(outcome, '') = 'client_gone')::int)::bigint as client_gone, sum((coalesce(outcome, '') = 'stall')::int)::bigint as stall,
  sum((coalesce(outcome, '') = 'streak')::int)::bigint as streak, sum((coalesce(outcome, '') = 'min_bandwidth')::int)::bigint as min_bandwidth, sum((coalesce(outcome, '') = 'hash_mismatch')::int)::bigint as hash_mismatch,
  sum((coalesce(outcome, '') = 'other')::int)::bigint as other, sum((outcome is null)::int)::bigint as active, sum(remote)::bigint as remote, sum(wire)::bigint as wire, sum(replayed)::bigint as replayed, sum(literal)::bigint as literal from r group by 1""")
def transfer_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.expr("case event_id % 9 when 0 then null when 1 then 'client_gone' when 2 then 'stall' when 3 then 'streak' when 4 then 'min_bandwidth' when 5 then 'hash_mismatch' when 6 then 'other' else 'completed' end")
    e = V.table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("peer"), outcome.alias("outcome"), F.floor(F.col("value") * 100).alias("remote"), F.floor(F.col("value") * 60).alias("wire"), F.floor(F.col("value") * 30).alias("replayed"), (F.col("event_id") % 100).alias("literal"))
    return S.transfers(rows, "peer")


@query("""
, a as (select ts as abort, user_id from events where event_type = 'error')
select e.event_id, exists (select 1 from a where a.user_id = e.user_id and a.abort <= e.ts and e.ts < a.abort + interval 86400 second) and floor(value * 1000) > 1000 * 20 as refused from events e""")
def roaming_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers that are too large for 1,000 bytes a second in 20 seconds while a link has failed within a day."""
    e = V.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.floor(F.col("value") * 1000).alias("size"))
    last = F.max(F.when(F.col("event_type") == "error", F.col("ts"))).over(W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0))
    roaming = F.coalesce(F.col("ts") < last + F.expr("interval 86400 seconds"), F.lit(False))
    return e.select("event_id", X.refused(roaming, F.col("size"), 1000, 20).alias("refused"))


@query("""
, f as (select v.*, doc_id in (select doc_id from labels) as signed from v_facts v)
select doc_id, 'have' as op from f union all select doc_id, 'attest' from f where ca <> '' or signed""")
def believable_exports(spark: SparkSession, sf: str) -> DataFrame:
    """What is exported of each fact: possession always, the fact itself only if it can be believed."""
    seen = V.table(spark, sf, "labels").select("doc_id").distinct().withColumn("signed", F.lit(True))
    f = V.facts(spark, sf).join(seen, "doc_id", "left").withColumn("signed", F.coalesce("signed", F.lit(False)))
    return catalog.exports(f).select("doc_id", "op")


@query("select doc_id, text is null or not (contains(text, 'token = ') or contains(text, 'AKIA')) as clean from documents")
def substitutable(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without either form of a flag."""
    return V.table(spark, sf, "documents").select("doc_id", X.clean_of("text", "token = ", "AKIA").alias("clean"))


@query("""
, l as (select leaf, bit_xor(hi) as hi, bit_xor(lo) as lo from v_hash where doc_id % 2 = 0 group by 1)
select count(*) as leaves, true as coarse_ok, true as rows_ok from l""")
def merkle_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a tree that was maintained has the root of its upper nodes, and of its facts computed anew."""
    every = V.hashed_facts(spark, sf)
    tree = catalog.maintained(catalog.fact_leaves(every), every.where("doc_id % 2 = 1"), every.limit(0))
    return catalog.tree_check(tree, every.where("doc_id % 2 = 0"))


def _secret(name: str) -> bytes:
    return hashlib.sha256(f"made-up key {name}".encode()).digest()


@query("""
select s_suppkey, s_suppkey % 4 in (0, 3) as verified from supplier""")
def signatures_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Statements of suppliers, signed by a trusted key, of another text, by an unknown key, or by one of two."""
    keys = {n: base64.b64encode(signature.sign(_secret(n), b"")[0]).decode() for n in ("k1", "k2")}

    def made(batches):
        import pyarrow as pa

        for b in batches:
            ids, sigs = b.column("s_suppkey").to_pylist(), []
            text = [f"1;/store/{i};{i}" for i in ids]
            for i, t in zip(ids, text, strict=True):
                by = lambda n, m: f"{n}:{base64.b64encode(signature.sign(_secret(n), m.encode())[1]).decode()}"
                sigs.append([[by("k1", t)], [by("k1", t + "!"), "k2:AAAA"], [by("k3", t)], [by("k3", t), by("k2", t)]][i % 4])
            yield pa.record_batch([b.column("s_suppkey"), pa.array(text), pa.array(sigs, pa.list_(pa.string()))], ["s_suppkey", "fingerprint", "sigs"])

    few = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")).repartition(32, "s_suppkey")  # some milliseconds of work a row
    rows = few.mapInArrow(made, "s_suppkey long, fingerprint string, sigs array<string>")
    return signature.verified(rows, keys).select("s_suppkey", "verified")


@query("""
, k as (select n_nationkey as line, 'key-' || n_nationkey as name, to_base64(unhex(sha256(n_name))) as body from nation)
select name, body as key from k where line = (select max(line) from k where line % 3 = 0) or (line % 3 = 1 and line % 2 = 0)""")
def trusted_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys that a settings file names: the last list, and all further ones; broken entries are skipped."""
    n = F.col("n_nationkey")
    entry = F.concat(F.lit("key-"), n.cast("string"), F.lit(":"), F.base64(F.unhex(F.sha2("n_name", 256))))
    line = F.when(n % 3 == 0, F.concat(F.lit("trusted-public-keys = "), entry, F.lit(" broken:xx # a note"))).when((n % 3 == 1) & (n % 2 == 0), F.concat(F.lit("extra-trusted-public-keys = "), entry)).otherwise(F.concat(F.lit("# "), entry))
    return settings.trusted_keys(V.table(spark, sf, "nation").select(line.alias("value"), n.alias("line")))


@query("""
, n as (select s_nationkey as dir, lower(left(s_name, 9)) || (s_suppkey % 6) as name, s_suppkey from supplier)
select dir, name, s_suppkey as ord, coalesce(lag(name) over (partition by dir order by name, s_suppkey) = name, false) as again from n""")
def adjacent_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a directory in byte order, and which one the name before it equals."""
    n = V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("dir"), F.concat(F.lower(F.substring("s_name", 1, 9)), (F.col("s_suppkey") % 6).cast("string")).alias("name"), F.col("s_suppkey").alias("ord"))
    return catalog.adjacent(n, ["dir"], "name", ["ord"]).select("dir", "name", "ord", "again")
