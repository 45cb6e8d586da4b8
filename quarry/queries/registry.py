"""What all query modules share: the registry, the logical tables in SQL, and clocks made of the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.plans import views as V

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"with recursive {VIEWS} {sql.strip()}"
        return f

    return add


#: The logical tables in SQL, as plans.views has them.
VIEWS = r"""
v_origins as (select s_suppkey as origin, n_regionkey as tier, s_acctbal >= 0 as live from supplier join nation on s_nationkey = n_nationkey),
v_holdings as (select distinct l_suppkey as origin, l_partkey as content from lineitem),
v_facts as (
  select doc_id, substr(sha256(doc_id::varchar), 1, 32) as hash_part, sha256(text) as content, '/store/' || substr(sha256(doc_id::varchar), 1, 32) || '-' || source as path,
    n_chars as size, case when lang = 'en' then 'fixed:' || lang else '' end as ca from documents),
v_hash0 as (select *, sha256(concat_ws(chr(31), coalesce('=' || hash_part, '-'), coalesce('=' || content, '-'), coalesce('=' || path, '-'), coalesce('=' || size, '-'), coalesce('=' || ca, '-'))) as h from v_facts),
v_hash as (
  select * exclude (h), ('0x' || substr(h, 1, 4))::int as leaf,
    case when substr(h, 1, 1) >= '8' then (('0x' || substr(h, 1, 16))::hugeint - 18446744073709551616)::bigint else ('0x' || substr(h, 1, 16))::bigint end as hi,
    case when substr(h, 17, 1) >= '8' then (('0x' || substr(h, 17, 16))::hugeint - 18446744073709551616)::bigint else ('0x' || substr(h, 17, 16))::bigint end as lo
  from v_hash0),
v_journal as (
  select user_id as origin, row_number() over (partition by user_id order by event_id) as seq,
    case when event_type in ('view', 'click') then 'have' when event_type = 'error' then 'drop' else 'attest' end as op, (props->>'$.k')::bigint as content, length(props) as bytes from events),
v_acks as (select o_orderpriority as peer, o_custkey as origin, count(*) as seq from orders group by 1, 2),
v_clocks as (select origin, 1 + count(distinct op) as generation, max(seq) as seq, max(seq) // 2 as tail_seq from v_journal group by origin),
v_theirs as (
  select origin, generation + case origin % 5 when 3 then -1 when 4 then 1 else 0 end as generation, case origin % 5 when 1 then greatest(seq - 1 - origin % 4, 0) when 2 then seq // 4 else seq end as seq
  from v_clocks where origin % 7 <> 0
  union all select s_suppkey + 1000000, 1, 3 from supplier),
v_segments as (select doc_id as tree, unnest(range(0, (length(text) + 63) // 64)) as ord, unnest([substr(text, (64 * o + 1)::int, 64) for o in range(0, (length(text) + 63) // 64)]) as part from documents),
v_seg as (select tree, ord, ord * 64 as off, length(part) as len, sha256(part) as hash from v_segments),
v_obs as (select event_type as peer, epoch_us(ts) as t, event_id as id, value, event_type <> 'error' as ok, user_id as "set" from events)
"""


def clocks(spark: SparkSession, sf: str) -> DataFrame:
    """origin, generation, seq, tail_seq of the journal."""
    return V.journal(spark, sf).groupBy("origin").agg((F.count_distinct("op") + 1).alias("generation"), F.max("seq").alias("seq"), F.expr("max(seq) div 2").alias("tail_seq"))


def their_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """A peer's clocks: like ours, a few events behind, far behind, of the generation before or after, missing; and of origins that we lack."""
    c = clocks(spark, sf).where("origin % 7 <> 0")
    generation = F.expr("generation + case origin % 5 when 3 then -1 when 4 then 1 else 0 end")
    seq = F.expr("case origin % 5 when 1 then greatest(seq - 1 - origin % 4, 0L) when 2 then seq div 4 else seq end")
    new = V.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("origin"), F.lit(1).cast("long").alias("generation"), F.lit(3).cast("long").alias("seq"))
    return c.select("origin", generation.alias("generation"), seq.alias("seq")).unionByName(new)
