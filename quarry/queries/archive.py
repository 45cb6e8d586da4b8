"""Archive and lookup operators bound to the driver's tables, with SQL for the same rows.

A conversation is a tree: its turns are files named by role and turn, those from the fifth on in the directory `more`;
every third turn is a link, and a first answer of every ninth conversation an empty file.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import codecs as X, compress
from quarry.operators import content, journal, lookups, manifest as M
from quarry.plans import views as V
from quarry.queries.base import B32
from quarry.queries.registry import query
from quarry.sources import records

PIECE = 256

NODES = r"""
, c as (select conv_id as tree, role || '-' || turn as name, turn, case when turn % 3 = 2 then 'symlink' else 'regular' end as kind, role = 'assistant' as executable, 'to-' || turn as target,
  case when conv_id % 9 = 0 and turn = 1 then '' else text end as body from conversations),
f as (select tree, case when turn >= 4 then 'more/' || name else name end as path, name, kind, executable, target, case when kind = 'regular' then length(body) else 0 end as size,
  case when kind = 'regular' then body else '' end as body from c),
n as (
  select tree, path, name, kind, executable, target, size, body, path as k0, path as k2 from f
  union all select distinct tree, 'more', 'more', 'dir', false, '', 0, '', 'more', 'more/~' from c where turn >= 4
  union all select distinct tree, '', null, 'dir', false, '', 0, '', '', '~' from c),
tk as (select *, 8 + length(target) + (8 - length(target) % 8) % 8 as t_target, case when name is null then 24 else 64 + 8 + length(name) + (8 - length(name) % 8) % 8 end as t_entry from n),
fr as (select *, t_entry + case kind when 'dir' then 56 when 'symlink' then 64 + t_target else 72 + case when executable then 32 else 0 end end as front,
  16 + case when name is null then 0 else 16 end + case when kind = 'regular' then (8 - size % 8) % 8 else 0 end as back from tk),
ev as (
  select tree, k0 as key, 0 as phase, 0 as k, front as len, null::varchar as hash from fr
  union all select tree, k2, 2, 0, back, null from fr
  union all select tree, path, 1, k, least(256, size - 256 * k), sha256(substr(body, (256 * k + 1)::int, 256)) from (select *, unnest(range(0, (size + 255) // 256)) as k from fr)),
sp as (select *, coalesce(sum(len) over (partition by tree order by key, phase, k rows between unbounded preceding and 1 preceding), 0) as off, count(hash) over (partition by tree order by key, phase, k) as run from ev),
spans as (
  select tree, off, len, 'segment' as kind, hash from sp where hash is not null
  union all select tree, min(off), sum(len), 'lit', null from sp where hash is null group by tree, run)"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    c = V.table(spark, sf, "conversations")
    name = F.concat_ws("-", "role", F.col("turn").cast("string"))
    regular = F.col("turn") % 3 != 2
    body = F.when(regular, F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 1), "").otherwise(F.col("text"))).otherwise("")
    path = F.when(F.col("turn") >= 4, F.array(F.lit("more"), name)).otherwise(F.array(name))
    segments = F.transform(F.expr(f"regexp_extract_all(body, '(?s).{{1,{PIECE}}}', 0)"), lambda s: F.sha2(s, 256))
    files = c.withColumn("body", body).select(
        F.col("conv_id").alias("tree"), path.alias("path"), F.when(regular, "regular").otherwise("symlink").alias("kind"), (F.col("role") == "assistant").alias("executable"),
        F.concat(F.lit("to-"), F.col("turn").cast("string")).alias("target"), F.length("body").cast("long").alias("size"), segments.alias("segments"), F.col("turn").alias("ord"),
    )
    folder = lambda rows, path: rows.select(F.col("conv_id").alias("tree"), path.cast("array<string>").alias("path"), F.lit("dir").alias("kind"), F.lit(False).alias("executable"), F.lit("").alias("target"), F.lit(0).cast("long").alias("size"), F.array().cast("array<string>").alias("segments"), F.lit(3).cast("long").alias("ord")).distinct()
    return files.unionByName(folder(c.where("turn >= 4"), F.array(F.lit("more")))).unionByName(folder(c, F.array()))


@query(f"{NODES} select tree, row_number() over (partition by tree order by off) - 1 as ord, off::bigint as off, len::bigint as len, kind, hash from spans")
def archive_spans(spark: SparkSession, sf: str) -> DataFrame:
    return M.spans(_nodes(spark, sf), PIECE).select("tree", "ord", "off", "len", "kind", "hash")


@query(f"""{NODES}
, o as (select tree, string_agg('{{"path":"' || path || '","kind":"' || kind || '","executable":' || executable || ',"size":' || size || ',"segments":' || (size + 255) // 256 || '}}', ',' order by path) as nodes from n group by 1)
select tree, '{{"tree":' || tree || ',"segment":256,"nodes":[' || nodes || ']}}' as manifest from o""")
def tree_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return M.documents(_nodes(spark, sf), PIECE)


@query(f"""{NODES}
, p as (select tree, hash, case when tree % 10 = 2 and off % 3 = 0 then len + 1 else len end as len from sp where hash is not null and tree % 10 <> 3
  union all select tree, hash, case when tree % 10 = 2 then len else 0 end from sp where hash is not null and tree % 10 in (2, 3)),
one as (select tree, bool_and(a = b and a > 0) as ok from (select tree, hash, min(len) as a, max(len) as b from p group by 1, 2) group by 1),
total as (select tree, sum(len) as total from ev group by 1),
cl as (select tree, total + case when tree % 10 = 4 then 1 else 0 end as size, total from total),
li as (select tree, path, name, case when path = 'more' then 3 else regexp_extract(path, '[0-9]+$')::int end as ord, kind, size, (size + 255) // 256 - case when tree % 10 = 5 and size > 0 then 1 else 0 end as has from n where path <> ''),
so as (select *, regexp_replace(path, '[^/]*$', '') as up from li),
rs as (select *, coalesce(lag(name) over (partition by tree, up order by case when tree % 2 = 0 then 0 else ord end, name) < name, true) as rises from so),
g as (select tree, bool_and(rises) as sorted, bool_and(kind <> 'regular' or has = (size + 255) // 256) as counts_ok from rs group by 1)
select cl.tree, sorted, true as deep_ok, counts_ok, coalesce(one.ok, true) as lengths_ok, case when tree % 10 = 5 then null else cl.size = total end as size_claimed, sorted and counts_ok and coalesce(one.ok, true) and tree % 10 not in (4, 5) as ok
from cl join g using (tree) left join one using (tree)""")
def manifest_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests that list names out of order, lack a segment, give a hash two lengths or none, or claim another size."""
    nodes = _nodes(spark, sf)
    total = M.spans(nodes, PIECE)
    pieces = total.where("kind = 'segment'").select("tree", "hash", "off", "len")
    wrong = pieces.where("tree % 10 <> 3").selectExpr("tree", "hash", "case when tree % 10 = 2 and off % 3 = 0 then len + 1 else len end as len")
    wrong = wrong.unionByName(pieces.where("tree % 10 in (2, 3)").selectExpr("tree", "hash", "case when tree % 10 = 2 then len else 0L end as len"))
    claims = total.groupBy("tree").agg(F.sum("len").alias("size")).selectExpr("tree", "size + case when tree % 10 = 4 then 1 else 0 end as size")
    name = F.try_element_at("path", F.lit(-1))
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("tree").orderBy(F.when(F.col("tree") % 2 == 0, 0).otherwise(F.col("ord")), name))
    listed = nodes.withColumn("ord", F.when(F.size("path") == 0, 0).otherwise(place)).withColumn("segments", F.expr("if(tree % 10 = 5 and size > 0, slice(segments, 1, size(segments) - 1), segments)"))
    got = M.checked(listed, wrong, claims, PIECE)
    return got.select("tree", "sorted", "deep_ok", "counts_ok", "lengths_ok", F.when(F.col("tree") % 10 != 5, F.col("size_ok")).alias("size_claimed"), "ok")


@query("""
, r as (select doc_id as tree, length(text) as n, (length(text) // 2)::bigint as off, 50::bigint as len, text from documents)
select tree, off, len, n - off >= 50 as ok, case when n - off >= 50 then sha256(substr(text, (off + 1)::int, 50)) end as hash from r""")
def exact_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty characters from the middle of each text, or an error."""
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("tree"), "text")
    reads = d.select("tree", F.expr("cast(length(text) div 2 as bigint)").alias("off"), F.lit(50).cast("long").alias("len"))
    return M.read_exactly(d, reads).select("tree", "off", "len", "ok", F.sha2("data", 256).alias("hash"))


@query("""
, s as (select tree, len, row_number() over (partition by hash order by tree, ord) as k from v_seg where tree in (select doc_id from labels)),
g as (select tree, count(*) as n, sum(len) as b from s where k = 1 group by 1)
select doc_id as tree, case when n is null then 'whole' else 'manifest' end as plan, case when n is null then (n_chars > 0)::int else n end::bigint as spans, case when n is null then n_chars else b end::bigint as bytes from documents left join g on tree = doc_id""")
def transfer_plan(spark: SparkSession, sf: str) -> DataFrame:
    """First segments of labelled documents, the only ones with a manifest; others, or those all of whose segments came before, whole."""
    labelled = V.table(spark, sf, "labels").select(F.col("doc_id").alias("tree")).distinct()
    fetch = content.first_later(V.segments(spark, sf).join(labelled, "tree", "left_semi")).where("not later")
    return M.planned(V.table(spark, sf, "documents").select(F.col("doc_id").alias("tree"), F.col("n_chars").alias("size")), fetch.select("tree", "len"))


@query("""
, r as (select event_id, case event_type when 'view' then 206 when 'click' then 206 when 'error' then case when event_id % 3 = 0 then 503 end when 'signup' then 410 else 404 end as status, 100 as asked, case when event_type = 'click' and event_id % 2 = 0 then 60 else 100 end as got from events)
select event_id, case when status = 206 and got = asked then 'ok' when status = 206 then 'short' when status = 410 then 'gone' when status >= 500 or status is null then 'strike' else 'refused' end as outcome from r""")
def range_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    status = F.expr("case event_type when 'view' then 206 when 'click' then 206 when 'error' then case when event_id % 3 = 0 then 503 end when 'signup' then 410 else 404 end")
    got = F.expr("case when event_type = 'click' and event_id % 2 = 0 then 60 else 100 end")
    return V.table(spark, sf, "events").select("event_id", M.outcome(status, F.lit(100), got).alias("outcome"))


@query("""
, s as (select * from v_seg where not (tree % 10 = 1 and ord = 1)),
t as (select *, off = coalesce(sum(len) over (partition by tree order by off rows between unbounded preceding and 1 preceding), 0) as fits from s),
u as (select *, bool_and(fits) over (partition by tree order by off) as on_ from t),
g as (select tree, sum(len) as bytes, max_by(len, off) as last from u where on_ group by 1),
r as (select doc_id as tree, coalesce(bytes, 0) as bytes, last, coalesce(bytes, 0) = n_chars as complete, doc_id % 10 = 4 and n_chars > 0 and coalesce(bytes, 0) = n_chars as withheld from documents left join g on tree = doc_id)
select tree, (bytes - case when withheld then last else 0 end)::bigint as emitted, complete, withheld from r""")
def ordered_emission(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers that lack a chunk, or whose hash is not the one promised."""
    d = V.table(spark, sf, "documents")
    parts = d.select(F.col("doc_id").alias("tree"), F.posexplode(F.expr(f"regexp_extract_all(text, '(?s).{{1,{V.SEGMENT}}}', 0)")).alias("ord", "data")).where("not (tree % 10 = 1 and ord = 1)")
    chunks = parts.select("tree", (F.col("ord") * V.SEGMENT).cast("long").alias("off"), F.length("data").cast("long").alias("len"), "data")
    trees = d.select(F.col("doc_id").alias("tree"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 10 == 4, F.lit("0")).otherwise(F.sha2("text", 256)).alias("hash"))
    return M.emitted(chunks, trees)


@query("""
select doc_id as tree, (n_chars + 999) // 1000 as chunks, ((n_chars + 999) // 1000 + 3) // 4 as waves, n_chars - 1000 * ((n_chars + 999) // 1000 - 1) as last from documents where length(text) > 0""")
def chunk_waves(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 1,000 characters, read four ahead."""
    r = V.table(spark, sf, "documents").select(F.col("doc_id").alias("tree"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end")).where("end > 0")
    return M.chunk_waves(content.pieces(r, 1000), ahead=4)


SOURCE = f", r as (select doc_id, path, content, case when doc_id % 2 = 0 then 'sha256:' || content else 'sha256:' || {B32} end as hash, size from v_facts)"


def _source(spark: SparkSession, sf: str) -> DataFrame:
    """The facts as a source of record has them, hashes in one of two encodings."""
    f = V.facts(spark, sf)
    return f.select("doc_id", "path", "content", F.concat(F.lit("sha256:"), F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise(X.base32("content"))).alias("hash"), "size")


@query(f"{SOURCE} select content, min(path) as path from r where content in (select content from v_facts where doc_id in (select doc_id from labels)) group by 1")
def lookup_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the contents of labelled documents, and of a content that nobody has."""
    probes = V.facts(spark, sf).join(V.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("content")
    return lookups.by_content(_source(spark, sf), probes.unionByName(spark.createDataFrame([("0" * 64,), (None,)], "content string")))


@query("""
select path, content, size from v_facts where hash_part = substr(sha256('7'), 1, 32)""")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The row of one 32-character key, by a range of paths."""
    return records.by_part(V.facts(spark, sf), "/store", hashlib.sha256(b"7").hexdigest()[:32]).select("path", "content", "size")


@query(f"""{SOURCE}
select doc_id as id, path, content, size, case when doc_id % 3 = 0 then 'k:a,k:b' else '' end as sigs, case when doc_id % 4 = 1 then 'fixed:x' end as ca from r where doc_id % 7 <> 0 and doc_id % 11 <> 0""")
def candidate_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All well-formed rows of a source, some of whose rows lack a size or have a hash of another kind."""
    s, k = _source(spark, sf), F.col("doc_id")
    rows = s.select(
        k.alias("id"), "path", F.when(k % 11 == 0, F.concat(F.lit("md5:"), "content")).otherwise(F.col("hash")).alias("hash"), F.when(k % 7 != 0, F.col("size")).alias("nar_size"),
        F.when(k % 3 == 0, "k:a   k:b").when(k % 3 == 1, " ").alias("sigs"), F.when(k % 4 == 1, "fixed:x").when(k % 4 == 2, "").alias("ca"),
    )
    return records.candidates(rows).withColumn("sigs", F.array_join("sigs", ","))


@query("select path, content, size from v_facts where doc_id % 5 = 0")
def lookup_by_path(spark: SparkSession, sf: str) -> DataFrame:
    f = V.facts(spark, sf)
    probes = f.where("doc_id % 5 = 0").select("path").unionByName(spark.createDataFrame([("/store/none",), (None,)], "path string"))
    return lookups.by_path(f, probes).select("path", "content", "size")


@query("select hash_part, doc_id from v_facts where starts_with(hash_part, 'a') order by hash_part limit 50")
def prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.prefix_scan(V.facts(spark, sf), "hash_part", "a", 50).select("hash_part", "doc_id")


@query("select path, content, 'k:' || hash_part as sigs from v_facts")
def claim_stream(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.claims(V.facts(spark, sf).withColumn("sigs", F.concat(F.lit("k:"), F.col("hash_part"))))


@query("""
select content from (select *, row_number() over (partition by origin, content order by seq desc) as k from v_journal where op <> 'attest' and origin = 7) where k = 1 and op = 'have'""")
def possession_of_one(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.possession(journal.fold(V.journal(spark, sf)), 7)


@query("""
, n as (select source, count(*) as version from documents group by 1), s as (select source, count(*) + case when count(*) % 3 = 0 then 1 else 0 end as version from documents where doc_id % 50 <> 7 group by 1)
select n.source, n.version from n left join s using (source) where s.version is null or s.version <> n.version""")
def version_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose number of documents is not the one seen last."""
    d = V.table(spark, sf, "documents")
    seen = d.where("doc_id % 50 <> 7").groupBy("source").agg((F.count("*") + F.when(F.count("*") % 3 == 0, 1).otherwise(0)).alias("version"))
    return lookups.changed(d.groupBy("source").agg(F.count("*").alias("version")), seen)


@query("""
, d as (select distinct event_type from events where event_type <> 'view'), i as (select event_type, row_number() over (order by event_type) - 1 as index from d)
select event_id, index from events left join i using (event_type)""")
def name_index(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("event_id", "event_type")
    return lookups.named(e, e.where("event_type <> 'view'"), "event_type").select("event_id", "index")


@query("""
, i as (select p_partkey as id, p_name || '#' || p_partkey as path, case when p_partkey % 13 <> 0 then p_size end as size from part),
e as (select distinct l_orderkey as referrer, l_partkey as reference from lineitem where l_orderkey <= (select max(p_partkey) from part)),
r as (select referrer as id, string_agg(distinct path, ',' order by path) as refs from e join i on id = reference group by 1)
select path, size, coalesce(refs, '') as refs, case when size is null then 'no size' end as problem from i left join r using (id)""")
def source_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the parts that the order of their number names; some lack a size."""
    rows = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size")).alias("size"))
    edges = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("referrer"), F.col("l_partkey").alias("reference")).join(rows.select(F.col("id").alias("referrer")), "referrer", "left_semi")
    return lookups.described(rows, edges)


@query("""
, r as (select distinct l_linenumber as path, l_partkey % 50 as content, l_suppkey as origin from lineitem),
n as (select path, content, count(distinct case when live then origin end) as n from r left join v_origins using (origin) group by 1, 2)
select path, content, n as sources from n qualify row_number() over (partition by path order by n desc, content) = 1""")
def most_available(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("path"), (F.col("l_partkey") % 50).alias("content"), F.col("l_suppkey").alias("origin"))
    return lookups.most_available(li, V.origins(spark, sf).where("live"))


@query("""
select doc_id, octet_length(encode(text)) <= 3000 as accepted, case when octet_length(encode(text)) <= 3000 then sha256(text) end as sha256 from documents""")
def zstd_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Texts compressed and taken back if they have at most 3,000 bytes."""
    return compress.round_trip(V.table(spark, sf, "documents"), "doc_id", "text", 3000)


@query(f"{SOURCE} select doc_id, content, to_base64(unhex(content)) as base64, content as unhexed from r")
def hash_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Hash columns of either encoding to hex, to base64, and back."""
    s = _source(spark, sf).select("doc_id", X.hash_column("hash").alias("content"))
    s = s.withColumn("base64", F.base64(F.unhex("content")))
    return s.withColumn("unhexed", F.lower(F.hex(F.unbase64("base64"))))


@query("""
, h as (select distinct sha256(p_name || '-' || l_linenumber) as content, l_suppkey as origin from lineitem join part on p_partkey = l_partkey where p_partkey % 5 = 0),
f as (select distinct substr(sha256(p_name), 1, 32) as hash_part, '/store/' || substr(sha256(p_name), 1, 32) as path, sha256(p_name || '-' || n) as content, 'fixed' as ca from part, (select unnest(range(1, 8)) as n) where p_partkey % 5 = 0),
l as (select content, tier, count(*) as holders from h join v_origins using (origin) where live group by 1, 2),
m as (select * from l qualify row_number() over (partition by content order by tier) = 1)
select path, content, holders as sources, tier from f join m using (content) qualify row_number() over (partition by path order by holders desc, content) = 1""")
def resolve_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The best usable content of each path, parts having a content for each line number."""
    from quarry import api

    p = V.table(spark, sf, "part").where("p_partkey % 5 = 0").select("p_partkey", "p_name")
    li = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", F.col("l_suppkey").alias("origin"))
    name = F.sha2(F.concat_ws("-", "p_name", F.col("l_linenumber").cast("string")), 256)
    held = li.join(p, "p_partkey").select("origin", name.alias("content")).distinct()
    part = F.substring(F.sha2("p_name", 256), 1, 32)
    empty = F.array().cast("array<string>")
    facts = p.withColumn("l_linenumber", F.explode(F.sequence(F.lit(1), F.lit(7)))).select(
        part.alias("hash_part"), F.concat(F.lit("/store/"), part).alias("path"), name.alias("content"), F.lit(1).cast("long").alias("size"), empty.alias("refs"), empty.alias("sigs"), F.lit("fixed").alias("ca"), F.lit(None).cast("boolean").alias("verified"),
    ).distinct()
    return api.resolve(facts, held, V.origins(spark, sf)).select("path", "content", "sources", "tier")
