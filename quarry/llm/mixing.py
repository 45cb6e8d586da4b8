"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in SQL expressions only.

Sources share `share` times all words by weight; a target stops at `epochs` times its source's words and the
excess is shared again (water filling). Every source is cut into blocks by a hash of the document id, in a
random order that is fixed by the seed. A source's draws are its blocks in that order, first the whole epochs,
then the remainder; the block where the remainder ends gives its documents in hash order, and the last one a
part. The tree splits the vector of the sources' draw counts among the output shards: every node halves its
draws, and how many of each source go left is drawn from the multivariate hypergeometric distribution, so
shards get exact, disjoint, random quotas. Each shard shuffles its own rows.

A block has `block_words` words or, where that is more, the square root of all words: blocks and the documents of the
one block where a remainder ends both grow with the root of the input. Rows meet their source's few numbers by a join,
and no running sum crosses more than one source's blocks or one block's documents. The sources themselves, a row each,
are ranked and split in one task; some thousands are meant.

Defined results: null and empty text has size 0 and is never taken; null source is a source of its own, last
in order; rows of one doc_id in one source share a place in the order, and share its last part equally; an
empty table gives no rows; other columns are kept by mixed() and ignored by quotas().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import discard, small_side, stored, width

WEIGHTS = (5, 2, 1)
SPACE = r"\x20\x09-\x0D"


def words(text: str = "text") -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text."""
    body = F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "w")
    return F.when(F.col(text).rlike(f"[^{SPACE}]"), F.length(body)).otherwise(0).cast("long")


def place(*parts: Column | str) -> Column:
    """A 60-bit hash of the joined parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 15), 16, 10).cast("long")


def _key(source: str = "source") -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def targets(sized: DataFrame, share: float, epochs: int) -> DataFrame:
    """skey, source_size, target: one row a source."""
    s = sized.groupBy("skey", F.col("skey").startswith("n").cast("int").alias("last")).agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(1))
    rank = F.row_number().over(one.orderBy("last", "skey"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)).withColumn("level", F.col("cap") / F.col("weight"))
    order = one.orderBy("level", "last", "skey")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("lam", (F.sum("source_size").over(one) * float(share) - before) / rest)
    first = F.min(F.when(F.col("lam") <= F.col("level"), F.struct("level", "last", "skey", "lam"))).over(one)["lam"]
    return s.select("skey", "source_size", F.least(F.col("cap"), F.coalesce(first, F.col("level")) * F.col("weight")).alias("target"))


def _hyper(total: str, good: str, draws: str, u: str) -> str:
    """SQL for the number of `good` among `draws` of `total`: inversion from the uniform number u, walking from the mode."""
    lo, hi = f"greatest(0L, {draws} - ({total} - {good}))", f"least({draws}, {good})"
    mode = f"least(greatest(cast(floor(({draws} + 1.0D) * ({good} + 1.0D) / ({total} + 2.0D)) as bigint), {lo}), {hi})"
    up = f"(({good} - k) * 1.0D * ({draws} - k)) / ((k + 1.0D) * ({total} - {good} - {draws} + k + 1.0D))"
    down = f"(k * 1.0D * ({total} - {good} - {draws} + k)) / (({good} - k + 1.0D) * ({draws} - k + 1.0D))"
    # far from the mode the weights are 0 in double precision
    ups = f"filter(sequence({mode}, least({hi}, {mode} + 4000L)), k -> k < {hi})"
    downs = f"reverse(filter(sequence(greatest({lo}, {mode} - 4000L), {mode}), k -> k > {lo}))"
    one = "named_struct('w', 1.0D, 's', 0.0D)"
    mass = lambda seq, ratio: f"aggregate({seq}, {one}, (a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}), a -> a.s)"
    start = f"named_struct('w', 1.0D, 's', 1.0D, 'k', {mode})"
    walk = lambda seq, ratio, step, init, aim: f"aggregate({seq}, {init}, (a, k) -> if(a.s > {aim}, a, named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}, 'k', k + {step})), a -> a)"
    up_mass, down_mass = mass(ups, up), mass(downs, down)
    aim = f"({u} * (1.0D + {up_mass} + {down_mass}))"
    init_down = f"named_struct('w', 1.0D, 's', 1.0D + {up_mass}, 'k', {mode})"
    return (
        f"aggregate(array(named_struct('aim', {aim}, 'up', {up_mass})), 0L, (z, g) -> if(g.aim <= 1.0D + g.up, "
        f"{walk(ups, up, '1L', start, 'g.aim')}.k, {walk(downs, down, '-1L', init_down, 'g.aim')}.k))"
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(skey, draws) to (skey, cuts): the running totals of the source's draws over the shards (a power of two).

    One row holds a node of the tree with the draws left to it by each source; a level doubles the rows.
    """
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("skey", F.col("draws").alias("n")))).alias("q"))  # a struct for each source
    node = node.select(F.lit(1).cast("long").alias("node"), "q")
    uniform = "(conv(substring(md5(concat_ws(':', '{seed}', cast(node as string), x.skey)), 1, 13), 16, 10) / 4503599627370496.0D)"
    take = _hyper("s.total", "x.n", "s.need", uniform.format(seed=seed))
    take = f"if(x.n = 0 or s.need = 0, 0L, if(x.n = s.total, s.need, {take}))"
    step = (
        "aggregate(q, named_struct('total', aggregate(q, 0L, (t, x) -> t + x.n), 'need', aggregate(q, 0L, (t, x) -> t + x.n) div 2, 'left', cast(array() as array<bigint>)), "
        f"(s, x) -> aggregate(array({take}), s, (_s, k) -> named_struct('total', s.total - x.n, 'need', s.need - k, 'left', concat(s.left, array(k)))), s -> s.left)"
    )
    for _ in range(int(math.log2(shards))):
        node = node.withColumn("l", F.expr(step)).select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.expr("zip_with(q, l, (x, k) -> named_struct('skey', x.skey, 'n', k))").alias("q")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(q, l, (x, k) -> named_struct('skey', x.skey, 'n', x.n - k))").alias("q")),
                )
            ).alias("c")
        ).select("c.node", "c.q")
        node = stored(node, "tree")
    leaves = node.select("node", F.explode("q").alias("x")).select("node", "x.skey", "x.n")
    lists = leaves.groupBy("skey").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "n"))), lambda x: x["n"]).alias("n"))  # a number for each shard
    return lists.select("skey", F.expr("aggregate(n, cast(array() as array<bigint>), (a, x) -> concat(a, array(coalesce(try_element_at(a, -1), 0L) + x)))").alias("cuts")) if shards > 1 else lists.select("skey", F.col("n").alias("cuts"))


def plan(sized: DataFrame, share: float, epochs: int, block_words: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One row a (source, block), and one a source: everything a document needs to know its draws.

    sized: skey, spot (hash of the document id), size.
    """
    t = targets(sized, share, epochs)
    total = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    each = F.greatest(F.lit(block_words).cast("long"), F.ceil(F.sqrt(total)))
    t = t.withColumn("n_blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / each)))
    want = F.round("target").cast("long")
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long")))
    t = stored(t.withColumn("rest", want - F.col("whole") * F.col("source_size")), "targets")
    few = small_side(t, t.count())

    own = sized.join(few, "skey").withColumn("block", F.col("spot") % F.col("n_blocks"))
    b = own.groupBy("skey", "block").agg(F.sum("size").alias("words"))
    order = W.partitionBy("skey").orderBy(place(F.lit(str(seed)), F.col("skey"), F.col("block")), "block")
    b = b.withColumn("turn", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    b = stored(b.join(few, "skey").withColumn("left", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("before")))), "blocks")

    edge = b.where("left > 0 and left < words").select("skey", "block", "left")
    inner = own.join(small_side(edge, edge.count()), ["skey", "block"]).groupBy("skey", "block", "left", "spot").agg(F.sum("size").alias("w"), F.count("*").alias("rows"))
    w = W.partitionBy("skey", "block").orderBy("spot")
    inner = inner.withColumn("sofar", F.sum("w").over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = inner.where("sofar >= left and sofar - w < left").select("skey", "block", F.col("spot").alias("last_spot"), F.expr("(left - (sofar - w)) div rows").alias("part"))
    b = b.join(last, ["skey", "block"], "left")

    drawn = b.groupBy("skey").agg(F.count("*").alias("full"), (F.max("whole") * F.count("*") + F.coalesce(F.max(F.when(F.col("left") > 0, F.col("turn") + 1)), F.lit(0))).cast("long").alias("draws"))
    drawn = stored(drawn, "drawn")
    sources = split_quotas(drawn.select("skey", "draws"), shards, seed).join(drawn, "skey").join(few, "skey")
    return b.select("skey", "block", "source_size", "target", "whole", "turn", "left", "words", "last_spot", "part"), sources.select("skey", "n_blocks", "full", "cuts")


class Plan:
    """The stored tables of a plan, with their counted sizes and the number of shards."""

    def __init__(self, blocks: DataFrame, sources: DataFrame, shards: int):
        self.blocks, self.sources, self.shards = blocks, sources, shards
        self.n_blocks, self.n_sources = blocks.count(), sources.count()


def draws(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (with skey, spot, size) and their draws: an array of (epoch, shard, words)."""
    rows = rows.join(small_side(plan.sources.select("skey", "n_blocks"), plan.n_sources), "skey").withColumn("block", F.col("spot") % F.col("n_blocks"))
    rows = rows.join(small_side(plan.blocks, plan.n_blocks, row_bytes=160), ["skey", "block"])
    rows = rows.join(small_side(plan.sources.select("skey", "full", "cuts"), plan.n_sources, row_bytes=96 + 8 * plan.shards), "skey")
    rest = F.expr("case when left = 0 then 0L when left = words then size when spot < last_spot then size when spot = last_spot then least(size, part) else 0L end")
    shard = "size(filter(cuts, c -> c <= {d}))"
    full = F.expr(f"transform(sequence(0L, whole), e -> named_struct('epoch', e, 'shard', {shard.format(d='e * full + turn')}, 'words', if(e < whole, size, rest)))")
    return rows.withColumn("rest", rest).withColumn("draws", F.filter(full, lambda d: d["words"] > 0))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"skey": _key(), "spot": place(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "size": words()})


def _plan_of(docs: DataFrame, share: float, epochs: int, block_words: int, shards: int | None, seed: int) -> tuple[DataFrame, Plan]:
    shards = shards or 1 << max(0, math.ceil(math.log2(width(docs.sparkSession))))
    sized = stored(_prepared(docs.select("doc_id", "source", "text")).select("doc_id", "skey", "spot", "size"), "sized")
    blocks, sources = plan(sized, share, epochs, block_words, shards, seed)
    return sized, Plan(stored(blocks, "plan"), stored(sources, "sources"), shards)


def quotas(docs: DataFrame, share: float = 1.5, epochs: int = 2, block_words: int = 50_000, shards: int | None = None, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken, draws of every document."""
    sized, of = _plan_of(docs, share, epochs, block_words, shards, seed)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return draws(sized, of).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed(docs: DataFrame, share: float = 1.5, epochs: int = 2, block_words: int = 50_000, shards: int | None = None, seed: int = 1) -> DataFrame:
    """The rows of docs, all columns, once for each draw, dealt to the shards, one partition each, and shuffled within them.

    The document that gives only a part of its words is repeated whole: texts are never cut.
    """
    sized, of = _plan_of(docs, share, epochs, block_words, shards, seed)
    discard(sized)
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}  # so that no column of docs clashes with the plan's
    kept = _prepared(docs.select("doc_id", "source", "text", F.struct(*[F.col(c).alias(names[c]) for c in docs.columns]).alias("row_")))
    kept = kept.select("skey", "spot", "size", "row_")
    out = draws(kept, of).select("row_", "spot", F.explode("draws").alias("d"))
    out = out.repartitionById(of.shards, F.col("d.shard").cast("int"))
    out = out.sortWithinPartitions(place(F.lit(str(seed)), F.col("spot"), F.col("d.epoch")))
    return out.select(*[F.col(f"row_.{names[c]}").alias(c) for c in docs.columns])
