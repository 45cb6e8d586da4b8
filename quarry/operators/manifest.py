"""Archives of trees: how nodes are framed into one byte stream, its spans, its manifest and what a manifest must hold to.

A tree's nodes are rows (tree, path, kind, executable, target, size, segments): path is the array of names from the
root (empty for the root itself), kind is dir, regular or symlink, segments the content hashes of a regular node's
pieces. Every text of the archive is a token: eight bytes of length, the text, zeros up to a multiple of eight.

Nulls: a null size counts 0, a null target or executable as empty and false; nodes without tree or path take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

#: Names sort before this one; the deepest tree and the longest piece that a manifest may have.
LAST, DEEPEST, LONGEST = "\U0010ffff", 512, 64 << 20


def pad(n: Column) -> Column:
    """Zeros behind n bytes."""
    return F.pmod(-n, F.lit(8))


def token(n: Column | str) -> Column:
    """Bytes of a token for a text of n bytes, or for this text."""
    n = F.lit(len(n.encode())) if isinstance(n, str) else n
    return F.lit(8) + n + pad(n)


def _sum(*words: str) -> int:
    return sum(8 + -(-len(w) // 8) * 8 for w in words)


def framing(kind: Column, executable: Column, target: Column, size: Column, name: Column) -> tuple[Column, Column]:
    """Bytes before a node's content and behind it, with its entry in the directory (name is null for the root)."""
    target_size = F.octet_length(F.coalesce(target, F.lit("")))
    front = (
        F.when(kind == "dir", _sum("(", "type", "directory")).when(kind == "symlink", F.lit(_sum("(", "type", "symlink", "target")) + token(target_size))
        .otherwise(F.lit(_sum("(", "type", "regular", "contents") + 8) + F.when(F.coalesce(executable, F.lit(False)), _sum("executable", "")).otherwise(0))
    )
    entry = F.when(name.isNull(), _sum("nix-archive-1")).otherwise(F.lit(_sum("entry", "(", "name", "node")) + token(F.octet_length(F.coalesce(name, F.lit("")))))
    back = F.lit(_sum(")")) + F.when(name.isNull(), 0).otherwise(_sum(")")) + F.when(kind == "regular", pad(F.coalesce(size, F.lit(0)))).otherwise(0)
    return (entry + front).cast("long"), back.cast("long")


def spans(nodes: DataFrame, segment: int) -> DataFrame:
    """tree, ord, off, len, kind, hash: the archive as literals and segments of content, in order and without a gap.

    Nodes are walked in byte order of their names. What stands between two segments is one literal; an archive
    is one sort of its nodes, and nothing of it is gathered.
    """
    n = nodes.where("tree is not null and path is not null").withColumn("name", F.when(F.size("path") > 0, F.try_element_at("path", F.lit(-1))))
    front, back = framing(F.col("kind"), F.col("executable"), F.col("target"), F.col("size"), F.col("name"))
    none = F.lit(None).cast("string")
    event = lambda key, phase, k, size, hash_: F.struct(key.alias("key"), F.lit(phase).alias("phase"), k.cast("int").alias("k"), size.cast("long").alias("len"), hash_.alias("hash"))
    content = F.when(F.col("kind") == "regular", F.coalesce("segments", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    pieces = F.transform(content, lambda h, k: event(F.col("path"), 1, k, F.least(F.lit(segment), F.col("size") - k * segment), h))
    end = F.when(F.col("kind") == "dir", F.concat("path", F.array(F.lit(LAST)))).otherwise(F.col("path"))
    events = F.concat(F.array(event(F.col("path"), 0, F.lit(0), front, none)), pieces, F.array(event(end, 2, F.lit(0), back, none)))
    rows = n.select("tree", F.explode(events).alias("e")).select("tree", "e.*")
    w = W.partitionBy("tree").orderBy("key", "phase", "k")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"off": F.coalesce(F.sum("len").over(before), F.lit(0).cast("long")), "run": F.coalesce(F.count("hash").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))})
    literal = rows.where("hash is null").groupBy("tree", "run").agg(F.min("off").alias("off"), F.sum("len").alias("len")).select("tree", "off", "len", F.lit("lit").alias("kind"), none.alias("hash"))
    every = rows.where("hash is not null").select("tree", "off", "len", F.lit("segment").alias("kind"), "hash").unionByName(literal)
    return every.withColumn("ord", F.row_number().over(W.partitionBy("tree").orderBy("off")).cast("long") - 1)


def documents(nodes: DataFrame, segment: int) -> DataFrame:
    """tree, manifest: the nodes of each tree in order as JSON; as large as its tree, which a reader holds anyway."""
    node = F.struct("path", F.array_join("path", "/").alias("name"), "kind", F.coalesce("executable", F.lit(False)).alias("executable"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.size(F.coalesce("segments", F.array().cast("array<string>"))).alias("segments"))
    got = nodes.where("tree is not null and path is not null").groupBy("tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    plain = F.transform("nodes", lambda x: F.struct(x["name"].alias("path"), x["kind"].alias("kind"), x["executable"].alias("executable"), x["size"].alias("size"), x["segments"].alias("segments")))
    return got.select("tree", F.to_json(F.struct(F.col("tree").alias("tree"), F.lit(segment).alias("segment"), plain.alias("nodes"))).alias("manifest"))


def checked(nodes: DataFrame, pieces: DataFrame, claims: DataFrame, segment: int) -> DataFrame:
    """tree, sorted, deep_ok, counts_ok, lengths_ok, size_ok, ok: what a manifest must hold to before it is used.

    nodes have `ord`, their place in the listing; pieces(tree, hash, len); claims(tree, size) say how long the archive is.
    Names rise strictly within a directory, no path is deeper than DEEPEST, a regular node has as many segments as its
    size asks for, a hash has one length, none of them 0 or beyond LONGEST, and the spans add up to the claim.
    """
    n = nodes.where("size(path) > 0").withColumn("up", F.slice("path", 1, F.size("path") - 1)).withColumn("name", F.try_element_at("path", F.lit(-1)))
    before = F.lag("name").over(W.partitionBy("tree", "up").orderBy("ord"))
    count = F.expr(f"(coalesce(size, 0L) + {segment - 1}) div {segment}")
    has = F.size(F.coalesce("segments", F.array().cast("array<string>")))
    per = n.withColumns({"rises": F.coalesce(before < F.col("name"), F.lit(True)), "flat": F.size("path") <= DEEPEST, "counted": (F.col("kind") != "regular") | (has == count)})
    per = per.groupBy("tree").agg(*[F.min(c).alias(c) for c in ("rises", "flat", "counted")])
    one = pieces.groupBy("tree", "hash").agg(F.min("len").alias("a"), F.max("len").alias("b"))
    one = one.groupBy("tree").agg(F.min((F.col("a") == F.col("b")) & (F.col("a") > 0) & (F.col("b") <= LONGEST)).alias("one"))
    total = spans(nodes, segment).groupBy("tree").agg(F.sum("len").alias("total"))
    rows = claims.join(per, "tree", "left").join(one, "tree", "left").join(total, "tree", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(True))
    rows = rows.select("tree", true("rises").alias("sorted"), true("flat").alias("deep_ok"), true("counted").alias("counts_ok"), true("one").alias("lengths_ok"), F.coalesce(F.col("total") == F.col("size"), F.lit(False)).alias("size_ok"))
    return rows.withColumn("ok", F.col("sorted") & F.col("deep_ok") & F.col("counts_ok") & F.col("lengths_ok") & F.col("size_ok"))


def planned(trees: DataFrame, fetches: DataFrame) -> DataFrame:
    """tree, plan, spans, bytes: what a transfer fetches: the spans (tree, len) of its manifest, or the whole tree (tree, size) without one."""
    got = fetches.groupBy("tree").agg(F.count("*").alias("n"), F.sum("len").alias("b"))
    rows = trees.join(got, "tree", "left")
    whole = F.col("n").isNull()
    return rows.select("tree", F.when(whole, "whole").otherwise("manifest").alias("plan"), F.when(whole, (F.col("size") > 0).cast("long")).otherwise(F.col("n")).alias("spans"), F.when(whole, F.col("size")).otherwise(F.col("b")).alias("bytes"))


def read_exactly(texts: DataFrame, reads: DataFrame) -> DataFrame:
    """tree, off, len, ok, data: the pieces of texts (tree, text) that reads (tree, off, len) ask for; a short one is an error without data."""
    got = reads.join(texts, "tree", "left").withColumn("data", F.substring(F.col("text"), (F.col("off") + 1).cast("int"), F.col("len").cast("int")))
    ok = F.coalesce(F.length("data") == F.col("len"), F.lit(False))
    return got.select("tree", "off", "len", ok.alias("ok"), F.when(ok, F.col("data")).alias("data"))


def outcome(status: Column, asked: Column, got: Column) -> Column:
    """A ranged answer: only 206 with all bytes counts; gone says that the copy is no more, and only servers' errors strike a peer."""
    return (
        F.when((status == 206) & (got == asked), "ok").when(status == 206, "short").when(status == 410, "gone").when(status >= 500, "strike").when(status.isNull(), "strike").otherwise("refused")
    )


def emitted(chunks: DataFrame, trees: DataFrame) -> DataFrame:
    """tree, emitted, complete, withheld: how much of a transfer is handed on when chunks (tree, off, len, data) have arrived.

    What is contiguous from 0 goes out; once all of trees (tree, size, hash) is there, its last chunk only if the hash of all is right.
    """
    w = W.partitionBy("tree").orderBy("off")
    sofar = F.coalesce(F.sum("len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = chunks.dropDuplicates(["tree", "off"]).withColumn("on", (F.col("off") == sofar).cast("int"))
    rows = rows.withColumn("on", F.min("on").over(w.rowsBetween(W.unboundedPreceding, 0))).where("on = 1")
    got = rows.groupBy("tree").agg(F.sum("len").alias("bytes"), F.max_by("len", "off").alias("last"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "data"))), lambda x: x["data"]), ""), 256).alias("got"))
    out = trees.join(got, "tree", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    complete = F.col("bytes") == F.col("size")
    wrong = complete & F.coalesce(F.col("got") != F.col("hash"), F.lit(False))
    return out.select("tree", F.when(wrong, F.col("bytes") - F.col("last")).otherwise(F.col("bytes")).alias("emitted"), complete.alias("complete"), wrong.alias("withheld"))


def chunk_waves(pieces: DataFrame, ahead: int = 16) -> DataFrame:
    """tree, chunks, waves, last: chunks (tree, start, end) of each stream, in how many waves of read-ahead, and the last one's length."""
    got = pieces.groupBy("tree").agg(F.count("*").alias("chunks"), F.max_by(F.col("end") - F.col("start"), "start").alias("last"))
    return got.select("tree", "chunks", F.ceil(F.col("chunks") / ahead).cast("long").alias("waves"), "last")
