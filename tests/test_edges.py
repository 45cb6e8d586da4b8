"""Null values, ties, repeated rows, empty tables and columns of other names: each operator has a defined result."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, content, folds, journal


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def t(spark):
    origins = spark.createDataFrame([("a", 1, True), ("b", 0, False), ("c", 1, True), ("c", 1, True), (None, 0, True), ("d", None, True)], "origin string, tier int, live boolean")
    held = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "x"), (None, "x"), ("a", None), ("b", "y"), ("nobody", "z")], "origin string, content string").withColumn("holders", F.lit("clash"))
    j = spark.createDataFrame([("a", 1, "have", "x"), ("a", 1, "have", "x"), ("a", 2, None, "y"), ("a", 3, "have", None), (None, 1, "have", "x"), ("b", None, "have", "q")], "origin string, seq long, op string, content string").withColumn("e", F.lit(1))
    return {"origins": origins, "held": held, "journal": j}


def test_resolve(t):
    assert rows(catalog.resolve(t["held"], t["origins"])) == [("x", 1, 2, "a")]
    assert catalog.resolve(t["held"].limit(0), t["origins"]).count() == catalog.resolve(t["held"], t["origins"].limit(0)).count() == 0


def test_holders_and_widest(spark, t):
    assert rows(catalog.holders(t["held"].where("content = 'x'"))) == [("x", "a,b,c")]
    ties = spark.createDataFrame([("/p", "b"), ("/p", "a"), ("/p", "a"), ("/p", "b"), ("/q", None), (None, "z")], "path string, content string")
    assert rows(catalog.widest(ties.where("path = '/p'"))) == [("/p", "a", 2)] and catalog.widest(ties).count() == 3
    assert catalog.holders(t["held"].limit(0)).count() == catalog.widest(ties.limit(0)).count() == 0


def test_facts(spark):
    h = "0" * 64
    facts = spark.createDataFrame([(1, h, "/s/p", "p" * 32, ""), (2, h, "/s/p", "p" * 32, "fixed"), (3, None, "/s/p", "p" * 32, "fixed"), (4, h, "s/p", "p" * 32, "fixed"), (5, h, "/s/p", "p", "fixed"), (6, h, "/s/p", "p" * 32, None)], "doc_id long, content string, path string, hash_part string, ca string")
    seen = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    assert [r.doc_id for r in catalog.feasible(facts, seen, "doc_id").orderBy("doc_id").collect()] == [1, 2]
    assert catalog.feasible(facts.limit(0), seen, "doc_id").count() == 0
    exports = catalog.exports(facts.withColumn("signed", F.col("doc_id") == 1))
    assert rows(exports.where("doc_id in (1, 6)").select("doc_id", "op")) == [(1, "attest"), (1, "have"), (6, "have")]


def test_merges_and_pages(spark):
    v = spark.createDataFrame([("k", 1, None), ("k", 1, "b"), ("k", None, "z"), ("m", None, None)], "k string, n int, p string")
    assert rows(catalog.merge_body(v, ["k"], ["n", "p"])) == [("k", 1, "b"), ("m", None, None)]
    assert rows(catalog.merge_signatures(v, "k", F.col("p"))) == [("k", "b,z"), ("m", "")]
    assert catalog.merge_body(v.limit(0), ["k"], ["n", "p"]).count() == 0
    same = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None)], "k string, n int")
    assert rows(catalog.keyset_page(same, ["k", "n"], ("a", 1), 5)) == [("a", 2), ("b", None)]
    sized = spark.createDataFrame([("g", 1, None), ("g", 2, 5), ("h", 1, 99)], "g string, k int, bytes long")
    assert rows(catalog.byte_prefix(sized, ["g"], ["k"], 10).select("g", "k", "truncated")) == [("g", 1, False), ("g", 2, False), ("h", 1, False)]
    names = spark.createDataFrame([("d", "b", 1), ("d", "a", 2), ("d", "b", 3), ("e", None, 4), ("e", None, 5)], "dir string, name string, ord int")
    assert rows(catalog.adjacent(names, ["dir"], "name", ["ord"]).where("again").select("ord")) == [(3,)]


def test_trees(spark):
    f = spark.createDataFrame([(5, 1, 2), (5, 1, 2), (70, 4, 4)], "leaf int, hi long, lo long")
    assert rows(catalog.fact_leaves(f)) == [(5, 0, 0), (70, 4, 4)] and rows(catalog.fact_root(f.limit(0))) == [(0, 0)]
    assert rows(catalog.tree_diff(catalog.fact_leaves(f), catalog.fact_leaves(f.limit(0)))) == [(70,)]
    assert catalog.missing(f, f).count() == 0 and catalog.missing(f.limit(0), f.where("leaf = 70")).count() == 1
    assert rows(catalog.tree_check(catalog.fact_leaves(f), f)) == [(2, True, True)] and rows(catalog.tree_check(catalog.fact_leaves(f.limit(0)), f)) == [(0, True, False)]


def test_journals(spark, t):
    j = t["journal"]
    assert rows(journal.fold(j.where("content is not null and origin is not null and seq is not null"))) == [("a", "x", 1)]
    assert journal.fold(j.limit(0)).count() == journal.gaps(j.limit(0)).count() == 0
    clocks = spark.createDataFrame([("a", 1, 5, 2), ("b", 0, 0, 0)], "origin string, generation long, seq long, tail_seq long")
    theirs = spark.createDataFrame([("a", None, None), ("z", 1, 1)], "origin string, generation long, seq long")
    assert rows(journal.decision(clocks, theirs)) == [("a", "snapshot")] and rows(journal.decision(clocks, theirs.limit(0))) == [("a", "snapshot")]
    acks = spark.createDataFrame([("p", "a", 3), ("p", "a", 4), ("q", "a", 5), ("stranger", "a", 0), ("p", None, 9)], "peer string, origin string, seq long")
    peers = spark.createDataFrame([("p",), ("q",), ("q",)], "peer string")
    assert rows(journal.compaction_floor(clocks, acks, peers)) == [("a", 4)]
    assert rows(journal.compaction_floor(clocks, acks.where("peer = 'p'"), peers)) == [] and rows(journal.compaction_floor(clocks, acks.limit(0), peers, backstop=1)) == [("a", 4)]
    assert journal.range_asks(spark.createDataFrame([("a", None, 5), ("b", 3, None), ("c", 9, 2)], "origin string, cursor long, target long"), 4, 2).count() == 0
    one, none = spark.createDataFrame([("x",), ("x",), (None,)], "content string"), spark.createDataFrame([], "content string")
    assert rows(journal.full_diff(one.where("content = 'x'"), none)) == [("x", "have")] and journal.full_diff(none, none).count() == 0
    assert rows(journal.retractions(one, one)) == [("x", "drop")]
    sig = lambda v: spark.createDataFrame(v, "content string, sigs array<string>")
    assert rows(journal.unexported(sig([("a", []), ("b", ["s"]), ("c", None), ("d", ["s", "t"])]), sig([("a", None), ("a", ["x"]), ("b", ["s", "t"]), ("d", ["s"])]), ["content"]).select("content")) == [("c",), ("d",)]
    assert rows(journal.additions(spark.createDataFrame([(1, "a"), (2, None), (9, None)], "id long, p string"), 0, "id", "p is not null").select("id", "table_max")) == [(1, 9)]


def test_contents(spark):
    seg = spark.createDataFrame([("t", 0, 0, 4, "h"), ("t", 1, 4, 4, "h"), ("u", 0, 0, 4, "h"), ("u", 1, 4, 2, None), (None, 0, 0, 4, "k")], "tree string, ord int, off long, len long, hash string")
    assert rows(content.first_later(seg).where("tree is not null").select("tree", "ord", "later")) == [("t", 0, False), ("t", 1, True), ("u", 0, True)]
    assert content.first_later(seg.limit(0)).count() == content.occurrences(seg.limit(0)).count() == content.accounting(seg.limit(0), 4).count() == 0
    assert rows(content.coalesced(spark.createDataFrame([("t", 0, 4), ("t", 0, 4), ("t", 2, 9), ("t", 50, 1)], "tree string, off long, len long"), 3)) == [("t", 0, 11, 3), ("t", 50, 51, 1)]
    trees = spark.createDataFrame([("t", 8), ("none", 0), ("lost", 5), ("unsized", None)], "tree string, size long")
    assert [(r.tree, r.ok) for r in content.integrity(trees, seg, 4).orderBy("tree").collect()] == [("lost", False), ("none", True), ("t", True), ("unsized", None)]
    r = spark.createDataFrame([("t", 3, 3), ("t", None, 5), ("t", 1, 99), ("x", 0, 5)], "tree string, start long, end long")
    assert rows(content.resolved(seg, r, 4)) == [("t", 0, 1, 4), ("t", 1, 4, 8)]
    probes = spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3)], "key string, at long, probe long")
    entries = spark.createDataFrame([("a", 5, 10), ("a", 5, 11), (None, 1, 12)], "key string, at long, entry long")
    assert rows(content.floor_lookup(probes.where("key is not null and at is not null"), entries)) == [(1, 11)] and content.floor_lookup(probes.limit(0), entries).count() == 0


def test_steps_without_history():
    assert folds.Pages(10).add(0) == 0 and folds.Draws().pick({}) is None and folds.WeightPool([]).weight == {}
    assert folds.Governor(5, 9, 2).limit() == 9 and folds.next_budget(0, 10, 5, 0.0) == 5 and folds.next_level(3, 0.0, 1, 0, 0, 0, True) == 3
    b = folds.Breaker(1, 10)
    assert b.available(0) and (b.observe(0, False), b.state(5), b.state(10)) == (None, "open", "half")
    assert folds.Epochs().add(5, 0, True) is None and folds.Leases().claim(0, "a") and folds.LruCache(0).use("a", 5) == (False, 0)
