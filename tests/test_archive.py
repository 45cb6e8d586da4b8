"""Archives and manifests against a plain walk of the tree."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from quarry import api
from quarry.operators import lookups, manifest as M

SCHEMA = "tree long, path array<string>, kind string, executable boolean, target string, size long, segments array<string>, extra string"


def token(b):
    return struct.pack("<Q", len(b)) + b + bytes(-len(b) % 8)


def walked(node):
    """The archive of a nested tree, byte for byte: dicts are directories, bytes files, (bytes,) executables, str links."""
    if isinstance(node, dict):
        out = b"".join(map(token, (b"(", b"type", b"directory")))
        for name in sorted(node, key=str.encode):
            out += b"".join(map(token, (b"entry", b"(", b"name", name.encode(), b"node"))) + walked(node[name]) + token(b")")
        return out + token(b")")
    if isinstance(node, str):
        return b"".join(map(token, (b"(", b"type", b"symlink", b"target", node.encode(), b")")))
    body, runs = (node[0], True) if isinstance(node, tuple) else (node, False)
    return b"".join(map(token, (b"(", b"type", b"regular", *((b"executable", b"") if runs else ()), b"contents"))) + token(body) + token(b")")


def listed(tree, node, piece, path=()):
    if isinstance(node, dict):
        yield tree, list(path), "dir", None, None, None, None, "x"
        for name in node:
            yield from listed(tree, node[name], piece, (*path, name))
    elif isinstance(node, str):
        yield tree, list(path), "symlink", None, node, None, None, "x"
    else:
        body = node[0] if isinstance(node, tuple) else node
        hashes = [hashlib.sha256(body[i : i + piece]).hexdigest() for i in range(0, len(body), piece)]
        yield tree, list(path), "regular", isinstance(node, tuple), None, len(body), hashes, "x"


def forest():
    rng = random.Random(3)

    def grown(depth):
        return {f"{rng.choice('aBzé')}{i}": rng.choice([grown(depth - 1) if depth else b"", rng.randbytes(rng.choice([0, 1, 8, 30, 64, 65])), (rng.randbytes(16),), "to/it"]) for i in range(rng.choice([0, 2, 4]))}

    return {0: {}, 1: b"", 2: "link", 3: (b"run" * 9,), 4: {"a": b"1", "a.b": b"2", "a-b": {"x": b"3" * 100}, "A": {}}, **{k: grown(3) for k in range(5, 12)}}


def test_spans_are_the_archive(spark):
    piece, trees = 16, forest()
    nodes = spark.createDataFrame([r for t, n in trees.items() for r in listed(t, n, piece)], SCHEMA)
    got = {}
    for r in sorted(M.spans(nodes, piece).collect(), key=lambda r: (r.tree, r.ord)):
        got.setdefault(r.tree, []).append(r)
    for t, node in trees.items():
        data, at = token(b"nix-archive-1") + walked(node), 0
        for k, r in enumerate(got[t]):
            assert (r.ord, r.off) == (k, at)
            if r.kind == "segment":
                assert hashlib.sha256(data[at : at + r.len]).hexdigest() == r.hash
            at += r.len
        assert at == len(data)
        assert all({a.kind, b.kind} != {"lit"} for a, b in zip(got[t], got[t][1:], strict=False))


def test_manifests_and_checks(spark):
    piece, trees = 16, forest()
    nodes = spark.createDataFrame([(*r, i) for t, n in trees.items() for i, r in enumerate(sorted(listed(t, n, piece), key=lambda r: [x.encode() for x in r[1]]))], f"{SCHEMA}, ord long")
    read = {r.tree: json.loads(r.manifest) for r in M.documents(nodes, piece).collect()}
    assert read[4]["nodes"][0]["path"] == "" and [n["path"] for n in read[4]["nodes"]] == ["", "A", "a", "a-b", "a-b/x", "a.b"] and read[4]["nodes"][4]["segments"] == 7
    spans = M.spans(nodes, piece)
    claims = spans.groupBy("tree").agg(F.sum("len").alias("size"))
    pieces = spans.where("kind = 'segment'").select("tree", "hash", "len")
    assert all(r.ok for r in M.checked(nodes, pieces, claims, piece).collect())
    again = nodes.withColumn("ord", F.when(F.col("tree") == 4, -F.col("ord")).otherwise(F.col("ord")))
    assert [r.tree for r in M.checked(again, pieces, claims, piece).where("not ok").collect()] == [4]
    assert [r.tree for r in M.checked(nodes, pieces.unionByName(spark.createDataFrame([(3, "h", 0)], "tree long, hash string, len long")), claims, piece).where("not lengths_ok").collect()] == [3]
    assert M.spans(nodes.limit(0), piece).count() == 0 and M.documents(nodes.limit(0), piece).count() == 0
    assert api.manifest(nodes, 4, piece).count() == 1 and api.manifest(nodes, 99, piece).count() == 0


def test_emission_cases(spark):
    chunks = [("a", 0, 2, "ab"), ("a", 2, 2, "cd"), ("a", 2, 2, "cd"), ("b", 0, 2, "ab"), ("b", 4, 1, "e"), ("c", 1, 1, "x"), ("d", 0, 1, "x"), ("d", 1, 1, "y")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    trees = [("a", 4, sha("abcd")), ("b", 5, sha("abcde")), ("c", 2, sha("zx")), ("d", 2, sha("no")), ("e", 0, sha("")), ("f", 3, None)]
    got = M.emitted(spark.createDataFrame(chunks, "tree string, off long, len long, data string"), spark.createDataFrame(trees, "tree string, size long, hash string")).collect()
    assert {r.tree: (r.emitted, r.complete, r.withheld) for r in got} == {"a": (4, True, False), "b": (2, False, False), "c": (0, False, False), "d": (1, True, True), "e": (0, True, False), "f": (0, False, False)}


def test_reads_plans_and_outcomes(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, None), (3, "")], "tree long, text string")
    reads = spark.createDataFrame([(1, 2, 3), (1, 4, 3), (2, 0, 1), (3, 0, 0), (9, 0, 1)], "tree long, off long, len long")
    assert sorted((r.tree, r.off, r.ok, r.data) for r in M.read_exactly(texts, reads).collect()) == [(1, 2, True, "cde"), (1, 4, False, None), (2, 0, False, None), (3, 0, True, ""), (9, 0, False, None)]
    plan, ranges = api.plan_transfer(spark.createDataFrame([(1, 200), (2, 50), (3, 0)], "tree long, size long"), spark.createDataFrame([(1, 0, 0, 64, "x"), (1, 1, 64, 64, "y"), (1, 2, 128, 64, "x")], "tree long, ord int, off long, len long, hash string"))
    assert sorted(map(tuple, plan.collect())) == [(1, "manifest", 2, 128), (2, "whole", 1, 50), (3, "whole", 0, 0)] and [tuple(r) for r in ranges.collect()] == [(1, 0, 128, 2)]
    out = spark.createDataFrame([(206, 5, 5), (206, 5, 4), (206, 5, None), (410, 5, 0), (503, 5, 0), (404, 5, 0), (None, 5, 0)], "s int, a int, g int").select(M.outcome(F.col("s"), F.col("a"), F.col("g")).alias("o"))
    assert [r.o for r in out.collect()] == ["ok", "short", "short", "gone", "strike", "refused", "strike"]


def test_lookups(spark):
    from quarry.functions import codecs as X

    h = ["%064x" % (i * 7919) for i in range(4)]
    rows = spark.createDataFrame([("/b", h[0]), ("/a", h[0]), ("/c", h[1]), ("/d", None), (None, h[2])], "path string, content string")
    stored = rows.withColumn("hash", F.concat(F.lit("sha256:"), F.when(F.col("path") == "/a", X.base32("content")).otherwise(F.col("content"))))
    probes = spark.createDataFrame([(h[0],), (h[0],), (h[2],), (h[3],), (None,), ("zz",)], "content string")
    assert sorted(map(tuple, lookups.by_content(stored, probes).collect()), key=str) == sorted([(h[0], "/a"), (h[2], None)], key=str)
    assert [r.path for r in lookups.prefix_scan(rows, "path", "/", 2).collect()] == ["/a", "/b"]
    now, seen = (spark.createDataFrame(v, "source string, version long") for v in ([("a", 1), ("b", 2), ("c", 3), ("d", None)], [("a", 1), ("b", 1), ("d", None)]))
    assert sorted(r.source for r in lookups.changed(now, seen).collect()) == ["b", "c"]
    held = spark.createDataFrame([("x", "1"), ("x", "1"), ("y", "2"), (None, "3")], "origin string, content string")
    assert [r.content for r in lookups.possession(held, "x").collect()] == ["1"] and lookups.possession(held, "none").count() == 0
    away = spark.createDataFrame([("/p", "b", "o1"), ("/p", "a", "o2"), ("/p", "a", "gone"), ("/q", "c", "gone")], "path string, content string, origin string")
    assert sorted(map(tuple, lookups.most_available(away, spark.createDataFrame([("o1",), ("o2",)], "origin string")).collect())) == [("/p", "a", 1), ("/q", "c", 0)]
    described = lookups.described(spark.createDataFrame([(1, "/b", 5), (2, "/a", None)], "id long, path string, size long"), spark.createDataFrame([(1, 2), (1, 1), (1, 2), (2, 9)], "referrer long, reference long"))
    assert sorted(map(tuple, described.collect())) == [("/a", None, "", "no size"), ("/b", 5, "/a,/b", None)]


def test_capped_decompression(spark):
    from quarry.functions.compress import round_trip, unpacked

    rows = spark.createDataFrame([(1, "x" * 1000), (2, "x" * 1001), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in round_trip(rows, "doc_id", "text", 1000).collect()}
    assert [got[k].accepted for k in (1, 2, 3, 4)] == [True, False, True, True] and got[1].sha256 == hashlib.sha256(b"x" * 1000).hexdigest() and got[2].sha256 is None
    import zstandard

    assert unpacked(b"no zstd at all", 10) is None and unpacked(zstandard.ZstdCompressor().compress(bytes(10**8)), 1 << 20) is None


@pytest.mark.parametrize("part", [None, "p" * 32])
def test_resolve_endpoint(spark, part):
    c = ["%064x" % i for i in range(4)]
    p, q = "p" * 32, "q" * 32
    facts = spark.createDataFrame([
        (p, f"/s/{p}-n", c[0], 5, ["r"], ["k:1"], None, True), (p, f"/s/{p}-n", c[1], 5, [], [], "fixed", None), (p, f"/s/{p}-n", c[2], 5, [], ["k:1"], None, False), (q, f"/s/{q}-m", c[3], 5, [], [], "fixed", None), (q, None, c[0], 5, [], [], "fixed", None),
    ], "hash_part string, path string, content string, size long, refs array<string>, sigs array<string>, ca string, verified boolean")
    origins = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("c", 0, False), ("d", 2, True)], "origin string, tier int, live boolean")
    held = spark.createDataFrame([("a", c[0]), ("a", c[0]), ("d", c[0]), ("a", c[1]), ("b", c[1]), ("a", c[2]), ("b", c[2]), ("d", c[2]), ("c", c[3]), (None, c[3])], "origin string, content string")
    got = api.resolve(facts, held, origins, part).collect()
    assert [(r.path, r.content, r.sources, r.tier) for r in got] == [(f"/s/{p}-n", c[1], 2, 1)] and got[0].info.startswith(f"StorePath: /s/{p}-n\n")
    assert api.resolve(facts, held, origins, "x" * 32).count() == 0
