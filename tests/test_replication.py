"""Replication and state operators on small cases: nulls, ties, repeats, empty tables, and every outcome."""

import random

from pyspark.sql import functions as F

from quarry.operators import catalog, replication as R, state as S
from quarry.session import reliable

CLOCK = "origin string, generation long, seq long, tail_seq long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_clock_vectors_and_acks(spark):
    clocks = spark.createDataFrame([("a", 2, 9, 1), ("b", 1, 4, 0)], CLOCK)
    known = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "origin string")
    assert rows(R.clock_vector(known, clocks)) == [("a", 2, 9), ("z", 0, 0)]
    claims = spark.createDataFrame([("p", "a", 2, 5), ("p", "a", 2, 7), ("p", "a", 1, 99), ("q", "b", 1, 4), ("q", "none", 1, 4), (None, "a", 2, 8)], "peer string, origin string, generation long, seq long")
    assert rows(R.recorded_acks(claims, clocks)) == [("p", "a", 7), ("q", "b", 4)]
    assert R.recorded_acks(claims, clocks.limit(0)).count() == 0


def test_generations(spark):
    ours = spark.createDataFrame([("a", 2, 9, 1), ("b", 1, 4, 0), ("c", 3, 1, 0)], CLOCK)
    reports = spark.createDataFrame([("p", "a", 2, 9), ("p", "b", 1, 5), ("q", "b", 7, 1), ("p", "c", 2, 99), ("p", "other", 9, 9)], "peer string, origin string, generation long, seq long")
    assert rows(R.reminted(ours, reports, now=5)) == [("a", 2, 9, 1, False), ("b", 8, 4, 0, True), ("c", 3, 1, 0, False)]
    assert rows(R.reminted(ours, reports, now=50).where("reminted")) == [("b", 50, 4, 0, True)]
    known, own = spark.createDataFrame([("b",)], "origin string"), spark.createDataFrame([("a",), ("new",)], "origin string")
    assert rows(R.opened(ours, known, own, now=6)) == [("a", 2, 9, 1), ("b", 1, 4, 0), ("new", 6, 0, 0)]
    assert rows(R.opened(R.opened(ours, known, own, now=6), known, own, now=7)) == [("a", 2, 9, 1), ("b", 1, 4, 0), ("new", 6, 0, 0)]


def test_gates(spark):
    df = spark.createDataFrame([(5, True, "a"), (11, True, "a"), (5, False, "a"), (5, None, "a"), (5, True, "me"), (5, True, "x"), (5, True, None), (None, True, "a")], "size int, good boolean, who string")
    got = [r.o for r in df.select(R.gate(F.col("size"), F.col("good"), F.col("who"), ["a", "me"], "me", 10).alias("o")).collect()]
    assert got == ["accepted", "too_large", "malformed", "malformed", "self", "unknown", "unknown", "accepted"]


def plain_round(cursor, target, replies, strikes, far):
    """A catch-up round step by step: replies (after, until, covered) in order."""
    if target > cursor + far:
        return "cancelled", cursor
    run, worst, head, open_ = 0, 0, cursor, True
    for after, until, covered in replies:
        run = run + 1 if covered is None else 0
        worst = max(worst, run)
        got = after if covered is None else covered
        if open_ and after <= head:
            head = max(head, got)
        open_ = open_ and got >= until
    return "handed_back" if worst >= strikes else "finished" if head >= target else "running", head


def test_catch_up_against_a_plain_round(spark):
    rng, backlog, replies, want = random.Random(4), [], [], {}
    for k in range(60):
        cursor, target = rng.randrange(9), rng.randrange(60)
        target = max(cursor, target)
        mine = [(a, min(a + 4, target)) for a in range(cursor, target, 4)]
        mine = [(a, z, rng.choice([z, z, z, a + 1, a, None])) for a, z in mine]
        backlog.append((f"o{k}", cursor, target))
        replies += [(f"o{k}", *m) for m in mine]
        want[f"o{k}"] = plain_round(cursor, target, mine, 3, 50)
    got = R.caught_up(spark.createDataFrame(backlog, "origin string, cursor long, target long"), spark.createDataFrame(replies, "origin string, after long, until long, covered long"), far=50).collect()
    assert {r.origin: (r.status, r.cursor) for r in got} == want and {w[0] for w in want.values()} == {"cancelled", "handed_back", "finished", "running"}
    assert R.caught_up(spark.createDataFrame([("a", 1, 5)], "origin string, cursor long, target long"), spark.createDataFrame([], "origin string, after long, until long, covered long")).collect()[0].status == "running"


def test_a_dump_in_pages_is_all_of_it(spark):
    rng = random.Random(6)
    facts = [(f"{rng.randrange(16**4):04x}", k, rng.randrange(8, 200)) for k in range(90)]
    df, cursor, seen, pages = spark.createDataFrame(facts, "part string, id long, bytes long"), None, [], 0
    while True:
        page = sorted(R.dump_page(df, ["part", "id"], cursor, 400, 8).collect(), key=lambda r: (r.part, r.id))
        assert len(page) == 1 or sum(r.bytes for r in page) <= 400
        seen += [(r.part, r.id) for r in page]
        pages += 1
        if not page[-1].resume:
            break
        cursor = (page[-1].part, page[-1].id)
    assert seen == sorted(f[:2] for f in facts) and pages > 10 and R.dump_page(df.limit(0), ["part", "id"], None, 400, 8).count() == 0


def test_repair_reaches_the_same_tree(spark):
    """Round after round of targets, until the trees are equal; the caps of a round only make more rounds."""
    rng = random.Random(7)
    facts = sorted({(rng.choice([rng.randrange(1 << 16), rng.randrange(600)]), rng.randrange(1 << 60), rng.randrange(1 << 60)) for _ in range(260)})
    df = lambda v: spark.createDataFrame(v, "leaf int, hi long, lo long")
    every, mine, kinds, turns = df(facts), set(rng.sample(facts, 120)), set(), 0
    while True:
        targets = R.repair_targets(catalog.fact_leaves(df(sorted(mine))), catalog.fact_leaves(every), coarse=60, wholesale=8, most=100).collect()
        if not targets:
            break
        turns += 1
        assert [t.turn for t in sorted(targets, key=lambda t: t.turn)] == list(range(1, len(targets) + 1)) and len(targets) <= 100
        kinds |= {t.kind for t in targets}
        mine |= {f for f in facts for t in targets if (t.kind == "leaf" and f[0] == t.node) or (t.kind == "bucket" and f[0] >> 8 == t.node)}
    assert mine == set(facts) and kinds == {"leaf", "bucket"} and turns > 1
    assert rows(R.repair_targets(catalog.fact_leaves(df([])), catalog.fact_leaves(every))) == [(1, "root", None)]
    assert R.repair_targets(catalog.fact_leaves(every), catalog.fact_leaves(every)).count() == 0
    children = R.node_children(catalog.fact_leaves(every), [0, 2])
    assert children.count() == 512 and children.where("hi <> 0").count() == len({f[0] for f in facts if f[0] >> 8 in (0, 2)})


def test_sweeps_hints_and_cadence(spark):
    order = rows(R.sweep(spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "peer string"), 4))
    assert order[:6] == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "b"), (1, 1, "c"), (1, 2, "a")] and order[-3:] == [(3, 0, "a"), (3, 1, "b"), (3, 2, "c")]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "src long, dst long")
    assert rows(R.hinted(edges, spark.createDataFrame([(1,), (1,)], "node long"), reliable)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    df = spark.createDataFrame([(True, 1), (False, 1), (None, 179), (False, 180)], "known boolean, age int")
    assert [r.s for r in df.select(R.pull_delay(F.col("known"), F.col("age")).alias("s")).collect()] == [60, 5, 5, 60]


def test_responses(spark):
    clocks = spark.createDataFrame([("a", 1, 9, 3), ("b", 1, 9, 3), ("c", 2, 4, 0), ("d", 1, 5, 0), ("e", 1, 2, 0)], CLOCK)
    asks = spark.createDataFrame([("a", 1, 9), ("b", 1, 5), ("c", 1, 4), ("d", 2, 0)], "origin string, generation long, seq long")
    journal = spark.createDataFrame([("b", s, 10) for s in range(4, 10)] + [("c", 1, 10)], "origin string, seq long, bytes long")
    held = spark.createDataFrame([("c", 1), ("c", 2), ("e", 1)], "origin string, content long")
    assert rows(R.responses(asks, clocks, journal, held, 10_000, 25)) == [("a", "up_to_date", 0, False), ("b", "suffix", 2, True), ("c", "snapshot", 2, False), ("e", "snapshot", 1, False)]
    assert rows(R.responses(asks, clocks, journal, held, 20, 25).where("decision = 'deferred'")) == [("c", "deferred", 0, True), ("e", "deferred", 0, True)]


def test_state(spark):
    meta = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "c", 2), (None, "x", 9), ("m", None, 1)], "key string, value string, version long")
    assert rows(S.latest(meta, "key", "value", "version")) == [("k", "c"), ("m", None)]
    old = spark.createDataFrame([("a", 0.5, 0.1, 3, 10), ("b", 0.5, 0.1, 3, 10), ("gone", 0.5, 0.1, 3, 10)], "peer string, weight double, loss double, seen long, updated long")
    new = spark.createDataFrame([("a", 0.7, 0.2, 4), ("b", 0.9, 0.2, 3), ("new", 1.0, 0.0, 1)], "peer string, weight double, loss double, seen long")
    assert rows(S.saved(old, new, now=99)) == [("a", 0.7, 0.2, 4, 99), ("b", 0.5, 0.1, 3, 10), ("gone", 0.5, 0.1, 3, 10), ("new", 1.0, 0.0, 1, 99)]
    assert [r.peer for r in S.pruned(old, new).orderBy("peer").collect()] == ["a", "b"] and {r.updated for r in S.shifted(old, 50).collect()} == {0}
    inf, nan = float("inf"), float("nan")
    broken = spark.createDataFrame([("a", nan, inf, 0), ("b", -inf, -1.0, 0), ("c", None, None, 0), ("d", 0.0, 9.0, 86_400), ("e", 9.0, 0.5, 0)], "peer string, weight double, loss double, updated long")
    got = {r.peer: (round(r.weight, 12), r.loss) for r in S.restored(broken, now=86_400).collect()}
    assert got == {"a": (1.0, 0.0), "b": (1.0, 0.0), "c": (1.0, 0.0), "d": (0.03, 1.0), "e": (1.0, 0.25)}


def test_levels_caps_and_counts(spark):
    df = spark.createDataFrame([("none", 5), ("zstd:7", 5), ("zstd:", 5), ("auto", 5), (None, 5)], "e string, now int")
    assert [r.v for r in df.select(S.level(F.col("e"), F.col("now")).alias("v")).collect()] == [None, 7, None, 5, 5]
    df = spark.createDataFrame([(5, 5), (11, 11), (11, None), (5, None), (11, 5)], "n int, said int")
    assert [r.v for r in df.select(S.capped(F.col("n"), F.col("said"), 10).alias("v")).collect()] == ["taken", "refused", "cut", "taken", "cut"]
    df = spark.createDataFrame([("12",), ("-1",), ("x",), (None,), ("9" * 30,)], "h string")
    assert [r.v for r in df.select(S.micros(F.col("h")).alias("v")).collect()] == [12, 0, 0, 0, 0]
    t = spark.createDataFrame([("p", "completed", 5, None), ("p", None, None, 2), ("p", "stall", 1, 1), (None, "odd", 1, 1)], "peer string, outcome string, remote long, wire long").withColumns({"replayed": F.lit(0), "literal": F.lit(1)})
    got = {r.peer: r for r in S.transfers(t, "peer").collect()}
    assert (got["p"].started, got["p"].completed, got["p"].stall, got["p"].active, got["p"].remote, got["p"].wire) == (3, 1, 1, 1, 6, 3)
    assert S.transfers(t.limit(0), "peer").count() == 0
    stats = S.status(spark.createDataFrame([("b", 1), ("a", None)], "peer string, ok long"), facts=spark.createDataFrame([(7,)], "n long")).first().status
    assert stats == '{"peers":[{"peer":"a"},{"peer":"b","ok":1}],"facts":7}'
    kept, rebuilt = S.laid_out(spark.createDataFrame([("a", 1), ("b", 1)], "store string, v int"), spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "store string, layout int"), 2, "store")
    assert rows(kept) == [("a", 1)] and rows(rebuilt) == [("b",), ("c",)]
