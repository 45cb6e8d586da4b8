import random

import pytest
from hypothesis import given, settings as settings_, strategies as st
from pyspark.sql import functions as F

from quarry.functions import codecs as X
from quarry.functions.signature import any_valid, valid
from quarry.operators import catalog, content, folds, journal
from quarry.sources import settings


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- algebra of facts ---------------------------------------------------------------------------------


def test_merge_commutes_and_is_idempotent(spark):
    rng = random.Random(1)
    a = [(rng.randrange(6), rng.randrange(4), f"p{rng.randrange(3)}") for _ in range(40)]
    b = [(rng.randrange(6), rng.randrange(4), f"p{rng.randrange(3)}") for _ in range(40)]
    x, y = (spark.createDataFrame(v, "k int, n int, p string") for v in (a, b))
    m = lambda *d: rows(catalog.merge_body(d[0] if len(d) == 1 else d[0].unionByName(d[1]), ["k"], ["n", "p"]))
    once = m(x, y)
    assert once == m(y, x) == m(spark.createDataFrame(once, "k int, n int, p string"), x)
    assert catalog.merge_changes(x.unionByName(y), x, ["k"], ["n", "p"]).count() == 0


def test_tree_is_maintained_and_repaired(spark):
    rng = random.Random(2)
    facts = [(rng.randrange(1 << 16), rng.randrange(-(1 << 60), 1 << 60), rng.randrange(-(1 << 60), 1 << 60)) for _ in range(300)]
    df = lambda v: spark.createDataFrame(v, "leaf int, hi long, lo long")
    every, some = df(facts), df(facts[:180])
    assert rows(catalog.maintained(catalog.fact_leaves(some), df([]), df(facts[180:]))) == rows(catalog.fact_leaves(every))
    assert rows(catalog.maintained(catalog.fact_leaves(every), df(facts[180:]), df([]))) == rows(catalog.fact_leaves(some))
    assert rows(catalog.fact_root(every)) == rows(catalog.fact_root(catalog.fact_coarse(catalog.fact_leaves(every))))
    assert rows(catalog.missing(some, every).select("leaf", "hi", "lo")) == rows(df(facts[180:]))
    assert catalog.missing(every, every).count() == 0
    assert rows(catalog.fact_root(df([]))) == [(0, 0)]


# --- journals -------------------------------------------------------------------------------------------


def test_apply_cases(spark):
    clocks = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("c", 2, 5), ("d", 1, 2)], "origin string, generation long, seq long")
    suffix = [("a", 1, 1), ("a", 1, 2), ("b", 1, 9), ("c", 1, 6), ("d", 2, 1), ("new", 7, 1), ("new", 7, 2)]
    s = spark.createDataFrame([(*x, "have", "h") for x in suffix], "origin string, generation long, seq long, op string, content string")
    outcome, taken = journal.applied(s, clocks, s)
    assert rows(outcome) == [("a", "replayed", 0), ("b", "needs_snapshot", 0), ("c", "ignored", 0), ("d", "needs_snapshot", 0), ("new", "applied", 2)]
    assert taken.count() == 2


def test_snapshot_replaces_unless_stale(spark):
    held = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "origin string, content long")
    clocks = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "origin string, generation long, seq long")
    new = spark.createDataFrame([("a", 3), ("b", 3)], "origin string, content long")
    for snap, want in (([("a", 1, 9)], held), ([("a", 1, 10)], None), ([("a", 2, 1)], None)):
        got = rows(catalog.replaced(held, clocks, spark.createDataFrame(snap, "origin string, generation long, seq long"), new))
        assert got == (rows(want) if want is not None else [("a", 3), ("b", 1)])


def test_fold_gaps_and_pages(spark):
    j = spark.createDataFrame([("a", 1, "have", "x"), ("a", 2, "have", "y"), ("a", 3, "drop", "x"), ("b", 1, "drop", "z"), ("b", 3, "have", "z")], "origin string, seq long, op string, content string")
    assert rows(journal.fold(j)) == [("a", "y", 2), ("b", "z", 3)]
    assert rows(journal.gaps(j)) == [("a", 3, 0, None, True), ("b", 2, 1, 3, False)]
    page = spark.createDataFrame([("a", i, 10) for i in range(1, 6)], "origin string, seq long, bytes long")
    assert rows(catalog.byte_prefix(page, ["origin"], ["seq"], 15).select("seq", "truncated")) == [(1, True)]
    assert rows(catalog.byte_prefix(page, ["origin"], ["seq"], 1).select("seq", "truncated")) == [(1, True)]
    assert len(rows(catalog.byte_prefix(page, ["origin"], ["seq"], 50).where("not truncated"))) == 5
    assert rows(journal.compacted(page.select("origin", "seq"), spark.createDataFrame([("a", 3)], "origin string, floor long"))) == [("a", 4), ("a", 5)]


def test_a_second_diff_is_empty(spark):
    local, held = spark.createDataFrame([(1,), (2,)], "content long"), spark.createDataFrame([(2,), (3,)], "content long")
    assert rows(journal.full_diff(local, held)) == [(1, "have"), (3, "drop")]
    assert journal.full_diff(local, local).count() == 0


def test_range_plan_covers_the_backlog(spark):
    asks = journal.range_asks(spark.createDataFrame([("a", 0, 10), ("b", 5, 5)], "origin string, cursor long, target long"), 4, 2)
    assert rows(asks) == [("a", 0, 4, 0), ("a", 4, 8, 0), ("a", 8, 10, 1)]


# --- content --------------------------------------------------------------------------------------------


def test_ranges(spark):
    spans = spark.createDataFrame([("t", 0, 10), ("t", 12, 5), ("t", 100, 1)], "tree string, off long, len long")
    assert rows(content.coalesced(spans, 2)) == [("t", 0, 17, 2), ("t", 100, 101, 1)]
    segs = spark.createDataFrame([("t", i, i * 64, 64 if i < 3 else 7) for i in range(4)], "tree string, ord int, off long, len long")
    for a in (0, 1, 63, 64, 65, 100, 198):
        for z in (a, a + 1, 64, 128, 199):
            got = content.resolved(segs, spark.createDataFrame([("t", a, z)], "tree string, start long, end long"), 64).collect() if z > a else []
            assert sum(r.end - r.start for r in got) == max(0, z - a)
    assert rows(content.pieces(spark.createDataFrame([("t", 0, 5, 12)], "tree string, ord int, start long, end long"), 3)) == [("t", 0, 11, 12), ("t", 0, 5, 8), ("t", 0, 8, 11)]


def test_floor_lookup(spark):
    p = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "key string, at long, probe long")
    e = spark.createDataFrame([("a", 2, 10), ("a", 5, 11), ("a", 7, 12), ("c", 1, 13)], "key string, at long, entry long")
    assert rows(content.floor_lookup(p, e)) == [(1, 11), (2, None), (3, None)]


@settings_(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9)), max_size=40), st.integers(0, 25))
def test_residency_properties(uses, budget):
    """The budget is never exceeded, every content is fetched first, and what is cached was promised when it was fetched."""
    size = {}
    uses = [(k, size.setdefault(k, n)) for k, n in uses]
    keys = [k for k, _ in uses]
    plan, promised, most = folds.Residency(budget), {}, 0
    for i, (k, n) in enumerate(uses):
        step, kept = plan.add(str(k), n, keys.count(k), k not in keys[:i], k not in keys[i + 1 :])
        assert plan.used <= budget and plan.used == sum(plan.resident.values())
        if k not in keys[:i]:
            assert step == "fetch" and kept in (0, keys.count(k) - 1)
            promised[k] = kept
        else:
            assert (step == "cached") == (promised[k] > 0) and kept == 0
    assert not plan.resident


def test_residency_without_a_limit_fetches_each_content_once():
    keys = list("abcabcxa")
    plan = folds.Residency(10**9)
    steps = [plan.add(k, 3, keys.count(k), k not in keys[:i], k not in keys[i + 1 :])[0] for i, k in enumerate(keys)]
    assert steps == ["fetch", "fetch", "fetch", "cached", "cached", "cached", "fetch", "cached"]


# --- estimators -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("best", [3, 25, 90])
def test_governor_climbs_to_the_best_limit(best):
    """Throughput rises up to `best` streams and falls beyond; the limit settles around it from either side."""
    for start in (2, 200):
        g, limit, late = folds.Governor(start, 1, 300), start, []
        for epoch in range(160 * folds.PROBES):
            limit = g.observe(100.0 * min(limit, best**2 / limit), False, 9, 1)
            if epoch > 120 * folds.PROBES:
                late.append(limit)
        middle = sorted(late)[len(late) // 2]
        assert best / 2 <= middle <= 2 * best + 2, (start, middle)


def test_governor_keeps_its_bounds_and_backs_off():
    rng = random.Random(5)
    g = folds.Governor(9, 3, 17)
    for _ in range(500):
        assert 3 <= g.observe(rng.random(), rng.random() < 0.1, rng.randrange(9), rng.randrange(4)) <= 17
    h = folds.Governor(20, 1, 64)
    assert [h.observe(1.0, False, 1, 3) for _ in range(3)] == [14, 10, 7] and h.observe(1.0, False, 1, 2) == 7


@settings_(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.floats(0, 1e6), st.booleans()), max_size=60))
def test_weights_keep_their_bounds(log):
    pool = folds.WeightPool(list("abc"))
    for peer, size, ok in log:
        before = pool.weight[peer]
        pool.observe(peer, size, 0.01, ok)
        assert all(folds.WEIGHT_FLOOR <= w <= 1 for w in pool.weight.values()) and 0 <= pool.loss <= 1
        assert ok or pool.weight[peer] <= before + 0.01 or before == min(pool.weight.values())
    share, floor = pool.shares(list("abc"), "b")
    assert 0 < floor <= share + 1e-12 <= 1 + 1e-12


def test_the_best_of_three_peers_is_drawn_most():
    """Also after the rates turn round."""
    pool, draws = folds.WeightPool(["near", "far", "thin"]), folds.Draws(seed=11)
    for rates in ({"near": 9e5, "far": 3e5, "thin": 1e5}, {"near": 1e5, "far": 3e5, "thin": 9e5}):
        picks = []
        for _ in range(500):
            picks.append(draws.pick(pool.weight))
            pool.observe(picks[-1], rates[picks[-1]] * 0.5, 0.5, True)
        late = picks[250:]
        assert max(set(late), key=late.count) == max(rates, key=rates.get)


def test_draws_follow_the_weights():
    draws, weights = folds.Draws(seed=3), {"a": 5.0, "b": 0.0, "c": 2.0, "d": 1.0}
    got = [draws.pick(weights) for _ in range(8000)]
    assert [round(got.count(n) / 1000) for n in "abcd"] == [5, 0, 2, 1]
    assert {draws.pick({"a": 0.0, "b": 0.0}) for _ in range(50)} == {"a", "b"} == {draws.pick({"a": float("nan"), "b": 1.0}) for _ in range(50)} and draws.pick({}) is None


def test_folds_leave_out_nulls_and_take_empty_tables(spark):
    log = [("k", 1, 1.0), ("k", 2, None), ("k", 3, 3.0), (None, 1, 5.0), ("m", None, 1.0)]
    df = spark.createDataFrame(log, "key string, t long, value double")
    step = lambda s, r: (r.t, s.add(r.value))
    assert rows(folds.folded(df, ["key"], ["t"], folds.Ewma, step, "t long, rate double")) == [("k", 1, 1.0), ("k", 3, 0.7 + 0.3 * 3)]
    assert rows(folds.folded(df, ["key"], ["t"], folds.Ewma, step, "t long, rate double", last=True)) == [("k", 3, 0.7 + 0.3 * 3)]
    assert folds.folded(df.limit(0), ["key"], ["t"], folds.Ewma, step, "t long, rate double").count() == 0
    e = folds.Ewma()
    assert e.add(4.0, 0.0001) == 0.0 and e.add(4.0) == 4.0 and e.add(9.0, folds.SHORTEST) == 4.0


def test_breaker_opens_again_after_a_failed_probe():
    b = folds.Breaker(2, 100)
    b.observe(0, False)
    assert b.available(0)
    b.observe(1, False)
    assert not b.available(50) and b.opens == 1
    b.observe(50, False)
    assert b.opens == 1
    b.observe(151, False)
    assert b.opens == 2
    b.observe(200, True)
    assert b.available(200) and b.strikes == 0


def test_levels_and_budgets():
    assert folds.next_level(9, 0, 1.0, 0.9, 0.05, 0.01, False) == 7
    assert folds.next_level(9, 0, 1.0, 0.01, 0.05, 0.01, False) == 12
    assert folds.next_level(9, 0, 1.0, 0.3, 0.9, 0.01, True) == 9
    assert folds.next_level(3, 5e6, 1.0, 0, 0, 0, False) == 9
    seen, b = [], 256 << 20
    for _ in range(4):
        b = folds.next_budget(b, 32 << 20, 256 << 20, 1.0)
        seen.append(b >> 20)
    assert seen == [128, 64, 32, 32] and folds.next_budget(b, 32 << 20, 256 << 20, 0.0) >> 20 == 41


def test_pages_are_greedy_and_never_empty():
    p = folds.Pages(10)
    assert [p.add(s) for s in (4, 6, 1, 20, 3)] == [0, 0, 1, 2, 3]


def test_epochs_close_on_the_first_event_after_expiry():
    e = folds.Epochs(1000)
    assert e.add(0, 5, True) is None and e.add(500, 5, False) is None
    assert e.add(1500, 10, True) == (0, 1500, 10000.0, False, 2, 1)
    assert e.add(1600, 0, True, True) is None and e.add(2600, 0, True)[3]


def test_leases_and_cache():
    l = folds.Leases(100)
    assert l.claim(0, "x") and not l.claim(50, "y") and l.claim(50, "x") and l.claim(160, "y")
    l.release("y")
    assert l.claim(161, "x")
    c = folds.LruCache(10)
    assert c.use("a", 6) == (False, 0) and c.use("b", 4) == (False, 0) and c.use("a", 6) == (True, 0) and c.use("c", 4) == (False, 1)
    assert set(c.held) == {"a", "c"} and c.use("big", 50) == (False, 2)


def sized(r):
    return int(min(max(2 * r, 256 << 10), 4 << 20)) if r else 1 << 20


@pytest.mark.parametrize("failing", [{}, {"slow": 2}, {"fast": 3, "mid": 1, "slow": 4}])
def test_replayed_transfer_covers_the_content_once(failing):
    """What won covers the content without gap or overlap; a failed chunk is asked again after the gate at the earliest."""
    rates = {"fast": 7e6, "mid": 4e6, "slow": 1e6}
    t = folds.Transfer(33 << 20, rates, sized, failing=failing)
    done = sorted((o, n) for _, o, n, _, _, ok, won in t.log if won)
    assert t.outcome == "completed" and done[0][0] == 0 and sum(n for _, n in done) == 33 << 20 and all(a + n == b for (a, n), (b, _) in zip(done, done[1:], strict=False))
    assert sum(not ok for *_, ok, _ in t.log) <= sum(failing.values())
    for p, off, _, _, end, ok, _ in t.log:
        if not ok:
            later = [began for _, o, _, began, _, _, _ in t.log if o == off and began >= end]
            assert not later or min(later) >= end + 0.1 - 1e-9
    brought = {p: sum(n for q, _, n, _, _, _, won in t.log if won and q == p) for p in rates}
    assert brought["fast"] == max(brought.values())


def test_transfers_that_end_early():
    t = folds.Transfer(9 << 20, {"a": 1e6, "b": 1e6}, sized, failing={"a": 99, "b": 99}, streak=7)
    assert t.outcome == "streak" and len(t.log) == 7 and not any(won for *_, won in t.log)
    slow = folds.Transfer(500 << 20, {"a": 2e5}, sized, least=1e6, grace=10.0)
    assert slow.outcome == "min_bandwidth" and slow.now >= 10
    assert folds.Transfer(0, {"a": 1.0}, sized).log == [] and folds.Transfer(0, {"a": 1.0}, sized).outcome == "completed"
    late = folds.Transfer(1 << 20, {"a": 1e3}, sized, streak=2)  # a chunk that can't be there in 20 seconds
    assert late.outcome == "streak" and [round(end - began) for _, _, _, began, end, _, _ in late.log] == [20, 20]


def test_a_weak_peer_is_hedged():
    t = folds.Transfer(64 << 20, {"near": 2e7, "weak": 2e5}, sized)
    twice = [o for o in {o for _, o, *_ in t.log} if sum(x[1] == o and x[5] for x in t.log) > 1]
    assert t.outcome == "completed" and all(sum(x[1] == o and x[6] for x in t.log) == 1 for o in twice)
    assert folds.hedge_chance(2, 0.5, 0.03) == 0 and folds.hedge_chance(2, 0.03, 0.03) == 1 and 0 < folds.hedge_chance(4, 0.1, 0.03) < 1
    assert folds.deadline(1000, 0) == 20 and folds.deadline(10**6, 1e6) == 10 and folds.deadline(10**9, 1e6) == 300


# --- codecs ---------------------------------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_codecs(spark):
    for h, b in (("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "0mdqa9w1p6cmli6976v4wi0sw9r4p5prkj7lzfd1877wk11c9c73"), ("8388b2964cf255ccd6dfe853647927b7a44d3bd583175f932b9955c54d866239", "0fb2hr6wamcr5f9my5w3slxlv95p4xwn8lz8vzbcqmgj9jbb5243")):
        assert one(spark, X.base32(F.lit(h))) == b and one(spark, X.unbase32(F.lit(b))) == h
        assert one(spark, X.hash_column(F.lit(f"sha256:{b}"))) == h == one(spark, X.hash_column(F.lit(f"sha256:{h}")))
    assert one(spark, X.unbase32(F.lit("zz"), 1)) is None and one(spark, X.unbase32(F.lit("abc"))) is None and one(spark, X.hash_column(F.lit("md5:00"))) is None
    for text, want in (("0", 0), ("512", 512), ("16MiB", 16777216), ("1.5KiB", 1536), ("2GiB", 2147483648), ("5MB", None), ("x", None)):
        assert one(spark, X.byte_size(F.lit(text))) == want
    ranges = {"bytes=0-4": ("partial", 0, 5), "bytes=-3": ("partial", 7, 10), "bytes=8-": ("partial", 8, 10), "bytes=9-2": ("unsatisfiable", None, None), "bytes=10-": ("unsatisfiable", None, None), "bytes=-0": ("unsatisfiable", None, None), "bytes=0-1,3-4": ("full", None, None), "bytes=a-": ("full", None, None), None: ("full", None, None), f"bytes=2-{2**64 - 1}": ("partial", 2, 10)}
    for header, want in ranges.items():
        assert tuple(one(spark, X.byte_range(F.lit(header).cast("string"), F.lit(10)))) == want, header
    assert one(spark, X.pressure_avg10(F.lit("some avg10=1.25 avg60=0"))) == 1.25 and one(spark, X.pressure_avg10(F.lit("garbage"))) is None
    none = F.lit(None).cast("double")
    for signals, want in (((5.0, None, None, None), 1.0), ((None, None, 0.95, None), 1.0), ((None, None, None, 0.05), 1.0), ((None,) * 4, 0.0)):
        assert one(spark, X.severity(*[none if s is None else F.lit(s) for s in signals])) == pytest.approx(want)


def test_info_text_round_trip(spark):
    h = "07" * 32
    text = X.info_text(F.lit("/store/p"), F.lit(h), F.lit(1234), F.array(F.lit("r")), F.lit(None).cast("string"), F.array(F.lit("k:s")), F.lit("fixed:x"))
    got = one(spark, X.parsed_info(text))
    assert (got.path, got.content, got.size, list(got.refs), list(got.sigs), got.ca, got.deriver, got.compression) == ("/store/p", h, 1234, ["r"], ["k:s"], "fixed:x", None, "none")
    assert one(spark, X.parsed_info(F.lit("StorePath: /x\nbroken\n"))) is None


def test_signatures():
    # RFC 8032, test 2
    public = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    sig = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    assert valid(public, b"\x72", sig) and not valid(public, b"\x73", sig) and not valid(public, b"\x72", sig[:-1] + b"\x01")
    import base64

    keys = {"k": base64.b64encode(public).decode()}
    assert any_valid("r", ["x:AA==", f"k:{base64.b64encode(sig).decode()}"], keys) and not any_valid("r", [f"j:{base64.b64encode(sig).decode()}"], keys)


def test_settings(spark):
    import base64

    key = lambda c: base64.b64encode(c * 32).decode()
    lines = ["# x", f"trusted-public-keys = old:{key(b'a')}", f"trusted-public-keys = a:{key(b'b')} bad:xx # note", f"extra-trusted-public-keys = e:{key(b'c')}", "noise"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, line int")
    assert rows(settings.trusted_keys(df)) == [("a", key(b"b")), ("e", key(b"c"))]
    assert settings.Config().problems() == []
    bad = settings.Config(name="p", peers=[("p", "https://x"), ("q", "http://y"), ("q", "http://z")], segment=10, breaker_failures=0, encodings={"p": "gzip", "q": "zstd:3", "r": "none"})
    assert len(bad.problems()) == 7
    assert settings.Config.read({"peers": [("a", "http://a")], "encodings": {"a": "zstd:22"}}).problems() == []
    with pytest.raises(ValueError):
        settings.Config.read({"peer": []})


def test_segments_of_any_length_resolve(spark):
    """Also those longer than a bucket: each overlap once."""
    rng, segs, at = random.Random(8), [], 0
    for i in range(30):
        n = rng.choice([0, 1, 5, 63, 64, 65, 300])
        segs.append(("t", i, at, n))
        at += n
    ranges = [("t", a, min(at, a + rng.choice([1, 7, 64, 500]))) for a in range(0, at - 1, 37)]
    got = rows(content.resolved(spark.createDataFrame(segs, "tree string, ord int, off long, len long"), spark.createDataFrame(ranges, "tree string, start long, end long"), 64))
    want = [("t", i, max(o, a), min(o + n, z)) for _, i, o, n in segs for _, a, z in ranges if n and o < z and o + n > a]
    assert got == sorted(want, key=str)
