import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm.mixing import _hyper, _plan_of, mixed, quotas, split_quotas

SCHEMA = "doc_id long, text string, source string, size long, draws string"


def rows(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 20, 80, 400])
        out.append((i, " ".join("x" * rng.randrange(1, 4) for _ in range(k)), rng.choice(["a", "a", "a", "b", "c", "é", "", None]), 7, "s"))
    return out + [(1000, None, "a", 1, None), (1001, " \n ", "zero", 1, None), (None, "a b c", "a", 1, ""), (None, "a b c", "a", 1, ""), (3, "q r", "one", 1, "")]


def expected(data):
    size = defaultdict(int)
    for _, text, source, *_ in data:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            free.discard(s)
        left = 1.5 * sum(size.values()) - sum(target.values())
    return size, target


@pytest.mark.parametrize("block_words", [50_000, 300])
def test_targets_and_draws(spark, block_words):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    got = quotas(docs, block_words=block_words, shards=4).collect()
    size, target = expected(data)
    source = defaultdict(list)
    for d, text, s, *_ in data:
        source[d, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))].append(s)
    assert len(got) == len(data)
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r["size"]].pop()
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(d.words for d in r.draws)
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 2
    again = quotas(docs.repartition(7), block_words=block_words, shards=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_repeats_whole_rows(spark):
    data = rows(120)
    docs = spark.createDataFrame(data, SCHEMA)
    want = Counter()
    for r in quotas(docs, block_words=200, shards=4).collect():
        want[r.doc_id] += len(r.draws)
    out = mixed(docs, block_words=200, shards=4)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == +want
    assert {tuple(r) for r in got} <= set(data)


def test_hypergeometric_frequencies(spark):
    df = spark.range(20_000).selectExpr(f"{_hyper('20L', '8L', '10L', '((id + 0.5D) / 20000)')} as k")
    got = {r.k: r["count"] / 20_000 for r in df.groupBy("k").count().collect()}
    from math import comb

    for k in range(9):
        assert abs(got.get(k, 0) - comb(8, k) * comb(12, 10 - k) / comb(20, 10)) < 2e-4


def test_shards_hold_disjoint_quotas(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = quotas(docs, block_words=500, shards=8).select(F.explode("draws").alias("d")).groupBy("d.shard").agg(F.sum("d.words").alias("w")).collect()
    assert len(got) == 8
    total = sum(r.w for r in got)
    assert all(abs(r.w - total / 8) < 0.5 * total / 8 for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quotas(docs).count() == 0 and mixed(docs).count() == 0


def test_tree_deals_exact_quotas_at_random(spark):
    """Every shard gets its part of all draws, every source its own number, and the parts vary as draws without replacement do."""
    quotas_ = {"sa": 3200, "sb": 2400, "sc": 799, "sd": 1, "se": 0}
    cuts = {r.skey: list(r.cuts) for r in split_quotas(spark.createDataFrame(list(quotas_.items()), "skey string, draws long"), 64, 3).collect()}
    assert {k: v[-1] for k, v in cuts.items()} == quotas_
    parts = {k: [b - a for a, b in zip([0, *v], v, strict=False)] for k, v in cuts.items()}
    assert all(p >= 0 for v in parts.values() for p in v) and {sum(x) for x in zip(*parts.values(), strict=True)} == {100}
    for k in ("sa", "sb", "sc"):
        q = quotas_[k] / 6400
        want = 100 * q * (1 - q) * (6400 - 100) / 6399
        mean = sum(parts[k]) / 64
        assert 0.5 * want < sum((p - mean) ** 2 for p in parts[k]) / 63 < 1.8 * want


def test_each_shard_is_a_partition(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    want = Counter(r.shard for r in quotas(docs, block_words=300, shards=8).select(F.explode("draws").alias("d")).select("d.shard").collect())
    out = mixed(docs, block_words=300, shards=8)
    assert out.rdd.getNumPartitions() == 8
    assert dict(enumerate(out.rdd.glom().map(len).collect())) == {k: want.get(k, 0) for k in range(8)}


def test_blocks_grow_with_the_root(spark):
    """With few words a block the number of blocks stays under the root of all words, and the result is as exact."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    sized, of = _plan_of(docs, 1.5, 2, 1, 4, 1)
    words = sized.agg(F.sum("size")).first()[0]
    assert 1 < of.n_blocks <= words**0.5 + of.n_sources
    taken = quotas(docs, block_words=1, shards=4).agg(F.sum("taken")).first()[0]
    assert abs(taken - 1.5 * words) <= 2 * of.n_sources
