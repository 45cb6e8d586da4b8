import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm.jaccard import jaccard_components, keep_one

SCHEMA = "doc_id long, text string, lang string, n long, label long"


def brute(rows, k=4, share=85):
    sets = []
    for _, text, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(low.get(top(i), r[0]), r[0])
    return Counter((r[0], len(s), low.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def same(spark, rows, **how):
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), **how).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([3, 4, 9, 30, 60, 200, 700]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            t = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1, 1])] = [rng.choice(words)] * rng.choice([0, 1, 1, 2])
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(t), "en", 1, 2))
    same(spark, rows)


@pytest.mark.parametrize("run", [3, 32])
def test_one_class_over_several_blocks(spark, run):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(60):
        t = list(base)
        for at in rng.sample(range(90), rng.choice([1, 1, 2, 3])):
            t[at] = f"x{i}"
        rows.append((i * 3, " ".join(t), "en", 1, 2))
    same(spark, rows, run=run, block=8)  # the class of 60 goes to sparse tasks, with short runs to dense ones


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", 0, 1), (3, " \n\t", "en", 0, 1), (4, "a b", "en", 3, 1), (5, "A  B", "en", 3, 1), (None, "a b", None, 3, 1),
        (6, "one two three four five six", "x", 1, 1), (6, "one two three four five six", "x", 1, 1), (7, "ONE two THREE four five six É", "x", 1, 1), (7, "q", "x", 1, 1),
        (8, "word " * 3000, "x", 1, 1), (9, "word " * 2900, "x", 1, 1), (10, "é É", "x", 1, 1), (11, "é é", "x", 1, 1), (None, "z y", "x", 1, 1), (12, "\x00 \x0b\x85 b", None, 1, 1),
    ]
    same(spark, rows)
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.kernels.PIECE", 1 << 12)
    monkeypatch.setattr("quarry.llm.kernels.CHUNK", 1 << 11)
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(20_000))
    same(spark, [(1, long, "", 1, 1), (2, f"{long} more", "", 1, 1), (3, "x" * 30_000 + " y z", "", 1, 1), (4, "short one", "", 1, 1)])


def plain_links(rows, k=4, share=85):
    """(doc_id, n_links) by comparing all pairs of rows."""
    sets = []
    for _, text, *_ in rows:
        w = text.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    near = lambda a, b: a and b and 100 * len(a & b) >= share * len(a | b)
    return Counter((r[0], sum(bool(near(a, b)) for j, b in enumerate(sets) if j != i)) for i, (r, a) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("how", [{}, {"run": 3, "block": 8}, {"run": 6, "block": 8}, {"run": 32, "block": 8}, {"run": 3, "block": 2}])
def test_number_of_links(spark, how):
    """Each pair once, however it is dealt: copies, whole classes, pairs of short runs, blocks of long runs."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = [(1000, "", "en", 1, 2), (1001, "one alone of all", "en", 1, 2), (1002, "two alike", "en", 1, 2), (1003, "two  alike", "en", 1, 2)]
    for i in range(48):
        t = list(base)
        for at in rng.sample(range(90), rng.choice([1, 1, 2, 3])):
            t[at] = f"x{i}"
        rows += [(len(rows), " ".join(t), "en", 1, 2)] * rng.choice([1, 1, 1, 2])
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), **how).select("doc_id", "n_links").collect()
    assert Counter(tuple(r) for r in got) == plain_links(rows)


def test_sets_that_share_their_digest(spark):
    """With five bits of the first digest most sets have another one's; they keep nodes of their own."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([2, 5, 20]))), "en", 1, 2) for i in range(40)]
    rows += [(100 + i, r[1] + (" more" if i % 3 else ""), *r[2:]) for i, r in enumerate(rows)]
    same(spark, rows, bits=5)
    kept = keep_one(spark.createDataFrame(rows, SCHEMA), bits=5).collect()
    low = {}
    for (d, _, c), n in brute(rows).items():
        low[c] = min(low.get(c, d), d)
    assert sorted(r.doc_id for r in kept) == sorted(low.values())


@pytest.mark.parametrize("sent", [1, 3, 7, 1000])
def test_runs_over_batches(monkeypatch, sent):
    """However the sorted rows are cut: short runs are paired, members of long ones and far ones named once."""
    import pyarrow as pa

    from quarry.llm import jaccard

    monkeypatch.setattr(jaccard, "SENT", sent)
    rng = random.Random(sent)
    for _ in range(60):
        run = rng.choice([1, 2, 4])
        data = []
        for sig in rng.sample(range(-50, 50), rng.randrange(12)):
            for i in rng.sample(range(20), rng.choice([1, 1, 2, 3, 5, 9])):
                data += [(sig, i, i % 5, rng.random() < 0.1)] * rng.choice([1, 1, 2])
        pack = lambda r: int(jaccard.packed(np.array([r[0] * 512 % 2**64], np.uint64), np.array([r[2]]), np.array([r[3]]))[0])
        data.sort(key=lambda r: (pack(r), r[1]))
        batches, at = [], 0
        while at < len(data):
            n = rng.randrange(1, 6)
            cols = list(zip(*data[at : at + n], strict=True))
            batches.append(pa.record_batch([pa.array([pack(r) for r in data[at : at + n]], pa.int64()), pa.array(cols[1], pa.int64())], ["sig", "id"]))
            at += n
        pairs, long = Counter(), set()
        for b in jaccard._runs(run)(iter(batches)):
            for r in b.to_pylist():
                if r["long"]:
                    long.add((r["src"], r["dst"]))  # a copy beyond a cut names it again, which candidates take once
                else:
                    pairs[r["src"], r["dst"]] += r["n"]
        want, wide = Counter(), set()
        for sig in {r[0] for r in data}:
            ids = sorted({r[1] for r in data if r[0] == sig})
            if len(ids) > run or any(r[3] for r in data if r[0] == sig):
                wide |= {(i, sig) for i in ids}
            else:
                want.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
        assert pairs == want and long == wide
