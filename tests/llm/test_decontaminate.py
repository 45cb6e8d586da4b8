import hashlib
import random
import re

from quarry.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(k, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def same(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit long, items string")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = contamination(d, b, **how).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def cases():
    rng = random.Random(1)
    vocab = ["the", "of", "and", *[f"w{i}" for i in range(60)]]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 30])))) for i in range(30)]
    items += [(3, "another text of item three here"), (None, "w1 w2 w3 w4"), (90, None), (91, ""), (92, "!!! ..."), (93, items[5][1])]
    docs = []
    for d in range(60):
        t = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            v = (rng.choice(items)[1] or "").split()
            cut = v[rng.randrange(3) :] if len(v) > 4 else v
            t[(at := rng.randrange(len(t) + 1)) : at] = cut
        docs.append((d, rng.choice([" ", ", ", "\n", " - "]).join(t).upper(), 1, "x"))
    return docs + [docs[5], docs[5], (None, docs[7][1], None, None), (5, None, 1, ""), (6, "", 1, ""), (7, "É é wordÉ", 1, "")], items


def test_against_brute_force(spark):
    same(spark, *cases())


def test_several_passes_agree(spark):
    same(spark, *cases(), item_bytes=300)


def test_empty_tables(spark):
    docs, items = cases()
    same(spark, docs[:9], [])
    same(spark, [], items)
