import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from quarry.llm import langid, mixing
from quarry.llm.jaccard import keep_one
from quarry.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def one_of_each(rows):
    sets, up = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    best = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if top(i) not in best or key < best[top(i)][0]:
            best[top(i)] = (key, r)
    return [r for _, r in best.values()]


def windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return w


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    pred = {r.doc_id: r for r in langid.language_mixture(docs).collect()}
    rows = [r for r in rows if pred[r["doc_id"]].lang_pred != "und" and pred[r["doc_id"]].score >= 0.5]
    rows = one_of_each(rows)
    items = [windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sought = {tuple(v[i : i + min(10, len(v))]) for v in items if v for i in range(len(v) - min(10, len(v)) + 1)}
    sizes = {len(s) for s in sought}
    rows = [r for r in rows if not any(tuple(windows(r["text"])[i : i + n]) in sought for n in sizes for i in range(len(windows(r["text"])) - n + 1))]
    kept = spark.createDataFrame(rows, docs.schema)
    copies = {r.doc_id: len(r.draws) for r in mixing.quotas(kept).collect()}
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    start = 0
    starts = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for _ in range(copies[r["doc_id"]]):
            want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
            starts.append(start)
            start += len(ids)
    got = P.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sorted(r.start for r in got) == starts


def test_stages_keep_the_columns_and_clash_with_no_name(spark):
    text = " ".join(f"the thing number {i} that is in the ring with" for i in range(40))
    schema = "text string, source string, doc_id long, lang string, n_chars long, digest_ string, c0_ int, row_ string, kept string, size long, draws string, skey string"
    row = lambda i, t, s="a": (t, s, i, "en", 1, None, 1, "r", "k", 5, "d", "x")
    rows = [row(3, text), row(3, text), row(9, text + " and"), row(None, text), row(5, None), row(6, ""), row(7, "12 34"), row(8, text[::-1], None), row(10, "of the thing and the ring")]
    docs = spark.createDataFrame(rows, schema)
    got = docs
    for _, stage in P.STAGES[:-1]:
        before, got = got, stage(spark, got, SF)
        assert got.schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert {r.doc_id for r in got.collect()} <= {3, 8, 10}
    assert P.STAGES[-1][1](spark, got, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_keep_one_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text), (4, text), (4, "other words of the same id"), (None, text), (7, text + " x"), (None, "alone one two"), (None, "alone one two"), (2, None), (1, ""), (1, "")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string"), k=5, share=80).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(4, text), (4, "other words of the same id"), (None, "alone one two"), (2, None), (1, ""), (1, "")])
