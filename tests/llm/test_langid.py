import zlib

import pytest

from quarry.llm import langid
from quarry.llm.queries import op5_language_mixture

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op5_language_mixture(spark, SF).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id][0] for r in held)
    print("held-out accuracy", right / len(held), "of", len(held))
    assert right >= 0.98 * len(held)


def test_mixture_shares():
    import numpy as np

    a, b = "the thing that in the ring with tion and shall ", "der schatz ist ein haus und zeit keit ung pfad "
    prob = np.stack([langid.trigram_counts(np.frombuffer((x * 50).encode(), np.uint8)) + 0.05 for x in (a, b)], 1)
    prob /= prob.sum(0)
    who, share = langid.mixture(langid.trigram_counts(np.frombuffer((a * 3 + b).encode(), np.uint8)), prob)
    assert list(who) == [0, 1] and share[0] == pytest.approx(0.75, abs=0.05)
    who, share = langid.mixture(langid.trigram_counts(np.frombuffer(a.encode(), np.uint8)), prob)
    assert list(who) == [0] and share[0] == 1


def test_odd_rows(spark):
    data = [(i, "the thing that is in the ring", "en", 1.0) for i in range(20)] + [(i + 50, "der schatz ist ein haus und", "de", 1.0) for i in range(20)]
    data += [(None, None, None, 0.0), (101, "", "en", 0.0), (102, "123 ... !!", "de", None), (103, "  \n", None, None), (104, "the ring", None, None), (104, "the ring", None, None), (105, "the thing " * 60_000, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score double")
    got = langid.language_mixture(docs).collect()
    assert len(got) == len(data)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[None] == by[101] == by[102] == by[103] == ("und", 0.0)
    assert by[104][0] == "en" and 0 < by[105][1] <= 1
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (101, 102, 103)").count() == 0 and kept.where("doc_id = 104").count() == 2
    assert langid.language_mixture(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_mixture(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_long_text_is_counted_whole(monkeypatch):
    import numpy as np

    data = np.frombuffer(("abc d" * 5000).encode(), np.uint8)
    whole = langid.trigram_counts(data)
    monkeypatch.setattr(langid, "PIECE", 1000)
    parts = langid.trigram_counts(data)
    assert abs(int(whole.sum()) - int(parts.sum())) <= 2 * 26


def test_small_share_of_a_long_text():
    """A language under a hundredth of the text, with thousands of letters, is a matter of likelihood alone."""
    import numpy as np

    a, b = "the thing that in the ring with tion and shall ", "der schatz ist ein haus und zeit keit ung pfad "
    prob = np.stack([langid.trigram_counts(np.frombuffer((x * 50).encode(), np.uint8)) + 0.05 for x in (a, b)], 1)
    prob /= prob.sum(0)
    who, share = langid.mixture(langid.trigram_counts(np.frombuffer((a * 20_000 + b * 100).encode(), np.uint8)), prob)
    assert list(who) == [0, 1] and share[1] == pytest.approx(0.005, abs=0.002)


def test_selection_against_all_sets():
    """The penalised likelihood of the chosen set is that of the best of all sets of languages."""
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(5)
    for trial in range(60):
        prob = rng.dirichlet(np.full(300, rng.choice([0.05, 0.3])), 5).T + 1e-4
        prob /= prob.sum(0)
        share = rng.dirichlet(np.full(5, rng.choice([0.1, 0.5, 2.0])))
        counts = np.bincount(rng.choice(300, int(rng.choice([30, 200, 3000])), p=prob @ share), minlength=300)
        some = np.flatnonzero(counts)
        c, cost = counts[some], 6.0 + 0.5 * np.log(counts.sum())

        def like(cols, c=c, some=some, prob=prob):
            q, w = prob[some][:, cols], np.full(len(cols), 1 / len(cols))
            for _ in range(400):
                r = q * w
                w = (c / r.sum(1)) @ r / c.sum()
            return float(c @ np.log(q @ w))

        best = max(like(list(cols)) - cost * len(cols) for m in range(1, 6) for cols in combinations(range(5), m))
        who, w = langid.mixture(counts, prob)
        assert w.sum() == pytest.approx(1) and (np.diff(w) <= 0).all()
        assert like(list(who)) - cost * len(who) >= best - 0.05, trial


def test_learning_against_plain_counts(spark):
    """Counts over partitions are those of all training texts together."""
    import numpy as np

    docs = spark.createDataFrame([(i, f"text number{i} of the ring", "en" if i % 3 else "de") for i in range(40)], "doc_id long, text string, lang string").repartition(5)
    langs, prob = langid.train(docs)
    want = np.zeros((langid.BINS, 2))
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            want[:, langs.index(r.lang)] += langid.trigram_counts(np.frombuffer(r.text.encode(), np.uint8))
    want += 0.05
    assert langs == ["de", "en"] and np.allclose(prob, want / want.sum(0))
