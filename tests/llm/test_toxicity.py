import random

import numpy as np
import pytest

from quarry.llm.toxicity import Likelihood, fit, graded, toxicity, train, value, word_bins

DOCS, LABELS = "doc_id long, text string, toxic string, severity int", "doc_id long, quality int, toxic int, text string"


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    clean = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 1, 2])
        text = [rng.choice(clean) for _ in range(rng.randrange(20, 60))]
        for _ in range(2 * grade):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scum", "moron"]))
        docs.append((i, " ".join(text), "x", 1))
        labels.append((i, int(grade < 2), int(grade > 0), ""))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:1000], LABELS)).collect()}
    held = labels[1000:]
    assert np.mean([got[d].toxic == (t == 1) for d, _, t, _ in held]) > 0.97
    mean = [np.mean([got[d].severity for d, q, t, _ in held if t + (t and not q) == g]) for g in range(3)]
    assert mean[0] < 0.4 < mean[1] < 1.4 < mean[2]


def test_thresholds_rise_and_grades_share_weights():
    docs, labels = corpus(400)
    import pyarrow as pa

    bins, counts = zip(*word_bins(pa.array([d[1] for d in docs])), strict=True)
    model = fit(np.array([t + (t and not q) for _, q, t, _ in labels]), list(bins), list(counts))
    assert model.theta[0] < model.theta[1]
    p = model.above(np.array([-2.0, 0.0, 2.0, 5.0]))
    assert (np.diff(p, axis=0) >= 0).all() and (p[:, 0] >= p[:, 1]).all()


def test_odd_rows(spark):
    docs, labels = corpus(300)
    docs += [(9000, None, None, None), (9001, "", "", 1), (9002, " ... ", "", 1), (None, "idiot scum idiot scum", "", 1), (9003, "idiot " * 50_000, "", 1), (9003, "idiot " * 50_000, "", 1)]
    odd = [*labels, (None, 1, 1, ""), (5, None, None, ""), (77777, 1, 1, ""), (3, None, 1, None)]
    got = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(odd, LABELS)).collect()
    assert len(got) == len(docs)
    assert all(r.severity == 0 and not r.toxic for r in got if r.doc_id in (9000, 9001, 9002))
    assert all(r.toxic for r in got if r.doc_id is None or r.doc_id == 9003)
    none = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(docs) and not any(r.toxic for r in none)
    assert toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def graded_texts(n=300, seed=1):
    import pyarrow as pa

    docs, labels = corpus(n, seed)
    bins, counts = zip(*word_bins(pa.array([d[1] for d in docs])), strict=True)
    return np.array([t + (t and not q) for _, q, t, _ in labels]), list(bins), list(counts)


def test_gradient_against_differences():
    of = Likelihood(*graded_texts(120), least=3, l2=0.3)
    rng = np.random.default_rng(3)
    par = of.start() + rng.normal(0, 0.2, len(of.start()))
    _, grad = of.loss(par)
    for i in [*rng.choice(of.k, 15, replace=False), of.k, of.k + 1]:
        step = np.zeros_like(par)
        step[i] = 1e-6
        assert grad[i] == pytest.approx((of.loss(par + step)[0] - of.loss(par - step)[0]) / 2e-6, abs=1e-5)


def test_likelihood_against_its_definition():
    """Cost of each text from the model's own cumulative chances, one text at a time."""
    grades, bins, counts = graded_texts(60)
    of = Likelihood(grades, bins, counts, least=2, l2=0.3)
    par = of.start() + np.random.default_rng(4).normal(0, 0.3, len(of.start()))
    weights, theta, total = dict(zip(of.used.tolist(), par, strict=False)), of.theta(par), 0.0
    share = [sum(grades == g) for g in range(3)]
    for g, b, c in zip(grades, bins, counts, strict=True):
        score = sum(weights.get(int(i), 0.0) * min(int(n), 4) for i, n in zip(b, c, strict=True))
        above = [1.0, *(1 / (1 + np.exp(t - score)) for t in theta), 0.0]
        total -= len(grades) / (3 * share[g]) * np.log(above[g] - above[g + 1])
    penalty = 0.3 / np.sqrt(60) / 2 * sum(w * w for w in weights.values())
    assert of.loss(par)[0] == pytest.approx(total / 60 + penalty)


def test_fit_against_plain_descent():
    """The fitted model is as likely as one of long plain gradient descent, and grades alike."""
    grades, bins, counts = graded_texts(200)
    of = Likelihood(grades, bins, counts, least=3, l2=0.3)
    par = of.start()
    cost, grad = of.loss(par)
    rate = 1.0
    for _ in range(3000):  # the step halves until it lowers the loss
        new = par - rate * grad
        then, slope = of.loss(new)
        if then <= cost:
            par, cost, grad, rate = new, then, slope, rate * 1.1
        else:
            rate /= 2
    model = fit(grades, bins, counts)
    mine = np.concatenate([model.weights[of.used], model.theta[:1], np.log(np.diff(model.theta))]).astype(float)
    assert of.loss(mine)[0] <= cost + 0.01
    score = lambda w: np.array([w[b] @ value(c) for b, c in zip(bins, counts, strict=True)])
    plain = np.zeros_like(model.weights)
    plain[of.used] = par[: of.k]
    severity = lambda w, t: (1 / (1 + np.exp(t[None, :] - score(w)[:, None]))).sum(1)
    assert np.corrcoef(severity(model.weights, model.theta), severity(plain, of.theta(par)))[0, 1] > 0.98


def test_table_held_out(spark):
    """Labelled documents of the table that the fit has not seen; a part of these labels is noise, which no text shows."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null and doc_id is not null")
    held = {r.doc_id: r.toxic for r in labels.where("pmod(xxhash64(doc_id), 4) = 1").collect()}
    seen = labels.where("pmod(xxhash64(doc_id), 4) <> 1")
    got = {r.doc_id: r.toxic for r in toxicity(docs, seen).collect() if r.doc_id in held}
    right = {t: np.mean([got[d] == bool(t) for d in got if held[d] == t]) for t in (0, 1)}
    print("held-out labels", len(got), "clean left alone", right[0], "toxic caught", right[1])
    assert right[0] >= 0.93 and right[1] >= 0.7


def test_labels_that_clash_and_a_small_sample(spark):
    docs, labels = corpus(400)
    twice = [*labels, *[(d, 1 - q, 1 - t, "") for d, q, t, _ in labels[:40]], *labels[40:80]]
    frames = spark.createDataFrame(docs, DOCS), graded(spark.createDataFrame(twice, LABELS))
    model = train(*frames)
    assert (np.diff(model.theta) > 0).all() and np.array_equal(model.weights, train(frames[0].repartition(5), frames[1].repartition(3)).weights)
    small = train(*frames, sample_bytes=60_000)
    assert small is None or not np.array_equal(small.weights, model.weights)
