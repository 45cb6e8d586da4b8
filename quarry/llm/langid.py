"""Language ID as multilingual mixture inference.

Each language is a smoothed distribution over hashed byte trigrams of its letters, counted over all training
documents. A document's trigrams are taken as drawn from a mixture of languages; expectation-maximisation
estimates the proportions. The set of languages is selected by penalised likelihood: from the likeliest language on,
the one that raises the log-likelihood most joins while it raises it by more than its penalty, and one that no
longer earns its penalty leaves. A language whose slope at the present mixture bounds its gain below the penalty is
not tried, which loses nothing, as the likelihood is concave in the proportions.

Defined results: null text, or text without a letter, is `und` with score 0; so is every text if nothing could
be learned. A null doc_id counts as training (its remainder is not the held-out one); rows with null lang are
predicted, not learned from; repeated rows each get their row and each count in training; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_text
from .kernels import buffers

BINS = 1 << 14
MOST_LANGS = 512  # a model of more would not fit the driver; refused, never cut
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint32)  # everything that is no letter becomes a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
PIECE = 1 << 22


def trigram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams; those with two spaces side by side say nothing and are left out."""
    out = np.zeros(BINS, np.int64)
    for at in range(0, max(1, len(data)), PIECE):
        x = _FOLD[data[max(0, at - 2) : at + PIECE]]
        x = np.concatenate(([32], x, [32])).astype(np.uint32)
        gap = (x[:-1] == 32) & (x[1:] == 32)
        t = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        t = t[~(gap[:-1] | gap[1:])] * np.uint32(0x9E3779B1)
        out += np.bincount(t >> np.uint32(18), minlength=BINS)
    return out


def held_out() -> Column:
    """crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learn(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        data, off = buffers(b.column("text"))
        for i, lang in enumerate(b.column("lang").to_pylist()):
            if lang not in total:
                total[lang] = np.zeros(BINS, np.int64)
            total[lang] += trigram_counts(data[off[i] : off[i + 1]])
    for lang, n in total.items():
        bins = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(bins), pa.string()), pa.array(bins.astype(np.int32)), pa.array(n[bins])], ["lang", "bin", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each trigram in each of them (one row a trigram)."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    summed = rows.mapInArrow(_learn, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    by_lang = summed.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("c"))  # at most BINS entries a language
    got = {r["lang"]: r["c"] for r in by_lang.limit(MOST_LANGS + 1).toLocalIterator()}
    if len(got) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = sorted(got)
    counts = np.zeros((BINS, len(langs)))
    for k, lang in enumerate(langs):
        for b, n in got[lang]:
            counts[b, k] = n
    counts += 0.05
    return langs, counts / counts.sum(0)


def mixture(counts: np.ndarray, prob: np.ndarray, logs: np.ndarray | None = None, penalty: float = 6.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Selected languages and their proportions, heaviest first. logs: the logarithms of prob, if at hand."""
    some = np.flatnonzero(counts)
    c, p = counts[some].astype(float), prob[some]
    n = c.sum()
    cost = penalty + 0.5 * np.log(n)

    def fit(cols, w):
        q = p[:, cols]
        for _ in range(rounds):
            r = q * w
            new = (c / r.sum(1)) @ r / n
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-4:
                break
        return w, float(c @ np.log(q @ w))

    alone = c @ (np.log(p) if logs is None else logs[some])
    chosen, weight = [int(np.argmax(alone))], np.ones(1)
    like = float(alone[chosen[0]])
    while len(chosen) < p.shape[1]:
        bound = (c / (p[:, chosen] @ weight)) @ p - n  # what each language could add at most
        bound[chosen] = -np.inf
        best = None
        for j in np.argsort(-bound, kind="stable"):
            if bound[j] <= max(cost, best[0] if best else cost):
                break
            w, new = fit([*chosen, j], np.append(weight * 0.9, 0.1))
            if new - like > max(cost, best[0] if best else cost):
                best = new - like, int(j), w, new
        if best is None:
            break
        chosen, weight, like = [*chosen, best[1]], best[2], best[3]
        while len(chosen) > 2:  # the newest has just earned its place
            less = [(fit(chosen[:k] + chosen[k + 1 :], np.delete(weight, k) / max(1e-12, 1 - weight[k])), k) for k in range(len(chosen) - 1)]
            (w, new), k = max(less, key=lambda x: x[0][1])
            if like - new > cost:
                break
            chosen, weight, like = chosen[:k] + chosen[k + 1 :], w, new
    top = np.argsort(-weight, kind="stable")
    return np.array(chosen)[top], weight[top]


def _predict(langs: list[str], prob: np.ndarray):
    def run(batches):
        logs = np.log(prob)
        for b in batches:
            column = b.column("text")
            data, off = buffers(column)
            pred, score, parts = [], [], []
            for i in range(b.num_rows):
                counts = trigram_counts(data[off[i] : off[i + 1]])
                if not langs or not counts.any() or not LETTER.search(column[i].as_py() or ""):
                    pred.append("und")
                    score.append(0.0)
                    parts.append([])
                    continue
                who, share = mixture(counts, prob, logs)
                pred.append(langs[who[0]])
                score.append(float(min(1.0, share[0])))
                parts.append([(langs[k], float(s)) for k, s in zip(who, share, strict=True)])
            mix_type = pa.map_(pa.string(), pa.float64())
            yield pa.record_batch([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(parts, mix_type)], [*(c for c in b.schema.names if c != "text"), "lang_pred", "score", "proportions"])

    return run


def language_mixture(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, proportions (language to share) of every document."""
    langs, prob = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(langs, prob), "doc_id long, held_out boolean, lang_pred string, score double, proportions map<string,double>")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose dominant language holds at least `least` of the text."""
    predict = _predict(*train(docs))

    def known(texts: pa.Array) -> pa.Array:
        got = next(predict(iter([pa.record_batch([texts], ["text"])])))
        return pc.and_(pc.not_equal(got.column("lang_pred"), "und"), pc.greater_equal(got.column("score"), least))

    return docs.where(by_text(known, "boolean"))
