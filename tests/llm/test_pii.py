import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_ip long"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    """The base patterns read literally."""
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if k == 2:
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((*m.span(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def texts(n=4000):
    rng = random.Random(9)
    bits = ["a@b.c", "@", ".", "1", "23", "256", "0", "4539578763621486", "4539 5787-6362 1486", "+1 (743) 555-3824", "+", "-", " ", "é", "x.y", "1.2.3.4", "\n", "(", "00012", "+12", "%", "_"]
    for _ in range(n):
        yield "".join(rng.choice(bits) for _ in range(rng.randrange(14)))


def test_base_against_plain_patterns():
    for t in texts():
        assert pii.base_spans(t) == plain(t), t


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_the_field_adds_and_keeps(field):
    text = 'the token = "0123abcd9f0123abcd9f0123abcd9f0123abcd9f" and 10.1.2.3 in version 3.2 of chapter 7'
    base, every = pii.spans(text, field)
    assert [k for *_, k in base] == [1] and set(base) <= set(every)
    assert [text[s:e] for s, e, k in every if k == 4] == ["0123abcd9f0123abcd9f0123abcd9f0123abcd9f"] and len(every) == 2
    for t in list(texts(300)):
        base, every = pii.spans(t, field)
        assert set(base) <= set(every)
        assert all(not (s < y and x < e) for s, e, k in set(every) - set(base) for x, y, _ in base)


def segmentations(n, segs):
    """All of them: lists of (candidate, kind), in order."""

    def rest(at):
        if at == n:
            yield []
            return
        yield from rest(at + 1)
        for r, (i, j, _) in enumerate(segs):
            if i == at:
                for tail in rest(j):
                    for k in range(len(pii.KINDS)):
                        yield [(r, k), *tail]

    return rest(0)


def test_decoding_is_the_best_segmentation():
    """Against all segmentations of short windows, with links between neighbouring kinds of any sign."""
    rng = random.Random(1)
    for text in ["call +1 (743) 5", "a@b 12 c3", "1.2.3 4", "x1 y2 z3"]:
        tokens, segs = pii._prepared(text, (0, len(text)))
        for _ in range(5):
            names = sorted({f for *_, feats in segs for f in feats})
            field = pii.Field({f: [rng.gauss(0, 0.7) for _ in pii.KINDS] for f in names}, [[rng.gauss(0, 2) for _ in pii.KINDS] for _ in range(pii.NONE + 1)])
            scores = [field.scores(feats) for *_, feats in segs]

            def total(way, field=field, scores=scores):
                out, before = 0.0, pii.NONE
                for r, k in way:
                    out, before = out + scores[r][k] + field.links[before][k], k
                return out

            assert sum(s for *_, s in field.decode(len(tokens), segs)) == pytest.approx(max(map(total, segmentations(len(tokens), segs))))


def test_likelihood_and_gradient_against_all_segmentations():
    rng = np.random.default_rng(2)
    text, gold = "a@b 12 +3 c", [(0, 3, 0), (4, 6, 4)]
    columns = {}
    (case,) = pii.cases([(text, gold)], columns)
    tokens, segs = pii._prepared(text, pii.windows(text)[0])
    w, links = rng.normal(0, 0.5, (len(columns), len(pii.KINDS))), rng.normal(0, 1, (pii.NONE + 1, len(pii.KINDS)))

    def total(way, w, links):
        out, before = 0.0, pii.NONE
        for r, k in way:
            out, before = out + w[[columns[f] for f in segs[r][2]], k].sum() + links[before, k], k
        return out

    ways = list(segmentations(len(tokens), segs))
    value, by_seg, by_link = case.likelihood(w, links)
    assert len(case.order) == 2 and value == pytest.approx(total(case.order, w, links) - np.logaddexp.reduce([total(x, w, links) for x in ways]))
    step = 1e-5
    for c in rng.choice(len(columns), 12, replace=False):
        for k in range(len(pii.KINDS)):
            up, down = w.copy(), w.copy()
            up[c, k] += step
            down[c, k] -= step
            slope = (case.likelihood(up, links)[0] - case.likelihood(down, links)[0]) / (2 * step)
            assert sum(by_seg[r, k] * (case.feats[r] == c).sum() for r in range(len(segs))) == pytest.approx(slope, abs=1e-4)
    for p in range(pii.NONE + 1):
        for k in range(len(pii.KINDS)):
            up, down = links.copy(), links.copy()
            up[p, k] += step
            down[p, k] -= step
            assert by_link[p, k] == pytest.approx((case.likelihood(w, up)[0] - case.likelihood(w, down)[0]) / (2 * step), abs=1e-4)


def test_held_out_windows(field):
    """Windows of another seed: boundaries and kinds."""
    maker = pii.Maker(seed=12345)
    right = found = there = 0
    for _ in range(500):
        text, gold = maker.window()
        got = set()
        for span in pii.windows(text):
            tokens, segs = pii._prepared(text, span)
            got |= {(tokens[i][0], tokens[j - 1][1], k) for i, j, k, s in field.decode(len(tokens), segs) if s >= pii.MARGIN}
        right, found, there = right + len(got & set(gold)), found + len(got), there + len(gold)
    print("held-out windows: precision", right / found, "recall", right / there)
    assert right >= 0.97 * found and right >= 0.97 * there


def test_secrets_of_the_table(spark, field):
    """Secrets that the table's texts hold are found, and texts without a digit or @ in a word of their own get none."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    known = re.compile(r"\b(AKIA[A-Z0-9]{16})\b|password=([0-9a-f]{18})|token = \"([0-9a-f]{40})\"")
    planted = {d: {m.span(m.lastindex) for m in known.finditer(t)} for d, t in text.items()}
    hit = every = wrong = 0
    for r in pii.personal_data(docs, field).collect():
        got = {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("secret")}
        assert r.n_secret == len(got)
        hit, every, wrong = hit + len(got & planted[r.doc_id]), every + len(planted[r.doc_id]), wrong + bool(got - planted[r.doc_id])
    assert every > 20 and hit >= 0.97 * every and wrong <= 0.002 * len(text), (hit, every, wrong)


def test_rows(spark, field):
    rows = [(1, None, None, None), (2, "", "", 0), (3, "a@b.cd", "", 0), (3, "a@b.cd", "", 0), (None, "é 1.2.3.4", "", 0), (4, "7" * 300_000 + "@" * 1000 + "a" * 300_000, "", 0), (5, "1 " * 100_000, "", 0)]
    got = sorted(pii.personal_data(spark.createDataFrame(rows, SCHEMA), field).collect(), key=lambda r: str(r.doc_id))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].n_ip == 1 and by[None].base_sha256 == hashlib.sha256(b"ip:2:9").hexdigest() and by[3].spans == "email:0:6" and by[1].spans == ""
    assert pii.personal_data(spark.createDataFrame([], SCHEMA), sample=20).count() == 0


def test_windows_hold_whole_tokens(field):
    for run in ["A1b2C3d4" + "q" * 40, "q" * 40 + "A1b2C3d4", "0123abcd" + "abcdef" * 8 + "9f01"]:
        text = f"the password={run} for it, " + "and more words " * 4
        assert any(s <= 4 + len("password=") and 4 + len("password=") + len(run) <= e for s, e in pii.windows(text))
        tokens = [text[s:e] for w in pii.windows(text) for s, e in pii._prepared(text, w)[0]]
        assert run in tokens
        assert all(text[s:e] == run for s, e, k in pii.spans(text, field)[1] if s < 13 + len(run) and e > 13)
    long = "a1" * 200_000 + "-" * 200_000
    assert pii.windows(long) == [(0, len(long))]
