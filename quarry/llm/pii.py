"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The field works on windows around digits and @. A window is cut into tokens; every run of at most
`MAX_TOKENS` tokens is a candidate segment, described as a whole (its shape, length, digits and checksum, what
stands before and after, the word that introduces it). A segment's kind is also weighed by the kind of the entity
before it. Forward and backward sums over all segmentations give the likelihood and its gradient for training; the
best segmentation, boundaries and types together, comes from dynamic programming over segments of bounded length.

It is trained on `SAMPLE` made-up windows whose entities are known as they are made, among numbers, dates,
versions and digests that are none; the base patterns have no part in it. It adds the segments that it decodes
clear of every base span with at least `MARGIN` over no entity.

Kinds, in order: email, ip, card, phone, then secret, which only the field finds.

Defined results: null and empty text has no spans; offsets are code points, end exclusive; repeated rows each
get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_TOKENS, CONTEXT, MARGIN = 14, 24, 2.0
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
ANCHOR = re.compile(r"[0-9@]+")
RUN = re.compile(r"[A-Za-z0-9_-]*+")  # what a window is not cut in
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
SAMPLE, SEED = 1500, 7  # made-up windows to learn from
WORD = re.compile(r"[A-Za-z]{2,}")
NONE = len(KINDS)  # the kind before the first entity of a window


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping within a kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            s = at
            while s > end and text[s - 1] in LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end(), 0))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    if ANCHOR.search(text):
        out += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and @ with CONTEXT characters on both sides, widened to whole runs of letters, digits,
    _ and -.
    """
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        s, e = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and e <= out[-1][1]:
            continue
        least = out[-1][1] if out else 0
        while s > least and text[s - 1] in PART and text[s] in PART:
            s -= 1
        if text[e - 1] in PART:
            e = RUN.match(text, e).end()
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 5)}"
    if not token[0].isalnum():
        return token
    if any(c.isdigit() for c in token):
        return "X" if len(token) >= 16 else "x"
    return "a"


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first token, last token + 1, features) of the candidates: with a digit or @, both ends letters, digits or + ( in front."""
    words = [text[s:e] for s, e in tokens]
    shapes = [_shape(w) for w in words]
    anchor = [w == "@" or any(c.isdigit() for c in w) for w in words]
    out, lead = [], "^"
    for i in range(len(tokens)):
        if i and WORD.fullmatch(words[i - 1]):
            lead = words[i - 1].lower()
        if not (words[i][0].isalnum() or words[i] in "+("):
            continue
        has, parts = False, []
        before = words[i - 1] if i else "^"
        before = before if not before[0].isalnum() else _shape(before)
        glued = i > 0 and tokens[i - 1][1] == tokens[i][0]
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if j > i and tokens[j - 1][1] < tokens[j][0]:
                parts.append("_")
            parts.append(shapes[j])
            has = has or anchor[j]
            if not has or not words[j][-1].isalnum():
                continue
            out.append((i, j + 1, (*_whole(text[tokens[i][0] : tokens[j][1]], "".join(parts), len(parts)), f"before {before} {glued}", f"lead {lead}", _after(words, tokens, j))))
    return out


def _after(words: list[str], tokens: list[tuple[int, int]], j: int) -> str:
    after = words[j + 1] if j + 1 < len(words) else "$"
    return f"after {after if not after[0].isalnum() else 'w'} {j + 1 < len(words) and tokens[j][1] == tokens[j + 1][0]}"


@lru_cache(1 << 14)
def _whole(body: str, shape: str, parts: int) -> tuple[str, ...]:
    """Features of a segment by itself."""
    digits = "".join(c for c in body if c.isdigit())
    bare = "".join(c for c in body if c.isalnum())
    low, kinds = bare.lower(), (any(c.isupper() for c in bare), any(c.islower() for c in bare), bool(digits))
    hexed = all(c in "0123456789abcdef" for c in low)
    solid = len(bare) == len(body)
    sum_ok = 14 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in body)
    quad = shape.count(".") == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in body.split("."))
    mail = body.count("@") == 1 and body[0] != "@" and "." in body.partition("@")[2] and not any(c.isspace() for c in body)
    return (
        "bias", f"shape {shape if parts <= 12 else 'long'}", f"loose {re.sub('d[0-9]', 'd', shape) if parts <= 12 else 'long'}", f"digits {min(len(digits), 20)}", f"parts {min(parts, 12)}", f"size {min(len(body), 48) // 4} {solid}",
        f"made {kinds} {hexed} {solid}", f"sum {sum_ok} quad {quad} mail {mail}", f"space {any(c.isspace() for c in body)} {sum(not c.isalnum() and not c.isspace() for c in body) > 3}",
        f"head {body[:4] if body[:4].isupper() or body[:4].islower() else ''} {len(body) >= 16}", f"plus {body[0] == '+'} {body[0] == '('}",
    )


class Field:
    """Weights of each feature by kind, and of each kind by the kind before; a token outside all segments scores 0."""

    def __init__(self, weights: dict[str, list[float]] | None = None, links: list[list[float]] | None = None):
        self.weights = weights or {}
        self.links = links or [[0.0] * len(KINDS) for _ in range(NONE + 1)]

    def scores(self, feats: tuple[str, ...]) -> list[float]:
        out = [0.0] * len(KINDS)
        for f in feats:
            if w := self.weights.get(f):
                out = [a + b for a, b in zip(out, w, strict=True)]
        return out

    def decode(self, n: int, segs) -> list[tuple[int, int, int, float]]:
        """The best segmentation of n tokens: (first, end, kind, score)."""
        by_end: list[list] = [[] for _ in range(n + 1)]
        most = [max(row[k] for row in self.links) for k in range(len(KINDS))]
        gain = max(0.0, max(a[k] - min(b[k] for b in self.links) for k in range(len(KINDS)) for a in self.links))
        for i, j, feats in segs:
            for k, s in enumerate(self.scores(feats)):
                if s + most[k] + gain > 0:  # else worse than no entity, whatever it leads to
                    by_end[j].append((i, k, s))
        low = -math.inf
        best = [[low] * NONE + [0.0]]
        back: list[list] = [[None] * (NONE + 1)]
        for j in range(1, n + 1):
            row, via = list(best[-1]), [None] * (NONE + 1)
            for i, k, s in by_end[j]:
                for p in range(NONE + 1):
                    total = best[i][p] + self.links[p][k] + s
                    if total > row[k]:
                        row[k], via[k] = total, (i, p, s + self.links[p][k])
            best.append(row)
            back.append(via)
        k = max(range(NONE + 1), key=lambda q: (best[n][q], q == NONE))
        out, j = [], n
        while j:
            if back[j][k]:
                i, p, s = back[j][k]
                out.append((i, j, k, s))
                j, k = i, p
            else:
                j -= 1
        return out[::-1]


class Case:
    """A window to learn from: its candidates' feature columns and its gold segments."""

    def __init__(self, n: int, segs, gold: set[tuple[int, int, int]], columns: dict[str, int]):
        self.n = n
        self.start = np.array([i for i, _, _ in segs], np.int64)
        self.end = np.array([j for _, j, _ in segs], np.int64)
        self.feats = np.array([[columns.setdefault(f, len(columns)) for f in feats] for *_, feats in segs], np.int64).reshape(len(segs), len(segs[0][2]) if segs else 0)
        self.gold = np.zeros((len(segs), len(KINDS)))
        where = {(i, j): r for r, (i, j, _) in enumerate(segs)}
        self.order = [(where[i, j], k) for i, j, k in sorted(gold) if (i, j) in where]
        for r, k in self.order:
            self.gold[r, k] = 1

    def likelihood(self, weights: np.ndarray, links: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold segmentation, and its gradient by candidate and kind, and by pair of kinds."""
        n, kinds = self.n, len(KINDS)
        score = weights[self.feats].sum(1) if len(self.feats) else np.zeros((0, kinds))
        from_, to = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for r, (i, j) in enumerate(zip(self.start.tolist(), self.end.tolist(), strict=True)):
            from_[i].append(r)
            to[j].append(r)
        a, m = np.full((n + 1, kinds + 1), -np.inf), np.zeros((n + 1, kinds))
        a[0, NONE] = 0
        m[0] = links[NONE]
        for j in range(1, n + 1):
            a[j] = a[j - 1]
            if to[j]:
                rows = to[j]
                a[j, :kinds] = np.logaddexp(a[j, :kinds], np.logaddexp.reduce(m[self.start[rows]] + score[rows], axis=0))
            m[j] = np.logaddexp.reduce(a[j][:, None] + links, axis=0)
        b, t = np.zeros((n + 1, kinds + 1)), np.full((n + 1, kinds), -np.inf)
        for i in range(n - 1, -1, -1):
            b[i] = b[i + 1]
            if from_[i]:
                rows = from_[i]
                t[i] = np.logaddexp.reduce(score[rows] + b[self.end[rows], :kinds], axis=0)
                b[i] = np.logaddexp(b[i], np.logaddexp.reduce(links + t[i][None, :], axis=1))
        z = b[0, NONE]
        by_seg = self.gold - np.exp(m[self.start] + score + b[self.end, :kinds] - z) if len(score) else self.gold
        with np.errstate(invalid="ignore"):
            by_link = -np.exp(a[:, :, None] + links[None] + t[:, None, :] - z).sum(0)
        value, before = -z, NONE
        for r, k in self.order:
            value += score[r, k] + links[before, k]
            by_link[before, k] += 1
            before = k
        return float(value), by_seg, by_link


def _prepared(text: str, span: tuple[int, int]):
    s, e = span
    tokens = [(s + m.start(), s + m.end()) for m in TOKEN.finditer(text[s:e])]
    return tokens, segments(text, tokens)


def cases(made: list[tuple[str, list[tuple[int, int, int]]]], columns: dict[str, int]) -> list[Case]:
    """One for each window of the labelled texts (text, [(start, end, kind)])."""
    out = []
    for text, entities in made:
        for span in windows(text):
            tokens, segs = _prepared(text, span)
            start, end = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            gold = {(start[s], end[e], k) for s, e, k in entities if s in start and e in end and end[e] - start[s] <= MAX_TOKENS}
            out.append(Case(len(tokens), segs, gold, columns))
    return out


def fit(made: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 8, rate: float = 0.5, l2: float = 1e-4) -> Field:
    """Trained on labelled texts by stochastic gradient steps (scaled by feature) on the penalised likelihood."""
    columns: dict[str, int] = {}
    every = cases(made, columns)
    w, links = np.zeros((len(columns), len(KINDS))), np.zeros((NONE + 1, len(KINDS)))
    seen, seen_links = np.full_like(w, 1e-6), np.full_like(links, 1e-6)
    order = random.Random(SEED)
    for _ in range(epochs):
        order.shuffle(every)
        for case in every:
            _, by_seg, by_link = case.likelihood(w, links)
            some = np.flatnonzero(np.abs(by_seg).max(1, initial=0) > 1e-4)
            g = np.zeros_like(w)
            np.add.at(g, case.feats[some], by_seg[some][:, None, :])
            at = np.unique(case.feats[some])
            g = g[at] - l2 * w[at]
            seen[at] += g * g
            w[at] += rate * g / np.sqrt(seen[at])
            seen_links += by_link**2
            links += rate * by_link / np.sqrt(seen_links)
    return Field({f: w[c].tolist() for f, c in columns.items() if np.abs(w[c]).max() > 1e-3}, links.tolist())


class Maker:
    """Made-up windows with their entities: names and forms of addresses, numbers and secrets among numbers that are none."""

    LOWER, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    NAMES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "auth", "credential", "pass", "bearer", "signature")
    PLAIN = ("page", "version", "chapter", "year", "room", "figure", "section", "commit", "revision", "checksum", "digest", "build", "number", "order", "in", "of", "on", "since", "about", "isbn", "total")

    def __init__(self, seed: int = SEED):
        self.rng = random.Random(seed)

    def some(self, letters: str, low: int, high: int | None = None) -> str:
        return "".join(self.rng.choice(letters) for _ in range(self.rng.randint(low, high or low)))

    def word(self) -> str:
        return self.some(self.LOWER, 2, 9)

    def email(self) -> str:
        user = self.rng.choice((self.word, lambda: f"{self.word()}.{self.word()}", lambda: f"{self.word()}{self.rng.randrange(999)}", lambda: f"{self.word()}.{self.rng.randrange(99)}", lambda: f"{self.word()}_{self.word()}+{self.word()}"))()
        host = self.rng.choice((lambda: f"{self.word()}.com", lambda: f"mail{self.rng.randrange(9)}.{self.word()}.org", lambda: f"{self.word()}-{self.word()}.co.uk"))()
        return f"{user}@{host}"

    def ip(self) -> str:
        return ".".join(str(self.rng.randrange(256)) for _ in range(4))

    def card(self) -> str:
        digits = self.some("123456789", 1) + self.some("0123456789", self.rng.choice((13, 14, 14, 14, 15, 17)))
        digits += next(str(c) for c in range(10) if luhn(digits + str(c)))
        return digits if self.rng.random() < 0.5 else self.rng.choice(" -").join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def phone(self) -> str:
        a, b, c = self.some("23456789", 3), self.some("0123456789", 3), self.some("0123456789", 4)
        country = f"+{self.rng.randrange(1, 99)}"
        return self.rng.choice((f"{country} ({a}) {b}-{c}", f"{country} {a} {b} {c}", f"{country}-{a}-{b}-{c}", f"{country}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"))

    def secret(self) -> tuple[str, str, str]:
        """What stands before, the secret, what stands behind."""
        mixed = self.LOWER + self.LOWER.upper() + "0123456789"
        bare = self.rng.random() < 0.4
        if bare:
            body = self.rng.choice((lambda: "AKIA" + self.some(self.LOWER.upper() + "0123456789", 16), lambda: "ASIA" + self.some(self.LOWER.upper() + "0123456789", 16), lambda: f"ghp_{self.some(mixed, 36)}", lambda: f"sk-{self.some(mixed, 24, 48)}", lambda: f"xoxb-{self.some('0123456789', 11)}-{self.some(mixed, 24)}"))()
            return "", body, ""
        body = self.rng.choice((lambda: self.some(self.HEX, 16, 44), lambda: self.some(mixed, 10, 40), lambda: self.some(self.LOWER, 4, 8) + self.some("0123456789", 2, 6)))()
        body = body if any(c.isdigit() for c in body) else f"{body}7"
        name = self.rng.choice(self.NAMES)
        name = self.rng.choice((name, name.upper(), f"{self.word()}_{name}", f"api_{name}"))
        mark = self.rng.choice(("=", " = ", ": ", ":"))
        quote = self.rng.choice(("", "", '"', "'"))
        return f"{name}{mark}{quote}", body, quote

    def other(self) -> str:
        r = self.rng.randrange
        return self.rng.choice((
            lambda: str(r(3000)), lambda: f"{r(20)}.{r(20)}", lambda: f"{r(20)}.{r(20)}.{r(20)}", lambda: f"{r(1900, 2100)}-{r(1, 13):02}-{r(1, 29):02}", lambda: f"{r(24):02}:{r(60):02}", lambda: f"{r(99)}%", lambda: f"${r(9999)}.{r(100):02}",
            lambda: f"{r(10**5, 10**9)}", lambda: self.some(self.HEX, 40), lambda: self.some(self.HEX, 64), lambda: f"{self.some(self.HEX, 8)}-{self.some(self.HEX, 4)}-{self.some(self.HEX, 4)}-{self.some(self.HEX, 12)}", lambda: f"{self.word()}{r(100)}",
            lambda: f"@{self.word()}", lambda: f"{r(256, 999)}.{r(999)}.{r(999)}.{r(999)}", lambda: f"{r(10**3)}-{r(10**2)}", lambda: f"{self.some('0123456789', 12, 20)}", lambda: f"{self.word().upper()}{r(10**4)}", lambda: f"({r(100)})", lambda: f"{r(9)}x{r(99)}",
        ))()

    def window(self) -> tuple[str, list[tuple[int, int, int]]]:
        text, found = " ".join(self.word() for _ in range(self.rng.randint(0, 4))), []
        for _ in range(self.rng.choice((1, 1, 1, 2, 3))):
            text += self.rng.choice((" ", " ", "\n", ". ", ", ", " (")) if text else ""
            kind = self.rng.choice((0, 1, 2, 3, 4, 4, 5, 5, 5, 5))
            before, after = "", ""
            if kind == 4:
                before, body, after = self.secret()
            elif kind == 5:
                body = self.other()
                if self.rng.random() < 0.6:
                    before = f"{self.rng.choice(self.PLAIN)} "
            else:
                body = (self.email, self.ip, self.card, self.phone)[kind]()
            text += before
            if kind < 5:
                found.append((len(text), len(text) + len(body), kind))
            text += body + after
            text += self.rng.choice((" ", " ", ", ", ". ", "; ")) + " ".join(self.word() for _ in range(self.rng.randint(0, 4)))
        return text, found


@lru_cache(2)
def train(sample: int = SAMPLE, seed: int = SEED) -> Field:
    """A field from `sample` made-up windows."""
    made = Maker(seed)
    return fit([made.window() for _ in range(sample)])


def spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    if not ANCHOR.search(text):
        return [], []
    base, added = base_spans(text), []
    for span in windows(text):
        tokens, segs = _prepared(text, span)
        for i, j, k, score in field.decode(len(tokens), segs):
            s, e = tokens[i][0], tokens[j - 1][1]
            if score >= MARGIN and not any(s < y and x < e for x, y, _ in base):
                added.append((s, e, k))
    return base, sorted({*base, *added}, key=lambda x: (x[0], x[2], x[1]))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def _find(field: Field):
    def run(batches):
        one = lru_cache(2048)(lambda text: spans(text, field))
        for b in batches:
            n: list[list[int]] = [[] for _ in range(4)]
            sha, every, secrets = [], [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                base, all_ = (one if len(text) < 20_000 else one.__wrapped__)(text)
                for k in range(4):
                    n[k].append(sum(x[2] == k for x in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(all_))
                secrets.append(sum(x[2] == 4 for x in all_))
            cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(secrets, pa.int64())]
            yield pa.record_batch(cols, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret"])

    return run


def personal_data(docs: DataFrame, field: Field | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base patterns), base_sha256, spans, n_secret of every document.

    sample: made-up windows that the field is trained on, if none is given.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(field or train(sample)), schema)
