"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of `window` words (a shorter item is one window). The short shingles of the
windows are counted over the whole corpus and ordered by rarity. To contain a window a text must contain all
its shingles, so the one-shingle prefix, the rarest, is enough to join on. The shingle's place in the window
fixes where the window would start (positional bound), and the text must have room for it (length bound);
what is left is verified word by word. Windows whose rarest shingle no text has are dropped at once.

The items of one pass are held by every task, so their size is checked: benchmarks beyond `item_bytes` go in
several passes over the corpus, whose hits are united.

Defined results: null and empty texts have no words and no hits; an item without words is never found; items
that share an item_id count once, a null item_id is written as an empty string; repeated documents each get
their row; empty tables give no rows, or rows without hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_text, stored
from .kernels import LETTERS, U, Cut, mix, rolling, same_bytes, word_hashes

PREFIX_WORDS = 3
SPAN = "doc_id long, n_words long, key long, spans binary, items array<string>"


def item_windows(items: list[tuple[object, str | None]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Distinct windows as words, each with its items' ids as strings."""
    out: dict[tuple[bytes, ...], set] = {}
    for name, text in items:
        for _, _, cut in LETTERS.texts(pa.array([text], pa.string())):
            words = [cut.word(k) for k in range(len(cut.h))]
            n = min(window, len(words))
            for s in range(len(words) - n + 1 if n else 0):
                out.setdefault(tuple(words[s : s + n]), set()).add("" if name is None else str(name))
    return out


class Vocabulary:
    """The distinct words of windows: their bytes, one after the other, and their hashes."""

    def __init__(self, windows: Iterable[tuple[bytes, ...]]):
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for words in windows for w in words))}
        self.size = np.array([len(w) for w in self.number], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.z = np.frombuffer(b"".join([*self.number, bytes(8)]), np.uint8)
        self.h = word_hashes(self.z, self.start, self.size)

    def numbers(self, words: tuple[bytes, ...]) -> np.ndarray:
        return np.array([self.number[w] for w in words], np.int64)


def window_shingles(windows: list[tuple[bytes, ...]], known: Vocabulary | None = None) -> list[tuple[int, np.ndarray]]:
    """Per window, the width and the hashes of its shingles in order."""
    known = known or Vocabulary(windows)
    return [(min(PREFIX_WORDS, len(w)), rolling(known.h[known.numbers(w)], min(PREFIX_WORDS, len(w)))) for w in windows]


def _count(keys: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            total = {q: np.zeros(len(v), np.int64) for q, v in keys.items()}
            for _, _, cut in LETTERS.texts(b.column("text")):
                h, at = cut.h, cut.at
                for q, sought in keys.items():
                    g = rolling(h, q)
                    c = np.searchsorted(sought, g)
                    c[c == len(sought)] = 0
                    hit = np.flatnonzero(sought[c] == g)
                    doc = np.searchsorted(at, hit, "right") - 1
                    hit = hit[hit + q <= at[doc + 1]]
                    total[q] += np.bincount(c[hit], minlength=len(sought))
            for q, t in total.items():
                some = np.flatnonzero(t)
                yield pa.record_batch([pa.array(keys[q][some].view(np.int64)), pa.array(t[some])], ["gram", "n"])

    return run


class Index:
    """Prefix shingles of the windows that can occur, and where each puts its window."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], seen: dict[int, int]):
        entries: dict[int, list[tuple[int, int, int]]] = {}
        self.items: list[list[str]] = []
        own = []
        for w, (q, grams) in zip(windows, window_shingles(list(windows)), strict=True):
            signed = grams.view(np.int64).tolist()
            rarest = min(range(len(signed)), key=lambda o: (seen.get(signed[o], 0), signed[o]))
            if seen.get(signed[rarest], 0):
                entries.setdefault((q, int(grams[rarest])), []).append((len(own), rarest))
                own.append(w)
                self.items.append(sorted(windows[w]))
        self.known = Vocabulary(own)
        self.long = max(map(len, own), default=1)
        self.length = np.array([len(w) for w in own], np.int64)
        self.words = np.zeros((len(own), self.long), np.int64)  # numbers in the vocabulary
        for r, w in enumerate(own):
            self.words[r, : len(w)] = self.known.numbers(w)
        self.by_width = {}
        for q in sorted({q for q, _ in entries}):
            keys = np.array(sorted(g for p, g in entries if p == q), U)
            lists = [entries[q, int(g)] for g in keys]
            self.by_width[q] = (
                keys, np.cumsum([0, *map(len, lists)]), np.array([e[0] for x in lists for e in x], np.int64), np.array([e[1] for x in lists for e in x], np.int64),
            )

    def find(self, text: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, window, start) of every window in the texts, compared word by word, byte by byte."""
        found, h, at, known = [], text.h, text.at, self.known
        for q, (keys, cut, window, offset) in self.by_width.items():
            g = rolling(h, q)
            c = np.searchsorted(keys, g)
            c[c == len(keys)] = 0
            pos = np.flatnonzero(keys[c] == g)
            k = c[pos]
            many = cut[k + 1] - cut[k]
            pos = np.repeat(pos, many)
            e = np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(cut[k], many)
            w, start = window[e], pos - offset[e]
            doc = np.searchsorted(at, pos, "right") - 1
            fits = (start >= at[doc]) & (start + self.length[w] <= at[doc + 1])
            doc, w, start = doc[fits], w[fits], start[fits]
            for o in range(self.long):
                inside = o < self.length[w]
                same = ~inside
                a, b = start[inside] + o, self.words[w[inside], o]
                same[inside] = (h[a] == known.h[b]) & same_bytes(text.z, text.start[a], text.size[a], known.z, known.start[b], known.size[b])
                doc, w, start = doc[same], w[same], start[same]
            found.append((doc, w, start))
        return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))


def united(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Disjoint (start, end) rows that cover the same words."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return np.stack([s[first], e[np.append(first[1:], len(s)) - 1]], 1) if len(s) else np.empty((0, 2), np.int64)


def _search(index: Index, only_hits: bool):
    none = np.empty((0, 2), np.int64).tobytes()

    def run(batches):
        for b in batches:
            rows = b.num_rows
            n, key = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            spans, items = [none] * rows, [[]] * rows
            for i, j, cut in LETTERS.texts(b.column("text")):
                h, at = cut.h, cut.at
                n[i:j] = np.diff(at)
                place = np.arange(len(h), dtype=U)
                total = np.concatenate(([U(0)], np.cumsum(mix(h ^ mix(place - np.repeat(at[:-1].astype(U), np.diff(at)))))))
                key[i:j] = (total[at[1:]] - total[at[:-1]]).view(np.int64)
                doc, w, start = index.find(cut)
                order = np.argsort(doc, kind="stable")
                doc, w, start = doc[order], w[order], start[order]
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                for x, y in zip(first, np.append(first, len(doc))[1:], strict=True):
                    d = doc[x]
                    s = start[x:y] - at[d]
                    spans[i + d] = united(s, s + index.length[w[x:y]]).tobytes()
                    items[i + d] = sorted({name for v in np.unique(w[x:y]) for name in index.items[v]})
            out = pa.record_batch([b.column("doc_id"), pa.array(n), pa.array(key), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "key", "spans", "items"])
            yield out.filter(pa.array([bool(x) for x in items], pa.bool_())) if only_hits else out

    return run


def _finish(batches):
    """Spans and items of one or more passes to the counts."""
    for b in batches:
        hit, count, sha = [], [], []
        for spans, items in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
            s = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
            u = united(s[:, 0], s[:, 1])
            names = sorted({x for part in items for x in part})
            hit.append(int((u[:, 1] - u[:, 0]).sum()))
            count.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.record_batch([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def indexes(docs: DataFrame, bench: DataFrame, window: int, item_bytes: int) -> Iterator[Index]:
    """An index for each pass over the corpus, of items of at most item_bytes together (or one item)."""
    texts, items = docs.select("text"), bench.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // item_bytes))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        windows = item_windows([tuple(r) for r in own.collect()], window)
        keys: dict[int, set] = {}
        for q, grams in window_shingles(list(windows), Vocabulary(windows)):
            keys.setdefault(q, set()).update(grams.tolist())
        sought = {q: np.array(sorted(v), U) for q, v in keys.items()}
        counted = texts.mapInArrow(_count(sought), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))  # at most one row for each shingle of the pass
        yield Index(windows, {r[0]: r[1] for r in counted.collect()} if sought else {})


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, item_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first, *more = [texts.mapInArrow(_search(index, k > 0), SPAN) for k, index in enumerate(indexes(docs, bench, window, item_bytes))]
    rows = first.select("doc_id", "n_words", "key", F.array("spans").alias("spans"), F.array("items").alias("items"))
    if more:
        rest = stored(more[0].sparkSession.createDataFrame([], SPAN), "hits")
        for m in more:
            rest = rest.unionByName(m.dropDuplicates(["doc_id", "n_words", "key"]))
        rest = rest.groupBy("doc_id", "n_words", "key").agg(F.collect_list("spans").alias("s"), F.collect_list("items").alias("i"))
        same = [rows[c].eqNullSafe(rest[c]) for c in ("doc_id", "n_words", "key")]
        none = F.array().cast("array<binary>")
        rows = rows.join(rest, same, "left").select(rows.doc_id, rows.n_words, F.concat(rows.spans, F.coalesce(rest.s, none)).alias("spans"), F.concat(rows.items, F.coalesce(rest.i, F.array().cast("array<array<string>>"))).alias("items"))
    out = rows.select("doc_id", "n_words", "spans", "items").mapInArrow(_finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _clean(index: Index):
    def run(texts: pa.Array) -> pa.Array:
        clean = np.ones(len(texts), bool)
        for i, _, cut in LETTERS.texts(texts):
            clean[i + index.find(cut)[0]] = False
        return pa.array(clean)

    return run


def keep_clean(docs: DataFrame, bench: DataFrame, window: int = 10, item_bytes: int = 8_000_000) -> DataFrame:
    """The rows of docs, all columns, that contain no window of an item."""
    out = docs
    for index in indexes(docs, bench, window, item_bytes):
        out = out.where(by_text(_clean(index), "boolean"))
    return out
