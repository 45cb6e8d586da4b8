"""Words are told apart by their bytes, whatever their hashes."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quarry.llm import decontaminate, jaccard
from quarry.llm.kernels import LETTERS, SPACED, buffers, same_bytes, word_hashes
from quarry.llm.queries import tokenizer_path
from quarry.llm.tokenfile import Encoder


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def swapped(s):
    return s.translate(str.maketrans("ab", "ba"))


LONG = [thue_morse(n) for n in (16, 1024, 2048)]
PAIRS = [(w, swapped(w)) for w in LONG]


def test_hashes_of_repeating_words_differ():
    for a, b in PAIRS:
        cut = SPACED.of(*buffers(pa.array([f"{a} {b}"])))
        assert cut.h[0] != cut.h[1]


def test_encoder_on_them():
    tok, e = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), 1)
    texts = [w for p in PAIRS for w in p]
    ids, n = e.texts(*buffers(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_encoder_with_hardly_a_hash():
    tok, e = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), 1, bits=3)
    texts = [f"the quick word{i} brown fox{i % 7} jumped over {i}" for i in range(60)] * 2
    for part in (texts, texts[::-1]):
        ids, n = e.texts(*buffers(pa.array(part)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in part]


def test_join_on_them(spark):
    rows = [(2 * k + i, w) for k, p in enumerate(PAIRS) for i, w in enumerate(p)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}


def test_decontamination_on_them(spark):
    docs = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(PAIRS)] + [(9, PAIRS[1][0])], "doc_id long, text string")
    bench = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(PAIRS)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, bench).collect()} == {0: False, 1: False, 2: False, 9: True}


def test_windows_are_compared_by_bytes(monkeypatch):
    monkeypatch.setattr(decontaminate, "word_hashes", lambda z, start, size: np.zeros(len(start), np.uint64))
    windows = decontaminate.item_windows([(1, "one two three four five six seven eight nine ten")], 10)
    known = decontaminate.Vocabulary(windows)
    grams = decontaminate.window_shingles(list(windows), known)[0][1]
    index = decontaminate.Index(windows, {int(g): 1 for g in grams.view(np.int64)})
    for text, n in (("ONE two three four five six seven eight nine ten", 1), ("one two three four five six seven eight nine tin", 0)):
        cut = LETTERS.of(*buffers(pa.array([text])))
        cut.h = np.zeros(len(cut.h), np.uint64)
        assert len(index.find(cut)[0]) == n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcABé中", min_size=1, max_size=40), min_size=1, max_size=20))
def test_words_like_split(words):
    cut = SPACED.of(*buffers(pa.array([" ".join(words)])))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [w.translate(fold).encode() for w in words]
    assert [cut.word(i) for i in range(len(cut.h))] == want
    assert len(set(cut.h.tolist())) == len(set(want))
    n = len(want)
    i, j = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    assert same_bytes(cut.z, cut.start[i], cut.size[i], cut.z, cut.start[j], cut.size[j]).tolist() == [want[a] == want[b] for a, b in zip(i, j, strict=True)]
    assert word_hashes(cut.z, cut.start, cut.size).tolist() == cut.h.tolist()
