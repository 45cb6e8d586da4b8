import random
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
from functools import lru_cache
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quarry.llm.queries import tokenizer_path
from quarry.llm.tokenfile import Encoder, read_tokens, token_digest, write_tokens

SCHEMA = "doc_id long, text string, shard string, ids string"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    chars = "ab é\tZ\n\x0b\x1c\x85 ́'st 09 .,<|endoftext|>\U0001f600ΣςΣ "
    out = [(rng.randrange(10**6), "".join(rng.choice(chars) for _ in range(rng.choice([0, 1, 20, 300]))), "s", None) for _ in range(150)]
    out += [(7, None, None, None), (8, "", "", ""), (9, "  \n ", "", ""), (10, "word " * 30_000, "", ""), (11, "y" * 5000, "", ""), (None, "no id", "", "")]
    return out + [(12, "same row", "", ""), (12, "same row", "", ""), (12, "other text", "", ""), (13, "I'll don't <|startoftext|> İstanbul", "", "")]


def test_round_trip(spark, data, tmp_path):
    tok = Tokenizer.from_file(tokenizer_path())
    path = f"file://{tmp_path}/tokens"
    write_tokens(spark.createDataFrame(data, SCHEMA), path, tokenizer_path(), end_id=1, shards=5)
    got = sorted(token_digest(spark, path).collect(), key=lambda r: r.start)
    ids = {}
    for doc, text, *_ in data:
        ids.setdefault(doc, []).append([*tok.encode(text or "", add_special_tokens=False).ids, 1])
    start = 0
    for r in got:
        mine = next(x for x in ids[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        ids[r.doc_id].remove(mine)
        assert r.start == start
        start += r.n_tokens
    assert not any(ids.values())
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    one = read_tokens(spark, path).where("doc_id = 10").collect()
    assert len(one) == 1 and list(one[0].ids) == [*tok.encode("word " * 30_000, add_special_tokens=False).ids, 1]
    files = sorted(tmp_path.glob("tokens/*.orc"))
    assert 1 < len(files) <= 5 and all(orc.ORCFile(f).nstripes >= 1 for f in files)


def test_empty(spark, tmp_path):
    write_tokens(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", tokenizer_path())
    assert token_digest(spark, f"file://{tmp_path}/none").count() == 0


def test_added_tokens_keep_their_case():
    tok, e = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), 1)
    texts = ["<|endoftext|> Word", "<|ENDOFTEXT|> word", "a<|EndOfText|>B a<|endoftext|>b", "A<|ENDOFTEXT|>b x<|startoftext|><|StartOfText|>", "", "<|STARTOFTEXT|> <|startoftext|>"]
    for some in ([t] for t in [*texts, *texts]), [texts, texts[::-1]]:
        for group in some:
            raw = [t.encode() for t in group]
            ids, n = e.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in group]


PARTS = ["the", "Don't", "'s", "'", "''ll", "it's-5", "12", "3rd", "a.b,c!", "é", "été,", "…", "éx", "ß", "中文字", "x y", "%%%", "&amp;", "İ", " ", "\x1c", "#1", "O'Neil's", "'tis", "re've", "<|", "|>", "_a_", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=12).map("".join), min_size=1, max_size=4))
def test_runs_like_whole_texts(texts):
    """What is looked up run by run is what the tokenizer makes of the text as a whole."""
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tok, e = encoders()
    raw = [t.encode() for t in texts]
    ids, n = e.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


@lru_cache(1)
def encoders():
    return Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), 1)


def test_index_and_bloom_filter(spark, tmp_path):
    """The files hold a row index of the stride asked for, and Bloom filters on doc_id that tell what is missing."""
    df = spark.range(5000).selectExpr("id * 2 as doc_id", "'' as lang", "'' as source", "concat('word ', id) as text").select("doc_id", "text")
    write_tokens(df, f"file://{tmp_path}/t", tokenizer_path(), shards=1)
    (file,) = tmp_path.glob("t/*.orc")
    jvm = spark._jvm
    options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{file}"), options)
    assert reader.getRowIndexStride() == 1000 and reader.getNumberOfRows() == 5000
    rows = reader.rows()
    columns = spark.sparkContext._gateway.new_array(jvm.boolean, 8)  # the row, its six fields, and the elements of ids
    columns[1] = True
    index = rows.readRowIndex(0, None, columns)
    assert len(index.getRowGroupIndex()[1].getEntryList()) == 5
    blooms = [b for b in (index.getBloomFilterIndex()[k] for k in range(8)) if b is not None]
    assert blooms and blooms[0].getBloomFilterCount() == 5
    rows.close()
    plan = read_tokens(spark, f"file://{tmp_path}/t").where("doc_id = 4444")
    assert [list(r.ids)[-1] for r in plan.collect()] == [1] and read_tokens(spark, f"file://{tmp_path}/t").where("doc_id = 4445").count() == 0
