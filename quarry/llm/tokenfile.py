"""Token ids in ORC: range-partitioned by document id, one shard a partition, read back stripe by stripe.

Each shard is one ORC file sorted by doc_id. Its id lists are integer columns, so the format's run-length
encoding, row indexes and, for doc_id, Bloom filters apply; a reader of one document or id range skips the
other stripes by their metadata. A row holds its offset within the shard; the few shard totals give the
offset in the whole, so no running sum crosses all rows.

Defined results: null and empty text gives the end id alone; rows of one doc_id are ordered by a hash of
their text (equal rows are interchangeable); a null doc_id sorts first; an empty table gives an empty file
and no rows; other columns are not written.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from .common import fresh_path, lean, width
from .kernels import CHUNK, PIECE, RUNS, SPACED, U, buffers, folded, same_bytes

FIRST = itemgetter(0)
KEPT_WORDS = 500_000  # about 20 MB a worker
SLICE = 2 << 20  # bytes of text encoded at once
ROW = "doc_id long, shard int, pos long, local_start long, n_tokens long, ids array<int>"


class Encoder:
    """Texts to ids, each distinct word going through the tokenizer once while the worker's table holds it.

    The tokenizer drops case and never joins letters, digits and other characters, nor what white space parts, so a
    text's ids are those of its runs of each in order. The table finds a run by its hash and then compares its bytes;
    another run of the same hash gets a row of its own. Row 0 is the end id. Where an added token occurs, which is
    matched with its case, whole words are looked up, those with the token by their bytes as they are.
    """

    def __init__(self, path: str, end_id: int, bits: int = 64):
        from tokenizers import Tokenizer

        self.tok, self.end_id, self.mask = Tokenizer.from_file(path), end_id, U((1 << bits) - 1)
        self.exact = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values() if not t.normalized]
        self.reset()

    def reset(self) -> None:
        self.hashes, self.row = np.empty(0, U), np.empty(0, np.int64)
        self.first, self.many = np.zeros(1, np.int64), np.ones(1, np.int64)  # of each row its ids in flat
        self.flat = np.array([self.end_id], np.int32)
        self.start, self.size, self.z = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(8, np.uint8)  # and its bytes in z
        self.cased: dict[bytes, int] = {}

    def words(self, text: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these sizes, which text has with a space behind each, and how many each has; told apart by where they came from."""
        flat, many = [], []
        byte = np.frombuffer(text, np.uint8)
        chars = np.add.reduceat((byte & 0xC0) != 0x80, np.cumsum(size + 1) - size - 1)  # with the space
        ends = np.cumsum(size + 1)
        for at in range(0, len(size), 500):
            some = text[ends[at - 1] if at else 0 : ends[min(at + 500, len(size)) - 1]]
            got = self.tok.encode(some.decode(), add_special_tokens=False)
            stop = np.cumsum(chars[at : at + 500])
            token = np.fromiter(map(FIRST, got.offsets), np.int64, len(got.ids))
            flat.append(np.array(got.ids, np.int32))
            many.append(np.bincount(np.searchsorted(stop, token, "right"), minlength=len(stop)))
        return np.concatenate(flat), np.concatenate(many)

    def add(self, z: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The rows of new words, stretches of z."""
        stop = np.cumsum(size + 1)
        place = np.arange(stop[-1]) - np.repeat(stop - size - 1 - start, size + 1)
        place[stop - 1] = 0
        text = z[place]
        text[stop - 1] = 32
        flat, many = self.words(text.tobytes(), size)
        row = len(self.many) + np.arange(len(size))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(many) - many])
        self.many, self.flat = np.concatenate([self.many, many]), np.concatenate([self.flat, flat])
        self.start = np.concatenate([self.start, len(self.z) - 8 + stop - size - 1])
        self.size = np.concatenate([self.size, size])
        self.z = np.concatenate([self.z[:-8], text, np.zeros(8, np.uint8)])
        return row

    def rows(self, h: np.ndarray, z: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The row of each word."""
        distinct, where, back = np.unique(h & self.mask, return_index=True, return_inverse=True)
        if len(self.many) + len(distinct) > KEPT_WORDS:
            self.reset()
        at = np.searchsorted(self.hashes, distinct)
        old = at < len(self.hashes)
        old[old] = self.hashes[at[old]] == distinct[old]
        if not old.all():
            w = where[~old]
            new = self.add(z, start[w], size[w])
            self.hashes, self.row = np.insert(self.hashes, at[~old], distinct[~old]), np.insert(self.row, at[~old], new)
        row = self.row[np.searchsorted(self.hashes, distinct)][back]
        others: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(~same_bytes(z, start, size, self.z, self.start[row], self.size[row])).tolist():
            others.setdefault(z[start[i] : start[i] + size[i]].tobytes(), []).append(i)
        for places in others.values():
            row[places] = self.add(z, start[places[:1]], size[places[:1]])
        return row

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[offsets[i]:offsets[i+1]], each text with its end id, and each text's count."""
        low = folded(data[offsets[0] : offsets[-1]]).tobytes() if self.exact else b""
        special = any(t in low for t in self.exact)
        kind = SPACED if special else RUNS
        cuts, raw, many, i = [], [], [], 0
        while i < len(offsets) - 1:  # words are cut a few texts at a time, to stay in the processor's cache
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            if offsets[j] - offsets[i] > PIECE:
                parts = [(a, kind.of(data, np.array([a, b]))) for a, b in kind.pieces(data, int(offsets[i]), int(offsets[j]))]
                many.append([sum(len(c.h) for _, c in parts)])
            else:
                parts = [(int(offsets[i]), kind.of(data, offsets[i : j + 1]))]
                many.append(np.diff(parts[0][1].at))
            cuts += [c for _, c in parts]
            raw += [c.start + a for a, c in parts]
            i = j
        base = np.cumsum([0, *(len(c.z) for c in cuts)])
        h, z, size, raw, many = (np.concatenate(x) for x in ([c.h for c in cuts], [c.z for c in cuts], [c.size for c in cuts], raw, many))
        start = np.concatenate([c.start + b for c, b in zip(cuts, base, strict=False)])
        row = self.rows(h, z, start, size)
        if special:
            low = z.tobytes()
            for i in {int(np.searchsorted(start, m.start(), "right")) - 1 for t in self.exact for m in re.finditer(re.escape(t), low)}:
                word = data[raw[i] : raw[i] + size[i]]
                if word.tobytes() not in self.cased:
                    self.cased[word.tobytes()] = int(self.add(word, np.zeros(1, np.int64), size[[i]])[0])
                row[i] = self.cased[word.tobytes()]
        row = np.insert(row, np.cumsum(many), 0)
        n = self.many[row]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(stop[-1]) + np.repeat(self.first[row] - stop + n, n)]
        ends = stop[np.cumsum(many + 1) - 1]
        if size.max(initial=0) > 1 << 16 or len(self.flat) > 16 * KEPT_WORDS or len(self.z) > 32 * KEPT_WORDS:
            self.reset()
        return ids, np.diff(ends, prepend=0)


@lru_cache(2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def _encode(path: str, end_id: int):
    def run(batches):
        encode = encoder(path, end_id)
        shard, pos, start = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            data, offsets = buffers(b.column("text"))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
                ids, n = encode.texts(data, offsets[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
                at = np.cumsum(n) - n + start
                yield pa.record_batch(
                    [b.column("doc_id").slice(i, j - i), pa.array([shard] * (j - i), pa.int32()), pa.array(np.arange(pos, pos + j - i)), pa.array(at), pa.array(n), lists],
                    ["doc_id", "shard", "pos", "local_start", "n_tokens", "ids"],
                )
                pos, start, i = pos + j - i, start + int(n.sum()), j

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shards: int | None = None, shard_bytes: int = 128 << 20) -> None:
    """Encodes every whole text and writes the shards in ascending doc_id order.

    Without a number of shards there are as many as the session's shuffles have, or more for shards of about shard_bytes of text.
    """
    order = ["doc_id", "tie"]
    if not shards:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(width(docs.sparkSession), -(-size // shard_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    writer = rows.mapInArrow(lean(_encode(tokenizer, end_id)), ROW).write
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20)}
    writer.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: the file's rows with their offsets in the whole."""
    rows = spark.read.schema(ROW).orc(path)
    ends = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard
    before = F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    bases = ends.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crc(batches):
    for b in batches:
        ids = b.column("ids")
        flat = np.asarray(ids.values).astype("<i4", copy=False)
        off = np.asarray(ids.offsets)
        view = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        n = pc.cast(pc.list_value_length(ids), pa.int64())
        yield pa.record_batch([b.column("doc_id"), b.column("start"), n, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    return read_tokens(spark, path).select("doc_id", "start", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_round(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes docs to a new file in the shared folder and digests what it holds."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digest(docs.sparkSession, path)
