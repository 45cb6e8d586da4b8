"""zstd over Arrow columns, with a cap on what is taken back; Spark has no function of its own for it."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def unpacked(data: bytes, most: int) -> bytes | None:
    """What data decompresses to, or None if that is more than `most` bytes, or no zstd; never more than that is held."""
    import zstandard

    out, size = [], 0
    try:
        reader = zstandard.ZstdDecompressor().stream_reader(data)
        while part := reader.read(min(1 << 16, most + 1 - size)):
            out.append(part)
            size += len(part)
            if size > most:
                return None
    except zstandard.ZstdError:
        return None
    return b"".join(out)


def round_trip(rows: DataFrame, key: str, text: str, most: int, level: int = 3) -> DataFrame:
    """key, accepted, sha256: texts compressed and taken back within `most` bytes; null texts are empty, refused ones have no hash."""

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for b in batches:
            back = [unpacked(packer.compress((t or "").encode()), most) for t in b.column("text").to_pylist()]
            sha = [None if x is None else hashlib.sha256(x).hexdigest() for x in back]
            yield pa.record_batch([b.column("key"), pa.array([x is not None for x in back], pa.bool_()), pa.array(sha, pa.string())], ["key", "accepted", "sha256"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, accepted boolean, sha256 string").withColumnRenamed("key", key)
