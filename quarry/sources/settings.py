"""key = value settings files, trusted keys, and the checked configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F


def settings(lines: DataFrame) -> DataFrame:
    """key, value, line of a file's lines (value, line); comments are stripped, lines without = skipped."""
    bare = F.trim(F.regexp_replace("value", "#.*$", ""))
    key, value = F.trim(F.substring_index(bare, "=", 1)), F.trim(F.regexp_replace(bare, "^[^=]*=", ""))
    return lines.where(F.contains(bare, F.lit("="))).select(key.alias("key"), value.alias("value"), "line")


def trusted_keys(lines: DataFrame) -> DataFrame:
    """name, key: the last trusted-public-keys and all extra- ones; malformed entries are skipped."""
    s = settings(lines)
    last = s.where("key = 'trusted-public-keys'").agg(F.max_by("value", "line").alias("value")).where("value is not null")
    extra = s.where("key = 'extra-trusted-public-keys'").select("value")
    words = last.unionByName(extra).select(F.explode(F.split("value", r"\s+")).alias("w"))
    out = words.where("instr(w, ':') > 1").select(F.substring_index("w", ":", 1).alias("name"), F.regexp_replace("w", "^[^:]*:", "").alias("key"))
    return out.where(F.length(F.expr("try_to_binary(key, 'base64')")) == 32).distinct()


@dataclass
class Config:
    """Knobs of a replica; problems() says what is wrong with them. peers: (name, url) in any order."""

    name: str = "self"
    peers: list[tuple[str, str]] = field(default_factory=list)
    segment: int = 4 << 20
    breaker_failures: int = 3
    encodings: dict[str, str] = field(default_factory=dict)

    KNOBS = ("name", "peers", "segment", "breaker_failures", "encodings")

    @classmethod
    def read(cls, values: dict[str, object]) -> Config:
        """From named values; an unknown name is refused."""
        if unknown := sorted(set(values) - set(cls.KNOBS)):
            raise ValueError(f"unknown settings {unknown}")
        return cls(**values)

    def problems(self) -> list[str]:
        names, out = sorted(n for n, _ in self.peers), []
        if self.name in names:
            out.append("a peer has the replica's own name")
        out += [f"two peers are called {a}" for a, b in zip(names, names[1:], strict=False) if a == b]
        out += [f"peer {n} is not reached by http" for n, url in self.peers if not url.startswith("http://")]
        if self.segment < 4096:
            out.append("segments are shorter than 4096 bytes")
        if self.breaker_failures < 1:
            out.append("a breaker needs a failure to open")
        for n, e in self.encodings.items():
            level = e.removeprefix("zstd:")
            if e not in ("none", "auto") and not (e.startswith("zstd:") and level.isdigit() and 1 <= int(level) <= 22):
                out.append(f"encoding {e} of {n} is unknown")
            if n not in names:
                out.append(f"encoding of {n}, who is no peer")
        return out
