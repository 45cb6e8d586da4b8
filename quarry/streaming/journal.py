"""Streams: applying journals per origin, exporting changes, and putting chunks in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

OUTCOME = "origin string, outcome string, applied long, generation long, seq long, held long"
EVENTS = "origin string, generation long, seq long, op string, content string"


class ApplyJournal(StatefulProcessor):
    """One origin's clock, possession and the number of contents held, so that no batch counts them again.

    Rows of a batch: journal events (have, drop, attest) and, for recovery, rows of a snapshot (op `snapshot`,
    one for each held content, seq being the snapshot's). A batch is applied as a whole or not at all.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "generation long, seq long, n long")
        self.held = handle.getMapState("held", "content string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        now = self.clock.get() if self.clock.exists() else None
        generation, seq, held = map(int, now) if now else (0, 0, 0)
        outcome, n = "replayed", 0
        snap = batch[batch.op == "snapshot"]
        if len(snap):
            g, s = max(zip(snap.generation.astype(int), snap.seq.astype(int), strict=True))
            if (g, s) >= (generation, seq):
                self.held.clear()
                contents = set(snap[(snap.generation == g) & (snap.seq == s)].content.dropna())
                for c in contents:
                    self.held.updateValue((c,), (s,))
                held = len(contents)
                generation, seq, outcome = g, s, "replaced"
        events = batch[batch.op != "snapshot"].sort_values("seq").drop_duplicates("seq")
        if len(events):
            theirs = int(events.generation.max())
            fresh = events[events.seq > seq] if theirs == generation or generation == 0 else events
            if theirs < generation:
                outcome = "ignored"
            elif generation and theirs > generation or (len(fresh) and fresh.seq.tolist() != list(range(seq + 1, seq + 1 + len(fresh)))):
                outcome = "needs_snapshot"
            elif len(fresh):
                for op, content, at in zip(fresh.op, fresh.content, fresh.seq, strict=True):
                    if content is None or op not in ("have", "drop"):  # an event without content moves the clock alone
                        continue
                    there = self.held.containsKey((content,))
                    if op == "have":
                        self.held.updateValue((content,), (int(at),))
                        held += not there
                    elif there:
                        self.held.removeKey((content,))
                        held -= 1
                generation, seq, outcome, n = theirs, int(fresh.seq.iloc[-1]), "applied", len(fresh)
        self.clock.update((generation, seq, held))
        yield pd.DataFrame([(key[0], outcome, n, generation, seq, held)], columns=["origin", "outcome", "applied", "generation", "seq", "held"])

    def close(self) -> None:
        pass


def applied_stream(events: DataFrame) -> DataFrame:
    """Outcomes of a stream of EVENTS, origin by origin (needs the RocksDB state store)."""
    return events.groupBy("origin").transformWithStateInPandas(statefulProcessor=ApplyJournal(), outputStructType=OUTCOME, outputMode="Update", timeMode="None")


class Reorder(StatefulProcessor):
    """Chunks of a transfer in order of offset: what is contiguous goes out, the rest waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "off long")
        self.waiting = handle.getMapState("waiting", "off long", "len long, data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = int(self.next.get()[0]) if self.next.exists() else 0
        for part in rows:
            for off, size, data in zip(part.off, part.len, part.data, strict=True):
                if off >= at:
                    self.waiting.updateValue((int(off),), (int(size), data))
        out = []
        while self.waiting.containsKey((at,)):
            size, data = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            out.append((key[0], at, int(size), data))
            at += int(size)
        self.next.update((at,))
        if out:
            yield pd.DataFrame(out, columns=["transfer", "off", "len", "data"])

    def close(self) -> None:
        pass


def ordered_stream(chunks: DataFrame) -> DataFrame:
    """transfer, off, len, data without gaps, of a stream in any order."""
    return chunks.groupBy("transfer").transformWithStateInPandas(statefulProcessor=Reorder(), outputStructType="transfer string, off long, len long, data string", outputMode="Append", timeMode="None")


CANDIDATES = "content string, path string, sigs array<string>, ca string, gone boolean, at long"
OPS = "op string, content string, path string, at long"


class Export(StatefulProcessor):
    """What is exported of one content: a have when it comes, a drop when it goes, and an attest where there is more to believe.

    The state is whether it is held and which signatures of which path were exported, so no history is read again.
    A fact without signature or content address can't be believed: of it only possession is exported.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "held boolean")
        self.known = handle.getMapState("known", "path string", "sigs array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = bool(self.held.get()[0]) if self.held.exists() else False, []
        for row in pd.concat(list(rows)).sort_values("at").itertuples():
            if row.gone:
                if held:
                    out.append(("drop", key[0], row.path, row.at))
                held = False
                continue
            sigs, ca = set() if row.sigs is None else set(row.sigs), isinstance(row.ca, str) and row.ca != ""
            known = set(self.known.getValue((row.path,))[0]) if self.known.containsKey((row.path,)) else None
            if (sigs or ca) and (known is None or not sigs <= known):
                self.known.updateValue((row.path,), (sorted(sigs | (known or set())),))
                out.append(("attest", key[0], row.path, row.at))
            if not held:
                out.append(("have", key[0], row.path, row.at))
            held = True
        self.held.update((held,))
        if out:
            yield pd.DataFrame(out, columns=["op", "content", "path", "at"])

    def close(self) -> None:
        pass


def candidate_events(rows: DataFrame) -> DataFrame:
    """Rows of the source (id, path, content, sigs, ca) as CANDIDATES that have come."""
    return rows.select("content", "path", "sigs", "ca", F.lit(False).alias("gone"), F.col("id").alias("at"))


def departed(local: DataFrame, journal: DataFrame, at: int) -> DataFrame:
    """A full pass: CANDIDATES that have gone, being held as the journal (op, content, path, at) says, and not local (content)."""
    last = journal.where("op in ('have', 'drop')").groupBy("content").agg(F.max(F.struct("at", "op", "path")).alias("m"))
    gone = last.where("m.op = 'have'").join(local.select("content").distinct(), "content", "left_anti")
    none = F.lit(None)
    return gone.select("content", F.col("m.path").alias("path"), none.cast("array<string>").alias("sigs"), none.cast("string").alias("ca"), F.lit(True).alias("gone"), F.lit(at).cast("long").alias("at"))


def exported_stream(candidates: DataFrame) -> DataFrame:
    """OPS of a stream of CANDIDATES (needs the RocksDB state store)."""
    rows = candidates.where("content is not null")
    return rows.groupBy("content").transformWithStateInPandas(statefulProcessor=Export(), outputStructType=OPS, outputMode="Append", timeMode="None")


def export_changes(candidates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The journal of a stream of CANDIDATES as files; a batch that runs again writes nothing twice."""
    ops = exported_stream(candidates)
    return ops.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def pulled(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    """A peer's published journal as a stream of EVENTS, so many files a batch at most."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def watched(events: DataFrame, handle, checkpoint: str, seconds: float = 5.0) -> StreamingQuery:
    """handle(batch, number) for what came within so many seconds together: the trigger gathers a burst of changes into one batch."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
