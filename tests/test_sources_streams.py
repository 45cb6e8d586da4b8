import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.sources import records
from quarry.streaming.journal import CANDIDATES, EVENTS, applied_stream, candidate_events, departed, export_changes, exported_stream, ordered_stream, pulled, watched

HEX = "ab" * 32


@pytest.fixture
def source(tmp_path):
    path = str(tmp_path / "db.sqlite")
    con = sqlite3.connect(path)
    con.execute("create table ValidPaths (id integer primary key autoincrement, path text, hash text, registrationTime int, deriver text, narSize int, ultimate int, sigs text, ca text)")
    for i in range(20):
        con.execute("insert into ValidPaths (path, hash, narSize, sigs, ca) values (?, ?, ?, ?, ?)", (f"/store/{i:032d}-n{i}", f"sha256:{HEX}" if i % 5 else "md5:1", 10 if i % 7 else None, "k:a k:b", ""))
    con.commit()
    yield path, con
    con.close()


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batch_stream_and_lookup(spark, source, tmp_path, rocks):
    path, con = source
    records.register(spark)
    rows = spark.read.format("records").option("path", path).load()
    assert rows.count() == 20 and spark.read.format("records").option("path", path).option("since", 15).load().count() == 5
    good = records.candidates(rows).collect()
    assert len(good) == sum(bool(i % 5 and i % 7) for i in range(20)) and good[0].sigs == ["k:a", "k:b"] and good[0].ca is None
    assert records.by_part(rows, "/store", f"{7:032d}").collect()[0].id == 8 and records.by_part(rows, "/store", "x").count() == 0
    assert records.ids_only_grow(path) and records.greatest(path) == 20

    out, checkpoint = str(tmp_path / "journal"), str(tmp_path / "check")

    def export():
        stream = records.candidates(spark.readStream.format("records").option("path", path).load()).withColumn("content", F.col("path"))
        export_changes(candidate_events(stream), out, checkpoint).awaitTermination()
        return spark.read.parquet(out).count()

    first = export()
    assert first == 2 * len(good) and export() == first
    con.execute("insert into ValidPaths (path, hash, narSize) values ('/store/new', ?, 1)", (f"sha256:{HEX}",))
    con.commit()
    assert export() == first + 1  # unsigned: possession alone


def test_drift_is_refused(spark, tmp_path):
    path = str(tmp_path / "other.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("create table ValidPaths (id integer)")
    with pytest.raises(records.SchemaDrift):
        records.greatest(path)


def files(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, make, schema, src, check):
    got = []
    stream = make(spark.readStream.schema(schema).parquet(src))
    mode = "append" if make is ordered_stream else "update"
    q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in got)


def test_journal_stream(spark, tmp_path, rocks):
    src, check = str(tmp_path / "events"), str(tmp_path / "state")
    steps = [
        ([("a", 1, 1, "have", "x"), ("a", 1, 2, "have", "y"), ("b", 3, 1, "have", "x")], {("a", "applied", 2, 1, 2, 2), ("b", "applied", 1, 3, 1, 1)}),
        ([("a", 1, 1, "have", "x"), ("a", 1, 2, "have", "y")], {("a", "replayed", 0, 1, 2, 2)}),
        ([("a", 1, 9, "have", "z"), ("b", 2, 2, "have", "q")], {("a", "needs_snapshot", 0, 1, 2, 2), ("b", "ignored", 0, 3, 1, 1)}),
        ([("a", 2, 1, "have", "z")], {("a", "needs_snapshot", 0, 1, 2, 2)}),
        ([("a", 2, 5, "snapshot", "z")], {("a", "replaced", 0, 2, 5, 1)}),
        ([("a", 2, 6, "drop", "z")], {("a", "applied", 1, 2, 6, 0)}),
        ([("a", 2, 7, None, None), ("a", 2, 8, "have", "z"), ("a", 2, 9, "have", "z"), ("a", 2, 10, "drop", "never")], {("a", "applied", 4, 2, 10, 1)}),
    ]
    for rows, want in steps:
        files(spark, rows, EVENTS, src)
        assert set(run(spark, applied_stream, EVENTS, src, check)) == want


def test_chunks_come_out_in_order(spark, tmp_path, rocks):
    src, check, schema = str(tmp_path / "chunks"), str(tmp_path / "state"), "transfer string, off long, len long, data string"
    files(spark, [("t", 4, 2, "ef"), ("t", 0, 2, "ab"), ("u", 1, 1, "z")], schema, src)
    assert run(spark, ordered_stream, schema, src, check) == [("t", 0, 2, "ab")]
    files(spark, [("t", 2, 2, "cd"), ("t", 0, 2, "ab")], schema, src)
    assert run(spark, ordered_stream, schema, src, check) == [("t", 2, 2, "cd"), ("t", 4, 2, "ef")]


def test_exports_come_and_go(spark, tmp_path, rocks):
    """Signatures that are new are exported again, what a full pass misses is dropped, and what comes back is had again."""
    src, check = str(tmp_path / "candidates"), str(tmp_path / "state")
    steps = [
        ([("x", "/p", ["a"], None, False, 1), ("y", "/q", None, None, False, 1), ("z", "/r", None, "fixed", False, 1), (None, "/n", None, None, False, 1)], [("attest", "x"), ("attest", "z"), ("have", "x"), ("have", "y"), ("have", "z")]),
        ([("x", "/p", ["a"], None, False, 2), ("y", "/q", [], "", False, 2)], []),
        ([("x", "/p", ["a", "b"], None, False, 3), ("x", "/other", ["a"], None, False, 4)], [("attest", "x"), ("attest", "x")]),
        ([("y", "/q", None, None, True, 5), ("none", "/s", None, None, True, 5)], [("drop", "y")]),
        ([("y", "/q", None, None, False, 6), ("z", "/r", None, None, True, 6), ("z", "/r", None, "fixed", False, 7)], [("drop", "z"), ("have", "y"), ("have", "z")]),
    ]
    for rows, want in steps:
        files(spark, rows, CANDIDATES, src)
        assert sorted(r[:2] for r in run(spark, exported_stream, CANDIDATES, src, check)) == want


def test_a_full_pass_finds_what_has_gone(spark):
    journal = spark.createDataFrame([("have", "x", "/x", 1), ("have", "y", "/y", 1), ("drop", "y", "/y", 2), ("attest", "w", "/w", 3), ("have", "z", "/z", 4)], "op string, content string, path string, at long")
    local = spark.createDataFrame([("x",), ("new",)], "content string")
    assert [(r.content, r.path, r.gone, r["at"]) for r in departed(local, journal, 9).collect()] == [("z", "/z", True, 9)]
    assert departed(local.limit(0), journal.limit(0), 9).count() == 0


def test_pulled_journals_and_bursts(spark, tmp_path):
    src, seen = str(tmp_path / "peer"), []
    for k in range(3):
        files(spark, [("a", 1, k + 1, "have", f"c{k}")], EVENTS, src)
    q = pulled(spark, src, files=1).writeStream.foreachBatch(lambda df, _: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [1, 1, 1]
    got = []
    q = watched(pulled(spark, src), lambda df, n: got.extend(r.content for r in df.collect()), str(tmp_path / "c2"), seconds=0.2)
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == ["c0", "c1", "c2"]
