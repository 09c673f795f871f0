"""Commits that count as one, buckets, merging and lookups of a store."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sessionloom.schema import TABLES, Config
from sessionloom.session import Session
from sessionloom.sources.commits import Conflict, Files, Mark, to_merge, uncovered
from sessionloom.sources.store import BUCKETS, Commit, Store


def line(i, content="some text", kind="AssistantMessage"):
    return json.dumps({"id": f"i{i}", "kind": kind, "content": content, "created_at": f"2024-01-01T00:00:{i % 60:02d}Z"})


def seen(session):
    """All that a session shows of itself."""
    store = session.store
    rows = lambda df: sorted(str(r) for r in df.collect())
    status = session.status().first()
    return (
        rows(store.items("s")), rows(store.read("events", "s").select("event_id", "type")), rows(store.token_stats("s")), rows(store.working_set("s")[0]), rows(store.runs("s")), rows(store.read("artifacts", "s")),
        session.stats(), str(status.asDict(True) if status else None),
    )


@pytest.fixture
def session(spark):
    session = Session(Store.temporary(spark), "s")
    session.ingest_lines([line(1), line(2, "other text")])
    session.compact()
    return session


def test_a_repeated_id_changes_nothing(session):
    before = seen(session)
    for lines in ([line(3), line(3)], [line(3), line(1)], [line(2)]):
        with pytest.raises(ValueError, match="already has"):
            session.ingest_lines(lines)
        assert seen(session) == before
    assert session.ingest_lines([line(3)]) == 1
    assert [r.item_id for r in session.compact().collect()] == ["i2", "i3"]  # i1 says the same as i3


def test_an_ingest_that_fails_counts_nothing(session, monkeypatch):
    """Wherever it fails: before any table is written, between two, or when all are but the mark."""
    before = seen(session)
    write, left = Store._write, 0
    for after in (0, 1, 3, 5):
        done = []

        def fail(self, *args, after=after, done=done):
            if len(done) == after:
                raise OSError("lost")
            done.append(write(self, *args))

        monkeypatch.setattr(Store, "_write", fail)
        monkeypatch.setattr("sessionloom.sources.commits.Log.publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            session.ingest_lines([line(7)])
        monkeypatch.undo()
        left += len(done)
        assert len(done) == after and (seen(session) == before if after in (1, 5) else session.stats() == before[-2])
    assert session.ingest_lines([line(7)]) == 1 and session.stats()["history_items"] == 3
    assert {r.event_type: r["count"] for r in session.store.token_stats("s").collect()} == {"assistant": 3}
    assert session.store.vacuum(grace=-1) == left  # what the failed ones left
    assert session.stats()["history_items"] == 3


def test_a_compaction_that_fails_counts_nothing(session, monkeypatch):
    before = seen(session)
    monkeypatch.setattr(Commit, "replace_working_sets", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        session.compact()
    monkeypatch.undo()
    assert seen(session) == before and session.store.actions("s").select("run_id").distinct().count() == 1


def test_the_second_of_two_writers_of_a_session_fails(session):
    store = session.store
    rows = store.items("s").limit(1)
    with pytest.raises(Conflict), store.commit("s") as first:
        first.insert_items(rows.withColumn("item_id", F.lit("x")))
        Session(store, "s").ingest_lines([line(8)])
    assert sorted(r.item_id for r in store.items("s").collect()) == ["i1", "i2", "i8"]


def test_a_commit_in_many_buckets_counts_at_once(spark, monkeypatch):
    store = Store.temporary(spark)
    many = spark.range(300).select(F.concat(F.lit("u"), "id").alias("session_id"))
    put = store.log.put

    def die(bucket, *args, **more):
        if bucket > 20:
            raise OSError("lost")
        return put(bucket, *args, **more)

    monkeypatch.setattr(store.log, "put", die)
    with pytest.raises(OSError, match="lost"), store.commit(rows=many, name="all") as change:
        change.ensure_sessions(many)
    monkeypatch.undo()
    # Its writer died once it counted, before all buckets had marks: it counts in each.
    assert store.has("all") and store.read("sessions").count() == 300 and all(store.read("sessions", f"u{i}").count() == 1 for i in (0, 7, 211))
    Session(store, "u7").ingest_lines([line(1)])
    assert not store.log.pending() and store.read("sessions").count() == 300 and not store.has("none")
    assert sum(m.commit.startswith("all.") for b in range(BUCKETS) for m in store.log.marks(b)) == len(store.buckets(many))


def test_marks_cover_what_they_merge():
    marks = [Mark(i, f"c{i}") for i in range(1, 6)]
    assert to_merge(marks, 6) == [] and to_merge(marks, 5) == marks
    marks.append(Mark(6, "m6", 1, 1, 5))
    assert [m.commit for m in uncovered([*marks, Mark(7, "c7"), Mark(8, "")])] == ["m6", "c7", ""]
    marks += [Mark(i, f"c{i}") for i in range(7, 9)] + [Mark(9, "m9", 1, 7, 8)]
    assert [m.commit for m in to_merge(marks, 2)] == ["m6", "m9"]
    marks.append(Mark(10, "m10", 2, 1, 9))
    assert [m.commit for m in uncovered(marks)] == ["m10"]


def test_merging_keeps_what_counts_and_bounds_what_is_read(spark, monkeypatch):
    monkeypatch.setattr(Store.merge, "__kwdefaults__", {"at": 3})
    store, plain = Store(spark, Store.temporary(spark).path, grace=0), Store.temporary(spark)
    plain.merge = lambda *_: 0
    only = spark.createDataFrame([("s",)], "session_id string")
    for one in (store, plain):
        for k in range(10):
            row = only.withColumns({"item_id": F.lit(f"i{k}"), "kind": F.lit("Other"), "state": F.lit("Active"), "content": F.lit("x"), "token_count": F.lit(k), "pos": F.lit(k), "event_type": F.lit("e"), "ema": F.lit(float(k)), "count": F.lit(k + 1)})
            with one.commit("s") as change:
                change.insert_items(row)
                change.upsert_token_stats(row)
                (change.replace_working_sets(row, only) if k in (2, 5) else change.append_working_sets(row))
    rows = lambda one: [sorted(map(str, df.collect())) for df in (one.items("s").select("item_id", "token_count"), one.token_stats("s"), one.working_set("s")[0], one.totals("s"))]
    want = rows(plain)
    assert rows(store) == want and [len(x) for x in want] == [10, 1, 5, 1]
    bucket = store.bucket("s")
    assert len(store.log.live([bucket])[bucket]) <= 4 < len(plain.log.live([bucket])[bucket]) == 10
    # Without grace what was merged is gone, and dead versions with it.
    assert len(Files(spark).names(f"{store.path}/context_items/bucket={bucket}")) <= 4
    # A merge whose mark is lost counts nothing and is removed.
    monkeypatch.setattr(plain.log, "put", lambda *_: False)
    assert Store.merge(plain, [bucket], at=2) == 1
    monkeypatch.undo()
    assert rows(plain) == want and plain.vacuum(grace=-1) == 5 and rows(plain) == want


def test_totals_are_a_recount_without_the_history(spark, monkeypatch):
    monkeypatch.setattr(Store.merge, "__kwdefaults__", {"at": 3})
    session = Session(Store.temporary(spark), "s")
    store = session.store
    for k in range(4):
        session.ingest_lines([line(10 * k + i, "w " * (k + i), kind) for i, kind in enumerate(("AssistantMessage", "Error", "FileContent"))])
    recount = store.items("s").groupBy("kind", "state").agg(F.count(F.lit(1)).alias("items"), F.sum("token_count").alias("tokens"))
    rows = lambda df: sorted(map(tuple, df.select("kind", "state", "items", "tokens").collect()))
    assert rows(store.totals("s")) == rows(recount) and len(rows(recount)) == 3
    monkeypatch.setattr(Store, "items", lambda *_: pytest.fail("the history is read"))
    assert session.stats()["history_items"] == 12
    files = store.totals("s").inputFiles()
    assert files and all("/item_totals/" in f for f in files)


def test_a_session_among_many_commits_of_others(spark, monkeypatch):
    """A read's calls to the file system depend on its bucket's commits, not on 10,000 others."""
    calls = []
    for name in ("matching", "exists", "text"):
        monkeypatch.setattr(Files, name, lambda self, *path, f=getattr(Files, name): calls.append(path) or f(self, *path))

    def read(store):
        calls.clear()
        store = Store(spark, store.path)
        start = time.perf_counter()
        assert store.items("s").count() == 1
        return len(calls), time.perf_counter() - start

    store = Store.temporary(spark)
    Session(store, "s").ingest_lines([line(1)])
    few, quick = read(store)
    mine = store.bucket("s")
    folder = lambda b: f"{store.path.removeprefix('file:')}/log/bucket={b}"
    from pathlib import Path

    for b in range(BUCKETS):
        if b != mine:
            Path(folder(b)).mkdir(parents=True, exist_ok=True)
            for k in range(1, 160):
                Path(folder(b), f"{k:012d}").write_text(f"other.{k} 0 -1 -1")
    many, slow = read(store)
    assert many == few and slow < 2 * quick + 0.5


def test_a_point_lookup_skips_row_groups(spark):
    store = Store.temporary(spark)
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "65536")
    conf.set("parquet.page.size.row.check.min", "10")
    try:
        for k in range(2):
            rows = spark.range(k * 20_000, (k + 1) * 20_000).select(F.lit("s").alias("session_id"), F.md5(F.col("id").cast("string")).alias("item_id"), F.lit("Other").alias("kind"), F.sha2(F.col("id").cast("string"), 512).alias("content"), F.lit(1).alias("token_count"), F.current_timestamp().alias("created_at"))
            with store.commit("s") as change:
                change.insert_items(rows)
        assert store.merge([store.bucket("s")], at=2) == 1
    finally:
        conf.unset("parquet.block.size")
        conf.unset("parquet.page.size.row.check.min")
    wanted = store.read("context_items", "s").where(F.col("item_id") == F.md5(F.lit("31234")).cast("string"))
    assert wanted.count() == 1

    def scanned(df):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    key = spark.range(1).select(F.md5(F.lit("31234"))).first()[0]
    assert scanned(store.item(key, "s").select("item_id")) < 10_000 < 40_000 == scanned(store.read("context_items", "s").select("item_id"))


def test_streams_leave_no_scratch_and_read_their_buckets(spark, tmp_path):
    from sessionloom.sources.shared import shared_dir
    from sessionloom.streaming.ingest import ingest_into, item_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.jsonl").write_text(line(k) + "\n")
    store = Store.temporary(spark)
    scratch = lambda: {n for n in Files(spark).names(shared_dir(spark)) if n.startswith("scratch-")}
    before = scratch()
    ingest_into(store, item_stream(spark, str(folder), "s", per_trigger=1), Config(), str(tmp_path / "c")).awaitTermination()
    assert scratch() == before and store.items("s").count() == 3
    assert [b for b in range(BUCKETS) if store.log.marks(b)] == [store.bucket("s")]
