import hashlib
import io
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom.memory import MemoryRef, NullMemory, RetrievalQuery
from sessionloom.operators import predict
from sessionloom.protocol import Server
from sessionloom.schema import WIRE, Config, Context, Model, Reserve
from sessionloom.session import Session
from sessionloom.sources.store import Store
from sessionloom.streaming.ingest import ema_stream, ingest_into, item_stream, latest_state, running_ema, start


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")
    return str(path)


def item(i, kind="FileContent", content="same text", **more):
    return {"id": f"i{i}", "kind": kind, "content": content, "created_at": f"2024-01-01T00:00:{i:02d}Z"} | more


def test_ingest_plan_compact_reopen(spark, tmp_path):
    rows = [{"type": "session.start", "session_id": "s"}, "", item(0), {"type": "context.add", "item": item(1)}, item(2, "UserMessage", "never lose this"), item(3, "CommandOutput", "a\n\n50%\nb", metadata={"command": "make", "exit_code": 0})]
    store = Store(spark, str(tmp_path / "db"))
    config = Config(context=Context(max_context_window=100), reserve=Reserve(10, 10))
    session = Session(store, "s", config, Model("m", 100, 10))
    assert session.ingest_file(write(tmp_path / "a.jsonl", rows)) == 4
    assert store.read("events").where("type = 'context.add'").count() == 4
    actions, header = session.plan()
    got = {x.item_id: x.action for x in actions.collect()}
    assert got == {"i0": "Deduplicate", "i1": "Keep", "i2": "Pin", "i3": "Keep"}
    working = session.compact().collect()
    assert [x.item_id for x in working] == ["i1", "i2", "i3"] and [x.pos for x in working] == [1, 2, 3]
    assert session.stats()["compactions"] == 1 and session.stats()["history_items"] == 4
    again = Session(store, "s", config)
    assert again.model.name == "m"
    again.ingest_file(write(tmp_path / "b.jsonl", [item(9, "UserMessage", "hi")]))
    assert [x.item_id for x in store.working_set()[0].orderBy("pos").collect()] == ["i1", "i2", "i3", "i9"]
    assert again.status().first().item_count == 4
    with pytest.raises(ValueError, match="already has"):
        again.ingest_file(write(tmp_path / "c.jsonl", [item(9)]))


def test_bad_records(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    session = Session(store, "s")
    for bad in ('{"content": "x"}', '{"kind": "Nope", "content": "x"}', "{oops", '{"kind": "Other", "content": "x", "content_hash": "00"}'):
        with pytest.raises(Exception):  # noqa: B017, PT011
            session.ingest_file(write(tmp_path / "bad.jsonl", [bad]))
    assert store.items().count() == 0


def test_empty_session(spark, tmp_path):
    session = Session(Store(spark, str(tmp_path / "db")), "none")
    assert session.plan()[0].count() == 0 and session.stats()["history_items"] == 0 and session.predicted() == 0


def test_protocol(spark, tmp_path):
    server = Server(Store(spark, str(tmp_path / "db")))
    lines = [
        {"type": "session.start", "request_id": "1", "session_id": "p", "model": {"name": "m", "context_window": 50_000}},
        {"type": "context.add", "request_id": "2", "item": {"kind": "UserMessage", "content": "hello world"}},
        {"type": "context.plan", "request_id": "3"},
        {"type": "context.compact", "request_id": "4", "predicted_extra_tokens": 10},
        {"type": "context.stats", "request_id": "5"},
        {"type": "nope", "request_id": "6"},
    ]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join([*map(json.dumps, lines), "", "{bad"]) + "\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["type"] for x in got] == ["ok", "ok", "plan", "working_set", "stats", "error", "error"]
    assert got[3]["total_tokens"] == 2 and got[-1]["request_id"] == "unknown" and got[4]["stats"]["composition"] == [["UserMessage", 2]]
    assert server.store.items().first().source.adapter == "stdio"


def test_ema_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        path = write(folder / f"{k}.jsonl", [item(10 * k + i, "CommandOutput" if i % 2 else "AssistantMessage", "w " * (i * 7 + k + 1)) for i in range(6)])
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files arrive in this order
    config = Config()
    items = item_stream(spark, str(folder), "s", per_trigger=1)
    start(ema_stream(items, config).writeStream.format("memory").queryName("emas").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True), spark).awaitTermination()
    got = {r.event_type: (r.ema, r["count"]) for r in spark.sql("SELECT event_type, max_by(ema, count) ema, max(count) count FROM emas GROUP BY event_type").collect()}
    store = Store(spark, str(tmp_path / "db"))
    ingest_into(store, item_stream(spark, str(folder), "s"), config, str(tmp_path / "c2")).awaitTermination()
    want = {r.event_type: (r.ema, r["count"]) for r in predict.token_stats(store.items(), config).collect()}
    assert got == want and store.items().count() == 18
    assert {r.event_type: (r.ema, r["count"]) for r in store.token_stats().collect()} == want
    assert store.read("events").where("type = 'context.add'").count() == 18


def test_streams_fill_working_sets_and_repeat_nothing(spark, tmp_path):
    store = Store.temporary(spark)
    config = Config()
    Session(store, "s", config).compact()
    assert store.working_set("s")[1].count() == 1
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.jsonl", [item(1), item(2, "UserMessage", "x"), item(1)])
    for _ in range(2):  # as after a loss of the stream's checkpoint: the same commits again
        ingest_into(store, item_stream(spark, str(folder), "s"), config, str(tmp_path / f"c{_}")).awaitTermination()
        assert [r.item_id for r in store.working_set("s")[0].orderBy("pos").collect()] == ["i1", "i2"]
        assert store.items().count() == 2 and store.read("events").where("type = 'context.add'").count() == 2
        assert {(r.event_type, r["count"]) for r in store.token_stats().collect()} == {("file-read", 1), ("other", 1)}


def test_checkpoints_and_late_items_are_ingested_as_others(spark):
    store = Store.temporary(spark)
    session = Session(store, "s")
    rows = spark.createDataFrame([("i1", "AssistantMessage", "one two three four", "2024-01-02T00:00:00Z", "L2")], "id string, kind string, content string, created_at string, compression_level string")
    columns = spark.createDataFrame([], WIRE).columns
    wire = lambda df: df.unionByName(spark.createDataFrame([], WIRE), allowMissingColumns=True).select(F.lit("s").alias("session_id"), *columns)
    session.ingest(wire(rows))
    assert store.items("s").first().compression_level == "L0"
    session.compact()
    made = F.struct(F.lit("goal").alias("goal"), F.lit("open").alias("status"))
    assert session.ingest_checkpoint(spark.range(1).select(F.lit("k1").alias("item_id"), F.timestamp_seconds(F.lit(0)).alias("created_at"), made.alias("checkpoint"))) == 1
    # An item of an earlier time than those there: behind them in the working set, and last in the average.
    session.ingest(wire(spark.createDataFrame([("i0", "AssistantMessage", "one two", "2020-01-01T00:00:00Z", "L2")], rows.schema)))
    working = store.working_set("s")[0].orderBy("pos").collect()
    assert [(r.item_id, r.compression_level) for r in working] == [("i1", "L0"), ("k1", "L0"), ("i0", "L0")]
    stats = {r.event_type: (r.ema, r["count"]) for r in store.token_stats("s").collect()}
    assert stats["assistant"] == (0.25 * 2 + 0.75 * 4, 2) and stats["other"][1] == 1
    assert store.read("events", "s").where("type = 'context.add'").count() == 3
    actions, _ = session.plan()
    assert [(r.item_id, r.action) for r in actions.orderBy("idx").collect()] == [("k1", "Keep"), ("i0", "Keep"), ("i1", "Keep")]
    assert session.last_plan is not None and session.status().first().item_count == 3


def test_an_ingest_writes_its_sessions_part_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    many = spark.range(2_000).select(F.concat(F.lit("u"), "id").alias("session_id"))
    sets = many.select("session_id", F.lit(1).alias("pos"), F.concat(F.lit("x"), "session_id").alias("item_id"), F.lit("Other").alias("kind"), F.lit("t").alias("content"), F.lit(1).alias("token_count"), F.lit("L0").alias("compression_level"))
    with store.commit(rows=many) as change:
        change.replace_working_sets(sets, many)
    parquet = lambda: {p for p in (tmp_path / "db").rglob("*.parquet")}
    session = Session(store, "u7")
    there, before = parquet(), {p: p.stat().st_mtime_ns for p in parquet()}
    session.ingest_lines(['{"id": "n", "kind": "UserMessage", "content": "hi"}'])
    new = parquet() - there
    assert {p.relative_to(tmp_path / "db").parts[0] for p in new} == {"context_items", "item_totals", "events", "token_stats", "working_set_items"} and len(new) == 5
    assert len({p.parent.parent.name for p in new}) == 1 and all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert sum(p.stat().st_size for p in new) < 40_000
    assert [r.item_id for r in store.working_set("u7")[0].orderBy("pos").collect()] == ["xu7", "n"]
    assert store.working_set()[0].count() == 2_001


def test_lines_from_a_stream_and_the_number_of_a_bad_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sessionloom.session.AT_ONCE", 2)
    session = Session(Store.temporary(spark), "s")
    good = [json.dumps(item(i)) for i in range(3)]
    assert session.ingest_lines([good[0] + "\n", "\n", good[1] + "\n"]) == 2
    with pytest.raises(ValueError, match="line 4: no kind"):
        session.ingest_lines([good[2], "", "", '{"content": "x"}'])
    assert session.store.items("s").count() == 3
    with pytest.raises(ValueError, match="line 3: not JSON"):
        session.ingest_file(write(tmp_path / "bad.jsonl", ["", item(7), json.dumps(item(8)) + " rubbish", "{"]))
    with pytest.raises(Exception, match="hash"):
        session.ingest_lines([json.dumps(item(9, content="x", content_hash=hashlib.sha256(b"x").hexdigest().upper()))])


def test_another_token_counter(spark):
    words = lambda c: F.size(F.split(F.trim(c), r"\s+")).cast("long")
    store = Store.temporary(spark)
    session = Session(store, "s", counter=words)
    session.ingest_lines([json.dumps(item(1, content="a, b, c."))])
    assert store.items("s").first().token_count == 3 and session.compact().first().token_count == 3


def test_ema_values(spark):
    df = spark.createDataFrame([("s", "e", i, v) for i, v in enumerate((100, 200, 50))], "session_id string, event_type string, at int, token_count long")
    row = predict.ema(df, 0.25, order=("at",)).first()
    assert (row.ema, row["count"]) == (106.25, 3)


def serial(rows, alpha):
    """Averages and counts of (key, value) rows in their order, one after the other."""
    out, a = {}, np.float32(alpha)
    for key, v in rows:
        now, count = out.get(key, (None, 0))
        v = None if v is None else np.float32(v)
        out[key] = (v if now is None or v is None else np.float32(a * v + (np.float32(1) - a) * now), count + 1)
    return {k: (None if m is None else float(m), n) for k, (m, n) in out.items()}


@pytest.mark.parametrize("alpha", [0.25, 1.0, 0.0, 0.01])
def test_ema_of_a_hot_key_is_folded_in_parts(spark, alpha):
    rows = [("hot" if i % 3 else None, "e" if i % 40 else "f", (i * 37) % 2500, None if i in (101, 2051) else (i * i) % 997 / 7 + 1) for i in range(2500)]
    df = spark.createDataFrame(rows, "session_id string, event_type string, at int, v double").repartition(5)
    out = predict.ema(df, alpha, value="v", order=("at",))
    got = {(r.session_id, r.event_type): (r.ema, r["count"]) for r in out.collect()}
    want = serial([((s, e), v) for s, e, _, v in sorted(rows, key=lambda r: r[2])], alpha)
    if alpha >= 0.25:
        assert got == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2 and "Python" not in plan and "InArrow" not in plan
    assert got.keys() == want.keys() and len(got) == 4
    for key, (m, n) in want.items():
        assert got[key][1] == n and got[key][0] == (None if m is None else pytest.approx(m, rel=1e-5))


def test_a_stream_of_averages_goes_on(spark, tmp_path):
    """From stored averages, over micro-batches of more rows than are held, and after a restart; keys that come no more stay as they are."""
    folder, made = tmp_path / "in", []
    folder.mkdir()

    def arrive(k, n):
        rows = [("a" if (i + k) % 5 else "b", (i * 7919) % n, float((i * i + k) % 101)) for i in range(n)]
        made.extend((key, v) for key, _, v in sorted(rows, key=lambda r: r[1]))
        pd.DataFrame(rows, columns=["key", "at", "v"]).to_parquet(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))

    before = spark.createDataFrame([("a", 50.0, 3), ("c", 7.0, 1)], "key string, ema double, count long")

    def run():
        rows = spark.readStream.schema("key string, at long, v double").option("maxFilesPerTrigger", 1).parquet(str(folder))
        updates = running_ema(rows, 0.25, {"key": "string"}, "v", ["at"], before=before)
        return {r.key: (r.ema, r["count"]) for r in latest_state(updates, ["key"], str(tmp_path / "c")).collect()}

    def wanted():
        a = serial([("a", 50.0), *(r for r in made if r[0] == "a")], 0.25)["a"]
        return {"a": (a[0], a[1] + 2), "b": serial([r for r in made if r[0] == "b"], 0.25)["b"]}

    arrive(0, 900)
    arrive(1, 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert run() == wanted()
        arrive(2, 60)
        assert run() == wanted()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_averages_of_many_keys_share_calls(monkeypatch):
    """A group's keys are folded in one call and kept as one list: keys with nulls, equal names of other keys, more values than are held, and keys that come no more."""
    import random

    from sessionloom.streaming import ingest

    class Listed:
        rows, calls = [], 0

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.calls = rows, self.calls + 1

    monkeypatch.setattr(ingest, "ROWS_AT_ONCE", 50)
    pick = random.Random(4)
    for alpha in (0.25, 1.0, 0.0):
        made = ingest._Averages(alpha, 2, 1, None)
        made.state, all_rows, out = Listed(), [], {}
        for batch in range(3):
            rows = [(pick.choice(["1", "a", None]), pick.choice(["x", None, "a"]), 1000 * batch + i, None if pick.random() < 0.02 else float(pick.randint(0, 99))) for i in range(900 if batch < 2 else 20)]
            rows += [("once", "x", 0, 5.0)] * (batch == 0)
            all_rows += rows
            pick.shuffle(rows)
            frame = pd.DataFrame(rows, columns=["key0", "key1", "order0", "value"])
            frames = [*made.handleInputRows((0,), iter([frame[k : k + 70] for k in range(0, len(frame), 70)]), None)]
            assert len(frames) == 1 and made.state.calls == batch + 1
            out |= {(k, j): (None if pd.isna(e) else e, n) for k, j, e, n in frames[0].astype(object).itertuples(index=False)}
        want = serial([((a, b), v) for a, b, _, v in all_rows], alpha)
        if alpha == 0.0:  # each batch begins with what was there
            assert {k: n for k, (_, n) in out.items()} == {k: n for k, (_, n) in want.items()}
        else:
            assert out == want and {tuple(r[:2]): tuple(r[2:4]) for r in made.state.rows} == want


def test_memory(spark):
    assert MemoryRef("none", "k").uri() == "memory://none/k" and RetrievalQuery("s", "q").max_results == 5
    m = NullMemory(spark)
    rows = spark.createDataFrame([("i",)], "item_id string")
    assert m.store(rows).first().uri == "memory://none/i" and m.retrieve(RetrievalQuery("s", "q")).count() == 0 and m.get(MemoryRef("none", "i")).count() == 0


def test_queries_have_sql():
    from sessionloom.plans.oracle import ORACLES
    from sessionloom.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)


def test_null_texts_in_tables(spark):
    from sessionloom.sources import tables

    docs = spark.createDataFrame([(1, None, None, None)], "doc_id long, text string, lang string, source string")
    assert tables.from_documents(docs).select("session_id", "token_count").first() == ("", 0)
    assert tables.from_conversations(spark.createDataFrame([(1, 0, None, None)], "conv_id long, turn long, role string, text string")).select(F.col("kind")).first().kind == "UserMessage"
