import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import replay
from sessionloom.schema import ITEMS, TABLES, Config, Context, Model, Prediction, Reserve, Tools
from sessionloom.session import Session
from sessionloom.sources.store import Store

COLUMNS = ["pos", "item_id", "parent_id", "kind", "content", "token_count", "compression_level", "artifact_ref"]
ASK = "ask_id int, session_id string, at timestamp"


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).orderBy("pos").collect()]


def log(i, lines=60):
    text = "\n".join(f"step {i} {j}\n\n50%\n" + ("error: bad\n" if j % 9 == i else "") for j in range(lines))
    return {"id": f"i{i:02d}", "kind": "CommandOutput", "content": text, "created_at": f"2024-01-01T00:00:{59 - i:02d}Z", "metadata": {"command": "make", "exit_code": 1, "recoverable": i % 2 == 0}}


def test_past_views_equal_the_sets_stored_at_the_time(spark, monkeypatch):
    monkeypatch.setattr(Store.merge, "__kwdefaults__", {"at": 4})
    config = Config(context=Context(max_context_window=9_000), reserve=Reserve(100, 50), tools=Tools(large_result_tokens=100), prediction=Prediction(enabled=False))
    store = Store(spark, Store.temporary(spark).path, grace=0)
    session = Session(store, "s", config, Model("m", 6_000, 100))
    now = lambda: spark.sql("SELECT current_timestamp()").first()[0]
    stored, n = [], 0

    def more(k, **other):
        nonlocal n
        session.ingest_lines([json.dumps(log(n + i) | other) for i in range(k)])
        n += k

    more(3)
    more(1, state="Abandoned")
    stored.append((now(), sorted(r.item_id for r in session.view().collect())))
    for size, compact in ((1200, True), (300, False)):
        session.model = Model("m", size, 100)
        (session.compact if compact else session.materialize)()
        stored.append((now(), rows(store.working_set("s")[0])))
        if compact:
            more(2)
            stored.append((now(), rows(store.working_set("s")[0])))
    levels = {r[6] for _, set_ in stored[1:] for r in set_}
    assert levels >= {"L0", "L1", "L2"}, levels
    first = session.view_at(stored[0][0])
    assert sorted(r.item_id for r in first.collect()) == stored[0][1] == ["i00", "i01", "i02"]
    assert [r.item_id for r in first.collect()] == ["i02", "i01", "i00"]  # by created_at
    asked = spark.createDataFrame([(i, "s", at) for i, (at, _) in enumerate(stored)], ASK)
    got = store.past(asked)
    for i, (_, want) in enumerate(stored[1:], 1):
        assert rows(got.where(F.col("ask_id") == i)) == want, i
    by_run = [rows(session.view_after(r.run_id)) for r in store.runs("s").collect()]
    assert by_run == [stored[i][1] for i in (1,)]
    assert session.view_at(datetime(2000, 1, 1)).count() == 0 and session.view_after("none").count() == 0
    # A hot session goes by ranges, with the same rows.
    monkeypatch.setattr(replay.as_of, "__kwdefaults__", replay.as_of.__kwdefaults__ | {"hot_rows": 1, "ranges": 5})
    monkeypatch.setattr(replay.at_times, "__kwdefaults__", replay.at_times.__kwdefaults__ | {"hot_rows": 1, "ranges": 5})
    assert sorted(map(str, store.past(asked).collect())) == sorted(map(str, got.collect()))


def test_compacted_to_nothing_unknown_and_empty(spark):
    store = Store.temporary(spark)
    Session(store, "e").compact()
    late = datetime(2100, 1, 1)
    asked = spark.createDataFrame([(1, "e", late), (1, "e", late), (2, "other", late), (3, None, late), (4, "e", None), (None, "e", late)], ASK)
    assert store.past(asked).count() == 0
    Session(store, "e").ingest_lines(['{"id": "a", "kind": "Other", "content": ""}'])
    assert [(r.ask_id, r.pos, r.token_count) for r in store.past(asked).orderBy("ask_id").collect()] == [(None, 1, 0), (1, 1, 0), (1, 1, 0)]
    empty = {name: spark.createDataFrame([], TABLES[name]) for name in ("working_set_meta", "working_set_actions")}
    arrivals = spark.createDataFrame([], "session_id string, item_id string, event_id long, arrived_at timestamp")
    asks = replay.at_times(asked.limit(0), empty["working_set_meta"])
    assert replay.as_of(spark.createDataFrame([], ITEMS), arrivals, empty["working_set_meta"], empty["working_set_actions"], asks).count() == 0


@pytest.mark.parametrize("ranges", [None, 6])
def test_epochs_equal_a_plain_search(spark, ranges):
    base = datetime(2024, 1, 1)
    events = [("a" if i % 3 else None, i, f"i{i}", base + timedelta(seconds=i)) for i in range(200)]
    marks = [("a", 20, 5), ("a", 20, 6), ("a", 90, 7), ("a", -1, 1), ("b", 3, 9)]
    arrivals = spark.createDataFrame(events, "session_id string, event_id long, item_id string, arrived_at timestamp")
    versions = spark.createDataFrame(marks, "session_id string, last_event long, version long")
    got = replay.epochs(arrivals, versions, hot_rows=10 if ranges else 10**6, ranges=ranges).collect()
    want, seen = {}, {}
    for s, i, item, _ in events:
        epoch = max((v for t, last, v in marks if t == s and last < i), default=0)
        seen[s, epoch] = seen.get((s, epoch), 0) + 1
        want[item] = (epoch, seen[s, epoch])
    assert {r.item_id: (r.epoch, r.place) for r in got} == want
