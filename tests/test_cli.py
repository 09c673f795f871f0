import json

from sessionloom import cli
from sessionloom.operators import report
from sessionloom.schema import CHECKPOINT, TABLES
from sessionloom.sources.store import Store


def test_commands(spark, tmp_path, capsys):
    path = tmp_path / "in.jsonl"
    path.write_text("".join(json.dumps({"id": f"i{i}", "kind": "CommandOutput", "content": f"step {i}\n\n50%\n" * 30, "created_at": f"2024-01-01T00:00:{i:02d}Z"}) + "\n" for i in range(6)))
    common = ["--db", str(tmp_path / "db"), "--session", "s"]
    small = [*common, "--context-window", "13000", "--reserved-output", "500"]
    assert cli.main(["ingest", "--file", str(path), *small]) == 0
    assert "ingested 6 items" in capsys.readouterr().out
    assert cli.main(["status", "--json", *common]) == 0
    status = json.loads(capsys.readouterr().out)
    assert status["item_count"] == 6 and status["usable_tokens"] == 500
    assert cli.main(["plan", *common]) == 0
    plan = json.loads(capsys.readouterr().out)
    assert len(plan["actions"]) == 6 and {a["action"] for a in plan["actions"]} <= {"Keep", "Reduce", "Extract", "Evict"} and plan["expected_after_tokens"] <= plan["target_tokens"]
    assert cli.main(["compact", *common]) == 0
    assert "reclaimed" in capsys.readouterr().out
    assert cli.main(["stats", "--json", *common]) == 0
    stats = json.loads(capsys.readouterr().out)
    assert len(stats) == 8 and stats["compactions"] == 1 and stats["history_items"] == 6 and stats["working_tokens"] <= stats["history_tokens"]


def test_store_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    for name in TABLES:
        assert store.read(name).count() == 0
    rows, meta = store.working_set()
    assert rows.count() == 0 and meta.count() == 0
    only = spark.createDataFrame([("s",)], "session_id string")
    with store.commit("s") as change:
        change.replace_working_sets(spark.createDataFrame([], TABLES["working_set_items"]), only)
    assert [r.session_id for r in store.working_set()[1].collect()] == ["s"]
    stats = spark.createDataFrame([("s", "tool", 1.5, 2)], "session_id string, event_type string, ema double, count long")
    for more in (0, 1):
        with store.commit("s") as change:
            change.upsert_token_stats(stats.selectExpr("session_id", "event_type", f"ema + {more} AS ema", f"count + {more} AS count"))
    assert [(r.ema, r["count"]) for r in store.token_stats().collect()] == [(2.5, 3)]
    art = spark.createDataFrame([("s", "artifact://file/i", "i", "text")], "session_id string, artifact_id string, item_id string, content string")
    for _ in range(2):
        with store.commit("s") as change:
            change.insert_artifacts(art)
    assert store.artifact("artifact://file/i").count() == 1
    assert spark.createDataFrame([], CHECKPOINT).columns[0] == "goal"


def test_telemetry(spark):
    runs = spark.createDataFrame([("s", 10, 4, "Emergency"), ("s", 5, 7, "Green")], "session_id string, before_tokens long, after_tokens long, pressure_state string")
    assert report.telemetry(runs).first()[1:] == (2, 1, 6)
