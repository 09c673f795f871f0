"""The set-based plan against a plain greedy loop, and the expected behaviour of single cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import materialize as apply_ops
from sessionloom.operators import planner
from sessionloom.operators.items import duplicates, indexed, metadata, new_items
from sessionloom.schema import Config, Context, Model, Reserve, Tools

f = np.float32


def greedy(rows, current, configured, target):
    """Takes the best next step until the budget is met; rows are (costs by level, start level, importance)."""
    level = [r[1] for r in rows]
    after = [r[2] for r in rows]
    order = {"L0": 0, "L1": 1, "L2": 2, "L3": 3, "L4": 4, "L5": 5}

    def following(i):
        for name in ("L1", "L2", "L4", "L5"):
            if order[name] > order[level[i]] and (name == "L5" or after[i] > rows[i][0][name]):
                return name, 0 if name == "L5" else rows[i][0][name]
        return None

    while current > target:
        best, who = f(0), None
        for i in range(len(rows)):
            if level[i] == "L5":
                continue
            name, cost = following(i)
            saved = after[i] - cost
            if (name == "L5" and current <= configured) or saved <= 0:
                continue
            u = f(saved) / (max(f(1) - f(rows[i][3]), f(0.01)) * (f(1) + f(order[name]) * f(0.15)))
            if u > best:
                best, who = u, i
        if who is None:
            break
        name, cost = following(who)
        current -= after[who] - cost
        level[who], after[who] = name, cost
    return level, after


def test_plan_equals_greedy_loop(spark):
    r = random.Random(5)
    steps, goals, want = [], [], {}
    for s in range(150):
        rows = []
        for i in range(r.randint(1, 7)):
            n = r.randint(0, 60)
            costs = {"L1": r.choice([n, r.randint(0, 60)]), "L2": r.choice([n, r.randint(0, 60)]), "L4": r.choice([n, 9, r.randint(0, 60)])}
            imp = float(f(r.choice([0.1, 0.25, 0.5, 1.0])))
            rows.append((costs, r.choice(["L0", "L0", "L1", "L2", "L4"]), n, imp))
            steps.append((str(s), f"i{i}", i, costs["L1"], costs["L2"], costs["L4"], rows[-1][1], n, imp))
        current = sum(x[2] for x in rows)
        configured = r.randint(0, current + 5)
        target = r.choice([configured, r.randint(0, configured)])
        goals.append((str(s), current, configured, target))
        want[str(s)] = greedy(rows, current, configured, target)
    columns = "session_id string, item_id string, idx int, reduced_tokens long, extracted_tokens long, external_tokens long, compression_level string, token_count long, importance float"
    df = spark.createDataFrame(steps, columns).withColumn("is_pinned", F.lit(False)).withColumn("deduplicated", F.lit(False))
    g = spark.createDataFrame(goals, "session_id string, current_tokens long, configured_target long, target_tokens long")
    taken = {}
    rows = planner.steps(df.join(g, "session_id"), Config(), keep=("current_tokens", "configured_target", "target_tokens"))
    for x in planner.taken(rows).where("is_taken").orderBy("session_id", "idx", "k").collect():
        taken[x.session_id, x.idx] = (x.level, x.after)
    for s, (level, after) in want.items():
        for i, (lv, a) in enumerate(zip(level, after, strict=True)):
            start = next(x for x in steps if x[0] == s and x[2] == i)
            assert taken.get((s, i), (start[6], start[7])) == (lv, a), (s, i)


def make(spark, rows):
    """Items from (id, kind, content, tokens, recoverable)."""
    df = spark.createDataFrame(rows, "id string, kind string, content string, n long, rec boolean").withColumn("at", F.monotonically_increasing_id())
    out = new_items(df.coalesce(1).orderBy("id"), F.lit("s"), F.col("id"), F.col("kind"), F.col("content"), F.timestamp_seconds(F.regexp_extract("id", r"(\d+)$", 1).cast("int")), meta=metadata(recoverable=F.col("rec")))
    return out.join(df.select(F.col("id").alias("item_id"), "n"), "item_id").withColumn("token_count", F.coalesce("n", "token_count")).drop("n").select(*out.columns)


def test_duplicates_newest_is_canonical(spark):
    items = make(spark, [("i0", "FileContent", "same", 5, True), ("i1", "FileContent", "same", 5, True), ("i2", "FileContent", "different", 5, True)])
    rows = {x.item_id: x for x in duplicates(indexed(items)).collect()}
    assert [(rows[i].dup_count, rows[i].is_canonical) for i in ("i0", "i1", "i2")] == [(2, False), (2, True), (1, True)]
    actions, headers = planner.plan(items)
    got = {x.item_id: x for x in actions.collect()}
    assert [got[i].action for i in ("i0", "i1", "i2")] == ["Deduplicate", "Keep", "Keep"]
    head = headers.first()
    assert (head.before_tokens, head.expected_after_tokens, head.pressure_state) == (15, 10, "Green")


def test_large_recoverable_file_is_externalized(spark):
    items = make(spark, [("i0", "FileContent", "x", 50_000, True)])
    config = Config(reserve=Reserve(10_000, 10_000), context=Context(max_context_window=120_000))
    actions, _ = planner.plan(items, config, Model("m", 120_000, 10_000), extra=30_000)
    assert actions.first().action == "Externalize"
    working, stored = apply_ops.materialize(items, actions)
    row = working.first()
    assert row.content == row.artifact_ref == "artifact://file/i0" and row.compression_level == "L4" and stored.count() == 1


def test_pins_survive_and_errors_stay(spark):
    log = "\n".join(f"\x1b[32mCompiling {i}\x1b[0m" for i in range(300))
    rows = [("i0", "SystemPrompt", "be good", 400, False), ("i1", "UserMessage", "you must not stop", 10, False), ("i2", "Error", "boom", 10, False)]
    rows += [(f"i{i}", "CommandOutput", log + str(i), None, False) for i in range(3, 9)]
    config = Config(context=Context(max_context_window=3_000), reserve=Reserve(100, 100), tools=Tools())
    items = make(spark, rows)
    actions, headers = planner.plan(items, config, Model("m", 3_000, 100))
    got = {x.item_id: x for x in actions.collect()}
    assert [got[i].action for i in ("i0", "i1", "i2")] == ["Pin"] * 3
    head = headers.first()
    assert head.expected_after_tokens <= head.before_tokens and head.expected_after_tokens <= head.target_tokens
    working, _ = apply_ops.materialize(items, actions)
    assert {"i0", "i1", "i2"} <= {x.item_id for x in working.collect()}
    view = apply_ops.active_view(items, working, headers.select("session_id"))
    again, _ = planner.plan(view, config, Model("m", 3_000, 100))
    assert again.count() == working.count()


def test_missing_item_fails(spark):
    items = make(spark, [("i0", "FileContent", "x", 5, True)])
    actions, _ = planner.plan(items)
    with pytest.raises(Exception, match="missing item"):
        apply_ops.materialize(items.where("false"), actions)[0].collect()
