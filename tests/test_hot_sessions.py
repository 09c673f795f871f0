"""Sessions that are planned in ranges: the same plans, and no task with a large share of the rows."""

import json
import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from sessionloom.operators import planner, prefix
from sessionloom.operators.items import metadata, new_items
from sessionloom.schema import Config, Context, Model, Reserve, Tools

CONFIG = Config(context=Context(max_context_window=9_000), reserve=Reserve(500, 100), tools=Tools(large_result_tokens=40))
MODEL = Model("m", 9_000, 500)


def some_items(spark, n, hot=0.6):
    """Items of a hot session and others, many alike, some pinned, externalizable or in order of equal times."""
    i = F.col("id")
    df = spark.range(n).withColumn("h", F.pmod(F.xxhash64(i), F.lit(1000)))
    session = F.when(F.col("h") < int(hot * 1000), "hot").when(F.col("h") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("h") % 5))
    kind = F.element_at(F.array(*map(F.lit, ("FileContent", "AssistantMessage", "UserMessage", "CommandOutput", "SystemPrompt"))), (F.col("h") % 5 + 1).cast("int"))
    content = F.when(F.col("h") % 3 == 0, "the very same text").otherwise(F.concat_ws(" ", F.lit("number"), i, F.repeat(F.lit("word "), (F.col("h") % 50).cast("int"))))
    meta = metadata(recoverable=F.col("h") % 2 == 0)
    return new_items(df, session, F.concat(F.lit("i"), i), kind, content, F.timestamp_seconds((i / 3).cast("long")), meta=meta, counter=lambda c: F.size(F.split(c, " ")).cast("long"))


def words(c):
    return F.size(F.split(c, " ")).cast("long")


def test_plans_in_ranges_are_the_same(spark):
    items = some_items(spark, 900)
    for extra in (5_000, spark.createDataFrame([("hot", 4_000)], "session_id string, extra_tokens long")):
        want = planner.plan(items, CONFIG, MODEL, extra=extra, counter=words)
        got = planner.plan(items, CONFIG, MODEL, extra=extra, counter=words, hot_rows=100, ranges=5)
        for a, b in zip(want, got, strict=True):
            a, b = ([r.asDict(True) for r in sorted(x.collect(), key=lambda r: (r.session_id or "", str(r.asDict().get("idx"))))] for x in (a, b))
            assert a == b and len(a) > 2
    assert planner.hot_sessions(items, 400) == ["hot"] and None in planner.hot_sessions(items, 10)
    actions = {r.action for r in want[0].collect()}
    assert {"Deduplicate", "Pin", "Evict"} <= actions


def test_running_sums(spark):
    rows = spark.range(2_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("v"))
    out = prefix.running(prefix.ranged(rows, ["k"], ["at"], 9), ["k"], ["at"], {"before": F.col("v"), "n": F.lit(1)}).orderBy("at").collect()
    sums, seen = {}, {}
    for r in out:
        assert (r.before, r.n) == (sums.get(r.k, 0), seen.get(r.k, 0))
        sums[r.k], seen[r.k] = sums.get(r.k, 0) + (r.v or 0), seen.get(r.k, 0) + 1
    assert len(out) == 2_000


SHARE = """
import sys
sys.path[:0] = [{repo!r}, {tests!r}]
from pyspark.sql import SparkSession
import test_hot_sessions as t
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "64").config("spark.sql.adaptive.coalescePartitions.enabled", "false") \\
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", {log!r}).config("spark.checkpoint.dir", {shared!r}).config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
items = spark.read.schema(t.some_items(spark, 1).schema).parquet({items!r})
actions, headers = t.planner.plan(items, t.CONFIG, t.MODEL, counter=t.words, hot_rows={n} // 20)
actions.write.format("noop").mode("overwrite").save()
spark.stop()
"""


def largest_share(spark, folder, n):
    """Rows that the fullest task got by a shuffle, of the rows that all tasks of its stage got, over stages with many rows."""
    some_items(spark, n, hot=0.9).repartition(16).write.parquet(str(folder / "items"))
    (folder / "log").mkdir()
    here = Path(__file__).resolve()
    code = SHARE.format(repo=str(here.parent.parent), tests=str(here.parent), log=f"file://{folder}/log", shared=str(folder / "shared"), items=str(folder / "items"), n=n)
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": str(here.parent.parent)}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, timeout=1500)
    stages = {}
    for line in next((folder / "log").iterdir()).open():
        event = json.loads(line)
        if event["Event"] == "SparkListenerTaskEnd":
            read = event["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
            stages.setdefault(event["Stage ID"], []).append(read)
    return max(max(s) / sum(s) for s in stages.values() if sum(s) >= n // 2)


def test_no_task_has_a_large_share_of_a_hot_session(spark, tmp_path):
    assert largest_share(spark, tmp_path, 40_000) <= 0.08
