"""Applying a plan: the working set, stored artifacts, and the active view afterwards. History stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import reducers, scoring
from ..functions.text import Counter, artifact_uri, content_hash, token_count
from .items import active, slug


def materialize(items: DataFrame, actions: DataFrame, registry: tuple[reducers.Reducer, ...] = reducers.REDUCERS, counter: Counter = token_count) -> tuple[DataFrame, DataFrame]:
    """(working set, artifacts) of a plan for these items; an action without its item fails the job.

    Keep and Pin leave an item as it is; Reduce and Extract rewrite it; Externalize stores it and leaves its URI;
    Summarize is a stub; what goes to L5 is dropped.
    """
    acts = actions.where("to_level <> 'L5'").select("session_id", "item_id", "idx", "action", "to_level")
    rows = acts.join(items, ["session_id", "item_id"], "left")
    found = F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("missing item: "), F.col("item_id")))).otherwise(F.col("kind"))
    rows = rows.withColumn("kind", found)
    content, command, code = F.col("content"), scoring.meta("command"), scoring.meta("exit_code")
    name = reducers.reducer_name(F.col("kind"), content, registry)
    uri = artifact_uri(slug(F.col("kind")), F.col("item_id"))
    text = F.when(F.col("action") == "Reduce", reducers.apply("reduce", name, content, command, code, registry))
    text = text.when(F.col("action") == "Extract", reducers.apply("extract", name, content, command, code, registry))
    text = text.when(F.col("action") == "Summarize", F.concat(F.lit("[semantic summary disabled: "), F.col("item_id"), F.lit("]"))).when(F.col("action") == "Externalize", uri)
    kept = F.col("action").isin("Keep", "Pin")
    ref = F.when(kept, scoring.meta("artifact_ref")).when(F.col("action") == "Externalize", uri)
    rows = rows.withColumn("_text", text.otherwise(content)).withColumn("_ref", ref)
    whole = F.col("to_level") == "L0"
    rows = rows.withColumn("_counted", F.when(~whole, F.col("_text")))
    tokens = F.greatest(F.when(whole, F.col("token_count")).otherwise(counter(F.col("_counted"))), F.lit(1).cast("long"))
    pos = F.row_number().over(W.partitionBy("session_id").orderBy("idx"))
    working = rows.select(
        "session_id", pos.alias("pos"), "item_id", "parent_id", "kind", F.col("_text").alias("content"), tokens.alias("token_count"), F.col("to_level").alias("compression_level"), F.col("_ref").alias("artifact_ref")
    )
    artifacts = rows.where("action = 'Externalize'").select("session_id", uri.alias("artifact_id"), "item_id", "content")
    return working, artifacts


def working_totals(working: DataFrame) -> DataFrame:
    return working.groupBy("session_id").agg(F.sum("token_count").alias("total_tokens"), F.count(F.lit(1)).alias("item_count"))


def appended(working: DataFrame, items: DataFrame, meta: DataFrame, order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Rows that add later items to the working sets of sessions that have one: at L0, behind the last, in the order they arrived."""
    last = working.groupBy("session_id").agg(F.max("pos").alias("_last"))
    new = items.join(meta.select("session_id"), "session_id", "left_semi").join(last, "session_id", "left")
    pos = F.coalesce("_last", F.lit(0)) + F.row_number().over(W.partitionBy("session_id").orderBy(*order))
    return new.select("session_id", pos.cast("int").alias("pos"), "item_id", "parent_id", "kind", "content", "token_count", F.lit("L0").alias("compression_level"), scoring.meta("artifact_ref").alias("artifact_ref"))


def active_view(items: DataFrame, working: DataFrame, meta: DataFrame) -> DataFrame:
    """What a plan sees: sessions without a working set by state; others as their working set has them.

    A session in ``meta`` with no rows was compacted to nothing. Items that left the active states stay in a working set.
    """
    fresh = active(items).join(meta.select("session_id"), "session_id", "left_anti")
    proj = working.select("session_id", "item_id", F.col("content").alias("_content"), F.col("token_count").alias("_tokens"), F.col("compression_level").alias("_level"), F.col("artifact_ref").alias("_ref"))
    rows = proj.join(items, ["session_id", "item_id"], "left")
    rows = rows.withColumn("kind", F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("missing item: "), F.col("item_id")))).otherwise(F.col("kind")))
    metadata = F.col("metadata").withField("artifact_ref", F.col("_ref")).withField("recoverable", scoring.flag("recoverable") | F.col("_ref").isNotNull())
    rows = rows.withColumn("metadata", metadata).withColumn("content", F.col("_content")).withColumn("content_hash", content_hash(F.col("_content")))
    rows = rows.withColumn("token_count", F.col("_tokens")).withColumn("compression_level", F.col("_level"))
    return fresh.select(*items.columns).unionByName(rows.select(*items.columns))
