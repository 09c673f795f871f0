"""Status, composition, candidates and telemetry of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import budget
from ..schema import Config, Model


def composition(items: DataFrame) -> DataFrame:
    """Tokens by kind."""
    return items.groupBy("session_id", "kind").agg(F.sum("token_count").alias("tokens"), F.count(F.lit(1)).alias("items"))


def history_totals(items: DataFrame) -> DataFrame:
    """Items and tokens of all states."""
    return items.groupBy("session_id").agg(F.count(F.lit(1)).alias("item_count"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))


def session_pressure(items: DataFrame, config: Config, model: Model) -> DataFrame:
    """Current tokens, usable ones, pressure and its state."""
    lit = lambda n: F.lit(n).cast("long")
    usable = budget.usable(lit(model.context_window), lit(model.reserved_output_tokens), lit(config.reserve.safety_tokens))
    rows = items.groupBy("session_id").agg(F.sum("token_count").alias("current_tokens"), F.count(F.lit(1)).alias("item_count")).withColumn("usable_tokens", usable)
    rows = rows.withColumn("pressure", budget.pressure(F.col("current_tokens"), F.col("usable_tokens")))
    return rows.withColumn("pressure_state", budget.pressure_state(F.col("pressure"), config.context))


def top_candidates(actions: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` items of each session that a plan saves most on; ``kind`` is the level they come from."""
    rows = actions.where(~F.col("action").isin("Keep", "Pin")).withColumn("savings", budget.minus(F.col("estimated_before"), F.col("estimated_after")))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("savings"), "idx"))).where(F.col("rank") <= n)
    return rows.select("session_id", "rank", "item_id", F.col("from_level").alias("kind"), "item_kind", "action", F.col("estimated_before").alias("before_tokens"), F.col("estimated_after").alias("after_tokens"), "reason")


def status(items: DataFrame, actions: DataFrame, headers: DataFrame, config: Config, model: Model) -> DataFrame:
    """One row a session: pressure now and predicted, composition by tokens and the top candidates."""
    now = session_pressure(items, config, model)
    parts = composition(items).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("tokens")).alias("o"), "kind", "tokens"))).alias("_c"))
    parts = parts.select("session_id", F.transform("_c", lambda c: F.struct(c["kind"].alias("kind"), c["tokens"].alias("tokens"))).alias("composition"))
    top = top_candidates(actions).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "kind", "action", "before_tokens", "after_tokens", "reason"))).alias("candidates"))
    head = headers.select("session_id", "predicted_pressure", F.col("pressure_state").alias("predicted_state"), "target_tokens", "expected_after_tokens")
    return now.join(head, "session_id").join(parts, "session_id").join(top, "session_id", "left").withColumn("model", F.lit(model.name))


def telemetry(runs: DataFrame) -> DataFrame:
    """Runs, emergency runs and reclaimed tokens."""
    saved = budget.minus(F.col("before_tokens"), F.col("after_tokens"))
    return runs.groupBy("session_id").agg(F.count(F.lit(1)).alias("compactions"), F.count_if(F.col("pressure_state") == "Emergency").alias("emergency_compactions"), F.sum(saved).alias("reclaimed_tokens"))


def latest_event(events: DataFrame) -> DataFrame:
    """The newest payload of each session and type."""
    return events.groupBy("session_id", "type").agg(F.max_by("payload_json", "event_id").alias("payload_json"), F.max("event_id").alias("event_id"))
