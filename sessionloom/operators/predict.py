"""Running averages of tokens by event type, and the prediction from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scoring import meta
from ..functions.text import f32
from ..schema import Config
from .prefix import ranged, same


def event_type() -> Column:
    out = F.when(F.col("kind").isin("ToolCall", "ToolResult"), F.coalesce(meta("tool_name"), F.lit("tool")))
    out = out.when(F.col("kind") == "CommandOutput", "command").when(F.col("kind") == "FileContent", "file-read")
    return out.when(F.col("kind") == "AssistantMessage", "assistant").otherwise("other")


#: Binary digits by which an average's start must shrink before it is left out; single precision has 24.
DIGITS = 60
#: Rows that Spark ranks within a task, before the shuffle, at most.
RANKED = 1000


def memory(alpha: float) -> int | None:
    """How many of the last values decide an average in single precision; None if all do, as nothing is forgotten."""
    a = max(0.0, min(1.0, alpha))
    return 1 if a == 1 else math.ceil(DIGITS * math.log(2) / -math.log1p(-a)) + 1 if a > 1e-9 else None


def ema(values: DataFrame, alpha: float, *, keys: tuple[str, ...] = ("session_id", "event_type"), value: str = "token_count", order: tuple[str, ...] = ("created_at", "item_id")) -> DataFrame:
    """Keys with ema and count: alpha * value + (1 - alpha) * before, from the first value on, in order and single precision; a null starts it anew.

    What lies more than ``memory`` values back has no weight left, so only the last ones of a key are folded. Each task keeps as many of its own
    before the shuffle: no task meets all rows of a hot key. Where alpha is so small that there would be more than RANKED, ranges of rows in order become one
    affine map each, in double precision, and a key's maps are composed.
    """
    a, last = max(0.0, min(1.0, alpha)), memory(alpha)
    rows = values.select(*keys, *order, F.col(value).cast("float").alias("_value"))
    if last is None or last > RANKED:
        return _mapped_ranges(rows, a, keys, order)
    back = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in (*order, "_value")]))
    ranked = rows.select(*keys, "_value", back.alias("_back")).where(F.col("_back") <= last)
    told = F.transform(F.sort_array(F.collect_list(F.struct("_back", "_value")), asc=False), lambda x: x["_value"])
    step = lambda now, v: F.when(now.isNull() | v.isNull(), v).otherwise((f32(a) * v + (f32(1.0) - f32(a)) * now).cast("float"))
    folded = ranked.groupBy(*keys).agg(F.aggregate(told, F.lit(None).cast("float"), step).alias("ema"))
    counts = rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("count"))
    return folded.join(counts, same(folded, counts, {k: f"_of_{k}" for k in keys})).select(*keys, "ema", "count")


def _mapped_ranges(rows: DataFrame, a: float, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """A range of a key's n rows in order takes an average e to e * (1 - a) ** n + more; a null in it forgets e and what came before."""
    place = [*order, "_value"]
    parts = ranged(rows, list(keys), place)
    own = W.partitionBy(*keys, "_range").orderBy(*[F.desc(c) for c in place])
    parts = parts.withColumn("_back", F.row_number().over(own)).withColumn("_nulls", F.sum(F.col("_value").isNull().cast("int")).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    kept = F.when(F.col("_nulls") == 0, F.col("_value").cast("double"))
    weight = F.lit(a) * F.pow(F.lit(1.0 - a), F.col("_back") - 1)
    maps = parts.groupBy(*keys, "_range").agg(
        F.sum(weight * kept).alias("more"), F.count(kept).alias("n"), F.max_by(kept, F.when(kept.isNotNull(), F.col("_back"))).alias("first"), F.max(F.col("_value").isNull()).alias("anew"), F.count(F.lit(1)).alias("rows")
    )
    told = F.sort_array(F.collect_list(F.struct("_range", "more", "n", "first", "anew")))

    def step(now: Column, m: Column) -> Column:
        now = F.when(~m["anew"], now)
        return F.when(m["n"] == 0, now).otherwise(F.coalesce(now, m["first"]) * F.pow(F.lit(1.0 - a), m["n"]) + m["more"])

    return maps.groupBy(*keys).agg(F.aggregate(told, F.lit(None).cast("double"), step).cast("float").alias("ema"), F.sum("rows").alias("count"))


def token_stats(items: DataFrame, config: Config, *, before: DataFrame | None = None, order: tuple[str, ...] = ("created_at", "item_id")) -> DataFrame:
    """Averages and counts of the items' tokens by session and event type; ``before`` are those to go on from."""
    rows = items.withColumn("event_type", event_type())
    if before is None:
        return ema(rows, config.prediction.ema_alpha, order=order)
    # An average so far is the first value of its key: it stays as it is, and the others are folded into it.
    keys = ["session_id", "event_type"]
    rows = rows.select(*keys, *order, F.col("token_count").cast("float").alias("token_count"), F.lit(True).alias("_new"))
    held = before.join(rows.select(*keys).distinct(), keys, "left_semi")
    first = held.select(*keys, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order], F.col("ema").cast("float").alias("token_count"), F.lit(False).alias("_new"))
    out = ema(rows.unionByName(first), config.prediction.ema_alpha, order=("_new", *order))
    counts = held.select(*keys, (F.col("count") - 1).alias("_more"))
    return out.join(counts, keys, "left").select(*keys, "ema", (F.col("count") + F.coalesce("_more", F.lit(0))).alias("count"))


def prediction(stats: DataFrame, config: Config) -> DataFrame:
    """session_id with expected input, tool and assistant tokens and confidence, of sessions that have statistics."""
    tool = F.lit(False)
    for word in ("tool", "command", "file-read", "test"):
        tool |= F.col("event_type").contains(word)
    found = stats.groupBy("session_id").agg(
        F.avg("ema").cast("float").alias("_input"), F.max(F.when(tool, F.col("ema"))).alias("_tool"), F.max(F.when(F.col("event_type") == "assistant", F.col("ema"))).alias("_assistant")
    )
    if not config.prediction.enabled:
        zero = F.lit(0).cast("long")
        return found.select("session_id", zero.alias("expected_input"), zero.alias("expected_tool_output"), zero.alias("expected_assistant_output"), f32(0.5).alias("confidence"))
    assistant = F.coalesce("_assistant", (F.col("_input") * f32(0.5)).cast("float"))
    return found.select(
        "session_id", F.col("_input").cast("long").alias("expected_input"), F.greatest(F.coalesce("_tool", f32(0.0)), f32(0.0)).cast("long").alias("expected_tool_output"),
        assistant.cast("long").alias("expected_assistant_output"), f32(0.5).alias("confidence"),
    )
