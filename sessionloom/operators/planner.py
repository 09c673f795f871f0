"""Compaction plans of all sessions in one query.

A greedy choice of the best next step, again and again, equals two running sums: steps of an item come in a fixed chain,
so the order of all steps is by the smallest utility so far in their chain, and those before the budget is met are taken.

Sessions go ``Together``, by windows over each session's slim rows after one shuffle, but for hot ones, which are ``Apart``: ordered by ranges, of
which a task holds one, with sums of whole ranges added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import budget, reducers, scoring
from ..functions.text import Counter, artifact_uri, f32, token_count
from ..schema import IMPORTANCE, Config, Model
from ..sources.shared import cut
from . import prefix
from .items import ORDER, duplicates, indexed, slug

# What a step to a level is called, and why it was taken.
STEP = {"L1": ("Reduce", "reduce: structural cleanup"), "L2": ("Extract", "extract: keep only key parts"), "L4": ("Externalize", "externalize: recoverable content"), "L5": ("Evict", "evict: low importance")}
_LAST = {"L0": -1, "L1": 1, "L2": 2, "L3": 3, "L4": 4, "L5": 5}


#: A session of more rows is hot.
HOT_ROWS = 2_000_000


class Together:
    """What a plan needs of whole sessions, by windows."""

    def numbered(self, rows: DataFrame) -> DataFrame:
        return duplicates(indexed(rows))

    def summed(self, rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """Adds sums over each session."""
        return rows.withColumns({name: F.sum(c).over(W.partitionBy("session_id")) for name, c in sums.items()})

    def with_extra(self, rows: DataFrame, extra: DataFrame) -> DataFrame:
        return rows.join(extra, "session_id", "left")

    def taken(self, rows: DataFrame) -> DataFrame:
        return taken(rows)

    def last(self, rows: DataFrame) -> DataFrame:
        """One row an item, with the last step that is taken, if any."""
        step = F.max(F.when(F.col("is_taken"), F.struct("k", "level", "after"))).over(W.partitionBy("session_id", "idx"))
        return rows.withColumn("_last", step).where("k = 0")


class Apart(Together):
    """The same for sessions of any size."""

    def __init__(self, hot: list[str | None], ranges: int | None = None):
        self.hot, self.ranges = hot, ranges

    def numbered(self, rows: DataFrame) -> DataFrame:
        rows = prefix.ranged(rows.drop("content"), ["session_id"], list(ORDER), self.ranges)
        rows = prefix.running(rows, ["session_id"], list(ORDER), {"idx": F.lit(1).cast("long")}).drop("_range")
        rows = self.summed(rows.withColumn("idx", F.col("idx").cast("int")), {"n_items": F.lit(1)})
        alike, can = ["session_id", "kind", "content_hash"], F.col("kind").isin(*scoring.DEDUPLICABLE)
        rows = prefix.totals(prefix.ranged(rows, alike, ["idx"], self.ranges), alike, {"_count": (F.sum, F.lit(1)), "_newest": (F.max, F.col("idx"))}).drop("_range")
        rows = rows.withColumn("dup_count", F.when(can, F.col("_count")).otherwise(F.lit(1).cast("long")))
        return rows.withColumn("is_canonical", ~can | (F.col("_newest") == F.col("idx"))).drop("_count", "_newest")

    def summed(self, rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
        total = rows.groupBy(F.col("session_id").alias("_of")).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
        return rows.join(F.broadcast(total), rows.session_id.eqNullSafe(total["_of"])).drop("_of")  # hot sessions are few, as the driver has counted

    def with_extra(self, rows: DataFrame, extra: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(extra.where(is_one_of(self.hot))), "session_id", "left")

    def taken(self, rows: DataFrame) -> DataFrame:
        order, own = [F.desc("low"), F.asc("idx"), F.asc("k")], ["session_id"]
        rows = prefix.ranged(rows, own, order, self.ranges)
        first, then, zero = met(F.col("_before")), F.col("_then"), F.lit(0).cast("long")
        rows = cut(prefix.running(rows, own, order, {"_before": F.col("savings")}).withColumn("_first", first).drop("_before"))
        rows = rows.withColumn("_then", after_first())
        rows = self.summed(rows, {"_spent": F.coalesce(F.when(F.col("_first"), F.col("savings")), zero)})
        rows = prefix.running(rows, own, order, {"_before": F.when(then, F.col("savings"))})
        second = then & (F.col("_before") < F.col("current_tokens") - F.col("_spent") - F.col("target_tokens"))
        return rows.withColumn("is_taken", F.col("_first") | second).drop("_first", "_then", "_spent", "_before", "_range")

    def last(self, rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        step = rows.where("is_taken").groupBy(F.col("session_id").alias("_session"), F.col("idx").alias("_idx")).agg(F.max(F.struct("k", "level", "after")).alias("_last"))
        items = rows.where("k = 0")
        return items.join(step, prefix.same(items, step, {"session_id": "_session", "idx": "_idx"}), "left").drop("_session", "_idx")


TOGETHER = Together()


def met(before: Column) -> Column:
    """Whether a step comes before the configured target is met, by the savings of those before it."""
    return (F.col("k") > 0) & (before < F.col("current_tokens") - F.col("configured_target"))


def after_first() -> Column:
    """Whether a step may be taken to a lower forecast target: not an eviction."""
    return (F.col("k") > 0) & ~F.col("_first") & (F.col("level") != "L5")


def hot_sessions(items: DataFrame, rows: int = HOT_ROWS) -> list[str | None]:
    """Sessions of more than so many rows; their number is bounded by that of all rows."""
    return [r[0] for r in items.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select("session_id").collect()]


def is_one_of(sessions: list[str | None]) -> Column:
    named = [s for s in sessions if s is not None]
    return F.coalesce(F.col("session_id").isin(named), F.lit(False)) | (F.col("session_id").isNull() & F.lit(None in sessions))


def scored(items: DataFrame, config: Config, way: Together = TOGETHER) -> DataFrame:
    """Items with idx, n_items, dup_count, is_canonical, is_pinned, the importance components and importance.

    What depends on texts comes before the windows, so that only slim rows are shuffled unless texts are asked for.
    """
    rows = items if "is_pinned" in items.columns else items.withColumn("is_pinned", scoring.pinned(config))
    out = way.numbered(rows).withColumns(scoring.components())
    return out.withColumn("importance", F.when(F.col("is_pinned"), f32(1.0)).otherwise(scoring.total()))


def candidates(items: DataFrame, config: Config, registry: tuple[reducers.Reducer, ...] = reducers.REDUCERS, counter: Counter = token_count, way: Together = TOGETHER) -> DataFrame:
    """Scored items with the tokens that each level would cost: reduced, extracted and external."""
    content, command, code = F.col("content"), scoring.meta("command"), scoring.meta("exit_code")
    rows = items.withColumn("is_pinned", scoring.pinned(config))
    name = reducers.reducer_name(F.col("kind"), content, registry) if config.tools.reduce_logs else F.lit(None).cast("string")
    rows = rows.withColumn("reducer", F.when(~F.col("is_pinned"), name))
    reduced = {which: F.when(F.col("reducer").isNotNull(), reducers.apply(which, F.col("reducer"), content, command, code, registry)) for which in ("reduce", "extract")}
    cost = lambda which: F.when(F.col("reducer").isNull(), F.col("token_count")).otherwise(counter(F.col(f"_{which}")))
    rows = rows.withColumns({f"_{which}": text for which, text in reduced.items()}).withColumns({"reduced_tokens": cost("reduce"), "extracted_tokens": cost("extract")}).drop("_reduce", "_extract")
    can = F.lit(config.tools.externalize_large_results) & scoring.flag("recoverable") & (F.col("token_count") >= config.tools.large_result_tokens)
    rows = rows.withColumn("external_tokens", F.when(can, counter(F.when(can, artifact_uri(slug(F.col("kind")), F.col("item_id"))))).otherwise(F.col("extracted_tokens")))
    dedup = F.lit(config.tools.deduplicate) & ~F.col("is_pinned") & (F.col("dup_count") > 1) & ~F.col("is_canonical")
    return scored(rows, config, way).withColumn("deduplicated", dedup)


def targets(rows: DataFrame, config: Config, model: Model, extra: Column) -> DataFrame:
    """Adds usable, pressures, states, configured_target and target to rows with session_id and before_tokens."""
    usable = budget.usable(F.lit(model.context_window).cast("long"), F.lit(model.reserved_output_tokens).cast("long"), F.lit(config.reserve.safety_tokens).cast("long"))
    rows = rows.withColumn("usable_tokens", F.when(usable == 0, F.raise_error(F.lit("the context window is empty")).cast("long")).otherwise(usable)).withColumn("extra_tokens", extra)
    u = F.col("usable_tokens")
    rows = rows.withColumn("pressure_before", budget.pressure(F.col("before_tokens"), u)).withColumn("predicted_pressure", budget.pressure(F.col("before_tokens") + F.col("extra_tokens"), u))
    rows = rows.withColumn("pressure_state", budget.pressure_state(F.col("predicted_pressure"), config.context)).withColumn("configured_target", budget.share(config.context.target_pressure, u))
    forecast = budget.minus(budget.share(config.context.compact, u), F.col("extra_tokens"))
    return rows.withColumn("target_tokens", F.when(budget.needs_compaction(F.col("pressure_state")), F.least("configured_target", forecast)).otherwise(F.col("configured_target")))


def steps(rows: DataFrame, config: Config, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a useful step of an item: its place k in the item's chain, level, after, savings, utility and low, the smallest so far.

    With ``keep``, these columns follow, and each item has a first row of k 0 without a step.
    """
    cost = {"L1": F.col("reduced_tokens"), "L2": F.col("extracted_tokens"), "L4": F.col("external_tokens"), "L5": F.lit(0).cast("long")}
    order = F.expr("CASE compression_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LAST.items()) + " ELSE -1 END")
    chain = F.array(F.struct(F.lit(-1).alias("n"), F.lit("").alias("level"), F.col("token_count").alias("after")), *[F.struct(F.lit(int(k[1])).alias("n"), F.lit(k).alias("level"), v.cast("long").alias("after")) for k, v in cost.items()])
    reachable = F.filter(chain, lambda s: (s["n"] == -1) | (s["n"] > order))
    loss = F.greatest((f32(1.0) - F.col("importance")).cast("float"), f32(0.01))
    if config.importance_protects:
        loss = F.greatest(F.col("importance"), f32(0.01))
    rows = rows.withColumn("_loss", loss).withColumn("_reachable", reachable)
    # A step is effective if it costs less than all before it.
    lower = F.filter("_reachable", lambda s, i: (i == 0) | (s["after"] < F.array_min(F.transform(F.slice("_reachable", F.lit(1), i), lambda x: x["after"]))))
    rows = rows.withColumn("_lower", lower)
    moves = F.transform("_lower", lambda s, i: F.struct(i.alias("k"), s["level"].alias("level"), s["after"].alias("after"), F.when(i > 0, F.get("_lower", i - 1)["after"] - s["after"]).alias("savings"), s["n"].alias("n")))
    still = F.col("is_pinned") | F.col("deduplicated") | (F.col("compression_level") == "L5")
    moves = F.when(still, F.slice(moves, 1, 1)).otherwise(moves)
    penalty = lambda n: (f32(1.0) + (f32(n) * f32(0.15)).cast("float")).cast("float")
    utility = lambda s: F.when(s["k"] > 0, (f32(s["savings"]) / (F.col("_loss") * penalty(s["n"])).cast("float")).cast("float"))
    rows = rows.withColumn("_moves", F.transform(moves, lambda s: s.withField("utility", utility(s))))
    low = F.transform("_moves", lambda s, i: s.withField("low", F.array_min(F.transform(F.slice("_moves", F.lit(2), i), lambda x: x["utility"]))))
    out = rows.select("session_id", "item_id", "idx", *keep, F.explode(low).alias("s"))
    out = out.select("session_id", "item_id", "idx", *[f"s.{c}" for c in ("k", "level", "after", "savings", "utility", "low")], *keep)
    return out if keep else out.where("k > 0")


def taken(rows: DataFrame) -> DataFrame:
    """Adds is_taken to steps that carry current_tokens, configured_target and target_tokens of their session.

    First until the configured target is met; then, to a lower forecast target, without evictions.
    """
    before = W.partitionBy("session_id").orderBy(F.desc("low"), "idx", "k").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("_first", met(F.coalesce(F.sum("savings").over(before), zero)))
    rows = rows.withColumn("_then", after_first())
    spent = F.coalesce(F.sum(F.when(F.col("_first"), F.col("savings"))).over(W.partitionBy("session_id")), zero)
    rows = rows.withColumn("_left", F.col("current_tokens") - spent - F.col("target_tokens"))
    second = F.col("_then") & (F.coalesce(F.sum(F.when(F.col("_then"), F.col("savings"))).over(before), zero) < F.col("_left"))
    return rows.withColumn("is_taken", F.col("_first") | second).drop("_first", "_then", "_left")


def plan(items: DataFrame, config: Config | None = None, model: Model | None = None, *, extra: int | DataFrame = 0, registry: tuple[reducers.Reducer, ...] = reducers.REDUCERS, counter: Counter = token_count, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(actions, headers): an action for each item in order, and a header for each session.

    ``extra`` are the predicted tokens, one number or (session_id, extra_tokens). Items are those of an active view. One shuffle
    by session, without texts, serves every window and sum. Sessions of more than ``hot_rows`` rows, which a job counts first, are planned in ``ranges``.
    """
    config = (config or Config()).validate()
    model = (model or Model.default(config)).check(config)
    hot = hot_sessions(items, hot_rows)
    make = lambda rows, way: _plan(rows, config, model, extra, registry, counter, way)
    if not hot:
        return make(items, TOGETHER)
    wide, narrow = make(items.where(is_one_of(hot)), Apart(hot, ranges)), make(items.where(~is_one_of(hot)), TOGETHER)
    return wide[0].unionByName(narrow[0]), wide[1].unionByName(narrow[1])


def _plan(items: DataFrame, config: Config, model: Model, extra: int | DataFrame, registry: tuple[reducers.Reducer, ...], counter: Counter, way: Together) -> tuple[DataFrame, DataFrame]:
    rows = candidates(items, config, registry, counter, way)
    rows = way.summed(rows, {"before_tokens": F.col("token_count"), "current_tokens": F.when(F.col("deduplicated"), 0).otherwise(F.col("token_count"))})
    more = F.lit(extra).cast("long") if isinstance(extra, int) else F.coalesce("_extra", F.lit(0)).cast("long")
    if not isinstance(extra, int):
        rows = way.with_extra(rows, extra.select("session_id", F.col("extra_tokens").alias("_extra")))
    rows = targets(rows, config, model, more).withColumn("importance_parts", F.struct(F.col("importance").alias("total"), *IMPORTANCE))
    header = ("before_tokens", "usable_tokens", "extra_tokens", "pressure_before", "predicted_pressure", "target_tokens", "pressure_state")
    keep = (*header, "current_tokens", "configured_target", "is_pinned", "deduplicated", "compression_level", "token_count", "kind", "importance_parts")
    rows = way.last(way.taken(steps(rows, config, keep=keep)))
    name = F.col("_last.level")
    step = lambda i: F.coalesce(*[F.when(name == level, F.lit(v[i])) for level, v in STEP.items()])

    def choose(pin: object, dup: object, done: Column, rest: object) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(F.col("is_pinned"), as_col(pin)).when(F.col("deduplicated"), as_col(dup)).when(name.isNotNull(), done).otherwise(as_col(rest))

    level, count = F.col("compression_level"), F.col("token_count")
    rows = rows.select(
        "session_id", "item_id", "idx", choose("Pin", "Deduplicate", step(0), "Keep").alias("action"), level.alias("from_level"), choose(level, "L5", name, level).alias("to_level"),
        count.alias("estimated_before"), choose(count, F.lit(0).cast("long"), F.col("_last.after"), count).alias("estimated_after"), F.col("importance_parts").alias("importance"),
        choose("pin: mandatory or user constraint", "deduplicate: repeated content", step(1), "keep: baseline").alias("reason"), F.col("kind").alias("item_kind"), *header,
    )
    headers = rows.groupBy("session_id", *header).agg(F.sum("estimated_after").alias("expected_after_tokens"))
    headers = headers.select("session_id", *header[:6], "expected_after_tokens", "pressure_state")
    return rows.drop(*header), headers
