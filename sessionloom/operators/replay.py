"""Views of the past: what sessions' plans saw at given times, or right after given runs, from history and slim rows of each compaction.

Levels only rise, so an item is reduced, extracted and externalized at most once each, in this order. Its text at any version follows from its
first text and from which of these had happened by then; no texts of old working sets are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import reducers, scoring
from ..functions.text import Counter, artifact_uri, token_count
from . import prefix
from .items import ORDER, active, slug
from .planner import HOT_ROWS, hot_sessions, is_one_of

#: What rewrites a text, in order of level, and the text that it leaves.
_REWRITES = {"Reduce": "reduced", "Extract": "extracted", "Summarize": "summarized", "Externalize": "externalized"}


def applied(actions: DataFrame) -> DataFrame:
    """What a working set's version has to remember of its plan: the items that stay, their places, actions and levels."""
    kept = actions.where("to_level <> 'L5'")
    pos = F.row_number().over(W.partitionBy("session_id").orderBy("idx"))
    return kept.select("session_id", pos.alias("pos"), "item_id", "action", "to_level")


def _latest(rows: DataFrame, order: list[str], hot_rows: int, ranges: int | None) -> DataFrame:
    """Adds ``_now``, the greatest version up to each row of its session, 0 before the first. Sessions of more than ``hot_rows`` rows go by ranges."""
    before = W.partitionBy("session_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    hot = hot_sessions(rows, hot_rows)
    now = rows.where(~is_one_of(hot)) if hot else rows
    now = now.withColumn("_now", F.coalesce(F.max("version").over(before), F.lit(0).cast("long")))
    if not hot:
        return now
    parts = prefix.ranged(rows.where(is_one_of(hot)), ["session_id"], order, ranges)
    return now.unionByName(prefix.latest(parts, ["session_id"], order, {"_now": F.col("version")}).drop("_range"))


def epochs(arrivals: DataFrame, versions: DataFrame, *, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """Arrivals with ``epoch``, the version of the working set that each joined (0: none was there), and ``place``, its number from 1 among those that joined it.

    A version takes over after the event ``last_event`` of its session.
    """
    none = lambda kind: F.lit(None).cast(kind)
    marks = versions.select("session_id", F.col("last_event").alias("event_id"), none("string").alias("item_id"), none("timestamp").alias("arrived_at"), "version")
    rows = arrivals.select("session_id", "event_id", "item_id", "arrived_at", none("long").alias("version")).unionByName(marks)
    # Of equal numbers the event comes first, as the version came after it.
    rows = rows.withColumn("_mark", F.col("version").isNotNull())
    found = _latest(rows, ["event_id", "_mark", "version", "item_id"], hot_rows, ranges).where("NOT _mark")
    place = F.row_number().over(W.partitionBy("session_id", "_now").orderBy("event_id", "item_id"))
    return found.select("session_id", "event_id", "item_id", "arrived_at", F.col("_now").alias("epoch"), place.alias("place"))


def at_times(asked: DataFrame, versions: DataFrame, *, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """(ask_id, session_id, at) with the version that held then, 0 if there was none."""
    asks = asked.where("at IS NOT NULL").select("session_id", "at", "ask_id", F.lit(None).cast("long").alias("version"))
    marks = versions.select("session_id", F.col("materialized_at").alias("at"), F.lit(None).cast(asks.schema["ask_id"].dataType).alias("ask_id"), "version")
    rows = asks.unionByName(marks).withColumn("_ask", F.col("version").isNull())
    return _latest(rows, ["at", "_ask", "version", "ask_id"], hot_rows, ranges).where("_ask").select("ask_id", "session_id", "at", F.col("_now").alias("version"))


def at_runs(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """(ask_id, session_id, run_id) as asks for the versions that the runs left; nothing arrived since. Runs that aren't there have no rows."""
    found = versions.where("run_id IS NOT NULL").select("session_id", "run_id", "version")
    return asked.join(found, ["session_id", "run_id"]).select("ask_id", "session_id", F.lit(None).cast("timestamp").alias("at"), "version")


def texts(items: DataFrame, applied: DataFrame, registry: tuple[reducers.Reducer, ...] = reducers.REDUCERS, counter: Counter = token_count) -> DataFrame:
    """Items with the version from which each rewriting holds (null: never), its text and its tokens, made once an item however often it is asked for."""
    when = [F.min(F.when(F.col("action") == a, F.col("version"))).alias(f"{name}_at") for a, name in _REWRITES.items()]
    changes = applied.where(F.col("action").isin(*_REWRITES)).groupBy("session_id", "item_id").agg(*when)
    rows = items.join(changes, ["session_id", "item_id"], "left")
    command, code = scoring.meta("command"), scoring.meta("exit_code")

    def rewritten(which: str, at: str, text: Column) -> Column:
        name = reducers.reducer_name(F.col("kind"), text, registry)
        return F.when(F.col(at).isNotNull(), reducers.apply(which, name, text, command, code, registry))

    rows = rows.withColumn("reduced", rewritten("reduce", "reduced_at", F.col("content")))
    rows = rows.withColumn("extracted", rewritten("extract", "extracted_at", F.coalesce("reduced", "content")))
    rows = rows.withColumn("summarized", F.when(F.col("summarized_at").isNotNull(), F.concat(F.lit("[semantic summary disabled: "), F.col("item_id"), F.lit("]"))))
    rows = rows.withColumn("externalized", F.when(F.col("externalized_at").isNotNull(), artifact_uri(slug(F.col("kind")), F.col("item_id"))))
    return rows.withColumns({f"{name}_tokens": F.greatest(counter(F.col(name)), F.lit(1).cast("long")) for name in _REWRITES.values()})


def as_of(items: DataFrame, arrivals: DataFrame, versions: DataFrame, applied: DataFrame, asked: DataFrame, *, registry: tuple[reducers.Reducer, ...] = reducers.REDUCERS,
          counter: Counter = token_count, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """The working set, or before a first compaction the active items, of each ask: its ask_id, and the columns of a working set.

    ``items`` are the history, ``arrivals`` (session_id, item_id, event_id, arrived_at) the events that added them, ``versions`` (session_id, version,
    materialized_at, last_event) and ``applied`` what each compaction left. ``asked`` comes from ``at_times`` or ``at_runs``. An ask of a time has what
    arrived until then. An ask with a null time, a null session, or a session that isn't there, has no rows. ask_ids tell asks apart; equal ones
    get the rows of all of them. Asks meet only the arrivals of the version that they are for.
    """
    sessions = asked.select("session_id").distinct()
    mine = lambda rows: rows.join(sessions, "session_id", "left_semi")
    versions, applied = mine(versions), mine(applied)
    joined = epochs(mine(arrivals), versions, hot_rows=hot_rows, ranges=ranges)
    held = asked.select("ask_id", "session_id", "version").join(applied.drop("action"), ["session_id", "version"]).withColumn("_planned", F.lit(True))
    ends = applied.groupBy("session_id", "version").agg(F.max("pos").alias("_end"))
    later = asked.join(joined.withColumnRenamed("epoch", "version"), ["session_id", "version"]).where(F.col("arrived_at") <= F.col("at")).join(ends, ["session_id", "version"], "left")
    pos = F.when(F.col("version") > 0, F.coalesce("_end", F.lit(0)) + F.col("place"))
    later = later.select("session_id", "version", "ask_id", pos.cast("int").alias("pos"), "item_id", F.lit("L0").alias("to_level"), F.lit(False).alias("_planned"))
    rows = held.unionByName(later).join(texts(mine(items), applied, registry, counter).withColumnRenamed("token_count", "_whole"), ["session_id", "item_id"])
    # Before a first version the states decide, and time; afterwards what the working set has.
    rows = active(rows.where("version = 0")).unionByName(rows.where("version > 0"))
    done = lambda name: F.coalesce(F.col(f"{name}_at") <= F.col("version"), F.lit(False))
    # A plan's items count one token at least.
    text, tokens, rewritten = F.col("content"), F.when(F.col("_planned"), F.greatest("_whole", F.lit(1).cast("long"))).otherwise(F.col("_whole")), F.lit(False)
    for name in _REWRITES.values():
        text, tokens = F.when(done(name), F.col(name)).otherwise(text), F.when(done(name), F.col(f"{name}_tokens")).otherwise(tokens)
        rewritten = rewritten | done(name)
    first = F.row_number().over(W.partitionBy("ask_id", "session_id", "version").orderBy(*ORDER))
    fresh = rows.where("version = 0").withColumn("pos", first)
    rows = fresh.unionByName(rows.where("version > 0"))
    ref = F.when(done("externalized"), F.col("externalized")).when(~rewritten, scoring.meta("artifact_ref"))
    return rows.select(
        "ask_id", "session_id", "pos", "item_id", "parent_id", "kind", text.alias("content"), tokens.alias("token_count"),
        F.col("to_level").alias("compression_level"), ref.alias("artifact_ref"),
    )
