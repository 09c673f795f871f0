"""Streams of item records, and running token averages kept as state by session and event type."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.items import enrich
from ..operators.predict import event_type, memory
from ..schema import Config
from ..session import add
from ..sources.jsonl import records
from ..sources.shared import Scratch
from ..sources.store import KEYS, Store

def item_stream(spark: SparkSession, path: str, session: str = "default", *, adapter: str = "stdio", per_trigger: int = 100) -> DataFrame:
    """Items of JSON-lines files as they appear in a folder. Records without an id get a random one."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", per_trigger).text(path)
    return enrich(records(lines, F.lit(session)), adapter=adapter)


#: Groups that keys are dealt to, each with one list as state: a call for each key, with its own frames and messages to the state store, costs milliseconds.
GROUPS = 1024
#: Rows of a group that come before those which weigh no more are left out.
ROWS_AT_ONCE = 1 << 16


class _Averages(StatefulProcessor):
    """Averages and counts of a group's keys, kept as state; see ``running_ema``."""

    def __init__(self, alpha: float, keys: int, order: int, idle_ms: int | None):
        self.alpha, self.idle_ms = np.float32(max(0.0, min(1.0, alpha))), idle_ms
        self.keys, self.order = key_names(keys), order_names(order)
        self.last = memory(alpha)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("averages", ", ".join(f"{k} string" for k in self.keys) + ", ema double, count long, seen long", self.idle_ms)

    def _now(self, timer_values: object) -> int:
        return 0 if self.idle_ms is None else timer_values.getCurrentProcessingTimeInMs()

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        ema = [None if np.isnan(x) else x for x in initialState["ema"].to_numpy(float, na_value=np.nan).tolist()]
        keys = [initialState[k].tolist() for k in self.keys]
        self.state.appendList([*zip(*keys, ema, initialState["count"].tolist(), [self._now(timerValues)] * len(ema), strict=True)])

    def _weighing(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The last values of each key, in order. Where nothing is forgotten, alpha is 0 and a first value stays what it is."""
        code = rows.groupby(self.keys, dropna=False, sort=False).ngroup()
        rows = rows.assign(_code=code).sort_values(["_code", *self.order], kind="stable", na_position="first")
        return rows[rows.groupby("_code").cumcount(ascending=self.last is None) < (self.last or 1)].drop(columns="_code")

    def _read(self, parts: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame | None, pd.DataFrame | None]:
        """Values that weigh, and how many there were, by key."""
        held, counts, waiting, n = None, [], [], 0

        def settle() -> None:
            nonlocal held, n
            new = pd.concat(waiting)
            counts.append(new.groupby(self.keys, dropna=False, sort=False).size().reset_index(name="n"))
            held = self._weighing(new if held is None else pd.concat([held, new], ignore_index=True))
            waiting.clear()
            n = 0

        for part in parts:
            if len(part):
                waiting.append(part[[*self.keys, *self.order, "value"]])
                n += len(part)
            if n >= max(ROWS_AT_ONCE, 0 if held is None else len(held)):
                settle()
        if waiting:
            settle()
        if held is None:
            return None, None
        found = pd.concat(counts).groupby(self.keys, dropna=False, sort=False)["n"].sum().reset_index().astype(object)
        return held, found.where(found.notna(), None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, found = self._read(rows)
        if held is None:
            return
        at = self._now(timerValues)
        old = pd.DataFrame([*map(tuple, self.state.get())], columns=[*self.keys, "ema", "count", "seen"])
        if self.idle_ms is not None:
            old = old[old["seen"] + self.idle_ms > at]
        # The found keys are numbered in order, then come those that were there only.
        code = pd.concat([x[self.keys].astype(object) for x in (found, old, held)]).groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
        n, code = len(found), code[len(found) :]
        of_old, of_held = code[: len(old)], code[len(old) :]
        again = of_old < n
        now, count, new = np.full(n, np.nan, np.float32), np.zeros(n, np.int64), found["n"].to_numpy(np.int64)
        now[of_old[again]], count[of_old[again]] = old["ema"].to_numpy(np.float32, na_value=np.nan)[again], old["count"].to_numpy(np.int64)[again]
        if self.last is not None:
            now[new > self.last] = np.nan
        value = held["value"].to_numpy(np.float32, na_value=np.nan)[np.argsort(of_held, kind="stable")]
        sizes = np.bincount(of_held, minlength=n)
        first = np.cumsum(sizes) - sizes
        rest = np.float32(1) - self.alpha
        for step in range(sizes.max()):  # a value of each key at a time
            mine = np.flatnonzero(sizes > step)
            v, before = value[first[mine] + step], now[mine]
            folded = before if self.last is None else self.alpha * v + rest * before
            now[mine] = np.where(np.isnan(before) | np.isnan(v), v, folded)
        keys, ema, count = [found[k].tolist() for k in self.keys], [None if np.isnan(x) else x for x in now.tolist()], (count + new).tolist()
        others = old[~again].astype(object).where(old[~again].notna(), None)
        self.state.put([*zip(*keys, ema, count, [at] * n, strict=True), *others.itertuples(index=False, name=None)])
        yield pd.DataFrame({**dict(zip(self.keys, keys, strict=True)), "ema": ema, "count": count})

    def close(self) -> None:
        pass


def key_names(n: int) -> list[str]:
    return [f"key{i}" for i in range(n)]


def order_names(n: int) -> list[str]:
    return [f"order{i}" for i in range(n)]


def running_ema(rows: DataFrame, alpha: float, keys: dict[str, str], value: str, order: list[str], *, before: DataFrame | None = None, idle: timedelta | None = None) -> DataFrame:
    """The keys (name to type) with ema and count after each micro-batch, of keys that it touched.

    Values of a key are folded in ``order``, nulls first, within a micro-batch, batches in order of arrival: equal to the batch operator if rows
    arrive in that order. Keys go as strings, by hash, to GROUPS groups, and a group's keys are folded at once. Only the last values that still weigh are held (see
    ``predict.memory``), so a key of any size takes bounded memory. State begins with ``before`` (keys, ema, count), survives restarts through the query's
    checkpoint, and goes when a key has been ``idle``. It needs the state store that ``start`` asks for.
    """
    names = key_names(len(keys))
    made = _Averages(alpha, len(keys), len(order), None if idle is None else int(idle.total_seconds() * 1000))
    told = [F.col(k).cast("string").alias(name) for k, name in zip(keys, names, strict=True)]

    def dealt(df: DataFrame, *others: Column) -> GroupedData:
        return df.select(*told, *others).withColumn("part", F.pmod(F.xxhash64(*names), F.lit(GROUPS)).cast("int")).groupBy("part")

    first = None if before is None else dealt(before, F.col("ema").cast("double").alias("ema"), F.col("count").cast("long").alias("count"))
    grouped = dealt(rows, *[F.col(c).alias(name) for c, name in zip(order, order_names(len(order)), strict=True)], F.col(value).cast("double").alias("value"))
    out = ", ".join(f"{name} string" for name in names) + ", ema float, count long"
    found = grouped.transformWithStateInPandas(made, out, "Update", "None" if idle is None else "ProcessingTime", first)
    return found.select(*[F.col(name).cast(kind).alias(k) for name, (k, kind) in zip(names, keys.items(), strict=True)], "ema", "count")


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query with the state store that custom state needs, and leaves the session's setting as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def ema_stream(items: DataFrame, config: Config, *, before: DataFrame | None = None, idle: timedelta | None = None) -> DataFrame:
    """Running averages of items' tokens by session and event type, in order of created_at and id; ``before`` are a store's statistics."""
    rows = items.withColumn("event_type", event_type())
    return running_ema(rows, config.prediction.ema_alpha, {"session_id": "string", "event_type": "string"}, "token_count", ["created_at", "item_id"], before=before, idle=idle)


def latest_state(updates: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a stream of updates over what is there and returns the last of each key; ``folder`` must be new and shared."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    start(updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True), updates.sparkSession).awaitTermination()
    rows = updates.sparkSession.read.parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by("ema", "count").alias("ema"), F.max("count").alias("count"))


def ingest_into(store: Store, items: DataFrame, config: Config, checkpoint: str, *, name: str = "stream", **trigger: object) -> StreamingQuery:
    """Adds each micro-batch's items to the store as any ingest does: items, events, statistics and working sets, all at once. Batches count in order of arrival,
    items within one by created_at and id.

    ``name`` tells a stream's commits from those of others: a batch that counts already is passed over when it is run again. So are items whose ids are
    stored already, or come again in a batch. A batch reads its sessions' part of the store only, and leaves no files but its commit's.
    """

    def write(batch: DataFrame, number: int) -> None:
        if store.has(f"{name}-{number}"):
            return
        with Scratch(store.spark) as scratch:
            keys = KEYS["context_items"]
            place = F.row_number().over(W.partitionBy("session_id").orderBy("created_at", "item_id")).cast("long")
            batch = scratch.keep(batch.withColumn("arrival", place))
            first = batch.groupBy(*keys).agg(F.min("arrival").alias("arrival"))
            there = store.read("context_items", buckets=store.buckets(batch)).select(*keys)
            new = scratch.keep(batch.join(first, [*keys, "arrival"], "left_semi").join(there, keys, "left_anti"))
            add(store, new, config, name=f"{name}-{number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
