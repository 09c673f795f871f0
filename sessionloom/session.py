"""One session over a store: ingest, plan, materialize, compact and status. All sessions at once: the operators."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from dataclasses import asdict
from datetime import datetime
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import Counter, token_count
from .operators import items as item_ops
from .operators import materialize as apply_ops
from .operators import planner, predict, replay, report
from .schema import Config, Model
from .sources import jsonl
from .sources.shared import Scratch
from .sources.store import Store

#: Lines of a text stream that are stored at once.
AT_ONCE = 50_000
#: Plans of a session whose files are kept.
PLANS = 8


def add(store: Store, items: DataFrame, config: Config, *, session_id: str | None = None, name: str = "add") -> None:
    """Stores items of any sessions, in order of ``arrival``: items, ``context.add`` events, statistics that go on from those stored, and working sets
    where there are any. All of it counts at once, or nothing; so an id that is there already, or comes twice, changes nothing. ``items`` must
    not change when they are read again.

    Only the sessions' parts of the store are read. ``session_id`` is that of all items, if they have one.
    """
    with store.commit(session_id, rows=items, name=name) as change:
        change.insert_items(items)
        payload = F.to_json(F.struct(*[c for c in items.columns if c != "arrival"]))
        change.append_events(items.select("session_id", F.lit("context.add").alias("type"), payload.alias("payload_json"), F.current_timestamp().alias("created_at"), "arrival"))
        if config.prediction.enabled:
            before = store.token_stats(session_id, buckets=change.buckets)
            change.upsert_token_stats(predict.token_stats(items, config, before=before, order=("arrival",)))
        working, meta = store.working_set(session_id, buckets=change.buckets)
        change.append_working_sets(apply_ops.appended(working, items, meta))


class Session:
    """``model`` overrides and is stored as an event; without one the last stored or the configured applies."""

    def __init__(self, store: Store, session_id: str = "default", config: Config | None = None, model: Model | None = None, counter: Counter = token_count):
        self.store, self.id, self.config, self.counter = store, session_id, (config or Config()).validate(), counter
        self.model = (model or store.load_model(session_id, self.config)).check(self.config)
        self.last_plan: tuple[DataFrame, DataFrame] | None = None
        self._plans: deque[Scratch] = deque()
        spark: SparkSession = store.spark
        row = spark.createDataFrame([(session_id, json.dumps(asdict(self.config)))], "session_id string, config_json string")
        with store.commit(session_id, name="open") as change:
            change.ensure_sessions(row.withColumn("created_at", F.current_timestamp()))
            change.save_model(session_id, self.model)

    def ingest(self, records: DataFrame, *, adapter: str | None = None) -> int:
        """Adds wire records (see ``add``). How many."""
        if "arrival" not in records.columns:
            records = records.withColumn("arrival", F.monotonically_increasing_id())
        return self._add(item_ops.enrich(records, adapter=adapter, counter=self.counter))

    def _add(self, items: DataFrame) -> int:
        with Scratch(self.store.spark) as scratch:
            items = scratch.keep(items)
            add(self.store, items, self.config, session_id=self.id)
            self.last_plan = None
            return items.count()

    def ingest_file(self, path: str) -> int:
        """A JSON-lines file; a bad line fails, by its number, before anything is written."""
        lines = jsonl.read_lines(self.store.spark, path)
        jsonl.check(lines)
        return self.ingest(jsonl.records(lines, F.lit(self.id)))

    def ingest_lines(self, lines: Iterable[str]) -> int:
        """JSON lines as they come, AT_ONCE at a time; those before the part with a bad line stay."""
        lines, total, seen = iter(lines), 0, 0
        while part := list(islice(lines, AT_ONCE)):
            rows = self.store.spark.createDataFrame([("", line.rstrip("\n"), i) for i, line in enumerate(part)], "path string, value string, arrival long")
            jsonl.check(rows, seen)
            total += self.ingest(jsonl.records(rows, F.lit(self.id)))
            seen += len(part)
        return total

    def ingest_checkpoint(self, checkpoint: DataFrame) -> int:
        """Rows with item_id, created_at and a struct ``checkpoint``, added as any other items."""
        made = item_ops.checkpoint_items(checkpoint.withColumn("session_id", F.lit(self.id)), counter=self.counter)
        return self._add(made.withColumn("arrival", F.monotonically_increasing_id()))

    def view(self) -> DataFrame:
        return apply_ops.active_view(self.store.items(self.id), *self.store.working_set(self.id))

    def view_at(self, when: datetime) -> DataFrame:
        """The working set, or before a first one the active items, as it was at a time, by the store's clock."""
        return self._past(self.store.spark.createDataFrame([(0, self.id, when)], "ask_id int, session_id string, at timestamp"))

    def view_after(self, run_id: str) -> DataFrame:
        """The working set that a run left."""
        return self._past(self.store.spark.createDataFrame([(0, self.id, run_id)], "ask_id int, session_id string, run_id string"))

    def _past(self, asked: DataFrame) -> DataFrame:
        return self.store.past(asked, session_id=self.id).drop("ask_id").orderBy("pos")

    def predicted(self) -> int:
        row = predict.prediction(self.store.token_stats(self.id), self.config).first()
        return row.expected_input + row.expected_tool_output + row.expected_assistant_output if row and self.config.prediction.enabled else 0

    def plan(self, predicted_extra: int = 0) -> tuple[DataFrame, DataFrame]:
        """Actions and header; a positive ``predicted_extra`` replaces the prediction from statistics. Kept for ``status`` until items or working set change.

        A plan is written once; the files of the last PLANS of a session stay.
        """
        actions, headers = planner.plan(self.view(), self.config, self.model, extra=predicted_extra or self.predicted(), counter=self.counter)
        self._plans.append(Scratch(self.store.spark))
        while len(self._plans) > PLANS:
            self._plans.popleft().close()
        self.last_plan = self._plans[-1].keep(actions), self._plans[-1].keep(headers)
        return self.last_plan

    def materialize(self, predicted_extra: int = 0, plan: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        return self._apply(plan or self.plan(predicted_extra), recorded=False)

    def compact(self, predicted_extra: int = 0) -> DataFrame:
        """Plans, records the run and materializes; run, artifacts and working set count at once."""
        return self._apply(self.plan(predicted_extra), recorded=True)

    def _apply(self, plan: tuple[DataFrame, DataFrame], recorded: bool) -> DataFrame:
        actions, headers = plan
        own = self.store.spark.createDataFrame([(self.id,)], "session_id string")
        with self.store.commit(self.id, name="apply") as change:
            working, artifacts = apply_ops.materialize(self.view(), actions, counter=self.counter)
            run = change.record_runs(headers, actions) if recorded else None
            change.insert_artifacts(artifacts)
            change.replace_working_sets(working, own, replay.applied(actions), run)
        self.last_plan = None
        return self.store.working_set(self.id)[0].orderBy("pos")

    def status(self, predicted_extra: int = 0) -> DataFrame:
        """Pressure, composition and candidates by the last plan if it still holds and nothing else is asked, else by a new one."""
        actions, headers = self.last_plan if self.last_plan and not predicted_extra else self.plan(predicted_extra)
        return report.status(self.view(), actions, headers, self.config, self.model)

    def stats(self) -> dict:
        """Totals of history, working set and runs; the history itself isn't read."""
        history = self.store.totals(self.id).groupBy("session_id").agg(F.sum("items").alias("item_count"), F.sum("tokens").alias("total_tokens")).first()
        runs = report.telemetry(self.store.runs(self.id)).first()
        working = apply_ops.working_totals(self.store.working_set(self.id)[0]).first()
        return {
            "session_id": self.id, "history_items": history.item_count if history else 0, "history_tokens": history.total_tokens if history else 0,
            "working_items": working.item_count if working else 0, "working_tokens": working.total_tokens if working else 0,
            "compactions": runs.compactions if runs else 0, "emergency_compactions": runs.emergency_compactions if runs else 0, "reclaimed_tokens": runs.reclaimed_tokens if runs else 0,
        }
