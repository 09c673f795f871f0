"""Append-only tables under one folder, laid out by session, with commits that count as one, keyed inserts and versions of what is replaced."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import content_hash
from ..operators import replay
from ..operators.items import ORDER, active, known, loaded
from ..schema import KINDS, STATES, TABLES, Config, Model
from .commits import Files, Log, to_merge
from .shared import shared_dir

#: Folders that sessions are dealt to, by a hash; a query about one session reads one of them.
BUCKETS = 64
#: Commits of one level that are merged into one of the next, and seconds that readers have before what was merged is removed.
MERGE_AT, GRACE = 16, 3600.0
KEYS = {"context_items": ["session_id", "item_id"], "sessions": ["session_id"], "artifacts": ["session_id", "artifact_id"]}
#: Columns for point lookups, which get Bloom filters in merged files.
LOOKUPS = {"context_items": "item_id", "artifacts": "artifact_id", "memory_items": "key", "memory_postings": "term"}


def bucket_of(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


class Commit:
    """What one change writes, to any of its buckets' tables; all of it counts once the change ends without an error, and nothing before."""

    def __init__(self, store: Store, buckets: list[int], session_id: str | None, name: str):
        self.store, self.buckets, self.session_id, self.id = store, buckets, session_id, f"{re.sub('[^A-Za-z0-9_-]', '_', name)}.{uuid.uuid4().hex[:12]}"
        self.read_at = store.log.last(buckets)

    def old(self, name: str) -> DataFrame:
        """The table as it was before this commit, in its buckets."""
        return self.store.read(name, self.session_id, buckets=self.buckets)

    def append(self, name: str, rows: DataFrame, *, ignore: bool = False) -> None:
        """Adds rows. A key that is there already is an error, or passed over if ``ignore``; so is a repeated one among them."""
        keys = KEYS.get(name)
        if keys and ignore:
            rows = rows.dropDuplicates(keys).join(self.old(name).select(*keys), keys, "left_anti")
        elif keys:
            self.refuse_repeats(name, rows)
        self.store._write(name, self.store._cast(name, rows), self.id, self.buckets if len(self.buckets) == 1 else None)

    def refuse_repeats(self, name: str, rows: DataFrame) -> None:
        keys = KEYS[name]
        clash = rows.join(self.old(name).select(*keys), keys, "left_semi").select(*keys).unionByName(rows.groupBy(*keys).count().where("count > 1").select(*keys))
        if bad := clash.first():
            raise ValueError(f"{name} already has {bad.asDict()}")

    def insert_items(self, items: DataFrame) -> None:
        """Items, and what they add to the totals of their sessions."""
        items = self.store._cast("context_items", items.withColumn("content_hash", content_hash(F.col("content"))))
        self.append("context_items", items)
        self.append("item_totals", items.groupBy("session_id", "kind", "state").agg(F.count(F.lit(1)).alias("items"), F.sum("token_count").alias("tokens")))

    def append_events(self, events: DataFrame) -> None:
        """Rows of session_id, type, payload_json and created_at, in order of a number ``arrival`` if they have it, get ids that rise within a session."""
        last = self.old("events").agg(F.coalesce(F.max("event_id"), F.lit(-1))).first()[0]
        number = F.col("arrival") if "arrival" in events.columns else F.monotonically_increasing_id()
        self.append("events", events.withColumn("event_id", number + F.lit(last + 1)))

    def ensure_sessions(self, sessions: DataFrame) -> None:
        self.append("sessions", sessions, ignore=True)

    def save_model(self, session_id: str, model: Model) -> None:
        row = self.store.spark.createDataFrame([(session_id, "session.start", model.name, model.context_window, model.reserved_output_tokens)], "session_id string, type string, name string, context_window long, reserved_output_tokens long")
        payload = F.to_json(F.struct("name", "context_window", "reserved_output_tokens"))
        self.append_events(row.select("session_id", "type", payload.alias("payload_json"), F.current_timestamp().alias("created_at")))

    def insert_artifacts(self, artifacts: DataFrame) -> None:
        """Artifacts that aren't stored yet; storing one plan's twice changes nothing."""
        self.append("artifacts", artifacts.withColumn("created_at", F.current_timestamp()), ignore=True)

    def record_runs(self, headers: DataFrame, actions: DataFrame) -> str:
        """One run id for all sessions of a plan, which sorts by time."""
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        self.append("compaction_actions", actions.withColumn("run_id", F.lit(run)))
        self.append("compaction_runs", headers.select(F.lit(run).alias("run_id"), "session_id", "before_tokens", F.col("expected_after_tokens").alias("after_tokens"), "pressure_state", F.current_timestamp().alias("created_at")))
        return run

    def upsert_token_stats(self, stats: DataFrame) -> None:
        """Statistics of higher counts than those stored; lower ones never count again."""
        self.append("token_stats", stats)

    def replace_working_sets(self, working: DataFrame, sessions: DataFrame, applied: DataFrame | None = None, run: str | None = None) -> None:
        """Sets the working sets of ``sessions`` to these rows; other sessions' are neither read nor written.

        With ``applied`` (see ``replay.applied``) the version can be seen again after it was replaced; ``run`` is the run that made it.
        """
        version = F.lit(time.time_ns())
        self.append("working_set_items", working.withColumn("version", version))
        last = self.old("events").groupBy("session_id").agg(F.max("event_id").alias("last_event"))
        meta = sessions.select("session_id").join(last, "session_id", "left").withColumn("last_event", F.coalesce("last_event", F.lit(-1)))
        self.append("working_set_meta", meta.withColumns({"materialized_at": F.current_timestamp(), "version": version, "run_id": F.lit(run)}))
        if applied is not None:
            self.append("working_set_actions", applied.withColumn("version", version))

    def append_working_sets(self, rows: DataFrame) -> None:
        """Adds rows to the working sets of sessions that have one."""
        meta = newest_meta(self.old("working_set_meta"))
        self.append("working_set_items", rows.drop("version").join(meta.select("session_id", "version"), "session_id"))


def newest_meta(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.max_by("materialized_at", "version").alias("materialized_at"), F.max("version").alias("version"))


def added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "kind", "state").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))


def newest_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "event_type").agg(F.max_by("ema", "count").alias("ema"), F.max("count").alias("count"))


class Store:
    """Tables as Parquet folders, ``<table>/bucket=<n>/commit=<id>``, and a log of the commits that count (see ``Log``).

    A reader of one session lists its bucket's marks and reads the folders that these name, whatever else the store holds. Nothing that is
    written is written again, but small commits are merged: MERGE_AT of one level become one of the next, without dead versions, so a bucket has a
    number of commits that grows with the logarithm of all there ever were. What was merged goes after a time of grace. Of two writers of one
    bucket at once the second gets a ``Conflict``, where the file system can create a file exclusively.

    Of token statistics the row with the greatest count holds, of a working set the newest version; totals are sums of what commits added.
    """

    def __init__(self, spark: SparkSession, path: str, *, grace: float = GRACE):
        self.spark, self.path, self.grace = spark, path.rstrip("/"), grace
        self.files, self.log = Files(spark), Log(spark, f"{self.path}/log")
        self._schemas: dict[str, StructType] = {}
        self._bucket: dict[str, int] = {}

    @staticmethod
    def temporary(spark: SparkSession) -> Store:
        """An empty store in the shared folder, for tests and trials."""
        return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")

    def schema(self, name: str) -> StructType:
        if name not in self._schemas:
            self._schemas[name] = StructType.fromDDL(TABLES[name])
        return self._schemas[name]

    def bucket(self, session_id: str) -> int:
        if session_id not in self._bucket:
            self._bucket[session_id] = self.spark.range(1).select(bucket_of(F.lit(session_id))).first()[0]
        return self._bucket[session_id]

    def buckets(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' sessions."""
        return sorted(r[0] for r in rows.select(bucket_of(F.col("session_id")).alias("bucket")).distinct().collect())

    # ---- reading ----

    def _folders(self, name: str, buckets: list[int] | None, commits: dict[int, list[str]] | None = None) -> list[str]:
        """Folders of a table that commits (all that count, if not given) have written to."""
        some = list(range(BUCKETS)) if buckets is None else buckets
        commits = self.log.live(some) if commits is None else commits
        if len(some) < 4:
            there = {(f"bucket={b}", c) for b in some for c in self.files.names(f"{self.path}/{name}/bucket={b}")}
        else:
            there = set(self.files.matching(f"{self.path}/{name}/bucket=*/commit=*", 2))
        return [f"{self.path}/{name}/bucket={b}/commit={c}" for b in some for c in commits[b] if (f"bucket={b}", f"commit={c}") in there]

    def read(self, name: str, session_id: str | None = None, *, buckets: list[int] | None = None) -> DataFrame:
        """A table, or its rows of one session, or of some buckets, of the commits that count now."""
        if buckets is None and session_id is not None:
            buckets = [self.bucket(session_id)]
        folders = self._folders(name, buckets)
        if not folders:
            return self.spark.createDataFrame([], self.schema(name))
        rows = self.spark.read.schema(self.schema(name)).parquet(*folders)
        return rows if session_id is None else rows.where(F.col("session_id") == session_id)

    def items(self, session_id: str | None = None) -> DataFrame:
        return loaded(self.read("context_items", session_id))

    def ordered_items(self, session_id: str) -> DataFrame:
        return self.items(session_id).orderBy(*ORDER)

    def active_items(self, session_id: str | None = None) -> DataFrame:
        return active(self.items(session_id))

    def item(self, item_id: str, session_id: str | None = None) -> DataFrame:
        return self.items(session_id).where(F.col("item_id") == item_id)

    def load_model(self, session_id: str, config: Config) -> Model:
        newest = self.read("events", session_id).where(F.col("type") == "session.start").agg(F.max_by("payload_json", "event_id").alias("p"))
        row = newest.select(F.from_json("p", "name string, context_window long, reserved_output_tokens long").alias("m")).select("m.*").first()
        return Model.default(config) if row is None or row.name is None else Model(row.name, row.context_window, row.reserved_output_tokens)

    def artifact(self, artifact_id: str, session_id: str | None = None) -> DataFrame:
        return self.read("artifacts", session_id).where(F.col("artifact_id") == artifact_id)

    def runs(self, session_id: str | None = None) -> DataFrame:
        return self.read("compaction_runs", session_id).orderBy("run_id", "session_id")

    def actions(self, session_id: str | None = None) -> DataFrame:
        return self.read("compaction_actions", session_id)

    def totals(self, session_id: str | None = None) -> DataFrame:
        """Items and tokens of the history by session, kind and state, from what each commit added: as many rows as commits that count, not as items."""
        rows = self.read("item_totals", session_id)
        return added_up(rows.withColumns({"kind": known(F.col("kind"), KINDS, "Other"), "state": known(F.col("state"), STATES, "Unknown")}))

    def token_stats(self, session_id: str | None = None, *, buckets: list[int] | None = None) -> DataFrame:
        return newest_stats(self.read("token_stats", session_id, buckets=buckets))

    def working_set(self, session_id: str | None = None, *, buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, meta); a session that is in meta without rows was compacted to nothing."""
        meta = newest_meta(self.read("working_set_meta", session_id, buckets=buckets))
        rows = self.read("working_set_items", session_id, buckets=buckets).join(meta.select("session_id", "version"), ["session_id", "version"], "left_semi")
        return rows.drop("version"), meta.drop("version")

    def past(self, asked: DataFrame, *, session_id: str | None = None) -> DataFrame:
        """Working sets as they were: of rows (ask_id, session_id, at) at these times, or of (ask_id, session_id, run_id) right after these runs (see ``replay.as_of``).

        Only the asked sessions' part of the store is read; ``session_id`` is that of all asks, if they have one.
        """
        buckets = [self.bucket(session_id)] if session_id is not None else self.buckets(asked)
        read = lambda name: self.read(name, session_id, buckets=buckets)
        versions = read("working_set_meta")
        added = read("events").where("type = 'context.add'")
        arrivals = added.select("session_id", F.get_json_object("payload_json", "$.item_id").alias("item_id"), "event_id", F.col("created_at").alias("arrived_at"))
        asks = replay.at_runs(asked, versions) if "run_id" in asked.columns else replay.at_times(asked, versions)
        return replay.as_of(loaded(read("context_items")), arrivals, versions, read("working_set_actions"), asks)

    # ---- writing ----

    def _cast(self, name: str, rows: DataFrame) -> DataFrame:
        there = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(name)])

    def _write(self, name: str, rows: DataFrame, commit: str, buckets: list[int] | None) -> None:
        """Rows of one bucket, or of several if ``buckets`` is None, in files of the size that adaptive execution aims at."""
        if buckets:
            rows.hint("rebalance").write.parquet(f"{self.path}/{name}/bucket={buckets[0]}/commit={commit}")
            return
        rows = rows.withColumn("bucket", bucket_of(F.col("session_id"))).hint("rebalance", "bucket").withColumn("commit", F.lit(commit))
        rows.write.mode("append").partitionBy("bucket", "commit").parquet(f"{self.path}/{name}")

    @contextmanager
    def commit(self, session_id: str | None = None, *, rows: DataFrame | None = None, name: str = "c") -> Iterator[Commit]:
        """A change to one session, to the sessions of ``rows``, or to any; it counts as a whole at the end, unless that isn't reached.

        ``name`` is any name that ``has`` may be asked for later.
        """
        buckets = [self.bucket(session_id)] if session_id is not None else list(range(BUCKETS)) if rows is None else self.buckets(rows)
        self.log.finish()
        change = Commit(self, buckets, session_id, name)
        yield change
        if buckets:
            self.log.publish(change.id, change.read_at)
            self.merge(buckets)

    def has(self, name: str) -> bool:
        """Whether a commit of this name counts; known for as long as it isn't merged and removed."""
        found = [c for c, _ in self.log.pending()] + [m.commit for marks in self.log.marks_of(list(range(BUCKETS))).values() for m in marks]
        return any(c.rpartition(".")[0] == re.sub("[^A-Za-z0-9_-]", "_", name) for c in found)

    # ---- upkeep ----

    def merge(self, buckets: list[int] | None = None, *, at: int = MERGE_AT) -> int:
        """Merges the last commits of each bucket that has ``at`` of one level. In how many buckets it did."""
        marks = self.log.marks_of(list(range(BUCKETS)) if buckets is None else buckets)
        runs = {b: run for b in marks if (run := to_merge(marks[b], at))}
        if not runs:
            return 0
        commit, old = f"m.{uuid.uuid4().hex[:12]}", {b: [m.commit for m in run] for b, run in runs.items()}
        for name, columns in TABLES.items():
            if folders := self._folders(name, list(runs), old):
                rows = self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{columns}, bucket INT, commit STRING").parquet(*folders).drop("commit", "bucket")
                rows = self._without_dead(name, rows, list(runs)).withColumn("bucket", bucket_of(F.col("session_id")))
                rows = rows.hint("rebalance", "bucket").withColumn("commit", F.lit(commit)).sortWithinPartitions("bucket", "commit", "session_id")
                write = rows.write.mode("append").partitionBy("bucket", "commit")
                if column := LOOKUPS.get(name):
                    write = write.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
                write.parquet(f"{self.path}/{name}")
        for b, run in runs.items():
            low, high = min(m.number if m.low < 0 else m.low for m in run), max(m.number for m in run)
            # If another commit came first, what was merged is an orphan, and the next merge takes it in.
            self.log.put(b, self.log.last([b])[b] + 1, commit, run[0].level + 1, low, high)
        self.vacuum(list(runs), orphans=False)
        return len(runs)

    def _without_dead(self, name: str, rows: DataFrame, buckets: list[int]) -> DataFrame:
        if name == "token_stats":
            return newest_stats(rows)
        if name == "item_totals":
            return added_up(rows)
        if name == "working_set_items":
            return rows.join(newest_meta(self.read("working_set_meta", buckets=buckets)).select("session_id", "version"), ["session_id", "version"], "left_semi")
        return rows

    def vacuum(self, buckets: list[int] | None = None, *, grace: float | None = None, orphans: bool = True) -> int:
        """Removes folders of commits that were merged, and with ``orphans`` of ones that never came to count, older than ``grace`` seconds. How many."""
        now, grace, gone = time.time(), self.grace if grace is None else grace, 0
        pending = {c for c, _ in self.log.pending()}
        for b, marks in self.log.marks_of(list(range(BUCKETS)) if buckets is None else buckets).items():
            for m in marks:
                over = [o for o in marks if o.covers(m)]
                mark = lambda x: f"{self.log.path}/bucket={b}/{x.number:012d}"  # noqa: B023, E731
                if over and max(self.files.age(mark(o), now) for o in over) > grace:
                    gone += sum(self._remove(f"{self.path}/{name}/bucket={b}/commit={m.commit}") for name in TABLES if m.commit)
                    self.files.delete(mark(m))
            known = {m.commit for m in marks} | pending
            for name in TABLES if orphans else ():
                for folder in self.files.names(f"{self.path}/{name}/bucket={b}"):
                    path = f"{self.path}/{name}/bucket={b}/{folder}"
                    if folder.removeprefix("commit=") not in known and self.files.age(path, now) > grace:
                        gone += self._remove(path)
        return gone

    def _remove(self, folder: str) -> bool:
        if there := self.files.exists(folder):
            self.files.delete(folder)
        return there
