"""From raw records to items: defaults, enrichment, checks, order, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scoring import DEDUPLICABLE
from ..functions.text import Counter, content_hash, new_id, token_count
from ..schema import KINDS, METADATA, SLUGS, STATES

ORDER = ("created_at", "item_id")


def known(column: Column, values: tuple[str, ...], other: str) -> Column:
    """The value if it is one of these, else ``other``."""
    return F.when(column.isin(*values), column).otherwise(F.lit(other))


def slug(kind: Column) -> Column:
    out = F.lit(SLUGS[-1])
    for k, s in zip(KINDS, SLUGS, strict=True):
        out = F.when(kind == k, F.lit(s)).otherwise(out)
    return out


def kind_of_role(role: Column, kind: Column | None = None) -> Column:
    """A valid kind wins; else the role's; any other role is a user's message."""
    by_role = F.when(role == "system", "SystemPrompt").when(role == "developer", "DeveloperPrompt").when(role == "assistant", "AssistantMessage")
    by_role = by_role.when(role == "tool", "ToolResult").otherwise("UserMessage")
    return by_role if kind is None else F.when(kind.isin(*KINDS), kind).otherwise(by_role)


def metadata(**given: Column) -> Column:
    """A metadata struct; fields that aren't given are null, flags false, tags empty."""
    empty = {"recoverable": F.lit(False), "pinned": F.lit(False), "tags": F.array().cast("array<string>")}
    parts = [p.split(" ", 1) for p in METADATA.split(", ")]
    return F.struct(*[given.get(name, empty.get(name, F.lit(None))).cast(kind).alias(name) for name, kind in parts])


def new_items(df: DataFrame, session: Column, item_id: Column, kind: Column, content: Column, created_at: Column, *, adapter: str | None = None, parent_id: Column | None = None, meta: Column | None = None, counter: Counter = token_count) -> DataFrame:
    """Items as their constructor makes them: hashed, counted, Active, L0."""
    source = F.struct(F.lit("adapter" if adapter else "ingest").alias("type"), F.lit(adapter).cast("string").alias("adapter"))
    return df.select(
        session.cast("string").alias("session_id"), item_id.cast("string").alias("item_id"), (F.lit(None) if parent_id is None else parent_id).cast("string").alias("parent_id"),
        kind.alias("kind"), content.alias("content"), content_hash(content).alias("content_hash"), counter(content).alias("token_count"), created_at.cast("timestamp").alias("created_at"),
        source.alias("source"), (metadata() if meta is None else meta).alias("metadata"), F.lit("Active").alias("state"), F.lit("L0").alias("compression_level"),
    )


def enrich(records: DataFrame, *, adapter: str | None = None, counter: Counter = token_count) -> DataFrame:
    """Wire records with session_id to items: defaults, counted tokens where 0, hash, source overridden by the caller's.

    A supplied hash must be the content's, in lower case, and a count must not be negative, else the job fails. Ids made here are random, so
    write the result before reading it twice. A column ``arrival`` stays.
    """
    given = F.col("content_hash")
    right = content_hash(F.col("content"))
    checked = F.when(F.col("content_hash").isNotNull() & (given != right), F.raise_error(F.concat(F.lit("content hash does not match: "), F.coalesce("id", F.lit("?"))))).otherwise(right)
    count = F.coalesce("token_count", F.lit(0))
    count = F.when(count < 0, F.raise_error(F.lit("token count out of range")).cast("long")).when(count == 0, counter(F.when(count == 0, F.col("content")))).otherwise(count)
    m = lambda name: F.col(f"metadata.{name}")
    names = [p.split(" ", 1)[0] for p in METADATA.split(", ")]
    flags = {n: F.coalesce(m(n), F.lit(False)) for n in ("recoverable", "pinned")} | {"tags": F.coalesce(m("tags"), F.array().cast("array<string>"))}
    source = F.struct(F.lit("adapter" if adapter else "ingest").alias("type"), F.lit(adapter).cast("string").alias("adapter"))
    created = F.date_trunc("MILLISECOND", F.coalesce(F.to_timestamp("created_at"), F.current_timestamp()))
    return records.select(
        "session_id", F.coalesce("id", new_id()).alias("item_id"), "parent_id", "kind", "content", checked.alias("content_hash"), count.alias("token_count"), created.alias("created_at"),
        source.alias("source"), metadata(**{n: flags.get(n, m(n)) for n in names}).alias("metadata"),
        F.coalesce("state", F.lit("Active")).alias("state"), F.coalesce("compression_level", F.lit("L0")).alias("compression_level"),
        *[c for c in ("arrival",) if c in records.columns],
    )


def loaded(items: DataFrame) -> DataFrame:
    """Stored rows as they are read back: unknown kinds are Other, states Unknown; the level is L0, as history holds contents that nothing compressed."""
    return items.withColumns({"kind": known(F.col("kind"), KINDS, "Other"), "state": known(F.col("state"), STATES, "Unknown"), "compression_level": F.lit("L0")})


def active(items: DataFrame) -> DataFrame:
    """Items that are neither Abandoned nor Superseded."""
    return items.where(~F.col("state").isin("Abandoned", "Superseded"))


def indexed(items: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds idx, the place from 0 in the session, and n_items."""
    own = W.partitionBy("session_id")
    return items.withColumn("idx", F.row_number().over(own.orderBy(*order)) - 1).withColumn("n_items", F.count(F.lit(1)).over(own))


def duplicates(items: DataFrame) -> DataFrame:
    """Adds dup_count and is_canonical, the newest of equal kind and content; kinds that aren't deduplicated are single.

    Needs idx. Only kinds that can be duplicates share a group.
    """
    same = W.partitionBy("session_id", "kind", "content_hash")
    can = F.col("kind").isin(*DEDUPLICABLE)
    count = F.when(can, F.count(F.lit(1)).over(same)).otherwise(F.lit(1).cast("long"))
    newest = F.when(can, F.max("idx").over(same) == F.col("idx")).otherwise(F.lit(True))
    return items.withColumn("dup_count", count).withColumn("is_canonical", newest)


def duplicate_summary(items: DataFrame) -> DataFrame:
    """Hashes that occur more than once in a session, whatever the kind: how often, and the greatest id, the most frequent first."""
    found = items.groupBy("session_id", "content_hash").agg(F.count(F.lit(1)).alias("count"), F.max("item_id").alias("canonical_id"))
    return found.where("count > 1").orderBy(F.desc("count"), "session_id", "content_hash")


def checkpoint_items(checkpoints: DataFrame, session: str = "session_id", item_id: str = "item_id", created_at: str = "created_at", counter: Counter = token_count) -> DataFrame:
    """Checkpoint items from rows with a struct column ``checkpoint``; the content is pretty JSON."""
    text = F.to_json("checkpoint", {"pretty": "true", "ignoreNullFields": "false"})
    made = new_items(checkpoints, F.col(session), F.col(item_id), F.lit("Checkpoint"), text, F.col(created_at), counter=counter)
    return made.withColumn("source", F.struct(F.lit("compaction").alias("type"), F.lit(None).cast("string").alias("adapter")))
