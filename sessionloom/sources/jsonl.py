"""JSON lines: item records, bare or in an envelope, and protocol requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KINDS, LEVELS, STATES, WIRE


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, arrival) of every line; arrival rises through a file."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), "value", F.monotonically_increasing_id().alias("arrival"))


def _is_json(v: Column) -> Column:
    """Whether a text is one JSON value and nothing else. Parsers stop at its end, so it is put into an array and into an object."""
    inside = F.concat(F.lit("["), v, F.lit("]"))
    return F.try_parse_json(inside).isNotNull() & (F.json_array_length(inside) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), v, F.lit("}"))).isNotNull()


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds type, item and error; blank lines and ``session.start`` records go.

    A record is an item itself, or one of type ``context.add`` with it inside. ``source`` in it is ignored. error tells what is
    wrong with a record: not JSON, no kind or content, or an unknown kind, state or level.
    """
    v = F.col(value)
    kind = F.get_json_object(v, "$.type")
    body = F.when(kind == "context.add", F.get_json_object(v, "$.item")).otherwise(v)
    rows = lines.where(F.trim(v) != "").withColumn("type", kind).where("type IS NULL OR type <> 'session.start'")
    rows = rows.withColumn("item", F.from_json(body, WIRE))
    unknown = lambda c, values: F.col(f"item.{c}").isNotNull() & ~F.col(f"item.{c}").isin(*values)
    error = F.when(~F.coalesce(_is_json(v), F.lit(False)), "not JSON").when(F.col("item.kind").isNull(), "no kind").when(unknown("kind", KINDS), "unknown kind")
    error = error.when(F.col("item.content").isNull(), "no content").when(unknown("state", STATES), "unknown state").when(unknown("compression_level", LEVELS), "unknown level")
    return rows.withColumn("error", error)


def check(lines: DataFrame, before: int = 0) -> None:
    """Raises a ValueError with the number, from 1, of the first bad line in its file; ``before`` lines came earlier."""
    bad = parsed(lines).where("error IS NOT NULL").select(F.min(F.struct("path", "arrival", "error", F.substring("value", 1, 200).alias("value")))).first()[0]
    if bad is not None:
        number = before + lines.where((F.col("path") == bad.path) & (F.col("arrival") <= bad.arrival)).count()
        raise ValueError(f"line {number}: {bad.error}: {bad.value}")


def records(lines: DataFrame, session: Column, *, strict: bool = True) -> DataFrame:
    """Wire records with session_id, and arrival if the lines have it. A bad line fails the whole job if ``strict``, else it is left out (see ``bad_records``)."""
    rows = parsed(lines)
    if strict:
        rows = rows.withColumn("item", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("error", F.lit(": "), F.substring("value", 1, 200)))).otherwise(F.col("item")))
    else:
        rows = rows.where("error IS NULL")
    return rows.select(session.cast("string").alias("session_id"), "item.*", *[c for c in ("arrival",) if c in lines.columns])


def bad_records(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("error IS NOT NULL").select("value", "error")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
