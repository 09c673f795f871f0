"""Helpers that several operators use: the shared scratch folder, bounded keyed batches and ranks."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.shared import shared_dir

#: White space and words as the corpus operators understand them.
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[str, list[str]] = {}


def _clean(spark: SparkSession, app: str) -> None:
    for path in _written.pop(app, []):
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have gone first
            return


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: no recomputation when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sessionloom-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_clean, spark, app)
    _written[app].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that a Python worker gets at once.
BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of at most about BATCH_BYTES: the session's ``spark.sql.execution.arrow.maxBytesPerBatch``
    is lowered to that if it is higher, as a batch is held by Spark and by the worker, for each of an executor's cores. What Arrow
    keeps for reuse at the end of a task goes back to the machine, as workers live on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def bounded_sample(docs: DataFrame, id_col: str, text_col: str, rows: int, name: str, chars: int) -> list[str]:
    """Beginnings of ``chars`` code points of ``rows`` texts at most: those of lowest hash of id and text, equal rows once, null texts never; sorted.

    Rows are thinned by hash before they are ordered, so the job orders a few times what it returns.
    """
    n = docs.count()
    mark = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.lit(name))
    picked = docs.where(F.col(text_col).isNotNull()).select(mark.alias("mark"), F.substring(text_col, 1, chars).alias("part"))
    picked = picked.where(F.pmod("mark", F.lit(1 << 30)) < int(min(1.0, 4 * rows / max(n, 1)) * (1 << 30)))
    return sorted(r.part for r in picked.groupBy("mark").agg(F.first("part").alias("part")).orderBy("mark").limit(rows).collect())


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores put before it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def with_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a unique number a row, and that column's name; written once, as the numbers depend on the order of rows."""
    name = fresh("row", df.columns)
    return cut(df.withColumn(name, F.monotonically_increasing_id())), name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_file(path: str, limit: int) -> str:
    """``path``, if the file is of at most ``limit`` bytes, so that what it holds may be sent to all executors."""
    if (size := os.path.getsize(path)) > limit:
        raise ValueError(f"{path} has {size} bytes, more than {limit}")
    return path


def ranks_within(df: DataFrame, key: str, spread: Column, order: list[str], weight: Column, before: str, total: str) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over the rows of the same ``key`` that come earlier, and ``total`` of the key.

    ``spread`` is a double in [0, 1) that is uniform within each key; rows go by its ranges, then ``order``.
    A key of n rows is cut into about sqrt(n) ranges of about sqrt(n) rows, so neither a range nor the table of
    range totals holds a large share of a hot key. Null keys count as one key.
    """
    sized = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias(total))
    sized = sized.select(F.col(key).alias("_key"), "_n", total)
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt("_n")))
    spread_out = df.withColumn("_s", spread).join(sized, F.col(key).eqNullSafe(F.col("_key")))
    spread_out = spread_out.withColumn("_part", F.least(F.floor(F.col("_s") * parts), parts - 1).cast("long"))
    parts_before = (
        spread_out.groupBy(F.col(key).alias("_key"), "_part")
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_base", F.coalesce(F.sum("_w").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("_key").alias("_key2"), F.col("_part").alias("_part2"), "_base")
    )
    own = W.partitionBy(key, "_part").orderBy("_s", *order).rowsBetween(W.unboundedPreceding, -1)
    inner = spread_out.withColumn("_inner", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    out = inner.join(parts_before, F.col(key).eqNullSafe(F.col("_key2")) & (F.col("_part") == F.col("_part2")))
    return out.withColumn(before, F.col("_base") + F.col("_inner")).drop("_key", "_n", "_s", "_part", "_key2", "_part2", "_base", "_inner")


def keyed_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Groups of equal ``keys`` of rows that arrive sorted by them, as single batches; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        ends = np.append(starts[1:], batch.num_rows)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``limit`` bytes of ``text`` each; a longer row stands alone."""
    _, offsets = flat_bytes(batch.column(text))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
