"""Running sums over groups of any size: rows in ranges of their order, sums within a range, and totals of the ranges before."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut

#: Rows of a range, about, and ranges at least, so that none is a large share of all.
RANGE_ROWS, LEAST_RANGES = 500_000, 64


def same(a: DataFrame, b: DataFrame, names: dict[str, str]) -> Column:
    """Columns of ``a`` equal those of ``b``, nulls too."""
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in names.items()])


def ranged(rows: DataFrame, keys: list[str], order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """Rows with the number ``_range`` of their range by keys and order, written once. ``order`` must tell the rows of a key apart, or equal ones share a range."""
    rows = cut(rows)  # it is read to be counted, to find the ranges and to be dealt
    n = ranges or max(LEAST_RANGES, rows.count() // RANGE_ROWS)
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key and range, in as many tasks as there are ranges."""
    n = (rows.agg(F.max("_range")).first()[0] or 0) + 1
    return rows.repartition(max(n, LEAST_RANGES), *keys, "_range")


def _with(rows: DataFrame, parts: DataFrame, keys: list[str], found: dict[str, Column]) -> DataFrame:
    """Rows with columns of their key and range."""
    more = parts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_at"), *[c.alias(name) for name, c in found.items()])
    return rows.join(more, same(rows, more, {k: f"_key_{k}" for k in keys} | {"_range": "_at"})).drop(*[f"_key_{k}" for k in keys], "_at")


def running(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, to rows of ``ranged``, each sum over the rows of equal keys that come before in order.

    A range's rows of a key are sorted in one task, and so are the totals of a key's ranges; nothing else needs the rows of a key together.
    """
    zero = F.lit(0).cast("long")
    parts = rows.groupBy(*keys, "_range").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = _dealt(rows, keys).withColumns({name: F.coalesce(F.sum(c).over(own), zero) for name, c in sums.items()})
    out = _with(local, parts, keys, {f"_base_{name}": F.coalesce(F.sum(name).over(earlier), zero) for name in sums})
    return out.select(*rows.columns, *[(F.col(name) + F.col(f"_base_{name}")).alias(name) for name in sums])


def latest(rows: DataFrame, keys: list[str], order: list[str | Column], found: dict[str, Column]) -> DataFrame:
    """Adds, to rows of ``ranged``, the greatest value so far of each column, the row's own included; 0 if there is none."""
    zero = F.lit(0).cast("long")
    parts = rows.groupBy(*keys, "_range").agg(*[F.max(c).alias(name) for name, c in found.items()])
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = _dealt(rows, keys).withColumns({name: F.max(c).over(own) for name, c in found.items()})
    out = _with(local, parts, keys, {f"_base_{name}": F.max(name).over(earlier) for name in found})
    return out.select(*rows.columns, *[F.coalesce(F.greatest(name, f"_base_{name}"), zero).alias(name) for name in found])


def totals(rows: DataFrame, keys: list[str], found: dict[str, tuple[Callable[[Column | str], Column], Column]]) -> DataFrame:
    """Adds, to rows of ``ranged``, an aggregate over all rows of equal keys: each is a function that may be applied to its own results, and what it is of."""
    parts = rows.groupBy(*keys, "_range").agg(*[f(c).alias(name) for name, (f, c) in found.items()])
    return _with(_dealt(rows, keys), parts, keys, {name: f(name).over(W.partitionBy(*keys)) for name, (f, _) in found.items()})
