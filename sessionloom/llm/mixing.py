"""Mixing sources to target weights: hash-random order, prefix sums of sizes, exact cuts, repeated epochs."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.prefix import ranged, running
from ._shared import WORD, cut, ranks_within, with_rows

#: Sources whose targets are found on the driver.
FEW_SOURCES = 20_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> dict[str | None, Fraction]:
    """Each source's words: shares of all words by weight, at most ``max_epochs`` times its size, the excess reshared.

    Sources take the weights in turn by code point, null last. Works on one number a source, exactly.
    """
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: dict[str | None, Fraction] = {}
    left, open_weight = Fraction(sum(sizes.values())), sum(weight.values())
    for s in sorted(order, key=lambda s: Fraction(sizes[s], weight[s])):  # the share of a weight only grows as sources are filled
        if left * weight[s] > max_epochs * sizes[s] * open_weight:
            full[s] = Fraction(max_epochs * sizes[s])
            left, open_weight = left - full[s], open_weight - weight[s]
        else:
            break
    return full | {s: left * weight[s] / open_weight for s in order if s not in full}


def planned(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(_source, target, _budget) of (source, n), as ``targets`` has it, for any number of sources: only sums and the level reach the driver.

    In order of size by weight, the sums of what lies before a source tell what is left for it and those behind; the first whose share is
    not above its size's epochs sets the level. Whole numbers throughout, so all sizes together times the largest weight must be below 2 to the 62.
    """
    place = [F.col("source").isNull().asc(), F.col("source").asc()]
    rows = running(ranged(sizes, [], place), [], place, {"_i": F.lit(1)}).drop("_range")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("long")
    rows = rows.withColumn("_w", turn).withColumn("_by", F.col("n") * F.floor(F.lit(math.lcm(*weights)) / F.col("_w")))
    order = [F.col("_by").asc(), *place]
    rows = ranged(rows.drop("_i"), [], order)
    total, weight = rows.agg(F.sum("n"), F.sum("_w")).first()
    rows = running(rows, [], order, {"_full": F.col("n") * max_epochs, "_weight": F.col("_w")})
    left, open_ = F.lit(total) - F.col("_full"), F.lit(weight) - F.col("_weight")
    rows = cut(rows.withColumn("_left", left).withColumn("_open", open_).withColumn("_holds", F.col("_left") * F.col("_w") <= max_epochs * F.col("n") * F.col("_open")))
    level = rows.where("_holds").agg(F.min(F.struct("_by", F.col("source").isNull().alias("_null"), "source", "_left", "_open")).alias("m")).select("m.*").first()
    if level is None or level._open is None:
        at, words, over = F.lit(False), F.lit(0).cast("long"), F.lit(1).cast("long")
    else:
        here = F.struct(F.col("_by"), F.col("source").isNull().alias("_null"), F.col("source"))
        mark = F.struct(F.lit(level._by).alias("_by"), F.lit(level._null).alias("_null"), F.lit(level.source).cast("string").alias("source"))
        at, words, over = here >= mark, F.lit(level._left).cast("long"), F.lit(level._open).cast("long")
    part, full = words * F.col("_w"), F.col("n") * max_epochs
    rows = rows.select(F.col("source").alias("_source"), F.when(at, part / over).otherwise(full).cast("double").alias("target"), (2 * part + over).alias("_twice"), (2 * over).alias("_over"), at.alias("_at"), full.alias("_full"))
    return rows.selectExpr("_source", "target", "CASE WHEN _at THEN _twice div _over ELSE _full END AS _budget")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", row_col: str | None = None, few: int = FEW_SOURCES) -> DataFrame:
    """One row a row of ``docs``: its id, size, source, source_size, target and taken.

    Size is the number of words; a null or empty text has size 0 and takes 0. Documents of a source stand in the order
    of an MD5 of seed and id; every document is taken ``target div source_size`` times, then the first ones once more
    until the source's target, rounded to whole words, is met: the last of them takes part of its words. Rows with the
    same id are ordered by size; equal ones are interchangeable. A null id hashes as an empty id; a null source is a
    source of its own. An empty table gives an empty result. Other columns are not read.

    ``row_col``, a unique number a row that must not change when it is read again, is kept if it is given; a null id then
    hashes as its text's MD5, so that many of them spread over the ranges.

    The targets of ``few`` sources at most are found on the driver, those of more by ``planned``; both go back as a table that Spark broadcasts only if it is under its threshold. A hot source is cut into about sqrt(n) key ranges (see ranks_within).
    """
    unnamed = F.lit("") if row_col is None else F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    kept = [] if row_col is None else [row_col]
    rows = docs.select(
        *kept,
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), unnamed))).alias("_hash"),
    )
    rows = cut(rows)
    sums = cut(rows.groupBy("source").agg(F.sum("size").alias("n")))
    if sums.count() > few:
        plan = cut(planned(sums, weights, max_epochs))
    else:
        found = targets({r.source: r.n for r in sums.collect()}, weights, max_epochs)
        plan = docs.sparkSession.createDataFrame([(s, float(t), int(t + Fraction(1, 2))) for s, t in found.items()], "_source string, target double, _budget long")
    spread = F.conv(F.substring("_hash", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    ranked = ranks_within(rows, "source", spread, ["_hash", "size", *kept], F.col("size"), "_before", "source_size")
    rest = F.col("_budget") - F.expr("CASE WHEN source_size = 0 THEN 0 ELSE _budget div source_size END") * F.col("source_size")
    epochs = F.expr("CASE WHEN source_size = 0 THEN 0L ELSE _budget div source_size END")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    out = ranked.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return out.select(*kept, "doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def take(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", row_col: str | None = None) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: a copy an epoch, the last cut after the words that are still due.

    ``mixed`` has doc_id, source, size and taken. A document that takes nothing goes, as does one without words. Text of whole copies is left as it is; a cut copy
    is its words joined by single spaces, and ``length_col``, if it is there, follows. Each row takes its own count: that of
    its ``row_col``, if both tables have it; else rows of one id, source and size, which the mix holds interchangeable, are
    numbered in both and joined by number.
    """
    rows, due = docs.select(F.struct("*").alias("doc")), mixed
    if row_col is None:
        size = F.coalesce(F.regexp_count(F.col(f"doc.{text_col}"), F.lit(WORD)), F.lit(0)).cast("long")
        rows = rows.select("doc", F.col(f"doc.{id_col}").alias("_id"), F.col(f"doc.{source_col}").cast("string").alias("_source"), size.alias("_size"))
        rows = rows.where("_size > 0").withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64(f"doc.{text_col}"))))
        due = due.where("size > 0").withColumn("due_nth", F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(F.desc("taken"))))
        same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size")) & (F.col("_nth") == F.col("due_nth"))
    else:
        due = due.withColumnRenamed(row_col, "due_row")
        same = F.col(f"doc.{row_col}") == F.col("due_row")
    rows = rows.join(due.where("taken > 0").withColumnRenamed("taken", "due").hint("shuffle_hash"), same)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("due") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("due") - (F.col("copy") - 1) * F.col("size"))
    space = r"[\x20\x09-\x0D]+"
    text = F.col(f"doc.{text_col}")
    first = F.array_join(F.slice(F.split(F.regexp_replace(text, "^" + space, ""), space), F.lit(1), words.cast("int")), " ")
    new = {text_col: F.when(words < F.col("size"), first).otherwise(text)}
    if length_col in docs.columns:
        new[length_col] = F.when(words < F.col("size"), F.length(first)).otherwise(F.col(f"doc.{length_col}")).cast(docs.schema[length_col].dataType)
    return rows.select(*[new.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])


def mixed_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **options: object) -> DataFrame:
    """``docs`` as their own mix takes them, each row by a number of its own; ids may repeat or be null."""
    rows, key = with_rows(docs)
    mixed = mix(rows, id_col=id_col, text_col=text_col, source_col=source_col, row_col=key, **options)
    return take(rows, mixed, id_col=id_col, text_col=text_col, source_col=source_col, length_col=length_col, row_col=key).drop(key)
