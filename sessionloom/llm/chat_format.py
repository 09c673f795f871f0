"""Chat formatting: logged conversations that are a prefix of longer ones collapse into these, the rest is rendered.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _said(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), F.sha2(text, 256).alias("_hash"), F.xxhash64(role, text).alias("_a"), text.alias("_text"))


def _terms(n: Column) -> tuple[Column, Column]:
    """What a turn at place n adds to the two hashes."""
    return F.xxhash64(n, "_a").cast("decimal(20,0)"), F.xxhash64(F.lit("second"), "_hash", "_role", n).cast("decimal(20,0)")


def prefixes(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n, h1, h2): two rolling hashes of the first n turns of each conversation that has an id, for every n.

    A hash sums hashes of place, role and text, so it grows by one term a turn. Turns go by number, then role, then text.
    """
    by = W.partitionBy("conv").orderBy("_turn", "_role", "_hash")
    rows = _said(turns, id_col, turn_col, role_col, text_col).where("conv IS NOT NULL").drop("_text").withColumn("n", F.row_number().over(by))
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    h1, h2 = (F.sum(term).over(so_far) for term in _terms(F.col("n")))
    return rows.select("conv", "n", h1.alias("h1"), h2.alias("h2"))


def maximal(rolling: DataFrame) -> DataFrame:
    """(conv, n) of the conversations to keep, by their ``prefixes``: no prefix of a longer one, and of equal ones the one with the smallest id."""
    marked = rolling.withColumn("_last", F.max("n").over(W.partitionBy("conv")))
    whole = marked.where("n = _last").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"))
    inner = marked.where("n < _last").select("n", "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv", "n")


def render(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", head: str = "<|im_start|>", tail: str = "<|im_end|>") -> DataFrame:
    """One row a maximal conversation: its id, n_turns and chat.

    A turn is ``head`` + role + newline + text + ``tail`` + newline; a null role or text counts as empty. Turns with a null number come
    first; ties go by role, then text; repeated rows are turns of their own. A row with a null id is a conversation of one turn, so
    it goes if a conversation begins with that turn; of equal ones one stays. Of equal conversations one with an id
    stays. An empty table gives an empty result. Other columns are not read.

    Hashes of the turns are shuffled, not their texts; hot prefixes, copies and rows without an id are pre-aggregated. Texts move once, and only a
    conversation's own turns meet in a row, as the rendered chat is one value.
    """
    columns = {"id_col": id_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    rolling = prefixes(turns, **columns)
    keep = maximal(rolling).withColumnRenamed("conv", "_conv")
    every = _said(turns, **columns)
    rows = every.drop("_a").join(keep.hint("shuffle_hash"), F.col("conv") == F.col("_conv"))
    said = F.array_sort(F.collect_list(F.struct("_turn", "_role", "_hash", "_text")))
    line = lambda role, text: F.concat(F.lit(head), role, F.lit("\n"), text, F.lit(tail + "\n"))
    shown = F.transform(said, lambda s: line(s["_role"], s["_text"]))
    chats = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(shown, "").alias("chat"))
    alone = every.where("conv IS NULL").groupBy("_role", "_hash", "_a").agg(F.first("_text").alias("_text"))
    h1, h2 = _terms(F.lit(1))
    alone = alone.withColumns({"h1": h1, "h2": h2}).join(rolling.where("n = 1").select("h1", "h2").distinct(), ["h1", "h2"], "left_anti")
    alone = alone.select(F.lit(None).cast(every.schema["conv"].dataType).alias("conv"), F.lit(1).cast("long").alias("n_turns"), line(F.col("_role"), F.col("_text")).alias("chat"))
    return chats.unionByName(alone).withColumnRenamed("conv", id_col)
