"""Adapters that lift tables to items of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.items import kind_of_role, metadata, new_items


def _at(seconds: str) -> F.Column:
    return F.timestamp_seconds(F.col(seconds))


def from_conversations(df: DataFrame) -> DataFrame:
    """A session a conversation, an item a turn, kinds by role."""
    item_id = F.concat_ws("-", F.lit("c"), "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0"))
    return new_items(df, F.col("conv_id"), item_id, kind_of_role(F.col("role")), F.coalesce("text", F.lit("")), _at("turn"), adapter="stdio")


def from_documents(df: DataFrame, session: str = "source") -> DataFrame:
    """A session a value of ``session``, an item a document as a recoverable file read."""
    item_id = F.concat(F.lit("d-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    meta = metadata(file_path=F.concat(F.lit("docs/"), F.col("doc_id").cast("string")), recoverable=F.lit(True))
    return new_items(df, F.coalesce(F.col(session), F.lit("")), item_id, F.lit("FileContent"), F.coalesce("text", F.lit("")), _at("doc_id"), meta=meta)


def from_pages(df: DataFrame) -> DataFrame:
    """A session a host, an item a page as the result of the tool ``fetch``."""
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1), F.lit(""))
    item_id = F.concat(F.lit("p-"), F.lpad(F.col("page_id").cast("string"), 12, "0"))
    return new_items(df, host, item_id, F.lit("ToolResult"), F.coalesce("html", F.lit("")), _at("page_id"), meta=metadata(tool_name=F.lit("fetch")))
