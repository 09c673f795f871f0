"""Contracts of a long-term memory, a backend without any, and one over a store's tables that finds items by BM25."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sources.store import Store

EXTERNALIZED = "session_id STRING, item_id STRING, kind STRING, content STRING, token_count BIGINT"
CANDIDATE = "key STRING, content STRING, score DOUBLE"
STORED = "key STRING, content STRING"


@dataclass(frozen=True)
class MemoryRef:
    backend: str
    key: str

    def uri(self) -> str:
        return f"memory://{self.backend}/{self.key}"


@dataclass(frozen=True)
class RetrievalQuery:
    session_id: str
    query: str
    max_results: int = 5


def memory_uri(backend: Column, key: Column) -> Column:
    return F.concat(F.lit("memory://"), backend, F.lit("/"), key)


class MemoryBackend(Protocol):
    def store(self, rows: DataFrame) -> DataFrame:
        """Item ids with the URIs under which rows were stored."""

    def retrieve(self, query: RetrievalQuery) -> DataFrame:
        """Candidates, best first."""

    def get(self, ref: MemoryRef) -> DataFrame:
        """The stored row, if there is one."""


class NullMemory:
    """Stores nothing: references to ``none``, no candidates, no rows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def store(self, rows: DataFrame) -> DataFrame:
        return rows.select("item_id", memory_uri(F.lit("none"), F.col("item_id")).alias("uri"))

    def retrieve(self, query: RetrievalQuery) -> DataFrame:
        return self.spark.createDataFrame([], CANDIDATE)

    def get(self, ref: MemoryRef) -> DataFrame:
        return self.spark.createDataFrame([], STORED)


# ---- BM25 over inverted lists ----

#: How much a repeated term and a long text count.
K1, B = 1.2, 0.75
#: Items of a block of an inverted list, about; blocks that are scored before the others' bounds are looked at; slack for sums in another order.
BLOCK_ITEMS, SEED_BLOCKS, SLACK = 1024, 2, 1e-9
#: Pairs of a query and an item of its session above which queries are answered together, see ``search_many``; bytes of texts of a part, of items or queries, about.
MANY_PAIRS, PART_BYTES = 1_000_000, 16 << 20
#: Sessions that are sent to all tasks to leave out the texts of others; where more are asked for, all texts are looked at.
FEW_SESSIONS = 10_000


def terms(text: Column) -> Column:
    """Words in lower case: runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def key_of(session_id: Column, item_id: Column) -> Column:
    """An item's key, always the same one."""
    return F.sha2(F.concat(F.length(session_id).cast("string"), F.lit(":"), session_id, item_id), 256)


def indexed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, postings) of rows with session_id, item_id and content: items by key with their length in words, and their words with frequencies.

    Items of a session fall into blocks by key; a block is as good a place as any for a new item, so an index is added to by adding rows. Null texts
    have no words.
    """
    made = rows.select("session_id", key_of(F.col("session_id"), F.col("item_id")).alias("key"), "item_id", "content", terms(F.col("content")).alias("_terms"))
    slim = made.select("session_id", "key").groupBy("session_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ITEMS).alias("_blocks"))
    made = made.join(slim, "session_id").withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    items = made.select("session_id", "key", "item_id", "content", F.size("_terms").cast("long").alias("length"), "block")
    words = made.select("session_id", "key", "block", F.size("_terms").cast("long").alias("length"), F.explode("_terms").alias("term"))
    return items, words.groupBy("session_id", "term", "key", "block", "length").agg(F.count(F.lit(1)).alias("tf"))


def weight(tf: Column, length: Column, average: Column) -> Column:
    """What a term adds to an item's score, but for its rarity: grows with ``tf`` and shrinks with ``length``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def search(items: DataFrame, postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, key, item_id, score): the best ``max_results`` items of each query's session by BM25, equal scores (to 9 digits) by key.

    ``queries`` have query_id, session_id, query and max_results. Each block of an inverted list has a bound, by its largest frequency and
    shortest item. The blocks of highest bounds are scored first; of the others only those whose bound reaches the least score that a query has so far. So nothing
    that belongs to the result is left out, and long lists are mostly passed over. Where there are more than MANY_PAIRS pairs of a query and an item, bounds
    save less than the lists' rows cost: see ``search_many``.
    """
    pairs = queries.groupBy("session_id").agg(F.count(F.lit(1)).alias("_q")).join(items.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")), "session_id")
    if (pairs.agg(F.sum(F.col("_q") * F.col("_n"))).first()[0] or 0) > MANY_PAIRS:
        return search_many(items, queries)
    asked = queries.select("query_id", "session_id", "max_results", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    sizes = items.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_average"))
    blocks = postings.groupBy("session_id", "term", "block").agg(F.max("tf").alias("_tf"), F.min("length").alias("_length"), F.count(F.lit(1)).alias("_in"))
    found = blocks.groupBy("session_id", "term").agg(F.sum("_in").alias("_df"))
    asked = asked.join(found, ["session_id", "term"]).join(sizes, "session_id")
    asked = asked.withColumn("_idf", F.log1p((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))).select("query_id", "session_id", "max_results", "term", "_idf", "_average")
    bounds = asked.join(blocks, ["session_id", "term"]).groupBy("query_id", "session_id", "block").agg(F.sum(F.col("_idf") * weight(F.col("_tf"), F.col("_length"), F.col("_average"))).alias("_bound"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_bound"), "block"))
    bounds = bounds.withColumn("_place", place)

    def scored(chosen: DataFrame) -> DataFrame:
        wanted = asked.join(chosen.select("query_id", "block"), "query_id")
        hits = wanted.join(postings, ["session_id", "term", "block"])
        score = F.round(F.sum(F.col("_idf") * weight(F.col("tf"), F.col("length"), F.col("_average"))), 9)
        return hits.groupBy("query_id", "session_id", "max_results", "key").agg(score.alias("score"))

    def best(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("max_results"))

    seeds = best(scored(bounds.where(F.col("_place") <= SEED_BLOCKS)))
    floor = seeds.where(F.col("rank") == F.col("max_results")).select("query_id", F.col("score").alias("_floor"))
    more = bounds.where(F.col("_place") > SEED_BLOCKS).join(floor, "query_id", "left").where(F.coalesce("_floor", F.lit(0.0)) <= F.col("_bound") * (1 + SLACK) + SLACK)
    out = best(seeds.drop("rank").unionByName(scored(more)))
    return out.join(items.select("session_id", "key", "item_id"), ["session_id", "key"]).select("query_id", "rank", "key", "item_id", "score")


def _parts(rows: DataFrame, text: str) -> dict[str, int]:
    """Into how many parts of about PART_BYTES the texts of a session go, of sessions that have more than one; at most one session for each PART_BYTES of texts."""
    sizes = rows.groupBy("session_id").agg(F.sum(F.octet_length(text)).alias("_bytes")).where(F.col("_bytes") > PART_BYTES)
    return {r.session_id: -(-r["_bytes"] // PART_BYTES) for r in sizes.collect()}


def _best_of(key: tuple, items: pa.Table, queries: pa.Table) -> pa.Table:
    """The best items of a part for each query of a part. Of equal scores the smallest keys are enough; what rounding may make equal to the last place is given out, too."""
    items = items.sort_by("key")
    length, said = items["length"].to_numpy(), pc.split_pattern(items["words"], " ").combine_chunks()
    wanted = pc.split_pattern(queries["words"], " ").combine_chunks()
    ends, terms = wanted.offsets.to_numpy(), wanted.flatten().dictionary_encode()
    number = terms.indices.to_numpy()
    found = pc.index_in(said.flatten(), value_set=terms.dictionary)
    at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    item = np.repeat(np.arange(len(items)), np.diff(said.offsets.to_numpy()))[at]
    # Inverted lists: pairs of term and item in order, with how often they come.
    pairs, tf = np.unique(found.fill_null(0).to_numpy()[at].astype(np.int64) * len(items) + item, return_counts=True)
    term, item = np.divmod(pairs, len(items))
    lists = np.searchsorted(term, np.arange(len(terms.dictionary) + 1))
    n, average = queries["n"].to_numpy(), queries["average"].to_numpy()
    df = queries["df"].combine_chunks().flatten().to_numpy()
    added = weight(tf, length[item], average[0]) if len(average) else tf
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for q, most in enumerate(queries["max_results"].to_pylist()):
        if most is None or most < 1:
            continue
        own, of = number[ends[q] : ends[q + 1]], df[ends[q] : ends[q + 1]]
        idf = np.log1p((n[q] - of + 0.5) / (of + 0.5))
        score = np.zeros(len(items))
        for t, a, b in zip(idf.tolist(), lists[own].tolist(), lists[own + 1].tolist(), strict=True):
            score[item[a:b]] += t * added[a:b]  # an item comes once in a list
        hit = np.flatnonzero(score)
        if len(hit) > most:
            hit = hit[score[hit] >= np.partition(score[hit], -most)[-most] - 2 * SLACK]
            hit = hit[np.argsort(-score[hit], kind="stable")]
            first = np.flatnonzero(np.diff(score[hit], prepend=np.inf))
            hit = hit[np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit)))) < most]
        out.append((q, hit, score[hit]))
    query = np.repeat([q for q, _, _ in out], [len(h) for _, h, _ in out]).astype(np.int64)
    rows = np.concatenate([np.zeros(0, np.int64), *[h for _, h, _ in out]])
    del said, found, at, pairs, tf, term, item, added
    pa.default_memory_pool().release_unused()
    made = queries.select(["query_id", "session_id", "max_results"]).take(pa.array(query))
    mine = items.select(["key", "item_id"]).take(pa.array(rows))
    return pa.table([*made.columns, *mine.columns, pa.array(np.concatenate([np.zeros(0), *[s for _, _, s in out]]))], [*made.column_names, *mine.column_names, "score"])


def search_many(items: DataFrame, queries: DataFrame) -> DataFrame:
    """What ``search`` returns, for many queries at once; ``items`` have session_id, key, item_id and content.

    Texts of a session are dealt by key, its queries by id, into parts of about PART_BYTES. Every part of queries meets every part of items in one group, which
    builds inverted lists of the words asked for and adds up scores in an array; only a group's best items leave it. So texts and queries are shuffled, never what
    a query and an item share.
    """
    spark, columns = items.sparkSession, ["query_id", "rank", "key", "item_id", "score"]
    texts, sessions = items.select("session_id", "key", "item_id", "content"), queries.select("session_id").distinct()
    if sessions.limit(FEW_SESSIONS + 1).count() <= FEW_SESSIONS:
        texts = texts.join(F.broadcast(sessions), "session_id", "left_semi")
    of_items, of_queries = _parts(texts, "content"), _parts(queries, "query")
    many = [(s, of_items.get(s, 1), of_queries.get(s, 1)) for s in {*of_items, *of_queries}]
    many = F.broadcast(spark.createDataFrame(many, "session_id string, _parts int, _asks int"))

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        rows = rows.join(many, "session_id", "left").fillna(1, ["_parts", "_asks"])
        mine = F.pmod(F.xxhash64(by), F.col(f"_{own}s")).cast("int")
        return rows.withColumn(f"_{own}", mine).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_{other}s") - 1))).drop("_parts", "_asks")

    said = texts.withColumn("_terms", terms(F.col("content")))
    sizes = said.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_terms")).alias("average"))
    counts = said.select("session_id", F.explode(F.array_distinct("_terms")).alias("term")).groupBy("session_id", "term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query_id", "session_id", "max_results", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    asked = asked.join(counts, ["session_id", "term"]).groupBy("query_id", "session_id", "max_results").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("_of"))
    asked = asked.join(sizes, "session_id").select("query_id", "session_id", "max_results", F.array_join("_of.term", " ").alias("words"), F.col("_of.df").alias("df"), "n", "average")
    said = said.where("key IS NOT NULL").select("session_id", "key", "item_id", F.size("_terms").alias("length"), F.array_join("_terms", " ").alias("words")).where("length > 0")
    asked, said = dealt(asked, "query_id", "ask", "part"), dealt(said, "key", "part", "ask").withColumnsRenamed({"session_id": "_session", "_part": "_in_part", "_ask": "_in_ask"})
    kind = {f.name: f.dataType.simpleString() for f in queries.schema}
    out = f"query_id {kind['query_id']}, session_id string, max_results {kind['max_results']}, key string, item_id string, score double"
    found = asked.groupBy("session_id", "_part", "_ask").cogroup(said.groupBy("_session", "_in_part", "_in_ask"))
    found = found.applyInArrow(lambda key, q, i: _best_of(key, i, q), out).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= F.col("max_results")).select(*columns)


class TableMemory:
    """Items in a store's tables ``memory_items`` and ``memory_postings``, which count at once; URIs ``memory://tables/<key>`` stay what they are."""

    NAME = "tables"

    def __init__(self, store: Store):
        self.tables = store

    def store(self, rows: DataFrame) -> DataFrame:
        """Adds items; one that is there already stays as it is. The URIs of all of them."""
        keyed = rows.dropDuplicates(["session_id", "item_id"]).withColumn("key", key_of(F.col("session_id"), F.col("item_id")))
        with self.tables.commit(rows=rows, name="memory") as change:
            new = keyed.join(change.old("memory_items").select("session_id", "key"), ["session_id", "key"], "left_anti")
            items, postings = indexed(new)
            change.append("memory_items", items)
            change.append("memory_postings", postings)
        return keyed.select("item_id", memory_uri(F.lit(self.NAME), F.col("key")).alias("uri"))

    def retrieve_all(self, queries: DataFrame) -> DataFrame:
        """Results of any queries (see ``search``), in as many sessions as they name."""
        buckets = self.tables.buckets(queries)
        return search(self.tables.read("memory_items", buckets=buckets), self.tables.read("memory_postings", buckets=buckets), queries)

    def retrieve(self, query: RetrievalQuery) -> DataFrame:
        row = self.tables.spark.createDataFrame([("q", query.session_id, query.query, query.max_results)], "query_id string, session_id string, query string, max_results int")
        found = self.retrieve_all(row).join(self.tables.read("memory_items", query.session_id).select("key", "content"), "key")
        return found.orderBy("rank").select("key", "content", "score")

    def get(self, ref: MemoryRef, session_id: str | None = None) -> DataFrame:
        """The stored row; ``session_id`` spares looking in all buckets."""
        rows = self.tables.read("memory_items", session_id)
        return rows.where((F.col("key") == ref.key) & F.lit(ref.backend == self.NAME)).select("key", "content")
