"""Exact top-k by inner product: vectors by descending length, partial sums after an SVD rotation, Cauchy-Schwarz bounds.

Queries and vectors meet in blocks. A first round over the block of longest vectors gives each query a floor. Blocks whose longest
vector can't lift any of a query block's scores to its floor are never sent to it; what is sent drops in turn by the bound
on length, then by the partial sum plus the bound on the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import cut, mapped
from .embedding_dedup import usable

#: Vectors and queries a block, rotated components of a partial sum, and vectors (expected) that the rotation is fitted to.
BLOCK, QUERY_BLOCK, HEAD, TRAIN_ROWS = 2048, 2048, 16, 2000
#: Ranges of lengths, at most, whose longest lengths the driver learns and puts into the plan.
RANGES = 512
#: A bound is taken so much higher than it is computed.
SLACK = 1 + 1e-9


def _pack(size: int, dim: int, kind: np.dtype):
    """Rows of a partition as (part, n, ids, x, floor, reach): the partition, which block of it, up to ``size`` rows' columns, and the
    least length that a vector needs to lift one of them, as a query, to its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = rows = 0

        def out() -> pa.RecordBatch:
            ids, x, floor = (np.concatenate(c) for c in zip(*held, strict=True))
            length = np.linalg.norm(x.astype(np.float64), axis=1)
            reach = float(np.where((floor > 0) & (length > 0), floor / np.maximum(length * SLACK, 1e-300), 0.0).min())
            raw = [pa.array([c.tobytes()], pa.binary()) for c in (ids, x, floor)]
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int32()), *raw, pa.array([reach])], ["part", "n", "ids", "x", "floor", "reach"])

        for batch in batches:
            lists = batch.column("x")
            dims = lists.value_lengths().to_numpy()
            x = np.zeros((batch.num_rows, dim), kind)
            x[np.arange(dim) < dims[:, None]] = lists.flatten().to_numpy()
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, at + size - rows)
                held.append((batch.column("id").to_numpy()[at:to], x[at:to], batch.column("floor").to_numpy()[at:to]))
                rows, at = rows + to - at, to
                if rows == size:
                    yield out()
                    n, rows, held = n + 1, 0, []
        if held:
            yield out()

    return run


def _score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; beyond their range the nearest of these."""
    largest = lambda v: max(int(v.max(initial=0)), -int(v.min(initial=0)))
    most = largest(q) * largest(x) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    exact = q.astype(object) @ x.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _topk(k: int, dim: int, kind: np.dtype, rotation: np.ndarray, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, xid = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, x = np.frombuffer(row["q_x"], kind).reshape(-1, dim), np.frombuffer(row["x"], kind).reshape(-1, dim)
                floor = np.frombuffer(row["q_floor"], np.float64)
                qf, xf = q.astype(np.float64), x.astype(np.float64)
                qn, xn = np.linalg.norm(qf, axis=1), np.linalg.norm(xf, axis=1)
                order = np.argsort(-xn, kind="stable")
                xid, x, xf, xn = xid[order], x[order], xf[order], xn[order]
                # By length: nothing from here on can reach the floor of a query.
                reach = np.searchsorted(-xn, -floor / np.maximum(qn * SLACK, 1e-300), "right")
                reach[(floor <= 0) | (qn == 0)] = len(xn)
                live = np.flatnonzero(reach)
                if not len(live):
                    continue
                m = int(reach.max())
                qr, xr = qf[live] @ rotation, xf[:m] @ rotation
                rest = lambda r: np.sqrt((r[:, head:] ** 2).sum(1))
                bound = qr[:, :head] @ xr[:, :head].T + np.outer(rest(qr), rest(xr)) + 1e-6 + 1e-9 * np.outer(qn[live], xn[:m])
                may = bound >= floor[live][:, None]
                columns = np.flatnonzero(may.any(0))
                score = _score(q[live], x[columns])
                ids = xid[columns]
                out = [], [], []
                for i, row_live in enumerate(live.tolist()):
                    ok = np.flatnonzero(may[i, columns] & (ids != qid[row_live]))
                    s = score[i, ok]
                    if len(ok) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        ok, s = ok[s >= least], s[s >= least]
                    best = np.lexsort((ids[ok], -s))[:k]
                    out[0].append(np.full(len(best), qid[row_live]))
                    out[1].append(ids[ok][best])
                    out[2].append(s[best])
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["query_id", "vec_id", "score"])

    return run


_BLOCKS = "part int, n int, ids binary, x binary, floor binary, reach double"


def lengths(blocks: DataFrame, dim: int, kind: np.dtype) -> DataFrame:
    """(part, longest): the greatest length in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = (np.frombuffer(x.as_py(), kind).reshape(-1, dim).astype(np.float64) for x in batch.column("x"))
            yield pa.record_batch([batch.column("part"), pa.array([float(np.linalg.norm(x, axis=1).max()) for x in each], pa.float64())], ["part", "longest"])

    return blocks.select("part", "x").transform(mapped, run, "part int, longest double")


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, head: int = HEAD) -> DataFrame:
    """For each query, a row whose id is divisible by ``every``: query_id, rank (from 1), vec_id and score of its ``k`` best.

    Components x count as floor(scale * x); scores are integer inner products with every row that has another id, ties go
    to the smaller id; all rows if they are fewer than ``k``. Vectors that are null or hold null or non-finite components
    and rows with a null id take no part. Shorter vectors count as filled up with zeros. Equal rows each count. Scores outside
    64 bits become the nearest number inside. An empty table gives an empty result.

    Blocks are shuffled, never broadcast, in the smallest integers that hold all components; a query block meets only the ranges of blocks
    that its bounds leave, each pair of blocks is worked on by itself, and a query gets at most ``k`` rows from it. The rotation is fitted to about
    TRAIN_ROWS rows of lowest hash and only decides how soon bounds prune. To the driver come these and at most RANGES lengths.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))
    length = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = cut(rows.withColumn("length", length))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim"), F.count(F.when(F.col("id") % every == 0, 1)).alias("queries"), F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low")).first()
    schema = "query_id long, vec_id long, score long"
    if not stats.queries:
        return rows.where("false").select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    dim = max(1, stats.dim)
    kind = np.min_scalar_type(-max(1, (stats.high or 0), -(stats.low or 0) - 1) - 1)
    mark = F.pmod(F.xxhash64("id", F.lit("rotation")), F.lit(1 << 30)) < int(min(1.0, TRAIN_ROWS / stats.n) * (1 << 30))
    sample = [r[0] for r in rows.where(mark).select("x").collect()]
    matrix = np.zeros((len(sample) + 1, dim))
    for i, v in enumerate(sample):
        matrix[i, : len(v)] = v
    rotation = np.linalg.svd(matrix / max(1.0, np.abs(matrix).max()), full_matrices=True)[2].T
    # By descending length, then id: about one range partition a block; equal vectors spread over blocks by id.
    low = F.lit(float("-inf"))
    blocks = rows.repartitionByRange(max(1, -(-stats.n // BLOCK)), F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    blocks = cut(blocks.select("id", "x", low.alias("floor")).transform(mapped, _pack(BLOCK, dim, kind), _BLOCKS).drop("floor", "reach"))
    ends = blocks.agg(F.min("part").alias("first"), F.max("part").alias("last"), F.max("n").alias("n")).first()
    queries = rows.where(F.col("id") % every == 0)
    kernel = _topk(k, dim, kind, rotation, min(head, dim))

    def against(asked: DataFrame, parts: Column, blocks_each: Column) -> DataFrame:
        packed = asked.repartition(max(1, -(-stats.queries // QUERY_BLOCK)), "id").transform(mapped, _pack(QUERY_BLOCK, dim, kind), _BLOCKS)
        packed = packed.select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("floor").alias("q_floor"), F.explode(parts).alias("part"))
        packed = packed.withColumn("n", F.explode(blocks_each))
        return packed.join(blocks.hint("merge"), ["part", "n"]).select("q_ids", "q_x", "q_floor", "ids", "x").transform(mapped, kernel, schema)

    first = against(queries.select("id", "x", low.alias("floor")), F.array(F.lit(ends.first)), F.array(F.lit(0)))
    floors = first.groupBy("query_id").agg(F.min("score").cast("double").alias("_low"), F.count(F.lit(1)).alias("_found")).where(F.col("_found") >= k)
    asked = queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "x", F.coalesce("_low", low).alias("floor"))
    # The longest length from each range of parts on, for parts in order; a query block needs the ranges whose longest reaches its own least.
    width = -(-(ends.last + 1) // RANGES)
    longest = dict(lengths(blocks, dim, kind).groupBy(F.floor(F.col("part") / width).alias("range")).agg(F.max("longest")).collect())
    tops, most = [], 0.0
    for r in range(ends.last // width, -1, -1):
        most = max(most, longest.get(r, 0.0))
        tops.append(F.lit(most))
    needed = F.size(F.filter(F.array(*tops), lambda top: top * SLACK >= F.col("reach"))) * width
    parts = F.when(needed > 0, F.sequence(F.lit(0), F.least(needed, F.lit(ends.last + 1)) - 1)).otherwise(F.array().cast("array<int>"))
    found = against(cut(asked), parts, F.sequence(F.lit(0), F.lit(ends.n)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
