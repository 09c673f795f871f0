"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, keyed_groups, mapped
from .components import connected_components
from .near_dedup import BLOCK_DOCS, _forest, _in_blocks

#: Vectors of the largest label that a bucket holds on average if they are spread at random, and the chance at most that a pair at the threshold collides in no table.
BUCKET, MISS = 64, 1e-6


def tables_for(largest: int, cosine: float) -> tuple[int, int]:
    """Hyperplanes a table, and tables: so many buckets that the largest label's vectors lie about BUCKET in each, so that work grows
    in proportion to vectors, and so many tables that a pair at ``cosine`` is missed with a chance of MISS.

    A pair at cosine c has the same side of a hyperplane with probability 1 - arccos(c) / pi.
    """
    bits = min(24, max(4, math.floor(math.log2(max(1, largest) / BUCKET))))
    together = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return bits, 1 if together >= 1 else max(1, math.ceil(math.log(MISS) / math.log1p(-max(together, 1e-3))))


def usable(vector: str) -> Column:
    """Whether a vector is not null and holds only finite components."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & ~bad, F.lit(False))


def _sign(bits: int, tables: int, seed: int, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            lists = batch.column("x")
            dims = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy().astype(dtype, copy=False)
            begin = np.cumsum(dims) - dims
            signs = np.zeros((batch.num_rows, tables), np.int32)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                rows = np.flatnonzero(dims == d)
                x = flat[begin[rows][:, None] + np.arange(d)].astype(np.float64)
                x /= np.abs(x).max(1, initial=1e-300, keepdims=True)
                up = (x @ planes[d] > 0).reshape(len(rows), tables, bits)
                signs[rows] = up @ weight
            raw = [flat[a : a + d].tobytes() for a, d in zip(begin.tolist(), dims.tolist(), strict=True)]
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * tables
            columns = [batch.column(c) for c in ("id", "copies", "label")]
            columns += [pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signs.ravel()))]
            yield pa.record_batch(columns, ["id", "copies", "label", "dim", "raw", "signs"])

    return run


def _similar(cosine: float, dtype: np.dtype):
    """Within each bucket: how many vectors each links with that share no earlier table, and links that join what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in keyed_groups(batches, ["bucket", "lo", "hi"]):
            m = g.num_rows
            if m < 2:
                continue
            ids, part, copies = (g.column(c).to_numpy() for c in ("id", "part", "copies"))
            x = np.frombuffer(b"".join(g.column("raw").to_pylist()), dtype).reshape(m, -1).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            near = x @ x.T >= cosine
            if g.column("lo")[0].as_py() != g.column("hi")[0].as_py():
                near &= part[:, None] != part[None, :]
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            new = near.copy()
            signs = g.column("signs").flatten().to_numpy().reshape(m, -1)
            for t in range(g.column("t")[0].as_py()):
                new &= signs[:, t][:, None] != signs[:, t][None, :]
            n = new @ copies
            some = np.flatnonzero(n)
            pairs = list(_forest(m, lambda i, js: near[i, js]))
            a = np.concatenate([ids[some], ids[[i for i, _ in pairs]]])
            b = pa.array([None] * len(some) + [int(ids[j]) for _, j in pairs], pa.int64())
            yield pa.record_batch([pa.array(a), pa.array(np.concatenate([n[some], np.zeros(len(pairs), np.int64)])), b], ["a", "n", "b"])

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, bits: int | None = None, tables: int | None = None, seed: int = 7) -> DataFrame:
    """One row a row of ``vectors``: vec_id, n_links, component_id and kept.

    Vectors of one label and length link at a cosine of at least ``cosine`` in double precision. Null, empty or zero
    vectors, ones with a null or non-finite component and those with a null label or id link with nothing: n_links 0,
    component the own id. component_id is the smallest id reachable, kept whether it is the own one (false for a null id). Equal rows
    count as vectors of their own. Equal vectors of a label are one class, hashed once.

    A pair is found if it collides in a table: at the threshold with probability 1 - MISS by default (see tables_for), closer ones more often. It is counted
    in the first table where it collides, so pairs are never listed. Large buckets are compared in pairs of blocks. Only the largest
    label's number of distinct vectors reaches the driver.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = np.dtype(np.float32 if element == "float" else np.float64)
    x = F.col(vector_col) if element in ("float", "double") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("x"))
    zero = ~F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("ok", usable("x") & ~F.coalesce(zero, F.lit(True)) & F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = rows.withColumn("f1", F.xxhash64("label", "x")).withColumn("f2", F.xxhash64(F.lit("second"), "x", "label"))
    classes = rows.where("ok").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("label", "x"), "id").alias("_v"))
    classes = classes.select("id", "f1", "f2", "copies", "_v.label", "_v.x")
    classes = cut(classes)
    if bits is None or tables is None:
        largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        bits, tables = tables_for(largest, cosine)
    signed = cut(classes.select("id", "copies", "label", "x").transform(mapped, _sign(bits, tables, seed, dtype), "id long, copies long, label string, dim int, raw binary, signs array<int>"))

    light = signed.select("id", "label", "dim", F.posexplode("signs").alias("t", "sign"))
    large = light.groupBy("label", "dim", "t", "sign").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_DOCS)
    large = light.join(large, ["label", "dim", "t", "sign"]).groupBy(F.col("id").alias("_id"))
    large = large.agg(F.map_from_entries(F.collect_list(F.struct("t", F.ceil(F.col("_n") / BLOCK_DOCS).alias("parts")))).alias("_parts"))
    placed = signed.join(large, F.col("id") == F.col("_id"), "left").select("id", "copies", "label", "dim", "raw", "signs", "_parts", F.posexplode("signs").alias("t", "sign"))
    bucket = F.concat_ws(":", "t", "sign", "dim", "label")
    placed = placed.select("id", "copies", "raw", "signs", "t", bucket.alias("bucket"), F.coalesce(F.element_at("_parts", F.col("t")), F.lit(1)).alias("parts"))
    found = cut(_in_blocks(placed, "bucket").transform(mapped, _similar(cosine, dtype), "a long, n long, b long"))

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("b IS NOT NULL"), "a", "b")
    ends = classes.select("id", "copies", F.col("f1").alias("_f1"), F.col("f2").alias("_f2"))
    ends = ends.join(counts, F.col("id") == F.col("_a"), "left").join(joined, F.col("id") == F.col("node"), "left")
    ends = ends.select("_f1", "_f2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("_links"), F.coalesce("component", "id").alias("_component"))
    out = rows.select("id", "ok", "f1", "f2").join(ends, F.col("ok") & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")), "left")
    component = F.coalesce("_component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
