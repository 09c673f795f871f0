"""Near-duplicate documents by bottom-k sketches of word shingles under one hash function.

Inverted lists of the retained values bring together documents that may be similar; within a list the estimate from the
sketch of the union decides what becomes a candidate link. Candidates make clusters, and within these exact similarity of
the full shingle sets makes the links. Documents with equal sets are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import cut, flat_bytes, keyed_groups, mapped, slices, with_rows
from ._spans import runs
from .components import connected_components

#: Values that a sketch retains.
SKETCH = 32
#: Chance at most that a pair at the exact threshold shares too few values.
MISS = 1e-6
#: Documents and shingles of a block of a large list or cluster; blocks are compared in pairs.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A-Z lower-cased, and the n + 1 places where rows begin among them."""
    mask = ~_SPACE[data]
    start, end = runs(mask, offsets)
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), _MULTIPLIER * np.uint64(2) + np.uint64(1), np.uint64))
    return _mix(np.add.reduceat(_BYTES[data[mask]] * power[place], first)), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of k words in turn; of all its words if they are fewer; none without words."""
    words, bounds = word_hashes(data, offsets)
    salt = _mix(np.arange(1, k + 1, dtype=np.uint64))
    each = words * salt[0]
    n = len(words)
    for j in range(1, k):
        each[: max(0, n - j)] += _mix(words[j:] + salt[j])
    each = _mix(each)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(each[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            whole = words[a] * salt[0]
            for j in range(1, b - a):
                whole = whole + _mix(words[a + j : a + j + 1] + salt[j])[0]
            out.append(_mix(np.array([whole ^ salt[b - a - 1]])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketches(k: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for some in slices(batch, "_text"):
                sets = shingle_sets(*flat_bytes(some.column("_text")), k)
                n = np.array([len(s) for s in sets], np.int64)
                f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                f2 = np.array([_mix(s ^ _MULTIPLIER).sum(dtype=np.uint64) for s in sets], np.uint64)
                kept = [s[:size] for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.record_batch([some.column("_id"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), sketch], ["id", "n", "f1", "f2", "sketch"])

    return run


def _forest(m: int, others: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join what ``others`` links; it gets a row and rows not joined with it yet and tells which link."""
    group = np.arange(m)
    for i in range(m):
        apart = np.flatnonzero(group != group[i])
        if len(apart):
            for j in apart[others(i, apart)].tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    yield i, j


def _similar_sketches(least: float, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within each list by the union's sketch: its ``size`` smallest values, and how many of them both retain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        a, b = [], []
        for g in keyed_groups(batches, ["v", "lo", "hi"]):
            m = g.num_rows
            if m < 2:
                continue
            ids, part = g.column("id").to_numpy(), g.column("part").to_numpy()
            across = g.column("lo")[0].as_py() != g.column("hi")[0].as_py()
            lists = g.column("sketch")
            sizes = lists.value_lengths().to_numpy()
            table = np.full((m, size), _LAST)
            table[np.arange(size) < sizes[:, None]] = lists.flatten().to_numpy().view(np.uint64)

            def similar(i: int, js: np.ndarray) -> np.ndarray:
                js_ok = (part[js] != part[i]) if across else (js > i)
                good = np.zeros(len(js), bool)
                if js_ok.any():
                    both = np.sort(np.hstack([table[js[js_ok]], np.broadcast_to(table[i], (int(js_ok.sum()), size))]), axis=1)
                    real = both != _LAST
                    twice = np.zeros(both.shape, bool)
                    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
                    rank = np.cumsum(real & ~twice, axis=1)
                    shared = (twice & (rank <= size)).sum(1)
                    good[js_ok] = shared >= least * np.minimum(size, rank[:, -1])
                return good

            for i, j in _forest(m, similar):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _full_sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for some in slices(batch, "_text"):
                sets = shingle_sets(*flat_bytes(some.column("_text")), k)
                yield pa.record_batch([*(some.column(c) for c in ("id", "cluster", "parts")), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "cluster", "parts", "full"])

    return run


def _similar_sets(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within each block by 100 * intersection >= percent * union of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in keyed_groups(batches, ["cluster", "lo", "hi"]):
            m = g.num_rows
            if m < 2:
                continue
            ids, part = g.column("id").to_numpy(), g.column("part").to_numpy()
            across = g.column("lo")[0].as_py() != g.column("hi")[0].as_py()
            sets = [np.frombuffer(x, np.uint64) for x in g.column("full").to_pylist()]
            n = np.array([len(s) for s in sets])
            end = np.cumsum(n)
            values, at = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(values), np.int32)

            def similar(i: int, js: np.ndarray) -> np.ndarray:
                ok = (part[js] != part[i]) if across else (js > i)
                ok &= 100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])
                rows = js[ok]
                good = np.zeros(len(js), bool)
                if len(rows):
                    mine = at[end[i] - n[i] : end[i]]
                    mark[mine] = 1
                    hit = mark[np.concatenate([at[end[j] - n[j] : end[j]] for j in rows.tolist()])]
                    both = np.add.reduceat(hit, np.cumsum(n[rows]) - n[rows]).astype(np.int64)
                    mark[mine] = 0
                    good[ok] = 100 * both >= percent * (n[rows] + n[i] - both)
                return good

            for i, j in _forest(m, similar):
                a.append(ids[i])
                b.append(ids[j])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Adds part, lo and hi: rows of a key with ``parts`` > 1 go to one block for each pair of parts that has theirs."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    rows = rows.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")).drop("_other", "parts")
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def least_shared(share: float, size: int) -> tuple[int, float]:
    """Values of ``size`` that a pair must share, each shared with chance ``share``, and the binomial chance, at most MISS, of fewer; one at least."""
    below = 0.0
    for m in range(size + 1):
        here = math.comb(size, m) * share**m * (1 - share) ** (size - m)
        if m and below + here > MISS:
            return m, below
        below += here
    return size, below


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id and kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set has the distinct shingles of ``words`` words,
    of all words if they are fewer. Documents link where 100 * intersection >= ``percent`` * union. component_id is
    the smallest id that links reach; kept is whether it is the document's own. A null or empty text, or one of white space, has
    an empty set and links with nothing. A null id has no component and isn't kept. Rows with one id are one document.
    No list, cluster or number of partners is capped: large ones are compared in pairs of blocks.

    A similar pair is missed only if its sketches share fewer values than least_shared asks: of 32 values 16 at 0.85, a chance
    of 5.7e-7 by the exact binomial tail, or 13 at 0.8, a chance of 1.9e-7.
    """
    least = (least_shared(percent / 100, sketch)[0] - 1e-6) / sketch
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = cut(texts.transform(mapped, _sketches(words, sketch), "id long, n long, f1 long, f2 long, sketch array<long>"))
    classes = cut(rows.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.min_by("sketch", "id").alias("sketch")))

    values = classes.select("id", "f1", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = values.groupBy(F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("lists")).where("lists > 1")
    shared = values.join(often, F.col("v") == F.col("_v")).drop("_v")
    # Two sketches that share enough values share one of each one's rarest but (enough - 1).
    own = W.partitionBy("id", "f1")
    shared = shared.withColumn("_all", F.count(F.lit(1)).over(own)).withColumn("_nth", F.row_number().over(own.orderBy("lists", "v")))
    rare = shared.where(F.col("_nth") <= F.col("_all") - F.greatest(F.lit(1), F.ceil(F.lit(least) * F.col("s"))) + 1)
    lists = rare.join(classes.select("id", "f1", "sketch"), ["id", "f1"]).select("v", "id", "sketch", F.ceil(F.col("lists") / BLOCK_DOCS).alias("parts"))
    candidates = _in_blocks(lists, "v").transform(mapped, _similar_sketches(least, sketch), "a long, b long")
    clusters = connected_components(candidates, "a", "b")

    members = cut(clusters.join(classes.groupBy("id").agg(F.sum("n").alias("n")), F.col("node") == F.col("id")).select("id", "n", F.col("component").alias("cluster")))
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    members = members.join(sizes, "cluster").select("id", "cluster", "parts")
    found = texts.join(members.hint("shuffle_hash"), F.col("_id") == F.col("id")).select("id", "cluster", "parts", "_text")
    full = found.transform(mapped, _full_sets(words), "id long, cluster long, parts long, full binary")
    links = _in_blocks(full, "cluster").transform(mapped, _similar_sets(percent), "a long, b long")
    joined = connected_components(links, "a", "b")

    ends = classes.join(joined, F.col("id") == F.col("node"), "left").select(
        F.col("n").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("component", "id").alias("_component")
    )
    same = (F.col("n") == F.col("_n")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2"))
    out = rows.select("id", "n", "f1", "f2").join(ends, same, "left")
    component = F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """``docs`` with exactly one row of each group of near-duplicates: that with the smallest id, a null one last.

    Each row takes part for itself, under a number of its own: rows with a null id, and rows that repeat an id, which stay
    apart if their texts differ. Of rows with one id in a group a hash over the plain columns chooses, then the number.
    """
    rows, key = with_rows(docs)
    found = near_duplicates(rows, id_col=key, **options).select("doc_id", "component_id")
    plain = [c for c, t in docs.dtypes if "<" not in t and t != "variant"]
    ids = rows.select(F.col(key).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(*plain).alias("_hash"))
    ranked = found.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("_row"))
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_hash", "_row"))
    kept = ranked.groupBy("component_id").agg(first.alias("_first")).select(F.col("_first._row").alias(key))
    return rows.join(kept.hint("shuffle_hash"), key, "left_semi").select(*docs.columns)
