"""Spans of kinds in texts, and finding the few rows of a batch that can hold any."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (start, end, kind's place in the list of kinds); code points, end exclusive.
Span = tuple[int, int, int]
FOUND_TYPE = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def lookup(chars: str) -> np.ndarray:
    """Of each byte, whether it is one of these ASCII characters."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true within rows that lie end to end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[1:-1]
    inner = inner[inner < len(mask)]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    begin[inner] = mask[inner]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    last = inner[inner > 0] - 1
    end[last] = mask[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def rows_of(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold these places, each once."""
    return np.unique(np.searchsorted(offsets, places, "right") - 1)


def digests(found: DataFrame, kinds: tuple[str, ...], base: int, id_col: str = "doc_id") -> DataFrame:
    """id, n_<kind> of the first ``base`` kinds, base_sha256 over these and spans over all, from a column ``found``."""
    order = F.create_map(*[F.lit(x) for k, name in enumerate(kinds) for x in (name, k)])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    ranked = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    of = lambda name: F.filter("found", lambda s: s["kind"] == name)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds[:base]]
    rows = found.select(id_col, *counts, ranked.alias("_r"))
    base_line = F.array_join(F.transform(F.filter("_r", lambda s: s["k"] < base), line), ",")
    return rows.select(id_col, *[f"n_{k}" for k in kinds[:base]], F.sha2(base_line, 256).alias("base_sha256"), F.array_join(F.transform("_r", line), ",").alias("spans"))
