"""URL filters by dated lists: entries become validity intervals, and an as-of join finds those active at fetch time.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import let
from ._shared import cut

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a last dot, an address in brackets whole; null for a null or other text than an absolute URL."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def patterns_of(host: Column, path: Column, labels: list[int], depths: list[int]) -> Column:
    """Patterns that cover a URL, of those sizes that occur: domains of so many labels, and the host with so many leading parts of the path.

    Each size costs one pass over the URL, so a long one takes time in proportion to its length, whatever its depth.
    """
    sizes = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    domains = let(F.split(host, r"\."), lambda all_: F.transform(F.filter(sizes(labels), lambda n: n <= F.size(all_)), lambda n: F.array_join(F.slice(all_, F.size(all_) - n + 1, n), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = let(parts, lambda all_: F.transform(F.filter(sizes(depths), lambda n: n <= F.size(all_)), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(all_, F.lit(1), n), "/"))))
    return F.when(host.isNotNull(), F.concat(domains, paths))


def normal(pattern: Column) -> Column:
    """A pattern in the form of patterns_of: host in lower case without a last dot, no empty parts of the path.

    Null, so void, without a host, and for a slash that no part follows (``host/``), which names neither a domain nor a path.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, "^[^/]*", 0)), r"\.$", "")
    path = F.array_join(F.filter(F.split(F.regexp_extract(pattern, "^[^/]*(.*)", 1), "/"), lambda p: p != ""), "/")
    bare = ~F.contains(pattern, F.lit("/"))
    return F.when(host != "", F.when(bare, host).when(path != "", F.concat(host, F.lit("/"), path)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from (pattern, action, at): an ``add`` holds until the pattern's next entry.

    valid_to is exclusive, null if nothing follows. Other actions than ``add`` end it. Of entries at one time for one
    pattern an ``add`` comes last; repeated entries count once. Entries without pattern or time are void. Patterns are
    brought into normal form first, so spellings of one are one.
    """
    known = entries.select(normal(F.col("pattern")).alias("pattern"), "action", "at").where("pattern IS NOT NULL AND at IS NOT NULL")
    daily = known.groupBy("pattern", "at").agg(F.max(F.coalesce(F.col("action") == "add", F.lit(False))).alias("_add"))
    following = F.lead("at").over(W.partitionBy("pattern").orderBy("at"))
    return daily.withColumn("valid_to", following).where("_add").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def pattern_sizes(valid: DataFrame) -> tuple[list[int], list[int]]:
    """Distinct numbers of labels of the domains, and of path parts of the other patterns; a list of n labels and parts in all has at most about 2 * sqrt(n)."""
    path = F.contains("pattern", F.lit("/"))
    size = F.when(path, F.size(F.split("pattern", "/")) - 1).otherwise(F.size(F.split("pattern", r"\.")))
    rows = valid.select(path.alias("path"), size.alias("n")).distinct().collect()
    return sorted(r.n for r in rows if not r.path), sorted(r.n for r in rows if r.path)


def evaluate(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row a capture: its id, url and time, host, blocked, n_entries, pattern and since.

    Entries are (pattern, action, at): a domain covers its subdomains, ``host/path`` what lies below it. A capture is blocked if
    an entry that covers it is active at its time; pattern is the longest such (ties: the smaller), since its begin. A null time or
    a null or malformed URL matches nothing; a null id is an id. Equal rows give equal results. An empty table or list gives no match. Other
    columns are not read. A URL of any length is matched whole, in time proportional to it.

    The list's intervals are written once, as they are read twice: for the sizes of patterns that occur, and for the join.
    Captures are spread by pattern: matches only, once a capture and pattern, are gathered again. A hot host is left to the
    splitting of skewed joins; nothing is broadcast unless the engine finds it small.
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_time"))
    keyed = rows.withColumn("_host", host_of(F.col("_url"))).where("_host IS NOT NULL AND _time IS NOT NULL").distinct()
    valid = cut(intervals(entries))
    covering = patterns_of(F.col("_host"), path_of(F.col("_url")), *pattern_sizes(valid))
    keyed = keyed.select("_id", "_url", "_time", F.explode(covering).alias("_pattern"))
    active = (F.col("_pattern") == F.col("pattern")) & (F.col("_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to")))
    hits = keyed.join(valid, active).groupBy(F.col("_id").alias("_id2"), F.col("_url").alias("_url2"), F.col("_time").alias("_time2"))
    hits = hits.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.length("pattern")).alias("size"), "pattern", F.col("valid_from").alias("since"))).alias("best"))
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_url") == F.col("_url2")) & (F.col("_time") == F.col("_time2"))
    return rows.join(hits, same, "left").select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_time").alias(time_col),
        host_of(F.col("_url")).alias("host"),
        F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.since").alias("since"),
    )
