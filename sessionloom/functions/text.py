"""Hashes, token counts and lines as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import words

def content_hash(content: Column) -> Column:
    """Lower-case SHA-256 of the UTF-8 text."""
    return F.sha2(content, 256)


@dataclass(frozen=True)
class Counter:
    """Counts tokens of a text column, null as 0; ``exact`` if by a model's own tokenizer. Items, plans and working sets take any such function."""

    count: Callable[[Column], Column]
    exact: bool = False

    def __call__(self, content: Column) -> Column:
        # Named twice, a column that lambdas made isn't put into the count's argument, where Spark can't evaluate them.
        return F.coalesce(F.when(content.isNotNull(), self.count(content)), F.lit(0)).cast("long")


#: Bytes of a batch of texts that a Python worker gets at once, for each column that is counted about as much again.
BATCH_BYTES = 4 << 20


def _counted(content: Column) -> Column:
    """Tokens of a column, in batches of at most about BATCH_BYTES: the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` is lowered to that if it is higher,
    as every core of an executor has workers that hold a batch each, of 10,000 rows else."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", SparkSession.active()
    now = spark.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return _words(content)


# Counts travel with the plan, so that workers need not find this package.
cloudpickle.register_pickle_by_value(words)

#: Segments between Unicode word boundaries (annex 29) that are not white space, an approximation of any model's. An Arrow function, as the rules look at
#: classes of neighbours, which regular expressions do many times slower. Guard what is counted, not the count: all rows' texts go to it.
_words = F.arrow_udf(words.count, LongType())
token_count = Counter(_counted)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it; within lambdas, too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(content: Column) -> Column:
    """Lines ended by LF or CRLF; one final line end makes no line, an empty or null text has none."""
    body = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def f32(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def ratio32(a: Column, b: Column) -> Column:
    """a / b in single precision; infinite where b is 0."""
    return F.when(b == 0, F.lit(float("inf")).cast("float")).otherwise((f32(a) / F.nullif(f32(b), f32(0.0))).cast("float"))


def artifact_uri(slug: Column, item_id: Column) -> Column:
    return F.concat(F.lit("artifact://"), slug, F.lit("/"), item_id)


# Fixed value: how generated ids begin.
ID_PREFIX = "cgc-"


def new_id() -> Column:
    """The prefix and a random UUID; write it before it is used twice."""
    return F.concat(F.lit(ID_PREFIX), F.uuid())
