"""The folder that the driver and all executors share, for what is written once and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster, whose machines share none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="sessionloom-"))
        found = _own[0]
    return found.rstrip("/")


class Scratch:
    """Tables written once to the shared folder, so that random ids and times stay what they are; they go when it is closed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


_kept: dict[str, Scratch] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, for plans that read it several times or need its rows' partitions to stay; it goes when the program ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _kept:
        _kept[app] = Scratch(spark)
        atexit.register(_close, app)
    return _kept[app].keep(df)


def _close(app: str) -> None:
    try:
        _kept.pop(app).close()
    except Exception:  # the JVM may have gone first
        return
