"""Shared plumbing of the text operators: scratch tables in the folder all executors see."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN[app]


ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches that stay small with long texts, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


class Scratch:
    """Tables written once and read back: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.base = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table made here; nothing may read it afterwards."""
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(f)

    def settle(self) -> None:
        """Let go of finished plans, so that Spark's cleaner deletes their shuffle files before more are written."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def sqrt_buckets(n: int) -> int:
    """How many sub-buckets keep both the rows of one and their number near the square root of n."""
    return max(1, int(max(n, 1) ** 0.5))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, col: str):
    return F.coalesce(df[col].cast("string"), F.lit(""))
