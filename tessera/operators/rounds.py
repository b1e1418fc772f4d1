"""Iterations over DataFrames: lineage cut in the shared folder, connected parts, pointers followed to their roots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """Of this application's tables, in the folder named by spark.checkpoint.dir; a temporary one only in local mode without the setting."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    named = spark.conf.get("spark.checkpoint.dir", None)
    if app not in _OWN:
        if not named and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = f"{named.rstrip('/')}/tessera-rounds-{app}" if named else "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN[app]


def settled(df: DataFrame) -> DataFrame:
    """The rows written once and read back. A table rather than a checkpoint: what the planner infers about a checkpoint's
    rows is carried from round to round, and planning time then grows with a power of the rounds."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that `settled` has written in this application; nothing may read them afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, part): the least node that edges reach from each node with an edge.

    Each round every node takes the least part among its neighbours, and then the part of that part, so that the rounds
    grow with the logarithm of a part's width in all but contrived cases. Rows of a round: edges and nodes."""
    both = settled(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).filter("x <> y").distinct())
    parts = settled(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("part")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(parts, F.col("y") == F.col("node")).groupBy("x").agg(F.min("part").alias("near"))
        new = parts.join(near, F.col("node") == F.col("x")).select("node", F.least("part", "near").alias("new"), F.col("part").alias("old"))
        # The old part learns the new one as well, and everyone looks up the part of its part.
        hooks = new.filter("new < old").groupBy(F.col("old").alias("node")).agg(F.min("new").alias("hook"))
        hooked = new.join(hooks, "node", "left").select("node", F.least("new", "hook").alias("part"), "old")
        jump = hooked.select(F.col("node").alias("part"), F.col("part").alias("far"))
        step = settled(hooked.join(jump, "part", "left").select("node", F.coalesce("far", "part").alias("part"), "old"))
        moved = step.filter("part <> old").limit(1).count()
        parts = step.select("node", "part")
        if not moved:
            return parts


def roots(pointers: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, root) of a forest given by pointers, by doubling their reach each round. Roots have no row."""
    at = settled(pointers.select(F.col(child).alias("child"), F.col(parent).alias("root")))
    while True:
        up = at.select(F.col("child").alias("root"), F.col("root").alias("far"))
        step = settled(at.join(up, "root", "left").select("child", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if not step.filter("moved").limit(1).count():
            return step.select("child", "root")
        at = step.select("child", "root")


def added(parts: DataFrame, key: str, sums: str) -> DataFrame:
    """(key, sums) with the arrays of a key added place by place; partial sums of batches are combined before they are shuffled."""
    cells = parts.select(key, F.posexplode(sums).alias("place", "v")).groupBy(key, "place").agg(F.sum("v").alias("v"))
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda c: c["v"]).alias(sums))
