"""Intermediate tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be sent to every executor (after they were counted).
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a join may bring to one task.
HOT_ROWS = 100_000
#: Bytes of a batch on its way between Spark and a Python worker.
BATCH_BYTES = 4 << 20


class Workspace:
    """Parquet tables under spark.checkpoint.dir: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, release: bool = False, **options: object) -> DataFrame:
        """``release``: the shuffles behind it were large; have the driver let go of them, so that Spark's cleaner drops their files now."""
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        if release:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, *names: str) -> None:
        """For tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """At a task's end: the worker, which lives on for other tasks, gives back what Arrow keeps."""
    pa.default_memory_pool().release_unused()


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends Python workers batches of at most ``BATCH_BYTES``, unless it has a bound of its own.

    Spark's default bound of 64 MB is held several times over, by a task and by its worker.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, BATCH_BYTES)
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own, longer than ``names`` where ``df`` has those (in any case) already."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
        have.add(name.lower())
    return out


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a narrow table that is cheap to count, marked for broadcast if it has few rows."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(rows: DataFrame, side: DataFrame, key: str, weight: str, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` left-joined to ``side``, a written table with one row for each ``key`` and the number of its ``rows`` as ``weight``.

    Keys of more than ``hot`` rows, of which there can be few only, are broadcast, so that none fills a task.
    """
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side.drop(weight)), key, "left")
    while (heavy := side.filter(F.col(weight) > hot)).limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        hot *= 10
    keys = F.broadcast(heavy.select(key))
    light = rows.join(keys, key, "left_anti").join(side.filter(F.col(weight) <= hot).drop(weight), key, "left")
    return light.unionByName(rows.join(F.broadcast(heavy.drop(weight)), key))


def components(edges: DataFrame, work: Workspace, name: str, hot: int = HOT_ROWS) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes of ``edges`` (a, b) with a <> b.

    Alternating large-star and small-star steps; each round's edges are written, and the rounds grow with
    the logarithm of the number of nodes.
    """
    now = work.write(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{name}0")
    digest = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head())
    before, k = None, 0
    while (state := digest(now)) != before:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = work.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("rows")).filter("rows > 0"), f"{name}least{k}")
        large = join_hot(both.filter("v > u"), least, "u", "rows", hot).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = work.write(large, f"{name}large{k}")
        mins = work.write(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("rows")), f"{name}mins{k}")
        joined = join_hot(large.withColumnRenamed("hi", "u"), mins, "u", "rows", hot)
        small = joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(mins.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        k += 1
        now, before = work.write(small.distinct(), f"{name}{k}"), state
        work.delete(*(f"{name}{x}{k - 1}" for x in ("", "least", "large", "mins")))
    labels = now.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
