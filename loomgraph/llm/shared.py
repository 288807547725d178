"""Reading tables, and cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import lean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  A temporary folder stands in only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="loomgraph-"))
    return folder


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are staged inside are removed at the end, so what leaves must have been written by then."""
    outer, _scratch.paths = getattr(_scratch, "paths", None), []
    try:
        yield
    finally:
        paths, _scratch.paths = _scratch.paths, outer
        for x in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """df, written as a table in the shared folder and read back: no later failure recomputes what is above it.

    It is removed with the ``scratch`` around it, unless ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep and getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more are removed now, and not when the driver's heap fills up."""
    for _ in range(2):  # the plans that Python lets go, then what those held
        gc.collect()
        spark._jvm.System.gc()


#: A key is hot if it holds at least one in so many rows; so there are at most this many hot keys.
HOT_KEYS = 1000


def join_spread(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with a table of one row for each key, which has the number of rows of the key as ``count``.

    The table's rows of hot keys (at most HOT_KEYS) are broadcast, so their rows stay where they are; all others are
    shuffled by the key, and none of these keys holds more than 1 / HOT_KEYS of the rows.  Null keys are not joined.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_KEYS >= total
    few = F.broadcast(table.where(hot).drop(count))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(table.where(~hot).drop(count), key))


def free_names(columns, *names: str) -> list[str]:
    """Names that are none of the columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: A link table of at most so many rows (16 bytes each) is solved in one task; a larger one by distributed rounds.
ONE_TASK_LINKS = 1 << 20


def _solve(batches):
    """Components of all links of a task: labels flow over links, then jump, until nothing moves."""
    import numpy as np
    import pyarrow as pa

    u, v = [], []
    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
    if not u:
        return
    nodes, at = np.unique(np.concatenate(u + v), return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[label[i : i + 100_000]])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """Connected components of an edge table of longs: (node, root), root the smallest node of its component.

    A small table is solved in one task.  Else by alternating large-star and small-star steps.  Each is one aggregation with
    map-side combine and one join whose skewed partitions adaptive execution can
    split, so a star of any size never meets in one task.  Lineage is cut after
    each round; the number of rounds grows with the logarithm of the diameter.
    """
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    seen = state(now)
    if seen[0] <= (ONE_TASK_LINKS if one_task is None else one_task):
        return stage(now.coalesce(1).mapInArrow(lean(_solve), "node long, root long"), "components")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stage(small, "links")
        if (new := state(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
