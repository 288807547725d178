"""Semi-naive closures, and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An edge table of at most so many rows is closed on the driver (breadth first); larger ones by distributed rounds.
DRIVER_EDGES = 5000
#: .. unless the closure has more pairs than this (a long chain): then by rounds too.
DRIVER_PAIRS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  A temporary folder stands in only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="loomgraph-"))
    return folder


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are staged inside are removed at the end, so nothing that leaves may read them."""
    outer, _scratch.paths = getattr(_scratch, "paths", None), []
    try:
        yield
    finally:
        paths, _scratch.paths = _scratch.paths, outer
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]):
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as a table in the shared folder and read back; it lives as long as the ``scratch`` around it, if any."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _on_driver(edges, seeds, backwards, limit):
    step: dict = {}
    for a, b, g in edges:
        a, b = (b, a) if backwards else (a, b)
        step.setdefault((g, a), set()).add(b)
    pairs, cut = set(), False
    for g, start in list(step) if seeds is None else [k for k in step if k[1] in seeds]:
        seen, front = set(), [start]
        for _ in range(limit):
            front = [y for y in {y for x in front for y in step.get((g, x), ())} if y not in seen]
            seen.update(front)
            if not front:
                break
        else:
            cut = cut or any(y not in seen for x in front for y in step.get((g, x), ()))
        pairs.update((start, y, g) for y in seen)
        if len(pairs) > DRIVER_PAIRS:
            return None
    return pairs, cut


def transitive(edges: DataFrame, limit: int, seeds: DataFrame | None = None, backwards: bool = False) -> tuple[DataFrame, bool]:
    """(pairs (a, b, g) linked by 1 .. limit edges, whether longer paths were cut off).

    seeds: (id) of the only starts that are asked for (ends, if ``backwards``), so a bound end of a path never
    computes all pairs.  Each round joins the newest pairs with the edges and drops those already known.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b", "g").distinct()
    told = edges.limit(DRIVER_EDGES + 1).collect()
    if len(told) <= DRIVER_EDGES:
        few = None if seeds is None else {r[0] for r in seeds.limit(DRIVER_EDGES + 1).collect()}
        if few is None or len(few) <= DRIVER_EDGES:
            found = _on_driver(told, few, backwards, limit)
            if found is not None:
                pairs, cut = found
                if backwards:
                    pairs = {(b, a, g) for a, b, g in pairs}
                return spark.createDataFrame(list(pairs), "a long, b long, g long"), cut
    edges = stage(edges, "edges")
    if backwards:
        edges = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "g")
    front = edges if seeds is None else edges.join(seeds.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    known = front = stage(front.select("a", "b", "g"), "pairs")
    steps = edges.select(F.col("a").alias("b"), F.col("b").alias("c"), "g")
    cut = True
    for _ in range(limit - 1):
        new = front.join(steps, ["b", "g"]).select("a", F.col("c").alias("b"), "g").distinct().join(known, ["a", "b", "g"], "left_anti")
        front = stage(new, "front")
        if front.isEmpty():
            cut = False
            break
        known = known.unionByName(front)
    if cut:
        beyond = front.join(steps, ["b", "g"]).select("a", F.col("c").alias("b"), "g").join(known, ["a", "b", "g"], "left_anti")
        cut = not beyond.isEmpty()
    return (known.select(F.col("b").alias("a"), F.col("a").alias("b"), "g") if backwards else known), cut


def connected(links: DataFrame) -> DataFrame:
    """(id, root) of the nodes of links (a, b): root is the least id that can be reached.

    Few links are joined on the driver.  Else each node takes the least label of its neighbours and then that
    label's own label, so a path shortens by half in each round.
    """
    spark = links.sparkSession
    links = links.select("a", "b").where("a <> b").distinct()
    told = links.limit(DRIVER_EDGES + 1).collect()
    if len(told) <= DRIVER_EDGES:
        up: dict[int, int] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in told:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return spark.createDataFrame([(x, root(x)) for x in list(up)], "id long, root long")
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stage(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = label.join(near, F.col("id") == F.col("a")).select("id", "root", F.least("root", "near").alias("low"))
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("next"))
        new = stage(low.join(jump, "low", "left").select("id", F.col("root").alias("old"), F.least("low", F.coalesce("next", "low")).alias("root")), "labels")
        if new.where("old <> root").isEmpty():
            return new.select("id", "root")
        label = new.select("id", "root")
