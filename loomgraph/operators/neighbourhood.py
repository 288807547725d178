"""Balls around seed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from .closure import stage


def ball(quads: DataFrame, seeds: list[T.Term], hops: int) -> tuple[DataFrame, DataFrame]:
    """(quads between nodes at most ``hops`` undirected steps from a seed, (id) of neighbours just outside)."""
    spark = quads.sparkSession
    known = front = spark.range(1).select(F.explode(F.array(*[T.id_lit(s) for s in seeds])).alias("id")) if seeds else spark.createDataFrame([], "id long")
    resource = F.col("o__k") != T.LITERAL
    ends = quads.where(resource).select(F.col("s").alias("a"), F.col("o").alias("b"))
    ends = stage(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")

    def step(front: DataFrame) -> DataFrame:
        return ends.join(front.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()

    for _ in range(hops):
        front = stage(step(front).join(known, "id", "left_anti"), "front")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    inside = known.distinct()
    found = quads.join(inside.withColumnRenamed("id", "s"), "s", "left_semi")
    literal = found.where(~resource)
    linked = found.where(resource).join(inside.withColumnRenamed("id", "o"), "o", "left_semi")
    return literal.select(*T.QUAD).unionByName(linked.select(*T.QUAD)), step(inside).join(inside, "id", "left_anti")
