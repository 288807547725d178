"""Incremental ingestion of N-Triples and N-Quads with Structured Streaming.

New files of a folder are parsed inside the JVM and appended to a table of quads.
Each micro-batch is written under its own number, so a batch that is replayed
after a failure replaces what its first try left and nothing is stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import terms as T
from ..sources.quads import SCHEMA, with_ids
from ..sources.rdf import parse_lines


def quads_of_lines(lines: DataFrame, graph: int = 0, prefix: str = "s.") -> DataFrame:
    """Quads of a static or streaming DataFrame of lines (column ``value``); graph names of N-Quads become hashed graph ids."""
    rows = parse_lines(lines, prefix)
    g = F.when(F.col("graph").isNull(), F.lit(graph)).otherwise(F.pmod(F.xxhash64("graph"), F.lit(1 << 62)))
    return with_ids(rows.withColumn("g", g.cast("long")).drop("graph"))


def stream_quads(spark: SparkSession, source: str, graph: int = 0, max_files: int = 64) -> DataFrame:
    """Quads of all files of a folder, and of those that will arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(source)
    return quads_of_lines(lines, graph)


def ingest(spark: SparkSession, source: str, target: str, graph: int = 0, once: bool = True) -> StreamingQuery:
    """Appends a folder's new files to ``target``; with ``once`` it stops when all that is there has been taken."""

    def write(batch: DataFrame, number: int):
        batch.dropDuplicates(["s", "p", "o", "g"]).write.mode("overwrite").parquet(f"{target}/quads/batch={number}")

    writer = stream_quads(spark, source, graph).writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/progress")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """Distinct quads that have been ingested."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{target}/quads").select(*T.QUAD).dropDuplicates(["s", "p", "o", "g"])


def predicate_counts(quads: DataFrame, minutes: int = 10, late: int = 30, time_column: str = "arrived") -> DataFrame:
    """Quads for each predicate and window of arrival time; later ones than ``late`` minutes are left out of closed windows."""
    timed = quads.withWatermark(time_column, f"{late} minutes")
    return timed.groupBy(F.window(time_column, f"{minutes} minutes"), "p__x").agg(F.count(F.lit(1)).alias("n"))
