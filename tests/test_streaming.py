from pyspark.sql import functions as F

from loomgraph.sources.quads import QuadDataset
from loomgraph.streaming import ingest as I


def test_ingest(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.nt").write_text('<http://x/a> <http://x/p> "1" .\n<http://x/a> <http://x/p> "1" .\nbroken\n')
    I.ingest(spark, str(src), out).awaitTermination(60)
    assert I.read_ingested(spark, out).count() == 1
    (src / "b.nq").write_text('<http://x/a> <http://x/p> "1" .\n<http://x/b> <http://x/p> "2"@en <http://x/g> .\n')
    I.ingest(spark, str(src), out).awaitTermination(60)
    got = I.read_ingested(spark, out)
    assert got.count() == 2 and got.where("g <> 0").count() == 1
    graphs = spark.createDataFrame([(0, "urn:0")], "graph_id long, iri string")
    assert QuadDataset(got, graphs).quads.count() == 2


def test_windows(spark):
    df = spark.createDataFrame([("p", "2024-01-01 00:01:00"), ("p", "2024-01-01 00:09:00"), ("q", "2024-01-01 00:11:00")], "p__x string, t string").withColumn("arrived", F.to_timestamp("t"))
    assert sorted((r.p__x, r.n) for r in I.predicate_counts(df).collect()) == [("p", 2), ("q", 1)]
