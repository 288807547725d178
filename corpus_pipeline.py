"""A corpus pipeline over ``documents``: quality rules, near-duplicate removal, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept.  All but the last return the columns of ``documents``; after the mixing
stage a document stands as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import compression_bands, flow_mixing, ngram_jaccard, positional_index, wavelet_shards
from loomgraph.llm.queries import tokenizer_path
from loomgraph.llm.shared import scratch, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep."""
    return compression_bands.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones."""
    return ngram_jaccard.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return positional_index.keep_clean(docs, table(spark, sf_dir, "benchmark"), k=8, least_items=1)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return flow_mixing.take(docs, flow_mixing.mix(docs, F.array("source")))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet shards of all documents, and what they hold of each, read back."""
    return wavelet_shards.read_digest(wavelet_shards.write_shards(docs, tokenizer_path(), end_id=1, bits=16))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_shards),
]

#: The compression verdict, the join's components and the tokenizer can't be put into SQL; the stages' tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return step(spark, docs, sf_dir)
        with scratch(spark):  # what the stage stored on its way is removed once its result is written
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{i}", keep=True)
    return docs
