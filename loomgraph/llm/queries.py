"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_layouts, compression_bands, flow_mixing, fused_language, maxent_lm, ngram_jaccard, oracle, ordinal_quality, positional_index, tiered_shards, wavelet_shards
from .shared import shared_dir, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=8)
    return positional_index.digest(found, least_items=2)


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet_shards.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, bits=16)
    return wavelet_shards.read_digest(shards)


def op4_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.quality_bands(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fused_language.train_text(table(spark, sf_dir, "documents"))
    return fused_language.identify(table(spark, sf_dir, "pages"), model)


def op6_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in 16 lots, are compacted to the target size and read back from the newest version."""
    docs = table(spark, sf_dir, "documents")
    store = tiered_shards.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes=64 << 20)
    store.append_by(docs.withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(16))), "arrival")
    store.compact(docs.schema)
    store.vacuum(age_seconds=0)  # there is no other writer
    rows = store.read(docs.schema)
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    model, tables = maxent_lm.train(docs.where("NOT held_out"))
    return maxent_lm.score(docs, model, tables, held_out="held_out")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 good.  Kept: more likely than not above the lowest grade."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
    graded = ordinal_quality.grade(docs, ordinal_quality.fit(docs, ratings, n_grades=3))
    tail = F.col("tails")
    return graded.select("doc_id", "expected_grade", tail[0].alias("p_clean"), tail[1].alias("p_good"), (tail[0] >= 0.5).alias("kept"))


def op8_chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    turns = chat_layouts.canonical_turns(chat_layouts.row_records(rows))
    return chat_layouts.digest(chat_layouts.format_turns(turns))


def op9_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = flow_mixing.mix(table(spark, sf_dir, "documents"), F.array("source"), weights=(1, 2, 3), max_repeat=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_wavelet_shards": op3_wavelet_shards,
    "op4_quality_bands": op4_quality_bands,
    "op5_language": op5_language,
    "op6_tiered_shards": op6_tiered_shards,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_chat_layouts": op8_chat_layouts,
    "op9_flow_mixing": op9_flow_mixing,
    "op10_ordinal_quality": op10_ordinal_quality,
}
SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracle.OP1,
    "op2_decontamination": oracle.OP2,
    "op6_tiered_shards": oracle.OP6,
    "op8_chat_layouts": oracle.OP8,
}
