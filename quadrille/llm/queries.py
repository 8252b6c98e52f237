"""The opN_ queries over the driver's tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, decontaminate, media, near_dedup, pii, quality, quotes, shards, simple8b, warc
from quadrille.llm.common import documents


def vocabulary(name: str) -> str:
    """A vocabulary file's place, which is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2)


def op2_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def quote_links_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator over the given messages with those before them quoted, for the given ones hold no quotes."""
    return quotes.link_quotes(quotes.quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle=3, threshold=(85, 100)).withColumnRenamed("id", "doc_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(documents(spark, sf_dir), shards=8).withColumnRenamed("id", "doc_id")


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).withColumnRenamed("id", "doc_id")


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_simple8b_ids": op1_simple8b_ids,
    "op2_media_archive": op2_media_archive,
    "op3_quote_links": op3_quote_links,
    "quote_links_derived": quote_links_derived,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_byte_shards": op8_byte_shards,
    "op9_quality_nbsvm": op9_quality_nbsvm,
    "op10_pii_crf": op10_pii_crf,
}

ORACLES: dict[str, str] = {"op3_quote_links": quotes.ORACLE, "quote_links_derived": quotes.QUOTING_ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
