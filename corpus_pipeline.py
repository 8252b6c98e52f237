"""A training corpus from raw documents: five stages, each a DataFrame to a DataFrame.

Each stage takes all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, decontaminate, near_dedup, pii, quality
from quadrille.llm.common import documents, drop_written, written
from quadrille.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of near duplicates (five words, 0.8) the one with the smallest id stays.

    Of rows that share the id that stays, the one with the least text stays, then the least hash of its
    columns. Documents with a null id are linked with nothing and stay.
    """
    found = near_dedup.near_duplicates(docs)
    taken = {c.lower() for c in docs.columns}
    own = next(c for c in ("gone", *(f"gone{i}" for i in range(len(taken)))) if c not in taken)
    gone = written(found.filter("id IS NOT NULL AND NOT kept").select(F.col("id").alias(own)).distinct(), "gone")
    several = written(found.filter("kept").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias(own)), "several")
    few = gone.count() <= near_dedup.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")
    if several.isEmpty():
        return kept
    same = F.col("doc_id").cast("long") == F.col(own)
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "variant")]
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct("text", F.xxhash64(*plain)))
    one = kept.join(several, same, "left_semi").groupBy(F.col("doc_id").cast("long").alias(own)).agg(row.alias("row")).select("row.*")
    return kept.join(several, same, "left_anti").union(one)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item but for a few edits go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: spans of personal data become the names of their kinds."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: (doc_id, n_tokens, ids)."""
    return bpe.encode(docs, vocabulary("word_bpe_49k.json")).select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontaminate", not_in_benchmark),
    ("pii", no_personal_data),
    ("bpe", token_ids),
]

#: SQL cannot express the classifier, the field or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)  # this stage has read it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
