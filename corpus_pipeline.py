"""A training-data pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages
are written as Parquet in the shared folder and read again. Near-duplicates are texts of a
Jaccard index of at least 0.8 on five-word shingles: SimHash gives the closest pairs, the
others are completed, and every link is verified exactly.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwise.llm import bpe, decontam, linededup, quality, simhash
from floorwise.llm.shared import Written, fresh, tidy

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: SQL cannot express BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; every document stays."""
    removed = fresh(docs, "removed_lines")
    cleaned = linededup.without_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the smallest id."""
    return simhash.keep_one_of_each(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back; other columns than id, language and source go."""
    decoded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return decoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own scratch tables go when it is written, and it goes when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with tidy():
            written = Written(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            before.discard()
        docs, before = written.df, written
    return docs
