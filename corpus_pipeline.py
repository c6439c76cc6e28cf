"""The corpus pipeline: quality, near duplicates, repeated passages, test items, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smogcast.llm.bpe import encode_decode
from smogcast.llm.decontaminate import contaminated
from smogcast.llm.minhash import near_duplicates
from smogcast.llm.quality import quality
from smogcast.llm.shared import Tables
from smogcast.llm.suffixes import remove_repeats


def _free(docs: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``docs`` has or begins with."""
    while any(c.startswith(name) for c in docs.columns):
        name = "_" + name
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the ids of ``gone``; rows without an id stay."""
    name = _free(docs, "gone")
    gone = gone.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (an id goes if all its rows are rejected)."""
    judged = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))
    return _without(docs, judged.groupBy("doc_id").agg(F.max("keep").alias("keep")).where(~F.col("keep")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest id; rows that repeat an id and its text go."""
    left = _without(docs, near_duplicates(docs).where(~F.col("kept")))
    turn = _free(docs, "turn")
    same = Window.partitionBy("doc_id", "text").orderBy(F.lit(0))
    left = left.withColumn(turn, F.row_number().over(same))
    return left.where((F.col(turn) == 1) | F.col("doc_id").isNull()).drop(turn)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a smaller document also has are cut, by whole characters."""
    prefix = _free(docs, "cut_")
    done = remove_repeats(docs, characters=True, prefix=prefix)
    text = F.when(F.col("text").isNotNull(), F.decode(f"{prefix}kept", "utf-8"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digests of ids and decoded bytes."""
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("suffix_dedup", cut_repeats),
          ("decontamination", drop_leaks), ("byte_bpe", tokenize)]

#: SQL can't express the classifier, so the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.store(stage(spark, docs, sf_dir), name)
    return docs
