"""A corpus pipeline of five operators: toxicity, line dedup, near-dedup, decontamination, BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm.base import bounded, remove, table, write
from sunloom.llm.bpe import bpe_encode
from sunloom.llm.decontaminate import leaks
from sunloom.llm.line_dup import dedup_lines
from sunloom.llm.near_dup import near_duplicates
from sunloom.llm.toxicity import TOXIC, scores, training_rows


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs that are not among the pairs (doc_id, hash of the text) of bad, with the columns of docs.

    A bounded number of pairs is broadcast, so the texts are not shuffled; more are joined with a shuffle.
    """
    d, r = (f"{c}{'_' * max(map(len, docs.columns))}" for c in "dr")  # longer than any column's name
    return docs.join(bounded(bad.toDF(d, r)), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(r)), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a score of TOXIC or more; the others stay as they are.

    Null and empty texts stay. Repeated rows go or stay alike; rows of one doc_id are judged by their own texts. Without
    labels of both classes every document stays. An empty table gives an empty one. All columns come through.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("row")).alias("key"), "text")
    bad = scores(rows, training_rows(docs, table(spark, sf_dir, "labels")), "key").where(F.col("score") >= TOXIC)
    return _without(docs, bad.select("key.doc_id", "key.row").distinct())


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are near copies of an earlier one; every document stays.

    Where there is a column n_chars, documents that lose lines get their new length there; all other columns, also ones
    called n_lines or n_dropped, stay as they are. Null and empty texts, repeated rows and rows without a doc_id are
    treated as dedup_lines() says. An empty table gives an empty one.
    """
    own = f"before{'_' * max(map(len, docs.columns))}"
    out = dedup_lines(docs.withColumn(own, F.length("text")), counts=False)
    if "n_chars" in docs.columns:
        changed = ~F.length("text").eqNullSafe(F.col(own))
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8), that of smallest doc_id.

    Null, empty and white texts stay. A doc_id goes if none of its rows is the one that stays of its group; so repeated
    rows of a doc_id that stays all stay. An empty table gives an empty one. All columns come through.
    """
    d = f"d{'_' * max(map(len, docs.columns))}"
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias(d))
    return docs.join(bounded(gone), F.col("doc_id").eqNullSafe(F.col(d)), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window of words with the benchmark.

    Null and empty texts stay. Repeated rows go or stay alike; rows of one doc_id are judged by their own texts. An empty
    benchmark drops nothing; an empty table gives an empty one. All columns come through.
    """
    bad = leaks(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    return _without(docs, bad.select("doc_id", "row").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every document row, and the text that they decode to.

    Null and empty texts have no ids and decode to an empty text; each row gives a row; an empty table gives none. Other
    columns are neither read nor returned.
    """
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("near-dedup", near), ("decontamination", decontaminate), ("bpe", encode)]

#: Classifiers and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        done, path = path, write(stage(spark, docs, sf_dir))
        docs = spark.read.parquet(path)
        if done:
            remove(spark, done)  # the stage before, which nothing reads any more
    return STAGES[-1][1](spark, docs, sf_dir)
