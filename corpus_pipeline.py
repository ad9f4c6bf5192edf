"""A corpus pipeline of five of the llm operators: language ID, line dedup, n-gram Jaccard join, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written and read again before the next.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm import bpe, langid
from wicker.llm.common import documents, stash
from wicker.llm.line_dedup import dedup_lines
from wicker.llm.mixing import mixture
from wicker.llm.ngram_join import keep_first

#: A document stays if its language is known with at least this posterior.
LEAST_LANGUAGE_SCORE = 0.5
#: Near duplicates: shingles of five words, Jaccard similarity of 80 percent.
WORDS_EACH, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) and those whose language stays open; the model learns from docs' own labels."""
    path = langid.vocabulary_path()
    model = langid.train(docs.where(~langid.held_out()), path)
    found = langid.identify(docs, model, path, carry=True)
    return found.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts, n_chars following; a document that loses its last word by that goes. Null texts and ids pass."""
    found = dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\s]")
    return found.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of every group of near duplicates, one of equal rows; rows without words or id pass."""
    return keep_first(docs, WORDS_EACH, PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in order: rows as often as it takes them. Null and empty texts are in no mix; equal rows are interchangeable."""
    return mixture(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether the ids decode to the text) of each row of the mix, repeats included; a null text counts as empty."""
    found = bpe.encode(docs, bpe.vocabulary_path(), carry=True)
    return found.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.col("_ids").alias("ids"), F.col("_decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("bpe_encoding", bpe_encoding)]

#: SQL can express neither the forward algorithm nor the byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stash(docs)
    return docs
