"""A training-data pipeline over `documents`: toxicity, quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushgrid.llm import packing, quality, simhash, substrings, toxicity as toxic
from hushgrid.plans.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't predict as toxic. The model learns from the labels of docs; without
    labels of both kinds nothing goes. Null and empty texts stay, repeated rows are judged alike."""
    return toxic.clean(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band. Null and empty texts fail the
    base rules; repeated rows are judged alike, and a null language is one of its own."""
    return quality.good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id. Null and empty texts are one group;
    of repeated rows one stays; rows without doc_id come last in their group."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur earlier; n_chars, if there, is counted anew. Texts of which
    nothing is left go, and so do null and empty ones. Rows equal in id and text are one document here."""
    left = substrings.remove_repeats(docs).where(F.length("text") > 0)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows. Null and empty texts are an end mark alone; every row is packed for itself."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("near-duplicates", drop_near_copies), ("substring dedup", cut_repeats), ("packing", pack_windows)]

#: Learned scores, hashes and tokenizers can't be said in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each stored in the shared folder before the next reads it. An empty table gives no
    rows; other columns, whatever their names, are carried along up to the packing. Texts are taken whole."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
