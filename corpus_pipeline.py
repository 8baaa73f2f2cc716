"""A training-data pipeline over `documents`: classify, deduplicate lines and documents, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, whatever further columns those have.

Every stage takes an empty table to an empty one, and treats rows that agree in doc_id and text alike. A null doc_id
is an id like any other; a null source is a source of its own. A null text passes as a document without words: the
classifier rates it like an empty one, no line of it repeats, all texts without words are near duplicates of one another
(one stays), the mix takes it once, and its encoding is empty. Texts of any length are worked off whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowgrid.llm import bpe, lines, mixing, quality, simhash
from sparrowgrid.llm.common import stash, unstash


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labels of two grades it rejects none."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly do, are cut out; a document left without any goes. Blank lines stay."""
    return lines.dedup_documents(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id (null last)."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded."""
    e = bpe.encode(docs, bpe.vocabulary())
    return e.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", rate), ("lines", dedup_lines), ("near duplicates", dedup_documents), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the stages in order over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        unstash(before)
    return STAGES[-1][1](spark, docs, sf_dir)
