"""From raw documents to packed windows of tokens: the stages, and run(), which applies them in turn.

Each stage takes all that its predecessor kept, written as Parquet and read again; all but the last return the
columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import jaccard, langid, linededup, packing, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known go on; those that language ID rejects go: null and empty texts, and texts
    without words. Texts are read whole. Rows that repeat an id are judged each by its own text; in a table without labels no
    language is known and every text with words stays; an empty table stays empty. Further columns go through."""
    return langid.keep_identified(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and a document that loses all its lines goes. n_chars follows the text. Null and empty
    texts and rows with a null id stay as they are; for rows that repeat an id see dedup_lines. Of equal lines that of
    the smallest id stays. Further columns of any name go through; an empty table stays empty."""
    removed = "_removed"
    while removed in docs.columns:
        removed += "_"
    out = linededup.dedup_lines(docs, count_col=removed)
    out = out.where(f"{removed} = 0 OR text IS NULL OR text RLIKE '\\\\S'").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; of rows that repeat an id and a text
    one. Null texts, texts without words and rows with a null id stay. An empty table stays empty; further columns of any name
    go through."""
    return jaccard.keep_one_of_each_group(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, as packing.pack_documents describes them: null and empty texts are in none, rows that repeat an id
    are packed each, long texts fill several windows; an empty table gives no window."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("packing", windows)]

#: Language ID and packing can't be put in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what goes between them is written to the shared folder."""
    folder = shared.folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
