"""The corpus pipeline: documents in, packed training sequences out, a table written after each stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import jaccard, lines, packing, quality, simhash, suffixes
from quern.llm.common import new_folder, releasing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: those of null or empty text, too, since they
    have no words. Rows are judged alone, so repeated rows stay or go together, null ids are like any
    others, and a null lang is compared with all documents. An empty table gives an empty one; columns
    beside those of documents, whatever their names, are left out."""
    return quality.accepted(docs.select(*COLUMNS)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that stand in ten documents or more, and counts n_chars anew. All rows stay:
    repeated rows count as documents of their own, null ids are like any others, a null text becomes an
    empty one. An empty table gives an empty one; other columns are left out."""
    index = lines.LineIndex(spark, new_folder(spark, "line-index"), shards=lines.LineIndex.shards_for(docs))
    index.commit("all", inserts=docs)
    return index.drop_common(docs.select(*COLUMNS), committed=True).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: Jaccard similarity of 0.8 or more in shingles of
    five words. Op3's query is another contract (fingerprints at most 3 bits apart).

    The row of the smallest doc_id stays, a null one last; of rows that share it the one of the least
    hash of its text, of equal rows one. Texts without words, null ones too, are copies of each other.
    An empty table gives an empty one; other columns are left out."""
    kept = docs.select(*COLUMNS)
    return simhash.keep_one(kept, jaccard.near_copies(kept)).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what repeats 100 bytes of an earlier place; parts of characters at a cut go too.

    All rows stay, a null text as an empty one. Earlier is by doc_id, null first; rows that share an id
    go by their place in the table, so of equal rows one keeps its text. An empty table gives an empty
    one; other columns are left out."""

    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x.decode("utf-8", "ignore") for x in batch], dtype=object)

    text.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    kept = suffixes.without_repeats(docs.select(*COLUMNS)).withColumn("text", F.pandas_udf(releasing(text), "string")("_kept.bytes"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; returns their pieces. Every row is packed, repeated ones and
    those of null id or text (an end token alone) too; an empty table has no pieces; other columns are
    not looked at."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]

#: No SQL for SimHash components, curves or BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
