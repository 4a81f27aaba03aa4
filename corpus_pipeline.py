"""Corpus pipeline over documents: each stage works on what the stage before it kept.

1. quality classifier: documents judged low in quality or toxic go;
2. n-gram Jaccard join: of each group of near duplicates the document of the least doc_id stays;
3. suffix-array dedup: repeated 100-byte strings are cut out, all but the first;
4. benchmark decontamination: documents that hold a benchmark item go;
5. best-fit packing: the rest becomes pieces in sequences of 4096 tokens.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textveil.llm import jaccard, leaks, packing, quality, substrings
from textveil.llm.common import table, without, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged each; a null text has no evidence against it and stays unless its site tells. No labels: all rows stay."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a doc_id are one document: they stay or go together, and repeated rows stay as often as they stand. Null and empty texts stay."""
    return without(docs, jaccard.near_classes(docs).where("NOT (doc_id <=> component_id)"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A cut within a character takes the whole character. n_chars follows the text; a null text stays null; no row goes."""
    return substrings.cut_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a doc_id go together. Null and empty texts stay; an empty benchmark leaves all rows."""
    return without(docs, leaks.leaks(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one piece of the end id. Rows that repeat are packed each; an empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages' models and hashes are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
