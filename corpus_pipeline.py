"""From raw documents to packed training sequences, in five stages.

Each stage gets all that its predecessor kept, as a table read back from Parquet, and returns the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import stage, table
from quillon.llm.line_dedup import dedup_lines
from quillon.llm.mixing import mix
from quillon.llm.ngram_join import one_of_each_group
from quillon.llm.packing import pack
from quillon.llm.quality import accept


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with n_chars as its texts now are, in the columns of like."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is scored like any other, as is a row with a null id; repeated rows stay or go together. Without labels of both
    classes all have one score. An empty table gives an empty one.
    """
    return accept(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat, exactly or nearly, the first stays; no document goes.

    Null and empty texts and rows with a null id stay as they are; rows with the same id and text keep the same lines, and rows
    with the same id and other texts are other documents. A text that loses all of its lines is empty. n_chars follows the text.
    """
    return _sized(dedup_lines(docs), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Of repeated rows one stays. Rows without words and rows with a null id link with nothing and all stay. Rows with the same id and
    other texts belong to the groups of their texts.
    """
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights, each document at most once.

    Texts without tokens are not taken. A null lang or source is a node of its own, a null id counts as ''. The document
    at a leaf's cut is cut there, and n_chars follows the text.
    """
    return _sized(mix(docs, share=(4, 5), epochs=1), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences.

    A null text is an empty one, which holds the end token alone; null ids and repeated rows are packed like others.
    """
    return pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("mixing", mixing), ("packing", packing)]

#: A classifier and MinHash have no SQL equivalent; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
