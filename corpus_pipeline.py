"""From raw documents to packed training sequences: the stages, and the run over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontamination import decontaminated
from millrace.llm.exact_dedup import without_exact_duplicates
from millrace.llm.language_id import fit
from millrace.llm.ngram_join import without_near_duplicates
from millrace.llm.packing import packed
from millrace.llm.shared import made_so_far, saved_alone


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier names with a clear margin.

    Null, empty and letterless texts go, as do ties.  The dictionaries come from rows with an id, a
    label and a text; without any, everything goes.  Rows that repeat a text stay or go together.
    Other columns are carried along; an empty table gives an empty one.
    """
    return fit(docs).accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id.

    A null text is an empty one; null ids lose to any other.  Of rows that repeat id and text one stays.
    Whole texts are compared, however long.  Other columns are carried along; an empty table gives an empty one.
    """
    return without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of five-word shingles the one with the smallest id.

    Null and empty texts are no copies of anything and rows with a null id stay; rows that repeat an id
    stay or go together.  Whole texts count, however long.  Other columns are carried along; an empty
    table gives an empty one.
    """
    return without_near_duplicates(docs, width=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of the benchmark.

    Null and empty texts stay, and with an empty benchmark all do; null ids are ids like any other and
    repeated rows stay or go together.  Whole texts are searched.  Other columns are carried along; an
    empty table gives an empty one.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048.

    A null or empty text still has its end id.  Repeated rows and null ids are documents of their own;
    texts of any length are cut, never shortened.  Other columns are not read; an empty table gives no rows.
    """
    return packed(docs, length=2048, end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language ID by compression and packing are not expressible in SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents; each one's result is written and read again, and what it wrote before that goes."""
    before = made_so_far()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved_alone(docs, before)
    return docs
