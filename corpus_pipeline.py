"""The corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import public_file
from weftline.llm.common import WORD_PATTERN, stored, table, text_of
from weftline.llm.linededup import dedup_lines
from weftline.llm.ngram_join import Overlap, near_components
from weftline.llm.packing import packed_report
from weftline.llm.quality import judge_quality
from weftline.llm.secrets import find_secrets

#: What a secret's value is replaced by.
MARK = "<SECRET>"


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, n_chars following the text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go. Each row stays or goes by its own id, language and text; an id may be null."""
    kept = judge_quality(docs, table(spark, sf_dir, "labels")).where("kept").select(F.col("doc_id").alias("__id"), F.col("stratum").alias("__lang"), F.col("text_hash").alias("__hash")).distinct()
    own = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("lang").cast("string").eqNullSafe(F.col("__lang")) & (F.xxhash64(text_of()) == F.col("__hash"))
    return docs.join(kept, own, "left_semi").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; a document with no word left goes."""
    left = dedup_lines(docs).where((F.col("deleted_lines") == 0) | F.col("text").rlike(WORD_PATTERN))
    return _recounted(left, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal sets of five-word shingles (0.8 or more), the one with the smallest id stays, and every row without an id."""
    found = near_components(docs, rules=Overlap(words=5, percent=80))
    first = found.where("component_id = doc_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are replaced by MARK; every document stays."""
    return _recounted(find_secrets(docs, mark=MARK), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packed_report(docs, public_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: The stages use tokenizers, hashes and graph components, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
