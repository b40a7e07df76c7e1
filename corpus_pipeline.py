"""The corpus pipeline: from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder as Parquet and
reads it back as the next one's docs. All but the last return the columns of documents; where a stage changes texts,
n_chars follows.

Defined cases, the same in every stage: extra columns are carried along whatever their names are, but for names that
begin with __q_; an empty table gives no rows. A null text, and one without a letter, is rejected by the first stage;
after it a text may become empty, which stays a document. Rows that share a doc_id, or have none, are documents of
their own; equal rows are copies of each other, of which the near-duplicate stage keeps one. A text of any length is
worked on whole. Ties go to the least doc_id, and where that is shared to the row with the least hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import language, line_dedup, packing, shingles, substring_dedup
from quern.llm.common import finished, materialize, release, small_batches, table, with_uid, without_ids

#: SQL can express neither the language profiles nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that are like no language that was learned.

    A text is like a language if its cosine with the prototype is not below what nearly all labelled texts of about its
    length reach; where no language could be learned only texts without a letter go.
    """
    small_batches(spark)
    model = language.learn(docs, sample=None, limits=True)
    found = language.predict(docs, model, keep=docs.columns)
    known = F.col("__q_score") >= F.col("__q_least") if model.langs else F.lit(True)
    return found.where(F.col("__q_letters") & known).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs, of long single lines and of one-line documents."""
    return _recounted(line_dedup.dedup_lines(docs, long_words=line_dedup.LONG_WORDS), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    rows = with_uid(docs)
    later = materialize(shingles.later_of_groups(rows), "later-of-groups")
    return without_ids(rows, later).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of passages and keeps the first."""
    small_batches(spark)
    return _recounted(substring_dedup.dedup(docs, keep_first=True), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", dedup_substrings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, finished(lambda f=stage, d=docs: f(spark, d, sf_dir), f"stage-{name}")
        release(before)  # the stage's result is all that is left; the input is not a table of ours
    return docs
