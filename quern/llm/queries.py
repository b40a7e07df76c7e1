"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, importance, kdtree, language, lexical, line_dedup, packing, sharding, simhash, substring_dedup, toxicity, url_filter, webp
from quern.llm.common import finished, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: line_dedup.digest(table(spark, sf_dir, "documents")), "lines-of-documents")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies go, the first too."""
    return finished(lambda: substring_dedup.dedup(table(spark, sf_dir, "documents"), keep_first=False, digest=True), "bytes-of-documents")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: simhash.near_duplicates(table(spark, sf_dir, "documents")), "components-of-documents")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(language.learning_rows(docs)))


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.store_texts(table(spark, sf_dir, "documents"))


def op11_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: sharding.digest(table(spark, sf_dir, "documents")), "shards-of-documents")


def op12_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return finished(lambda: lexical.search(lexical.build(table(spark, sf_dir, "documents"), items), items), "hits-of-items")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "draw-of-documents")


def queries() -> dict[str, Query]:
    return {"op1_url_filter": op1_url_filter, "op2_bpe": op2_bpe, "op3_toxicity": op3_toxicity, "op4_packing": op4_packing, "op5_kdtree": op5_kdtree, "op6_line_dedup": op6_line_dedup, "op7_suffix_array": op7_suffix_array, "op8_simhash": op8_simhash, "op9_language": op9_language, "op10_webp": op10_webp, "op11_kdtree_shards": op11_kdtree_shards, "op12_tput": op12_tput, "op13_importance": op13_importance}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.oracle(), "op5_kdtree": kdtree.oracle(), "op6_line_dedup": line_dedup.oracle(), "op12_tput": lexical.oracle()}
