"""Queries of problem 1 over chunk texts and crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import markup
from lexforge.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "final_contextual_chunks").select(F.lit("final_contextual_chunks").alias("source_table"), F.col("chunk_id").alias("record_key"), F.col("original_text").alias("text"))
    pages = table(spark, sf_dir, "html_files").select(F.lit("html_files").alias("source_table"), F.col("item_id").alias("record_key"), F.col("full_text_html").alias("text"))
    return chunks.unionByName(pages)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found_kinds(_records(spark, sf_dir))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(_records(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean}
SQL: dict[str, str] = {}
