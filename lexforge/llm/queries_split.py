"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import splitting
from lexforge.session import table


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = splitting.split_items(splitting.oversized_items(table(spark, sf_dir, "final_contextual_chunks")))
    return got.withColumnRenamed("id", "chunk_id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = splitting.split_items(splitting.oversized_items(table(spark, sf_dir, "final_contextual_chunks")))
    return got.where("n_pieces > 1").select(F.col("id").alias("chunk_id"), "item").distinct()


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
SQL = {
    "p2_found": """
        SELECT DISTINCT chunk_id, item FROM (
            SELECT chunk_id, 'original_text' AS item FROM final_contextual_chunks WHERE length(original_text) > 1500
            UNION ALL
            SELECT chunk_id, e.key AS item
            FROM (SELECT chunk_id, unnest(map_entries(metadata.hierarchy)) AS e FROM final_contextual_chunks)
            WHERE length(e.value) > 300)
        WHERE chunk_id IS NOT NULL""",
}
