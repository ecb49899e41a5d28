"""Metadata and context for chunks, and their flat form for the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import json_text
from lexforge.operators.crawlstate import last_wins
from lexforge.schemas import MAX_LENGTHS, NO_DATE, NOT_GIVEN


def metadata_lookup(docs: DataFrame, metadata: DataFrame, seq: str = "row_id") -> DataFrame:
    """``docs`` (doc_id, ...) with doc_number and effective_date of their last metadata row; the id and a default where there is none."""
    known = last_wins(metadata.where("item_id is not null").select("item_id", "doc_number", "metadata_api", seq), "item_id", seq)
    known = known.select(F.col("item_id").alias("doc_id"), F.coalesce("doc_number", "item_id").alias("_number"), json_text(F.col("metadata_api"), "$.effFrom").alias("_date"))
    out = docs.join(known, "doc_id", "left")
    return out.withColumn("doc_number", F.coalesce("_number", "doc_id")).withColumn("effective_date", F.coalesce("_date", F.lit(NO_DATE))).drop("_number", "_date")


def flatten_chunks(chunks: DataFrame) -> DataFrame:
    """Flat columns with defaults for missing values; the hierarchy as JSON text."""
    m = F.col("metadata")
    return chunks.select(
        F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.coalesce(m["doc_id"], F.lit("")).alias("doc_id"), F.coalesce(m["doc_number"], F.lit(NOT_GIVEN)).alias("doc_number"),
        F.coalesce(m["effective_date"], F.lit(NO_DATE)).alias("effective_date"), F.coalesce(F.to_json(m["hierarchy"]), F.lit("{}")).alias("hierarchy"),
        F.coalesce("original_text", F.lit("")).alias("original_text"), F.coalesce("contextualized_text", F.lit("")).alias("contextualized_text"),
    )


def length_checks(limits: dict[str, int] = MAX_LENGTHS, bytes_: bool = False) -> dict:
    """Conditions for split_rejects: no text longer than its column takes, counted in characters or in bytes."""
    size = F.octet_length if bytes_ else F.length
    return {c: size(F.coalesce(F.col(c), F.lit(""))) <= n for c, n in limits.items()}
