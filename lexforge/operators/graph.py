"""The document - chapter - article - chunk graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.crawlstate import latest
from lexforge.schemas import NO_ARTICLE, NO_CHAPTER, NO_DATE, NO_NAME, NOT_GIVEN


def graph_rows(chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row for each chunk row with defaults; ``names`` (chunk_id, source_doc) gives document names where known."""
    m, h = F.col("metadata"), F.col("metadata")["hierarchy"]
    rows = chunks.where("chunk_id is not null").select(
        "chunk_id", "original_text", "written_at", F.coalesce(m["doc_id"], F.lit("Unknown")).alias("doc_id"), F.coalesce(m["doc_number"], F.lit(NOT_GIVEN)).alias("doc_number"),
        F.coalesce(m["effective_date"], F.lit(NO_DATE)).alias("effective_date"), F.coalesce(F.try_element_at(h, F.lit("Chương")), F.lit(NO_CHAPTER)).alias("chapter"), F.coalesce(F.try_element_at(h, F.lit("Điều")), F.lit(NO_ARTICLE)).alias("article"),
    )
    if names is None:
        return rows.withColumn("source_doc", F.lit(NO_NAME))
    known = names.select("chunk_id", F.nullif(F.trim("source_doc"), F.lit("")).alias("source_doc"))
    return rows.join(known, "chunk_id", "left").withColumn("source_doc", F.coalesce("source_doc", F.lit(NO_NAME)))


_NEWEST = ("written_at", "chunk_id")


def _newest():
    return [F.col("written_at").desc_nulls_last(), F.col("chunk_id").desc()]


def documents(rows: DataFrame) -> DataFrame:
    """Document nodes, attributes of the newest chunk row."""
    return latest(rows.select("doc_id", "source_doc", "doc_number", "effective_date", "written_at", "chunk_id"), "doc_id", _newest()).select("doc_id", F.col("source_doc").alias("name"), "doc_number", "effective_date")


def chunk_nodes(rows: DataFrame) -> DataFrame:
    return latest(rows.select("chunk_id", F.col("original_text").alias("text"), "written_at"), "chunk_id", [F.col("written_at").desc_nulls_last(), F.col("text").desc_nulls_last()]).select("chunk_id", "text")


def chapters(rows: DataFrame) -> DataFrame:
    """Chapter nodes, which are also the edges from their documents."""
    return rows.select("doc_id", "chapter").distinct()


def articles(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "chapter", "article").distinct()


def chunk_edges(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "chapter", "article", "chunk_id").distinct()


def paths(chunk_ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(chunk_id, doc_name, doc_number, effective_date, article) along the edges up to the document, for the wanted chunks."""
    e = chunk_edges(rows).join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return (
        e.join(articles(rows), ["doc_id", "chapter", "article"], "left_semi")
        .join(chapters(rows), ["doc_id", "chapter"], "left_semi")
        .join(documents(rows), "doc_id")
        .select("chunk_id", F.col("name").alias("doc_name"), "doc_number", "effective_date", "article", "chapter", "doc_id")
    )


def broken_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, or are null."""
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    return df.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)
