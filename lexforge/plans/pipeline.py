"""The chain of stages over tables: every stage a function from DataFrames to a DataFrame; any failure ends the chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.headings import normalize_headings
from lexforge.functions.text import contextual_text, template_context
from lexforge.operators import enrich, graph, html, splitting
from lexforge.schemas import LEVELS


def markdown_stage(pages: DataFrame) -> DataFrame:
    """(doc_id, md) of pages (doc_id, html)."""
    return pages.select("doc_id", normalize_headings(html.to_markdown(F.col("html"))).alias("md"))


def chunk_stage(markdown: DataFrame, metadata: DataFrame, context: Callable | None = None) -> DataFrame:
    """Contextual chunks of (doc_id, md); ``context(text, title)`` gives the context line as a column, a template by default."""
    s = splitting.header_sections(markdown, "doc_id", "md").withColumnRenamed("id", "doc_id")
    s = s.select("*", F.posexplode(splitting.size_split(F.col("content"))).alias("sub_no", "original_text"))
    c = splitting.number_chunks(s, "doc_id", ["first_pos", "sub_no"], "original_text")
    c = enrich.metadata_lookup(c, metadata)
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"level_{i}").alias("v")) for i, n in enumerate(LEVELS, 1)]), lambda x: x["v"].isNotNull())
    line = (context or template_context)(F.col("original_text"), F.col("doc_number"))
    return c.select(
        "chunk_id", F.struct("doc_id", "doc_number", "effective_date", F.map_from_entries(entries).alias("hierarchy")).alias("metadata"),
        "original_text", contextual_text(line, F.col("original_text")).alias("contextualized_text"), F.lit(None).cast("timestamp").alias("written_at"),
    )


def vector_stage(chunks: DataFrame, encode: Callable) -> tuple[DataFrame, DataFrame]:
    """(rows with embeddings, rejected rows): flat chunks within the table's lengths, encoded in Arrow batches by ``encode`` (texts to vectors)."""
    from lexforge.operators.crawlstate import split_rejects
    from lexforge.schemas import MAX_LENGTHS

    flat = enrich.flatten_chunks(chunks)
    ok, bad = split_rejects(flat, enrich.length_checks({k: v for k, v in MAX_LENGTHS.items() if k in flat.columns}))

    def run(s):
        import pandas as pd

        return pd.Series([list(map(float, v)) for v in encode(s.tolist())], dtype=object)

    return ok.withColumn("embedding", F.pandas_udf(run, "array<float>")("contextualized_text")).drop("contextualized_text"), bad


def graph_stage(chunks: DataFrame) -> dict[str, DataFrame]:
    rows = graph.graph_rows(chunks)
    return {"documents": graph.documents(rows), "chapters": graph.chapters(rows), "articles": graph.articles(rows), "chunks": graph.chunk_nodes(rows), "chunk_edges": graph.chunk_edges(rows)}


def run(stages: list[tuple[str, Callable]], until: str | None = None) -> dict[str, object]:
    """Run named stages in order, each given the results so far; stop after ``until``. The first exception ends the chain."""
    done: dict[str, object] = {}
    for name, stage in stages:
        done[name] = stage(done)
        if name == until:
            break
    return done
