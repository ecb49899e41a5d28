"""The chunk table's oversized texts and hierarchy values as pieces; see chunking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.chunking import NAME_LIMIT, OVERLAP, TEXT_LIMIT, pieces
from lexforge.session import ship_package

#: Names are cut within 300 characters; an overlap of 150 would be half of that.
NAME_OVERLAP = 30
_SCHEMA = "id string, item string, limit_chars int, piece_no int, n_pieces int, start int, core_start int, end int, piece string"


def split_items(items: DataFrame) -> DataFrame:
    """Pieces of ``items`` (id, item, limit_chars, overlap_chars, text): of at most limit_chars characters, overlapping by up to overlap_chars, which must be less than half the limit."""
    ship_package(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = []
            for i, item, limit, overlap, text in zip(*(rb.column(c).to_pylist() for c in ("id", "item", "limit_chars", "overlap_chars", "text"))):
                got = pieces(text, limit, overlap)
                rows += [(i, item, limit, k, len(got), s, c, e, p) for k, (s, c, e, p) in enumerate(got)]
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.string(), pa.string()] + [pa.int32()] * 6 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "item", "limit_chars", "piece_no", "n_pieces", "start", "core_start", "end", "piece"])

    return items.select("id", "item", "limit_chars", "overlap_chars", "text").where("text is not null").mapInArrow(run, _SCHEMA)


def oversized_items(chunks: DataFrame, text_limit: int = TEXT_LIMIT, name_limit: int = NAME_LIMIT, text_overlap: int = OVERLAP, name_overlap: int = NAME_OVERLAP) -> DataFrame:
    """(id, item, limit_chars, overlap_chars, text) of the texts and hierarchy values beyond their limits, found before any text leaves the JVM."""
    # one scan: the text and the hierarchy values side by side, only the long ones kept
    text = F.struct(F.lit("original_text").alias("item"), F.lit(text_limit).alias("limit_chars"), F.lit(text_overlap).alias("overlap_chars"), F.col("original_text").alias("text"))
    names = F.transform(F.map_entries("metadata.hierarchy"), lambda e: F.struct(e["key"].alias("item"), F.lit(name_limit).alias("limit_chars"), F.lit(name_overlap).alias("overlap_chars"), e["value"].alias("text")))
    items = F.filter(F.concat(F.array(text), F.coalesce(names, F.slice(F.array(text), 1, 0))), lambda x: F.length(x["text"]) > x["limit_chars"])
    return chunks.where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.inline(items))
