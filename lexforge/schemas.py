"""Record shapes the stages exchange."""

from pyspark.sql import types as T

RAW_ITEM = "item_id string, doc_number string, metadata_api string, diagram_json string, full_text_html string"
FAILED_ITEM = "item_id string, doc_number string, metadata_api string, diagram_json string, failed_at timestamp, attempt int"
MARKDOWN = "doc_id string, md string"
CHUNK = (
    "chunk_id string, metadata struct<doc_id: string, doc_number: string, effective_date: string, hierarchy: map<string, string>>, "
    "original_text string, contextualized_text string"
)
VECTOR = "chunk_id string, doc_id string, doc_number string, effective_date string, source_doc string, hierarchy string, original_text string, embedding array<float>"
CONTEXT = "query_id bigint, rank int, doc_info string, effective_date string, article string, content string"

#: Names of the header levels of a law text, '#' to '#####'.
LEVELS = ("Phần / Phụ lục", "Chương", "Mục", "Tiểu mục", "Điều")
#: What stands for a missing value.
NO_DATE, NO_NAME, NO_CHAPTER, NO_ARTICLE, NOT_GIVEN = "Chưa xác định", "Văn bản chưa xác định", "Chương N/A", "Điều N/A", "N/A"
#: Greatest lengths of the vector table's text columns.
MAX_LENGTHS = {"chunk_id": 200, "doc_id": 100, "doc_number": 100, "effective_date": 100, "source_doc": 200, "hierarchy": 500, "original_text": 65535}

__all__ = ["RAW_ITEM", "FAILED_ITEM", "MARKDOWN", "CHUNK", "VECTOR", "CONTEXT", "LEVELS", "MAX_LENGTHS", "T"]
