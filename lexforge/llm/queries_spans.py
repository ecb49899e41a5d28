"""Queries of the problems 7 and 9 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import blocks, leakage, spans
from lexforge.session import table


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.find_leaks(docs, items, "doc_id", "text", "eval_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "eval_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spans.sharing_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_parts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text: the members of the classes whose pairs p9_found gives."""
    rows = spans.keyed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return blocks.copies_of(rows.select("id", "sid"), "doc_id")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p9_found": p9_found, "p9_shared": p9_shared, "p9_copies": p9_copies}
_WINDOWS = "SELECT DISTINCT doc_id, substr(text, p + 1, 400) AS w FROM (SELECT doc_id, text, unnest(range(length(text) - 399)) AS p FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 400)"
_RUNS = "SELECT DISTINCT {0}, array_to_string(w[i + 1 : i + 13], ' ') AS run FROM (SELECT {0}, w, unnest(range(len(w) - 12)) AS i FROM (SELECT {0}, regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1} WHERE {0} IS NOT NULL))"
SQL: dict[str, str] = {
    "p7_found": f"SELECT DISTINCT doc_id, eval_id FROM ({_RUNS.format('doc_id', 'documents')}) d JOIN ({_RUNS.format('eval_id', 'eval_items')}) e ON d.run = e.run",
    "p9_found": f"""WITH w AS ({_WINDOWS}), s AS (SELECT * FROM w WHERE w IN (SELECT w FROM w GROUP BY w HAVING count(*) > 1))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id""",
    "p9_copies": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS copy_id, count(*) OVER (PARTITION BY text) - 1 AS n_copies FROM d""",
    "p9_shared": """
        WITH w AS (SELECT doc_id, p, substr(text, p + 1, 400) AS w FROM (SELECT doc_id, text, unnest(range(length(text) - 399)) AS p FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 400)),
        k AS (SELECT w FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
        s AS (SELECT doc_id, p, p + 400 AS e, coalesce(max(p + 400) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w SEMI JOIN k ON w.w = k.w),
        g AS (SELECT doc_id, sum(greatest(0, e - greatest(p, before))) AS shared, count(*) FILTER (WHERE p > before OR before = 0) AS stretches FROM s GROUP BY doc_id)
        SELECT d.doc_id, length(d.text)::BIGINT AS n_chars, coalesce(shared, 0)::BIGINT AS shared_chars, round(coalesce(shared, 0) / greatest(1, length(d.text)), 6) AS shared_part,
            coalesce(stretches, 0)::BIGINT AS n_stretches
        FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d LEFT JOIN g ON g.doc_id = d.doc_id""",
}
