"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import neardup
from lexforge.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "final_contextual_chunks")
    pairs = neardup.near_pairs(chunks, "chunk_id", "original_text", n=3, threshold=0.6, min_words=60)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the links of p6_found; one row for each chunk."""
    chunks = table(spark, sf_dir, "final_contextual_chunks")
    return neardup.near_groups(chunks, "chunk_id", "original_text", n=3, threshold=0.6, min_words=60)


def p6_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts alike by their runs of five words, each weighed by how often it occurs."""
    got = neardup.weighted_links(table(spark, sf_dir, "final_contextual_chunks"), "chunk_id", "original_text")
    return got.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"), "similarity")


_SHINGLES = """w AS (SELECT DISTINCT chunk_id AS id, original_text AS t FROM final_contextual_chunks WHERE chunk_id IS NOT NULL AND original_text IS NOT NULL),
    v AS (SELECT id, regexp_extract_all(lower(nfc_normalize(t)), '[\\p{{L}}\\p{{N}}]+') AS w FROM w),
    s AS (SELECT id, array_to_string(w[i + 1 : i + {n}], ' ') AS g, count(*) AS times FROM (SELECT id, w, unnest(range(len(w) - {n} + 1)) AS i FROM v WHERE len(w) >= {least}) GROUP BY ALL)"""
QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes, "p6_weighted": p6_weighted}
SQL: dict[str, str] = {
    "p6_found": f"""WITH {_SHINGLES.format(n=3, least=60)}, n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        b AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
        SELECT a AS chunk_id_a, b AS chunk_id_b FROM b JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common >= 0.6 * (x.n + y.n - common) - 1e-9""",
    "p6_weighted": f"""WITH {_SHINGLES.format(n=5, least=5)}, f AS (SELECT min(id) AS id FROM w GROUP BY t), k AS (SELECT s.*, 1 + ln(times) AS wt FROM s SEMI JOIN f ON s.id = f.id),
        n AS (SELECT id, sum(wt) AS n FROM k GROUP BY id),
        b AS (SELECT x.id AS a, y.id AS b, sum(least(x.wt, y.wt)) AS common FROM k x JOIN k y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
        SELECT a AS chunk_id_a, b AS chunk_id_b, round(common / (x.n + y.n - common), 6) AS similarity FROM b JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9""",
}
