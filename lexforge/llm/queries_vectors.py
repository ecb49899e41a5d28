"""Queries of problem 3 over the chunk vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import neighbors
from lexforge.session import materialize, table

#: Leaves a query opens beyond its own: WIDE, or SHARE of the number of leaves of a tree where that is more. Recall of a fixed number
#: falls as the collection grows (0.50 at 1,430,000 vectors of 64 unrelated numbers with 80), that of a share doesn't (0.94 at 143,000, 0.965 at 1,430,000).
WIDE, SHARE = 80, 0.75


def _asks(column: str = "chunk_id"):
    # chunk ids are strings; a hash of them stands for the number whose divisibility by 100 marks a query
    return F.conv(F.substring(F.md5(F.col(column)), 1, 8), 16, 10).cast("long") % 100 == 0


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbors.similar_pairs(table(spark, sf_dir, "vietlaw_chunks"), "chunk_id", "embedding")
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest(table(spark, sf_dir, "vietlaw_chunks"), "chunk_id", "embedding", probes=WIDE, share=SHARE, asks=_asks())
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbor").alias("neighbor_id"), F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine"))


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against brute force for one id in a hundred: of the 5 nearest by p3_topk, and of those of cosine 0.9 or more by p3_found."""
    true = materialize(neighbors.exact_neighbors(table(spark, sf_dir, "vietlaw_chunks"), "chunk_id", "embedding", _asks("id")), "recall-true")
    top = p3_topk(spark, sf_dir).select(F.lit("p3_topk").alias("query"), F.col("chunk_id").alias("id"), F.col("neighbor_id").alias("neighbor"))
    pairs = p3_found(spark, sf_dir).select(F.lit("p3_found").alias("query"), F.inline(F.array(F.struct(F.col("chunk_id_a").alias("id"), F.col("chunk_id_b").alias("neighbor")), F.struct(F.col("chunk_id_b").alias("id"), F.col("chunk_id_a").alias("neighbor")))))
    want = true.select(F.lit("p3_topk").alias("query"), "id", "neighbor").unionByName(true.where("cosine >= 0.9").select(F.lit("p3_found").alias("query"), "id", "neighbor"))
    return want.join(top.unionByName(pairs).withColumn("hit", F.lit(1)), ["query", "id", "neighbor"], "left").groupBy("query").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


_OK = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_NEAR = """c AS (SELECT DISTINCT chunk_id AS id, embedding::DOUBLE[] AS v FROM vietlaw_chunks WHERE chunk_id IS NOT NULL AND {ok}),
    n AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM c),
    s AS (SELECT a.id, b.id AS other, round(list_inner_product(a.u, b.u), 12) AS cosine FROM n a JOIN n b ON a.id <> b.id {where}),
    top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) <= 5)"""
_ASKS = "WHERE ('0x' || substr(md5(a.id), 1, 8))::BIGINT % 100 = 0"
QUERIES = {"p3_found": p3_found, "p3_topk": p3_topk, "p3_recall": p3_recall}
SQL = {
    "p3_found": f"WITH {_NEAR.format(ok=_OK, where='')} SELECT DISTINCT least(id, other) AS chunk_id_a, greatest(id, other) AS chunk_id_b FROM top WHERE cosine >= 0.9",
    "p3_topk": f"WITH {_NEAR.format(ok=_OK, where=_ASKS)} SELECT id AS chunk_id, other AS neighbor_id, rank, round(cosine, 6) AS cosine FROM top",
}
