"""Queries of problem 5: nested JSON as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import nested
from lexforge.session import table

FIELDS = ["metadata_api", "diagram_json"]


def p5_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object, with its nodeId if it has one: what it is, and the objects that hold it."""
    return nested.objects_of(table(spark, sf_dir, "metadata"), "row_id", FIELDS, every=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.objects_of(table(spark, sf_dir, "metadata"), "row_id", FIELDS).where("parent_node is not null and row_id is not null")
    return rows.select("row_id", "field", "parent_node", F.col("node").alias("child_node")).distinct()


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar, member of an object or item of a list, with the object it belongs to."""
    return nested.members_of(table(spark, sf_dir, "metadata"), "row_id", FIELDS)


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by what they are and what holds them."""
    o = p5_objects(spark, sf_dir)
    held = o.select("row_id", "field", F.col("object_no").alias("holder_no"), F.col("entity").alias("parent_entity"))
    return o.join(held, ["row_id", "field", "holder_no"], "left").groupBy("field", "entity", "parent_entity").agg(F.count("*").alias("n_objects"), F.countDistinct("row_id").alias("n_rows"))


QUERIES = {"p5_found": p5_found, "p5_objects": p5_objects, "p5_members": p5_members, "p5_entities": p5_entities}
_VALUES = """
    s AS (SELECT DISTINCT row_id, field, v FROM (SELECT row_id, 'metadata_api' AS field, metadata_api AS v FROM metadata UNION ALL SELECT row_id, 'diagram_json', diagram_json FROM metadata) WHERE json_valid(v)),
    w AS (
        SELECT row_id, field, v::JSON AS v, NULL::BIGINT AS up FROM s
        UNION ALL
        SELECT row_id, field, u.v, u.up FROM (
            SELECT w.row_id, w.field, unnest(CASE
                WHEN json_type(w.v) = 'OBJECT' THEN list_transform(map_values(json_transform(w.v, '"MAP(VARCHAR, JSON)"')), lambda x: {'v': x, 'up': coalesce(TRY_CAST(json_extract_string(w.v, '$.nodeId') AS BIGINT), w.up)})
                WHEN json_type(w.v) = 'ARRAY' THEN list_transform(json_extract(w.v, '$[*]'), lambda x: {'v': x, 'up': w.up})
                WHEN json_type(w.v) = 'VARCHAR' AND json_valid(w.v ->> '$') AND json_type(w.v ->> '$') IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN [{'v': (w.v ->> '$')::JSON, 'up': w.up}]
            END) AS u FROM w))"""
SQL: dict[str, str] = {
    "p5_found": f"""WITH RECURSIVE {_VALUES} SELECT DISTINCT row_id, field, up AS parent_node, TRY_CAST(json_extract_string(v, '$.nodeId') AS BIGINT) AS child_node
        FROM w WHERE row_id IS NOT NULL AND json_type(v) = 'OBJECT' AND up IS NOT NULL AND TRY_CAST(json_extract_string(v, '$.nodeId') AS BIGINT) IS NOT NULL""",
}
