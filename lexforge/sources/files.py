"""File sources and sinks: JSON lines (tolerant, strict), whole HTML and Markdown files, append and overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, required: str | None = None) -> DataFrame:
    """JSON lines. Blank lines are skipped; malformed lines are dropped, or fail the job if ``strict``; so does a null ``required`` column then."""
    if strict:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        if required:
            df = df.withColumn(required, F.when(F.col(required).isNull(), F.raise_error(F.lit(f"{required} is missing"))).otherwise(F.col(required)))
        return df
    s = T.StructType.fromDDL(schema).add("_bad", "string")
    return spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")


def _whole_files(spark: SparkSession, path: str, suffix: str, name: str) -> DataFrame:
    df = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return df.select(F.replace(F.element_at(F.split("_metadata.file_name", "/"), -1), F.lit(suffix), F.lit("")).alias("doc_id"), F.col("value").alias(name))


def read_html_dir(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html), one row a file."""
    return _whole_files(spark, path, ".html", "html")


def read_markdown_dir(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, md), one row a file; order by doc_id where order matters."""
    return _whole_files(spark, path, ".md", "md")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def recreate(df: DataFrame, path: str) -> None:
    """Drop what is there and write anew."""
    df.write.mode("overwrite").parquet(path)


def count_lines(text):
    """Lines with something on them, of a text column."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
