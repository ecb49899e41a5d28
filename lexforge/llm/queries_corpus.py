"""Queries of the problems 4 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import history, mixing
from lexforge.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated_documents(table(spark, sf_dir, "metadata"))


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the paragraphs of a record are the members of its JSON text
    return history.paragraphs_seen(table(spark, sf_dir, "metadata"), "row_id", "batch_no", "metadata_api", r',\s*(?=")')


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).short_sources()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).documents()


QUERIES = {"p4_found": p4_found, "p4_coverage": p4_coverage, "p8_found": p8_found, "p8_shares": p8_shares, "p8_mixture": p8_mixture}
SQL: dict[str, str] = {}
