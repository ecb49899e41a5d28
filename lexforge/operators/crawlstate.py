"""State of a crawl as tables: pages of a listing, known and failed items, retries, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import materialize


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: the first under ``order``. Nulls are a key of their own. Partial limits run before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    return latest(df, key, [F.col(seq).desc_nulls_last()])


def first_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    return latest(df, key, [F.col(seq).asc_nulls_last()])


def not_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't known; null keys pass."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def failed_set(failed: DataFrame, succeeded: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Failures still open: the last of each key, without those that succeeded."""
    return not_known(latest(failed.where(F.col(key).isNotNull() & (F.col(key) != "")), key, order), succeeded, key)


def append_union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, those of ``new`` in place of those of ``old``."""
    return not_known(old, new, key).unionByName(new)


def retry_rounds(failed: DataFrame, key: str, succeeds, rounds: int = 3) -> DataFrame:
    """(key, resolved_round): at most ``rounds`` passes over what is left; null where none succeeded. ``succeeds(round)`` is a condition on the failed row, one of each key."""
    done = F.coalesce(*[F.when(succeeds(r), F.lit(r)) for r in range(1, rounds + 1)])
    return failed.dropDuplicates([key]).select(key, done.alias("resolved_round"))


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Global positions 1, 2, ... under ``order`` without gathering the rows in one task.

    Rows are sorted into ranges and written; a range's rows are numbered where they lie and shifted by the sizes of the
    ranges before it. Only one row for each range passes through a single task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_p", before.alias("_before"))
    return ranged.withColumn("_p", part).join(F.broadcast(shift), "_p").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_before")


def paginate(df: DataFrame, order: list[Column], size: int = 20) -> DataFrame:
    """Rows with their page number, pages of ``size`` rows under ``order``."""
    return number_rows(df, order).withColumn("page_no", F.floor((F.col("position") - 1) / max(1, size)) + 1)


def split_rejects(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons): a failing row is set aside on its own, its batch goes on."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    tagged = df.withColumn("reasons", reasons)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)
