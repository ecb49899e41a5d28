"""Pieces that several operators share: bounded batches, membership bitmaps, copy classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.session import materialize

#: Characters handled at once in a Python worker; keeps its arrays in the tens of megabytes.
BATCH_CHARS = 400_000
#: A class of exact copies up to this size is expanded into all its pairs (half a million); of a larger one the members are linked to the first
#: and the first to other texts, and the tables of members (p6_classes, p9_copies) hold the rest. So the rows stay in proportion to the input.
EXPAND_COPIES = 1_000


def by_chars(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with at most ``limit`` characters, or one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def bitmap_bits(n: int, per_item: int = 16, least: int = 1 << 16, most: int = 1 << 26) -> int:
    """A power of two near n * per_item, at most ``most`` (8 MB): what is broadcast doesn't grow with the data."""
    return min(most, max(least, 1 << int(max(1, n * per_item) - 1).bit_length()))


def collect_bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Two bits set for each hash, by its low and by its high half. The driver gets bits / 64 words at the most, or-ed together by the executors."""
    half = hashes.select(F.explode(F.array(F.col(column), F.shiftrightunsigned(column, 32))).alias("x"))
    slot = F.col("x").bitwiseAND(F.lit(bits - 1))
    words = (
        half.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    x, mask = hashes.view(np.uint64), np.uint64(len(bitmap) * 64 - 1)
    slot = x & mask
    hit = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
    at = np.flatnonzero(hit)  # few pass the first look
    slot = (x[at] >> np.uint64(32)) & mask
    hit[at] = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
    return hit


def _may_be(known: DataFrame, column: str, n: int):
    """A function of a column: whether it may be among ``known``; a bounded bitmap, so others may pass too."""
    held = known.sparkSession.sparkContext.broadcast(collect_bitmap(known, column, bitmap_bits(n)))

    @F.pandas_udf("boolean")
    def may_be(s):
        import pandas as pd

        return pd.Series(in_bitmap(held.value, s.to_numpy(dtype=np.int64, na_value=0)))

    return may_be


def keep_known(df: DataFrame, column: str, known: DataFrame, known_column: str, n: int) -> DataFrame:
    """Rows whose ``column`` may be among ``known``: a bounded bitmap, so a join need not shuffle the others. Lets false positives pass."""
    return df.where(_may_be(known, known_column, n)(F.col(column)))


def one_of_each(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value), one row of each key; equal keys have equal values. Only rows whose key may be repeated are shuffled, one of each key a task."""
    repeated = materialize(rows.groupBy(key).count().where("count > 1").select(key), "repeated")
    n = repeated.count()
    if n == 0:
        return rows.select(key, value)
    may = _may_be(repeated, key, n)(F.col(key))
    some = rows.where(may).groupBy(key).agg(F.first(value).alias(value))
    return rows.where(~may).select(key, value).unionByName(some)


def copies_of(ids: DataFrame, id_col: str) -> DataFrame:
    """One row for each id of ``ids`` (id, sid): the smallest id of equal text and the number of others."""
    m = ids.distinct()
    return m.join(m.groupBy("sid").agg(F.min("id").alias("copy_id"), (F.count("*") - 1).alias("n_copies")), "sid").select(F.col("id").alias(id_col), "copy_id", "n_copies")


def expand_classes(links: DataFrame, members: DataFrame, limit: int = EXPAND_COPIES) -> DataFrame:
    """Pairs (id_a, id_b) of ids out of links (sid_a, sid_b) between classes of equal texts and the pairs within a class.

    ``members`` has (id, sid). A class of more than ``limit`` equal texts counts with its first id in links, and its other
    ids are linked to that first id, so that the rows stay in proportion to the input.
    """
    m = members.distinct()
    cls = m.groupBy("sid").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    full = m.join(cls, "sid").where((F.col("n") <= limit) | (F.col("id") == F.col("first")))
    a, b = full.select(F.col("sid").alias("sid_a"), F.col("id").alias("x")), full.select(F.col("sid").alias("sid_b"), F.col("id").alias("y"))
    cross = links.select("sid_a", "sid_b").distinct().join(a, "sid_a").join(b, "sid_b").select("x", "y")
    small = full.where((F.col("n") > 1) & (F.col("n") <= limit))
    within = small.select("sid", F.col("id").alias("x")).join(small.select("sid", F.col("id").alias("y")), "sid").where("x < y").select("x", "y")
    star = m.join(cls.where(F.col("n") > limit), "sid").where("id <> first").select(F.col("first").alias("x"), F.col("id").alias("y"))
    pairs = cross.unionByName(within).unionByName(star).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
