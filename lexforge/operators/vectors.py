"""Exact cosine search: a stated set of queries, in bounded blocks, against every stored vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import ship_package


def usable(c: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite numbers that aren't all zero."""
    return (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(c, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, for single pairs; ``search`` is for many."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x


def _good(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers that aren't all zero; nulls have become NaN."""
    return np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)


#: Queries and rows that are multiplied at once: 16 MB of similarities.
QUERY_ROWS, CORPUS_ROWS = 512, 4_096


class _Best:
    """The k best rows of each query so far, all that tie with the k-th included: what a task gives is bounded by its queries unless rows tie."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.held, self.size = k, np.full(n, -np.inf), [], 0

    def add(self, a: int, sim: np.ndarray, ids: pa.Array) -> None:
        m = sim.shape[1] - min(self.k, sim.shape[1])
        own = np.partition(sim, m, axis=1)[:, m] if sim.shape[1] >= self.k else np.full(len(sim), -np.inf)
        self.floor[a : a + len(sim)] = np.maximum(self.floor[a : a + len(sim)], own)
        r, j = np.nonzero(sim >= self.floor[a : a + len(sim), None])
        self.held.append((r + a, sim[r, j], ids.take(pa.array(j))))
        self.size += len(r)
        if self.size > 4 * self.k * len(self.floor) + 100_000:
            self.shrink()

    def shrink(self) -> None:
        """Of equal similarities only the k smallest ids can count."""
        if not self.held:
            return
        r, sim = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        ids = pa.chunked_array([h[2] for h in self.held]).combine_chunks()
        keep = sim >= self.floor[r]
        r, sim, ids = r[keep], sim[keep], ids.filter(pa.array(keep))
        order = pc.sort_indices(pa.table({"r": r, "s": -sim, "i": ids}), sort_keys=[("r", "ascending"), ("s", "ascending"), ("i", "ascending")]).to_numpy()
        r, sim, ids = r[order], sim[order], ids.take(pa.array(order))
        first = np.arange(len(r)) - np.searchsorted(r, r) < self.k
        self.held, self.size = [(r[first], sim[first], ids.filter(pa.array(first)))], int(first.sum())

    def batches(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        self.shrink()
        for r, sim, ids in self.held:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(r)), ids, pa.array(sim)], names=["query_id", "id", "similarity"])


def search(queries: DataFrame, corpus: DataFrame, k: int = 3, dim: int = 64, most_queries: int = 20_000) -> DataFrame:
    """(query_id, id, similarity, rank): the k best of ``corpus`` (id, vec) for each of ``queries`` (query_id, vec).

    The queries are broadcast in blocks of about ``most_queries`` (10 MB at 64 numbers). The corpus is read once for each
    block and never shuffled: a task multiplies parts of QUERY_ROWS queries with parts of its rows, keeps the k best of each
    query so far, and gives those at its end. Similarities are rounded to 6 places; among equal ones the smaller id comes first.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    q = queries.where(F.size("vec") == dim).select("query_id", "vec")
    blocks = -(-max(1, q.count()) // most_queries)
    c = corpus.where(F.size("vec") == dim).select("id", "vec")
    id_type, q_type = (df.schema[n].dataType.simpleString() for df, n in ((corpus, "id"), (queries, "query_id")))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    out = None
    for b in range(blocks):
        part = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        m = _matrix(part.column("vec").combine_chunks(), dim) if len(part) else np.zeros((0, dim))
        good = _good(m)
        m = m[good]
        held = spark.sparkContext.broadcast((part.column("query_id").combine_chunks().filter(pa.array(good)) if len(part) else None, m / np.sqrt((m * m).sum(axis=1))[:, None] if len(m) else m))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, x = held.value
            best = _Best(len(x), k)
            for rb in batches:
                y = _matrix(rb.column("vec"), dim)
                good = _good(y)
                y, ids = y[good], rb.column("id").filter(pa.array(good))
                y /= np.sqrt((y * y).sum(axis=1))[:, None]
                for s in range(0, len(y) if len(x) else 0, CORPUS_ROWS):
                    for a in range(0, len(x), QUERY_ROWS):
                        best.add(a, np.round(x[a : a + QUERY_ROWS] @ y[s : s + CORPUS_ROWS].T, 6), ids.slice(s, CORPUS_ROWS))
            yield from best.batches(names)

        hits = c.mapInArrow(run, f"query_id {q_type}, id {id_type}, similarity double")
        best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out
