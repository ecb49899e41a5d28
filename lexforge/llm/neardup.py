"""Near-duplicate texts by DartMinHash signatures, banded joining and an exact check.

Each text is a weighted set of word shingles. Darts are thrown by a hash into cells of (weight, rank) above every
element, all of area one, so an element of weight w keeps the darts that fall under w; each dart belongs to one of k coordinates
and the earliest dart of each coordinate is kept. Cells are flat and long near weight zero and tall and short far above, so work
is in proportion to elements + k log k for weights of any size. The chance that two sets keep the same dart equals their
(weighted) Jaccard similarity.

Defined cases: null and empty texts and texts below ``min_words`` have no links; repeated rows of an id count once; equal
texts form one class (see blocks.expand_classes) and linked classes one group (near_groups); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import textkit as K
from lexforge.llm.blocks import by_chars, expand_classes, keep_known
from lexforge.session import materialize, ship_package

U64 = np.uint64
ROWS, BANDS, SKETCH = 4, 32, 32  # 32 bands of 4 coordinates and 32 coordinates for the sketch of 4 bits each
COORDS = ROWS * BANDS + SKETCH
#: Of 32 sketch coordinates, a pair of similarity 0.6 agrees in fewer than 12 with a chance of 0.001.
SKETCH_LEAST = 12
#: A bucket beyond this many different texts is compared block by block, in tasks of its own.
BUCKET_BLOCK = 2_000


#: Weight bands below the first that may be empty are thrown at down to 2 ** -FAINT of a dart.
FAINT = 8


def _unit_darts(e: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, dart, rank) of elements of weight one: one dart in each cell of rank 1."""
    cells = high - low
    at = np.repeat(np.arange(len(e)), cells)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells) + low[at]
    dart = K.mix(e[at] + rank.astype(U64) * U64(0x9E3779B97F4A7C15))
    # the rank decides: its whole part, then 40 random bits
    return at, dart, (np.minimum(rank, (1 << 24) - 1).astype(U64) << U64(40)) | (dart >> U64(24))


def _area_darts(e: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, dart, rank) under any weights: band b holds the weights from 2**b to 2**(b+1), its cells are 2**-b ranks long."""
    top = np.floor(np.log2(w)).astype(np.int64)
    bottom = np.minimum(top, -np.ceil(np.log2(np.maximum(high, 1))).astype(np.int64) - FAINT)
    n = top - bottom + 1
    el = np.repeat(np.arange(len(e)), n)
    band = np.arange(len(el)) - np.repeat(np.cumsum(n) - n, n) + bottom[el]
    tall = np.exp2(band)
    first, last = np.floor(low[el] * tall).astype(np.int64), np.ceil(high[el] * tall).astype(np.int64)
    cells = last - first
    at = np.repeat(np.arange(len(el)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells) + first[at]
    el, tall, band = el[at], tall[at], band[at]
    dart = K.mix(K.mix(e[el] + cell.astype(U64) * U64(0x9E3779B97F4A7C15)) + band.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    share = lambda salt: (K.mix(dart ^ U64(salt)) >> U64(11)).astype(np.float64) / 2.0**53
    rank = (cell + share(0x5A5A5A5A)) / tall
    keep = (tall * (1 + share(0xA5A5A5A5)) < w[el]) & (rank >= low[el]) & (rank < high[el])
    el, dart, rank = el[keep], dart[keep], rank[keep]
    return el, dart, np.minimum(rank * 2.0**40, 2.0**63).astype(U64)


def dart_signatures(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray | None, n_docs: int, k: int = COORDS, seed: int = 1) -> np.ndarray:
    """[n_docs, k] earliest darts; ``doc`` is sorted. Rows of texts without elements hold the largest number only. Without weights all are one."""
    none = np.iinfo(U64).max
    out = np.full((n_docs, k), none, dtype=U64)
    w = np.ones(len(doc)) if weight is None else np.asarray(weight, dtype=np.float64)
    keep = w > 0
    doc, elem, w = doc[keep], elem[keep], w[keep]
    mass = np.bincount(doc, weights=w, minlength=n_docs)
    # rank bound of each document: enough darts that an empty coordinate is rare; doubled for those that have one
    bound = np.ceil(np.divide(k * (np.log(k) + 3), mass, out=np.zeros(n_docs), where=mass > 0)).astype(np.int64)
    low = np.zeros(n_docs, dtype=np.int64)
    alive = mass > 0
    flat = out.reshape(-1)
    while alive.any():
        use = alive[doc]
        d, e = doc[use], K.mix(elem[use] ^ U64(seed))
        at, dart, value = _unit_darts(e, low[d], bound[d]) if weight is None else _area_darts(e, w[use], low[d], bound[d])
        coord = ((dart & U64(0xFFFFFFFF)) * U64(k)) >> U64(32)
        np.minimum.at(flat, d[at] * k + coord.astype(np.int64), value)
        alive = alive & (out == none).any(axis=1)
        low, bound = bound, bound * 2
    return out


def count_weight(times: np.ndarray) -> np.ndarray:
    """The weight of a run of words by how often its text has it."""
    return 1 + np.log(times)


def signatures(texts: list[str | None], n: int, min_words: int, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts that take part, and their signatures."""
    doc, sh, times, n_words = K.shingle_counts(texts, n)
    ok = (n_words >= min_words) & (np.bincount(doc, minlength=len(texts)) > 0)
    use = ok[doc]
    return np.flatnonzero(ok), dart_signatures(doc[use], sh[use], count_weight(times[use]) if weighted else None, len(texts))[ok]


def pack_sketch(sig: np.ndarray) -> np.ndarray:
    """32 coordinates as 4 bits each, in two words."""
    nib = (K.mix(sig[:, ROWS * BANDS :].copy()) & U64(15)).reshape(-1, 2, 16)
    return np.bitwise_or.reduce(nib << (np.arange(16, dtype=U64) * U64(4)), axis=2)


def sketch_agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    x |= x >> U64(1)
    x |= x >> U64(2)
    return 32 - np.bitwise_count(x & U64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def band_rows(n: int, min_words: int, weighted: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.mix(np.arange(1, BANDS + 1, dtype=U64))
        for rb in batches:
            texts, sids = rb.column("text").to_pylist(), rb.column("sid").to_numpy()
            first = np.zeros(len(sids), dtype=bool)
            first[np.unique(sids, return_index=True)[1]] = True
            texts = [t if f else None for t, f in zip(texts, first)]
            for lo, hi in by_chars(texts):
                which, sig = signatures(texts[lo:hi], n, min_words, weighted)
                if not len(which):
                    continue
                key = np.zeros((len(which), BANDS), dtype=U64)
                for r in range(ROWS):
                    key = K.mix(key * U64(0x9FB21C651E98DF25) + sig[:, r : ROWS * BANDS : ROWS])
                key = K.mix(key + salt)
                sk = pack_sketch(sig).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64).reshape(-1))] + [pa.array(np.repeat(x, BANDS)) for x in (sids[lo:hi][which], sk[:, 0].copy(), sk[:, 1].copy())],
                    names=["bucket", "sid", "s0", "s1"],
                )

    return run


def _pairs_in_runs(key: np.ndarray, sid: np.ndarray, sk: np.ndarray, block: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at rows of the same key that agree enough; ``block`` restricts them to rows of two sides (0 and 1)."""
    left, right = [], []
    i = np.arange(len(key))
    step = 1
    while len(i):
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        ok = (sid[i] != sid[i + step]) & (sketch_agreement(sk[i], sk[i + step]) >= least)
        if block is not None:
            ok &= (block[i] != block[i + step]) | (block[i] == 2)
        left.append(sid[i[ok]])
        right.append(sid[(i + step)[ok]])
        step += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def bucket_pairs(least: int, block_size: int):
    """Over rows sorted by bucket: candidate pairs (kind 0), or the rows themselves of a bucket beyond block_size (kind 1)."""

    def out(kind, a, b, c, d):
        n = len(a)
        zero = np.zeros(n, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32))] + [pa.array(zero if x is None else x) for x in (a, b, c, d)], names=["kind", "x", "y", "s0", "s1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        hot = None

        def solve(rows: np.ndarray):
            keep = np.ones(len(rows), dtype=bool)
            order = np.lexsort((rows[:, 1], rows[:, 0]))
            rows = rows[order]
            keep[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            rows = rows[keep]
            edge = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0], [True])))
            size = np.repeat(np.diff(edge), np.diff(edge))
            big = size > block_size
            if big.any():
                r = rows[big]
                yield out(1, r[:, 0].copy(), r[:, 1].copy(), r[:, 2].copy(), r[:, 3].copy())
            r = rows[~big & (size > 1)]
            if len(r):
                a, b = _pairs_in_runs(r[:, 0], r[:, 1], r[:, 2:].view(U64), None, least)
                if len(a):
                    ab = np.unique(np.stack([a, b], 1), axis=0)
                    yield out(0, ab[:, 0].copy(), ab[:, 1].copy(), None, None)

        for rb in batches:
            rows = np.stack([rb.column(c).to_numpy() for c in ("bucket", "sid", "s0", "s1")], 1)
            if hot is not None:  # the rest of a bucket already known to be large
                n = int((rows[:, 0] == hot).sum())
                if n:
                    r = rows[:n]
                    yield out(1, r[:, 0].copy(), r[:, 1].copy(), r[:, 2].copy(), r[:, 3].copy())
                    rows = rows[n:]
                if not len(rows):
                    continue
                hot = None
            held.append(rows)
            if sum(map(len, held)) < 20_000:
                continue
            rows = np.concatenate(held)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield from solve(rows[:last])
            rest = rows[last:]
            if len(rest) > 20_000 and len(np.unique(rest[:, 1])) > block_size:
                hot = rest[0, 0]
                yield out(1, rest[:, 0].copy(), rest[:, 1].copy(), rest[:, 2].copy(), rest[:, 3].copy())
                rest = rest[:0]
            elif len(rest) > 20_000:
                rest = rest[np.unique(rest[:, 1], return_index=True)[1]]
            held = [rest] if len(rest) else []
        if held:
            yield from solve(np.concatenate(held))

    return run


def block_pairs(least: int):
    """Pairs of one (bucket, block, block) group of a large bucket."""

    def run(key, t):
        side = t.column("side").to_numpy()
        sid = t.column("sid").to_numpy()
        sk = np.stack([t.column("s0").to_numpy(), t.column("s1").to_numpy()], 1).view(U64)
        a, b = [], []
        left = np.flatnonzero(side != 1)
        right = np.flatnonzero(side != 0)
        for i in left:
            ok = right[(sketch_agreement(np.broadcast_to(sk[i], (len(right), 2)), sk[right]) >= least) & (sid[right] != sid[i])]
            a.append(np.full(len(ok), sid[i]))
            b.append(sid[ok])
        a = np.concatenate(a) if a else np.zeros(0, np.int64)
        b = np.concatenate(b) if b else np.zeros(0, np.int64)
        return pa.table({"x": np.minimum(a, b), "y": np.maximum(a, b)})

    return run


def _hot_pairs(hot: DataFrame, least: int, block_size: int) -> DataFrame:
    """All pairs of large buckets, as (block, block) groups spread over tasks: exact, and no task holds more than two blocks."""
    rows = hot.select(F.col("x").alias("bucket"), F.col("y").alias("sid"), "s0", "s1").distinct()
    size = rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block_size)).cast("int").alias("n"))
    r = rows.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("n")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    r = r.select(
        "bucket", "sid", "s0", "s1", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    return r.groupBy("bucket", "i", "j").applyInArrow(block_pairs(least), "x long, y long").select("x", "y")


def verify_pairs(n: int, threshold: float, min_words: int, weighted: bool = False):
    """Exact Jaccard similarity of the distinct shingles of both texts, or with ``weighted`` the sum of their lesser over that of their greater weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ta, tb = rb.column("text_a").to_pylist(), rb.column("text_b").to_pylist()
            for lo, hi in by_chars([a + b for a, b in zip(ta, tb)]):
                m = hi - lo
                doc, sh, times, n_words = K.shingle_counts(ta[lo:hi] + tb[lo:hi], n)
                w = count_weight(times) if weighted else np.ones(len(doc))
                size = np.bincount(doc, w, minlength=2 * m)
                pair = doc % m
                order = np.lexsort((sh, pair))
                s, p, w = sh[order], pair[order], w[order]
                same = (s[1:] == s[:-1]) & (p[1:] == p[:-1])
                both = np.bincount(p[1:][same], np.minimum(w[1:], w[:-1])[same], minlength=m)
                sim = both / np.maximum(1e-9, size[:m] + size[m:] - both)
                ok = np.flatnonzero((sim >= threshold - 1e-12) & (n_words[:m] >= min_words) & (n_words[m:] >= min_words))
                yield pa.RecordBatch.from_arrays(
                    [rb.column("sid_a").slice(lo, m).take(pa.array(ok)), rb.column("sid_b").slice(lo, m).take(pa.array(ok)), pa.array(sim[ok])],
                    names=["sid_a", "sid_b", "similarity"],
                )

    return run


def near_links(texts: DataFrame, n: int = 5, threshold: float = 0.8, min_words: int = 0, block_size: int = BUCKET_BLOCK, weighted: bool = False) -> DataFrame:
    """Links (sid_a, sid_b, similarity) between different texts of ``texts`` (sid, text) whose shingle similarity reaches the threshold (0.6 at least).

    With ``weighted`` a run of words weighs one and the logarithm of how often the text has it.
    """
    ship_package(texts.sparkSession)
    long_enough = texts.where(F.col("text").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    bands = long_enough.mapInArrow(band_rows(n, min_words, weighted), "bucket long, sid long, s0 long, s1 long")
    found = materialize(
        bands.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(bucket_pairs(SKETCH_LEAST, block_size), "kind int, x long, y long, s0 long, s1 long"),
        "near-candidates",
    )
    pairs = found.where("kind = 0").select("x", "y")
    hot = found.where("kind = 1")
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(hot, SKETCH_LEAST, block_size))
    pairs = materialize(pairs.distinct().select(F.col("x").alias("sid_a"), F.col("y").alias("sid_b")), "near-pairs")
    count = pairs.count()
    ids = pairs.select(F.explode(F.array("sid_a", "sid_b")).alias("sid"))
    part = keep_known(long_enough, "sid", ids, "sid", 2 * count).groupBy("sid").agg(F.first("text").alias("text"))
    a = part.select(F.col("sid").alias("sid_a"), F.col("text").alias("text_a"))
    b = part.select(F.col("sid").alias("sid_b"), F.col("text").alias("text_b"))
    return pairs.join(a, "sid_a").join(b, "sid_b").mapInArrow(verify_pairs(n, threshold, min_words, weighted), "sid_a long, sid_b long, similarity double")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("sid"))


def near_pairs(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, min_words: int = 0) -> DataFrame:
    """Pairs (id_a, id_b) of different ids with similar texts, copies included."""
    rows = keyed(df, id_col, text_col).where("id is not null and text is not null")
    links = materialize(near_links(rows.select("sid", "text"), n, threshold, min_words), "near-links")
    members = rows.select("id", "sid")
    repeated = members.distinct().groupBy("sid").count().where("count > 1").select("sid")
    # copies that aren't linked elsewhere must be long enough as well
    eligible = _long_classes(rows, repeated, min_words) if min_words else repeated
    wanted = links.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).unionByName(eligible).distinct()
    return expand_classes(links, members.join(wanted, "sid").select("id", "sid"))


def _long_classes(rows: DataFrame, repeated: DataFrame, min_words: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def long_enough(s):
        import pandas as pd

        t = s.tolist()
        out = np.zeros(len(t), dtype=bool)
        for lo, hi in by_chars(t):
            out[lo:hi] = np.bincount(K.words(t[lo:hi])[0], minlength=hi - lo) >= min_words
        return pd.Series(out)

    # one text of each class leaves its task: a class of a third of all rows isn't shuffled
    repeated = materialize(repeated, "near-repeated")
    one = keep_known(rows, "sid", repeated, "sid", repeated.count()).groupBy("sid").agg(F.first("text").alias("text"))
    return one.join(repeated, "sid", "left_semi").where(long_enough("text")).select("sid")


def weighted_links(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b, similarity) between the first ids of different texts whose weighted shingle similarity reaches the threshold; copies are members of their first id's class (near_groups)."""
    rows = keyed(df, id_col, text_col).where("id is not null and text is not null")
    links = materialize(near_links(rows.select("sid", "text"), n, threshold, weighted=True), "near-links")
    first = rows.groupBy("sid").agg(F.min("id").alias("id"))
    a, b = first.select(F.col("sid").alias("sid_a"), F.col("id").alias("x")), first.select(F.col("sid").alias("sid_b"), F.col("id").alias("y"))
    return links.join(a, "sid_a").join(b, "sid_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.round("similarity", 6).alias("similarity"))


def components(links: DataFrame) -> DataFrame:
    """(sid, root) of every sid in ``links`` (sid_a, sid_b): root is the smallest sid that can be reached from it.

    Large and small stars in turn: each vertex hands its larger, then its smaller neighbours on to the smallest one, until
    only stars are left. The rounds grow with the logarithm of the vertices; no component is gathered in one task.
    """

    def star(edges: DataFrame, out) -> DataFrame:
        low = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return materialize(edges.join(low, "u").select(F.inline(out)).where("u <> v").distinct(), "near-stars")

    def edge(u: str, v: str):
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    edges = materialize(links.select(F.greatest("sid_a", "sid_b").alias("u"), F.least("sid_a", "sid_b").alias("v")).where("u <> v").distinct(), "near-stars")
    while True:
        # a star: no vertex has two edges down, and none that is pointed to points on
        deep = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if edges.groupBy("u").count().where("count > 1").select("u").unionByName(deep).isEmpty():
            break
        both = edges.select(F.inline(F.array(edge("u", "v"), edge("v", "u"))))
        edges = star(both, F.when(F.col("v") > F.col("u"), F.array(edge("v", "m"))))
        edges = star(edges, F.array(edge("u", "m"), edge("v", "m")))
    roots = edges.select(F.col("v").alias("sid"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("sid"), F.col("v").alias("root")).unionByName(roots)


def near_groups(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, min_words: int = 0) -> DataFrame:
    """One row for each id: its group, its class of equal texts, the number of other ids with equal text, and the number of links of its text to other texts.

    A group (class_id, its smallest id) holds all ids whose texts are joined by a chain of links; copy_id is the smallest id of equal text.
    """
    rows = keyed(df, id_col, text_col).where("id is not null")
    links = materialize(near_links(rows.select("sid", "text"), n, threshold, min_words), "near-links")
    degree = links.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_links"))
    ids = rows.select("id", F.when(F.col("text").isNotNull(), F.col("sid")).alias("sid")).distinct()
    cls = materialize(ids.groupBy("sid").agg(F.min("id").alias("copy_id"), (F.count("*") - 1).alias("n_copies")), "near-classes")
    comp = materialize(components(links), "near-components")
    least = comp.join(cls, "sid").groupBy("root").agg(F.min("copy_id").alias("class_id"))
    linked = comp.join(least, "root").join(degree, "sid").select("sid", "class_id", "n_links")
    return (
        ids.join(cls.join(linked, "sid", "left"), "sid", "left")
        .select(
            F.col("id").alias(id_col), F.coalesce("class_id", "copy_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"),
            F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
