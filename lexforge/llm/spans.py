"""Long exact spans shared between records, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half the least length; a stretch of the least length holds a
whole block wherever it lies. The blocks are the index and every rolling window of every text probes it. A block and the
windows are found by their landmark: the leftmost of the grams (short windows) within it whose hash is least. Equal windows
have equal landmarks at equal offsets, and neighbouring windows mostly share one. A landmark is keyed by the hashes of the two
windows of a block's size that begin and that end with it; one of them lies within the shared stretch with the block. So a run of
windows of one landmark probes as two rows, equal keys mean equal windows, and what is shuffled is a fixed small part of the
characters, whatever the size of the corpus: no filter has to be sized, none fills up. Hits on one diagonal of two texts are
extended to their maximal exact repeats by comparing the texts themselves.

A key that stands in very many places (a footer, a ruled line) would give pairs for nothing. Windows of the full least
length around such places are looked at instead, first by nearly as long landmarks, then by their own hashes; only texts that
do share such a window make a pair, and pairs of a hot window are made by many tasks (salted).

``shared_parts`` makes no pairs: a run of windows whose surroundings another text has as well is shared as a whole, the windows
of the other runs are counted by hash.

Defined cases: null, empty and short texts share nothing; equal texts form one class (blocks.expand_classes); repeated rows
of an id count once; extra columns are ignored; an empty table gives no rows. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm import textkit as K
from lexforge.llm.blocks import by_chars, expand_classes, keep_known, one_of_each
from lexforge.session import materialize, ship_package

#: Places of a key beyond which its surroundings are looked at by windows of the full length. Changes the plan, not the rows.
HOT_BLOCK = 200
#: Texts of one window that meet in a task as one side of the pairs.
PAIR_BLOCK = 2_000
#: Characters of one text handled at once; longer texts go in overlapping parts.
PART_CHARS = 4_000_000
_PLACE = np.uint64((1 << 24) - 1)


def _least_grams(h: np.ndarray, width: int) -> np.ndarray:
    """For each place the place of the leftmost least hash among it and the ``width`` - 1 after it; places too near the end are left out."""
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    n, step = len(h) - width + 1, 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < width:
        m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
    return (m[:n] & _PLACE).astype(np.int64)


def _parts(texts: list[str], overlap: int) -> Iterator[tuple[int, int, str]]:
    """(text, place, characters): texts, the very long ones in parts that overlap by ``overlap``."""
    step = max(PART_CHARS, 2 * overlap)
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - overlap), step):
            yield i, s, t if len(t) <= step else t[s : s + step + overlap]


def landmark_runs(texts: list[str], size: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, landmark hash, its place, first and last start of the windows of ``size`` that have it), arrays for bounded groups of texts."""
    parts = list(_parts(texts, size - 1))
    for lo, hi in by_chars([p[2] for p in parts]):
        group = parts[lo:hi]
        c = K.codes("".join(p[2] for p in group))
        if len(c) < size:
            continue
        n = np.fromiter((len(p[2]) for p in group), np.int64, len(group))
        base = np.cumsum(n) - n
        of = np.repeat(np.arange(len(group)), n)
        start = np.arange(len(c) - gram + 1)
        h = K.span_hash(K.prefix_hash(c), start, start + gram)
        at = _least_grams(h, size - gram + 1)
        s = np.flatnonzero(of[: len(at)] == of[size - 1 :])  # windows within one text
        if not len(s):
            continue
        mark, own = at[s], of[s]
        first = np.ones(len(s), dtype=bool)
        first[1:] = (mark[1:] != mark[:-1]) | (own[1:] != own[:-1])
        i = np.flatnonzero(first)
        j = np.append(i[1:], len(s)) - 1
        p = own[i]
        text, shift = (np.array([g[k] for g in group], dtype=np.int64)[p] for k in (0, 1))
        shift = shift - base[p]
        yield text, h[mark[i]].view(np.int64), mark[i] + shift, s[i] + shift, s[j] + shift


def anchors(size: int, gram: int):
    """(h, sid, pos, block): the windows of ``size`` that begin and that end with a landmark; block is 1 if it is one of a reference block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sids, texts = rb.column("sid").to_numpy(), rb.column("text").to_pylist()
            for lo, hi in by_chars(texts):
                part = texts[lo:hi]
                n = np.fromiter(map(len, part), np.int64, len(part))
                base, held = np.cumsum(n) - n, K.prefix_hash(K.codes("".join(part)))
                for text, _, pos, first, last in landmark_runs(part, size, gram):
                    block = (-(-first // size) * size <= last).astype(np.int32)
                    text, start, block = np.concatenate([text, text]), np.concatenate([pos, pos + gram - size]), np.concatenate([block, block])
                    fits = (start >= 0) & (start + size <= n[text])
                    text, start, block = text[fits], start[fits], block[fits]
                    h = K.span_hash(held, base[text] + start, base[text] + start + size)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sids[lo:hi][text]), pa.array(start.astype(np.int32)), pa.array(block)], names=["h", "sid", "pos", "block"])

    return run


def key_pairs(hot: int):
    """Over rows sorted by h: diagonals (kind 0, sid_a, sid_b, delta) of a block and a window of equal key; of a key of more than ``hot`` rows those rows (kind 1, sid, pos)."""

    def out(kind, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32))] + [pa.array(x.astype(np.int64)) for x in (a, b, c)], names=["kind", "x", "y", "delta"])

    def solve(h: np.ndarray, sid: np.ndarray, pos: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        size = np.repeat(np.diff(edge), np.diff(edge))
        big = size > hot
        if big.any():
            yield out(1, sid[big], sid[big], pos[big])
        some = (size > 1) & ~big
        h, sid, pos, block = h[some], sid[some], pos[some], block[some]
        i, step = np.arange(len(h)), 1
        while len(i):
            i = i[i + step < len(h)]
            i = i[h[i] == h[i + step]]
            j = i + step
            ok = (sid[i] != sid[j]) & ((block[i] | block[j]) == 1)
            a, b, d = sid[i[ok]], sid[j[ok]], pos[i[ok]] - pos[j[ok]]
            if len(a):
                flip = a > b
                yield out(0, np.where(flip, b, a), np.where(flip, a, b), np.where(flip, -d, d))
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, open_hot = 0, None
        for rb in batches:
            rows = [rb.column(c).to_numpy() for c in ("h", "sid", "pos", "block")]
            if open_hot is not None:  # the rest of a key already known to be hot
                n = int(np.searchsorted(rows[0] != open_hot, True))
                if n:
                    yield out(1, rows[1][:n], rows[1][:n], rows[2][:n])
                if n == len(rows[0]):
                    continue
                rows, open_hot = [x[n:] for x in rows], None
            held.append(rows)
            size += len(rows[0])
            if size < 50_000:
                continue
            rows = [np.concatenate([x[c] for x in held]) for c in range(4)]
            last = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if (rows[0] != rows[0][-1]).any() else 0
            yield from solve(*(x[:last] for x in rows))
            rest = [x[last:] for x in rows]
            if len(rest[0]) > hot:
                open_hot = rest[0][0]
                yield out(1, rest[1], rest[1], rest[2])
                held, size = [], 0
            else:
                held, size = [rest], len(rest[0])
        if held:
            yield from solve(*(np.concatenate([x[c] for x in held]) for c in range(4)))

    return run


def landmarks(size: int, gram: int, around: int):
    """(h, sid, pos, first, last, off): runs of windows of one landmark; off is the hash of the landmark with ``around`` characters on either side (null at the ends of a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sids, texts = rb.column("sid").to_numpy(), rb.column("text").to_pylist()
            for text, h, pos, first, last in landmark_runs(texts, size, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(sids[text]), pa.array(pos.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), _surroundings(texts, text, pos, gram, around)],
                    names=["h", "sid", "pos", "first", "last", "off"],
                )

    return run


def _surroundings(texts: list[str], text: np.ndarray, pos: np.ndarray, gram: int, around: int) -> pa.Array:
    """Hashes of the stretches from ``around`` before to ``around`` after each landmark; null where the text ends before."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    fits = (pos >= around) & (pos + gram + around <= n[text])
    out = np.zeros(len(text), dtype=np.int64)
    for lo, hi in by_chars(texts):
        i = np.flatnonzero(fits & (text >= lo) & (text < hi))
        if len(i):
            base = np.cumsum(n[lo:hi]) - n[lo:hi]
            s = base[text[i] - lo] + pos[i] - around
            out[i] = K.span_hash(K.prefix_hash(K.codes("".join(texts[lo:hi]))), s, s + gram + 2 * around).view(np.int64)
    return pa.array(out, mask=~fits)


def landmarks_at(size: int, gram: int, inner: int):
    """As landmarks, of the windows that hold one of the ``inner`` characters from a place in ``places`` whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sids, texts, places = rb.column("sid").to_numpy(), rb.column("text").to_pylist(), rb.column("places").to_pylist()
            near = [np.zeros(len(t) + 2, dtype=np.int32) for t in texts]
            for held, at in zip(near, places):
                p = np.array(at, dtype=np.int64)
                np.add.at(held, np.maximum(0, p + inner - size), 1)
                np.add.at(held, p + 1, -1)
                np.cumsum(held, out=held)
                np.cumsum(held > 0, out=held)  # windows up to a place that count
            for text, h, _, first, last in landmark_runs(texts, size, gram):
                some = np.fromiter((near[i][b] > (near[i][a - 1] if a else 0) for i, a, b in zip(text, first, last)), bool, len(text))
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(sids[text[some]])] + [pa.array(x[some].astype(np.int32)) for x in (first, last)], names=["h", "sid", "first", "last"])

    return run


def window_hashes(size: int):
    """(h, sid, pos): the windows of ``size`` that begin in one of the ``runs`` (first, last) of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for sid, text, runs in zip(rb.column("sid").to_pylist(), rb.column("text").to_pylist(), rb.column("runs").to_pylist()):
                held = K.prefix_hash(K.codes(text))
                start = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs]))
                for k in range(0, len(start), 100_000):
                    s = start[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(K.span_hash(held, s, s + size).view(np.int64)), pa.array(np.full(len(s), sid)), pa.array(s.astype(np.int32))], names=["h", "sid", "pos"])

    return run


def extend(least: int):
    """Maximal equal stretches of at least ``least`` along the diagonals of pairs of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for a, b, ta, tb, deltas in zip(*(rb.column(c).to_pylist() for c in ("sid_a", "sid_b", "text_a", "text_b", "deltas"))):
                x, y = K.codes(ta), K.codes(tb)
                for d in deltas:  # place in a = place in b + d
                    lo, hi = max(0, d), min(len(x), len(y) + d)
                    edge = np.flatnonzero(np.concatenate(([True], x[lo:hi] != y[lo - d : hi - d], [True])))
                    run_len = np.diff(edge) - 1
                    for k in np.flatnonzero(run_len >= least):
                        s = lo + int(edge[k])
                        out.append((a, b, s, s - d, int(run_len[k])))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())] + [pa.array(c, pa.int32()) for c in cols[2:]], names=["sid_a", "sid_b", "start_a", "start_b", "length"])

    return run


def _in_two(rows: DataFrame, *key: str) -> DataFrame:
    """(key, n): keys that rows of two different texts have, and the number of their rows; counted before the shuffle, so no key gathers."""
    return rows.groupBy(*key).agg(F.min("sid").alias("_a"), F.max("sid").alias("_b"), F.count("*").alias("n")).where("_a < _b").select(*key, "n")


def _with_texts(texts: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (sid, ...), one of each sid, with their texts; the other texts aren't shuffled."""
    rows = materialize(rows, name)
    return keep_known(texts, "sid", rows, "sid", rows.count()).join(rows, "sid")


def _window_pairs(texts: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Pairs (sid_a, sid_b) of texts with an equal window of ``least`` characters among the runs (sid, first, last) of ``rows``."""
    runs = rows.groupBy("sid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    hashed = _with_texts(texts, runs, "spans-runs").mapInArrow(window_hashes(least), "h long, sid long, pos int")
    hashed = materialize(hashed.select("h", "sid").distinct(), "spans-windows")
    keys = _in_two(hashed, "h").withColumn("n", F.ceil(F.col("n") / PAIR_BLOCK).cast("long"))
    live = hashed.join(keys, "h")
    x = live.select("h", F.col("sid").alias("x"), F.pmod(F.xxhash64("sid"), F.col("n")).alias("salt"))
    y = live.select("h", F.col("sid").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"))
    return x.join(y, ["h", "salt"]).where("x < y").select(F.col("x").alias("sid_a"), F.col("y").alias("sid_b"))


def _cold_and_hot(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate diagonals (sid_a, sid_b, delta), and pairs (sid_a, sid_b) around hot keys if there are any."""
    size = least // 2
    gram = max(1, size * 3 // 25)
    rows = texts.mapInArrow(anchors(size, gram), "h long, sid long, pos int, block int")
    found = rows.repartition("h").sortWithinPartitions("h").mapInArrow(key_pairs(HOT_BLOCK), "kind int, x long, y long, delta long")
    found = materialize(found, "spans-found")
    pairs = found.where("kind = 0").select(F.col("x").alias("sid_a"), F.col("y").alias("sid_b"), "delta").distinct()
    hot = found.where("kind = 1")
    if hot.isEmpty():
        return pairs, None
    places = hot.groupBy(F.col("x").alias("sid")).agg(F.collect_set(F.col("delta").cast("int")).alias("places"))
    long_gram = max(gram, least - max(1, least // 20))
    around = materialize(_with_texts(texts, places, "spans-places").mapInArrow(landmarks_at(least, long_gram, size), "h long, sid long, first int, last int"), "spans-around")
    return pairs, _window_pairs(texts, around.join(_in_two(around, "h"), "h", "left_semi"), least)


def shared_stretches(texts: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Maximal stretches (sid_a, sid_b, start_a, start_b, length) on the diagonals ``pairs`` of ``texts`` (sid, text)."""
    pairs = materialize(pairs, "spans-pairs")
    n = pairs.count()
    grouped = pairs.groupBy("sid_a", "sid_b").agg(F.collect_set("delta").alias("deltas"))
    part = keep_known(texts, "sid", pairs.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")), "sid", 2 * n)
    a = part.select(F.col("sid").alias("sid_a"), F.col("text").alias("text_a"))
    b = part.select(F.col("sid").alias("sid_b"), F.col("text").alias("text_b"))
    return grouped.join(a, "sid_a").join(b, "sid_b").mapInArrow(extend(least), "sid_a long, sid_b long, start_a int, start_b int, length int")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("sid")).where("id is not null and text is not null")


def _long_texts(rows: DataFrame, least: int) -> DataFrame:
    """(sid, text), each different text of at least ``least`` characters once."""
    ship_package(rows.sparkSession)
    return one_of_each(rows.select("sid", "text").where(F.length("text") >= least), "sid", "text")


def sharing_pairs(df: DataFrame, id_col: str, text_col: str, least: int = 400) -> DataFrame:
    """Pairs (id_a, id_b) of different ids that share a stretch of at least ``least`` characters."""
    rows = keyed(df, id_col, text_col)
    texts = _long_texts(rows, least)
    diagonals, hot = _cold_and_hot(texts, least)
    links = shared_stretches(texts, diagonals, least).select("sid_a", "sid_b")
    links = materialize((links if hot is None else links.unionByName(hot)).distinct(), "spans-found")
    return expand_classes(links, rows.where(F.length("text") >= least).select("id", "sid"))


def _shared_windows(texts: DataFrame, least: int) -> DataFrame:
    """(sid, s, e): stretches, overlapping, that together cover every window of ``least`` characters that another text has too. No pairs are made."""
    gram = max(1, least * 3 // 4)
    rows = materialize(texts.mapInArrow(landmarks(least, gram, least - gram), "h long, sid long, pos int, first int, last int, off long"), "spans-landmarks")
    live = materialize(rows.join(_in_two(rows, "h").select("h"), "h", "left_semi"), "spans-live")
    # the windows of a run lie within its surroundings: if another text has those, it has them all
    whole = _in_two(live.where("off is not null"), "h", "off").select("h", "off", F.lit(1).alias("all"))
    split = materialize(live.join(whole, ["h", "off"], "left"), "spans-split")
    spans = split.where("all = 1").select("sid", F.col("first").alias("s"), (F.col("last") + least).alias("e"))
    rest = split.where("all is null").groupBy("sid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    # those windows may be equal to windows within runs that are shared as a whole, so their texts' runs of the same landmark count as well
    others = split.join(split.where("all is null").select("h").distinct(), "h", "left_semi").where("all = 1").groupBy("sid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    both = rest.unionByName(others).groupBy("sid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    hashed = materialize(_with_texts(texts, both, "spans-runs").mapInArrow(window_hashes(least), "h long, sid long, pos int"), "spans-windows")
    single = hashed.join(_in_two(hashed, "h").select("h"), "h", "left_semi").select("sid", F.col("pos").alias("s"), (F.col("pos") + least).alias("e"))
    return spans.unionByName(single)


def shared_parts(df: DataFrame, id_col: str, text_col: str, least: int = 400) -> DataFrame:
    """One row for each id: its length, how many of its characters lie in stretches found elsewhere too, their share, and the number of such stretches after merging."""
    rows = keyed(df, id_col, text_col)
    spans = _shared_windows(_long_texts(rows, least), least)
    ids = rows.select("id", "sid", F.length("text").alias("n_chars")).distinct()
    copies = ids.groupBy("sid", "n_chars").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n_chars") >= least))
    spans = spans.unionByName(copies.select("sid", F.lit(0).alias("s"), F.col("n_chars").alias("e"))).groupBy("sid", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("sid").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.max("e").over(w), F.lit(0)))
    per = spans.groupBy("sid").agg(
        F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before"))).alias("shared"),
        F.sum(F.when((F.col("s") > F.col("before")) | (F.col("before") == 0), 1).otherwise(0)).alias("stretches"),
    )
    return ids.join(per, "sid", "left").select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"),
        F.round(F.coalesce("shared", F.lit(0)) / F.greatest(F.lit(1), "n_chars"), 6).alias("shared_part"), F.coalesce("stretches", F.lit(0)).cast("long").alias("n_stretches"),
    )
