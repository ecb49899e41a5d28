"""Splitting by header hierarchy and by size."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.schemas import LEVELS

#: Greatest size, overlap and separators of the size split, coarsest first.
SIZE, OVERLAP, SEPARATORS = 1500, 150, ("\n\n", "\n", ".", " ", "")


def header_sections(docs: DataFrame, id_col: str, md_col: str) -> DataFrame:
    """(id, first_pos, level_1..level_5, content): the text between headers with the headers above it.

    A header ends all headers of its level and below; headers without text give nothing; neighbouring blocks under the same
    headers are one section. Windows run within one document.
    """
    line = LINE.replace("\\", "\\\\")  # Spark's string literals take a backslash as an escape
    lines = f"SELECT id, pos, {line} AS line FROM (SELECT {id_col} AS id, posexplode(split({md_col}, '\\n')) AS (pos, line) FROM {{docs}})"
    text = "array_join(transform(array_sort(collect_list(struct(pos, line))), x -> x.line), '\n')"
    view = f"docs_{uuid.uuid4().hex}"
    docs.createOrReplaceTempView(view)
    try:
        return docs.sparkSession.sql(SECTIONS.format(lines=lines.replace("{docs}", view), agg=text, titles=titles("last_value({}) IGNORE NULLS")))
    finally:
        docs.sparkSession.catalog.dropTempView(view)


#: A line without what isn't printed and without blanks at its ends; the same in both engines.
LINE = r"trim(regexp_replace(line, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ''))"
#: Shared by both engines: ``lines`` gives (id, pos, line). Within code fences no line is a header.
SECTIONS = """
    WITH k AS ({lines}),
    f AS (
        SELECT id, pos, line, CASE WHEN substr(line, 1, 3) IN ('```', '~~~') THEN 1 ELSE 0 END AS fence,
            length(regexp_extract(line, '^(#|##|###|####|#####)(?: |$)', 1)) AS header FROM k),
    l AS (
        SELECT id, pos, line, CASE WHEN coalesce(sum(fence) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 THEN 0 ELSE header END AS lvl FROM f),
    p AS (
        SELECT id, pos, line, lvl, {titles},
            max(CASE WHEN lvl = 1 THEN pos END) OVER w AS p1, max(CASE WHEN lvl = 2 THEN pos END) OVER w AS p2,
            max(CASE WHEN lvl = 3 THEN pos END) OVER w AS p3, max(CASE WHEN lvl = 4 THEN pos END) OVER w AS p4,
            max(CASE WHEN lvl = 5 THEN pos END) OVER w AS p5
        FROM l WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    live AS (
        SELECT id, pos, line, t1, t2, t3, t4, t5, coalesce(p1, -1) AS h1,
            CASE WHEN p2 > coalesce(p1, -1) THEN p2 ELSE -1 END AS h2,
            CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN p3 ELSE -1 END AS h3,
            CASE WHEN p4 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) THEN p4 ELSE -1 END AS h4,
            CASE WHEN p5 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1), coalesce(p4, -1)) THEN p5 ELSE -1 END AS h5
        FROM p WHERE lvl = 0 AND line <> '')
    SELECT id, min(pos) AS first_pos, max(CASE WHEN h1 >= 0 THEN t1 END) AS level_1, max(CASE WHEN h2 >= 0 THEN t2 END) AS level_2,
        max(CASE WHEN h3 >= 0 THEN t3 END) AS level_3, max(CASE WHEN h4 >= 0 THEN t4 END) AS level_4, max(CASE WHEN h5 >= 0 THEN t5 END) AS level_5,
        {agg} AS content
    FROM live GROUP BY id, h1, h2, h3, h4, h5
"""


def titles(form: str) -> str:
    """The last header text of each level; ``form`` is how an engine spells it."""
    return ", ".join(form.format(f"CASE WHEN lvl = {k} THEN trim(substr(line, {k + 1})) END") + f" OVER w AS t{k}" for k in range(1, 6))


def _split_on(text: str, separator: str) -> list[str]:
    """Parts of the text; each but the first begins with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [x for x in [head] + [separator + r for r in rest] if x]


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces below ``size`` characters where a separator allows it, at the coarsest separator that does; neighbours share up to ``overlap``."""
    if not text:
        return []
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    done: list[str] = []
    small: list[str] = []
    for part in _split_on(text, separators[at]):
        if len(part) < size:
            small.append(part)
            continue
        done += _merge(small, size, overlap)
        small = []
        done += split_text(part, size, overlap, separators[at + 1 :]) if separators[at + 1 :] else [part]
    return done + _merge(small, size, overlap)


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    """Join parts greedily; a new piece begins with the last parts of the one before, as far as they fit the overlap."""
    from collections import deque

    out: list[str] = []
    held: deque[str] = deque()
    total = 0
    for p in parts:
        if held and total + len(p) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def _split_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([split_text(t) for t in texts], dtype=object)


def size_split(c: Column) -> Column:
    """Array of pieces; texts within the size stay whole and never leave the JVM."""
    return F.when(F.length(c) <= SIZE, F.array(c)).otherwise(F.pandas_udf(_split_batch, "array<string>")(F.when(F.length(c) > SIZE, c)))


def number_chunks(sections: DataFrame, doc_col: str, order_cols: list[str], text_col: str) -> DataFrame:
    """Chunks of a document numbered over all its pieces before blank ones are dropped, so numbers may have gaps."""
    from pyspark.sql import Window

    from lexforge.functions.text import strip

    w = Window.partitionBy(doc_col).orderBy(*order_cols)
    numbered = sections.withColumn("chunk_no", F.row_number().over(w)).withColumn(text_col, strip(F.col(text_col)))
    return numbered.where(F.length(text_col) > 0).withColumn("chunk_id", F.concat(F.col(doc_col), F.lit("_chunk_"), F.col("chunk_no").cast("string")))


__all__ = ["LEVELS", "header_sections", "split_text", "size_split", "number_chunks"]
