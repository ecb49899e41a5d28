"""New batches against all history, in bucketed tables of hashes.

What has been accepted is kept as a table of hashes, bucketed by hash, each with the first row that had it: hashes of exact
normalised contents (keys, whole texts) and of paragraphs. A batch is hashed, its distinct hashes are brought to the buckets
and joined there (the history is read where it lies, never shuffled or computed again), and the hashes not seen before are
appended. The table outlives the session: ``SeenHashes(spark, name, path=...)`` opens what an earlier one left there.

A batch of few hashes (LOOKUP at most) is looked up by value, so that of the history only the pages of the Parquet files
are read that may hold one of them; a larger batch reads the two numbers of each hash of the history once. Appended files are
merged when they hold as many rows as the rest, so all merging together costs in proportion to the history; buckets double then
if they have grown beyond BUCKET_ROWS.

Batches are taken in order. A row repeats a document if an earlier row, of an earlier batch or earlier in its own, has one
of its keys; it is reported with the first row of that document, found through the first row that had the key. A row whose
two keys belong to two documents accepted before is reported with the earlier one. A batch that is checked again after a
crash, when some of its hashes were appended already, gives the same rows.

Defined cases: null, empty and placeholder keys equal nothing; a null batch number counts after all others; repeated rows
(same row id) are one row; ties don't arise, as row ids order the rows; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import textkit as K
from lexforge.session import materialize, ship_package, work_dir

#: Buckets of a new history, and the rows of a bucket beyond which merging doubles their number.
BUCKETS, BUCKET_ROWS = 8, 4_000_000
#: Distinct hashes of a batch up to which they are looked up by value. Changes what is read, not the rows.
LOOKUP = 5_000
#: Rows of a page, the least that a look-up by value reads.
PAGE_ROWS = 2_000
#: Appends before which files aren't merged.
MERGE_AFTER = 8

# Cyrillic and Greek capitals that look like Latin ones.
LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТУХІЈЅЗЬ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "ABEKMHOPCTYXIJS3B" + "ABEZHIKMNOPTYX",
)
PLACEHOLDERS = {"", "UNKNOWN", "UNKNOWN-ID", "UNKNOWN_ID", "N/A", "NA", "NONE", "NULL", "-"}
_LEAD = re.compile(r"^(?:SO-?HIEU|KY-?HIEU|SO|NUMBER|NUM|NO)?[.:°º#]*(?=[0-9OIL])")
_DASH = re.compile(r"[‐-―⁃−﹘﹣－_~]")
_TAIL = re.compile(r"[.,;:!)\]]+$")
_PAD = re.compile(r"(?<![0-9A-Z])0+(?=[0-9])")


def number_key(s: str | None) -> str | None:
    """A document number without case, marks, blanks, invisible characters, lead words, padding and look-alikes; None for placeholders."""
    if s is None:
        return None
    t = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Mn", "Cf", "Cc") and not c.isspace())
    t = _DASH.sub("-", t.upper().replace("Đ", "D").translate(LOOKALIKES))
    t = _TAIL.sub("", t)
    if t in PLACEHOLDERS:
        return None
    t = _LEAD.sub("", t).replace("O", "0").replace("I", "1").replace("L", "1")
    return _PAD.sub("", t) or None


def item_key(s: str | None) -> str | None:
    """The number an item id denotes, whatever its padding, width or suffix; None for placeholders."""
    if s is None:
        return None
    t = "".join(c for c in unicodedata.normalize("NFKC", s) if unicodedata.category(c) not in ("Cf", "Cc") and not c.isspace())
    t = re.sub(r"(?:\.html?|\.0+)+$", "", t.lower())
    if t.upper() in PLACEHOLDERS:
        return None
    return (t.lstrip("0") or "0") if t.isdigit() else t


def _of_distinct(f: Callable, s: pd.Series) -> pd.Series:
    """``f`` of each different value once."""
    code, values = pd.factorize(s)
    return pd.Series([None, *map(f, values)], dtype=object).take(code + 1).reset_index(drop=True)


def _number_keys(s: pd.Series) -> pd.Series:
    return _of_distinct(number_key, s)


def _item_keys(s: pd.Series) -> pd.Series:
    return _of_distinct(item_key, s)


def _folded(s: pd.Series) -> pd.Series:
    return pd.Series(K.folded(s.tolist()), dtype=object)


def number_key_col(column: str):
    return F.pandas_udf(_number_keys, "string")(column)


def item_key_col(column: str):
    return F.pandas_udf(_item_keys, "string")(column)


def folded_col(column: str):
    return F.pandas_udf(_folded, "string")(column)


class SeenHashes:
    """A growing table (h, first): each hash with the first row that had it, bucketed by hash, in a folder that outlives the session.

    Each state is a small file ``state-N.json``; the highest counts. Appends and merges first write their data, then the next
    state, so what an interrupted one leaves is never taken for complete. One writer at a time.
    """

    def __init__(self, spark: SparkSession, name: str = "", buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{work_dir(spark)}/seen-{name}-{uuid.uuid4().hex}").rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._last_state() or {"number": 0, "table": None, "buckets": buckets or BUCKETS, "base": 0, "appends": 0}
        self.table: str | None = None

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _last_state(self) -> dict | None:
        if not self.fs.exists(self._at("")):
            return None
        names = [f.getPath().getName() for f in self.fs.listStatus(self._at(""))]
        numbers = [int(m.group(1)) for m in (re.fullmatch(r"state-([0-9]+)\.json", n) for n in names) if m]
        if not numbers:
            return None
        stream = self.fs.open(self._at(f"state-{max(numbers)}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _set(self, **changes) -> None:
        self.state = self.state | changes | {"number": self.state["number"] + 1}
        new = self._at(f".state-{uuid.uuid4().hex}")
        stream = self.fs.create(new)
        stream.write(bytearray(json.dumps(self.state).encode()))
        stream.close()
        if not self.fs.rename(new, self._at(f"state-{self.state['number']}.json")):
            raise RuntimeError(f"another writer has changed {self.path}")
        self.fs.delete(self._at(f"state-{self.state['number'] - 2}.json"), False)

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def _open(self, folder: str) -> str:
        """The folder's files as a bucketed table of this session's catalog."""
        name = f"seen_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (h BIGINT, first BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        return name

    def known(self) -> DataFrame:
        if self.state["table"] is None:
            return self.spark.createDataFrame([], "h long, first long")
        if self.table is None:
            self.table = self._open(self.state["table"])
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame, folder: str, table: str | None) -> str:
        """``rows`` into the folder, one file a bucket, sorted."""
        rows = rows.select("h", "first").repartition(self.buckets, "h")
        table = table or f"seen_{uuid.uuid4().hex}"
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "h").sortBy("h").option("parquet.page.row.count.limit", PAGE_ROWS).option("path", f"{self.path}/{folder}").saveAsTable(table)
        return table

    def append(self, new: DataFrame) -> None:
        """Add hashes that aren't in the table yet."""
        folder = self.state["table"] or f"rows-{uuid.uuid4().hex}"
        if self.state["table"] is not None:
            self.known()
        self.table = self._write(new, folder, self.table)
        self._set(table=folder, appends=self.state["appends"] + 1)
        if self.state["appends"] >= MERGE_AFTER and (total := self.rows()) >= 2 * self.state["base"]:
            self.merge(total)

    def rows(self) -> int:
        """From the files' footers."""
        return self.known().count()

    def merge(self, total: int) -> None:
        """All files of a bucket as one sorted file; a hash that an interrupted append left twice once. Twice the buckets if they are too large."""
        old, old_table, rows = self.state["table"], self.table, self.known().groupBy("h").agg(F.min("first").alias("first"))
        if total > BUCKET_ROWS * self.buckets:
            self.state["buckets"] *= 2
        folder = f"rows-{uuid.uuid4().hex}"
        self.table = self._write(rows, folder, None)
        self._set(table=folder, base=total, appends=0)
        self.spark.sql(f"DROP TABLE IF EXISTS {old_table}")
        self.fs.delete(self._at(old), True)

    def lookup(self, own: DataFrame, n: int) -> DataFrame:
        """(h, first) of the history for the ``n`` different hashes of ``own``, or all of it where they are many."""
        if n > LOOKUP or self.state["table"] is None:
            return self.known()
        wanted = [r.h for r in own.select("h").toLocalIterator()]
        # by value: row groups and pages whose least and greatest hash exclude all of them aren't read
        limit = "spark.sql.parquet.pushdown.inFilterThreshold"
        before = self.spark.conf.get(limit)
        self.spark.conf.set(limit, str(LOOKUP))
        try:
            return materialize(self.known().where(F.col("h").isin(wanted)), "batch-known")
        finally:
            self.spark.conf.set(limit, before)

    def release(self) -> None:
        """Delete the history."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.fs.delete(self._at(""), True)


def _met(seen: SeenHashes, keys: DataFrame) -> DataFrame:
    """(h, own, first) of the different hashes of a batch (row_id, h): its first row in the batch and in the history."""
    own = keys.repartition(seen.buckets, "h").groupBy("h").agg(F.min("row_id").alias("own"))
    if seen.state["table"] is None:
        return materialize(own.withColumn("first", F.lit(None).cast("long")), "batch-met")
    known = seen.known()
    if seen.state["base"] > LOOKUP:
        own = materialize(own, "batch-own")
        known, own = seen.lookup(own, own.count()), own.repartition(seen.buckets, "h")
    # the distinct hashes of the batch meet the history's buckets; hot keys count once here
    return materialize(own.join(known, "h", "left"), "batch-met")


def check_batch(seen: SeenHashes, keys: DataFrame) -> DataFrame:
    """The table (first_row_id, row_id) of the rows of one batch (row_id, h) that repeat a document; the batch's new hashes are appended."""
    met = _met(seen, keys)
    roots = met.select("h", F.least("first", "own").alias("root"))
    to = keys.join(roots, "h").groupBy("row_id").agg(F.min("root").alias("first_row_id")).where("first_row_id < row_id")
    to = materialize(to, "batch-hits")
    # a first row within the batch may itself repeat a document: follow it
    while True:
        step = to.select(F.col("row_id").alias("first_row_id"), F.col("first_row_id").alias("next"))
        if to.join(step, "first_row_id", "left_semi").isEmpty():
            break
        to = materialize(to.join(step, "first_row_id", "left").select("row_id", F.coalesce("next", "first_row_id").alias("first_row_id")), "batch-hits")
    new = met.where("first is null").join(to.select(F.col("row_id").alias("own"), "first_row_id"), "own", "left")
    seen.append(new.select("h", F.coalesce("first_row_id", "own").alias("first")))
    return to


def check_paragraphs(seen: SeenHashes, parts: DataFrame) -> DataFrame:
    """The table (row_id, full_copy_of, n_paragraphs, n_shared) of one batch (row_id, whole, h), whole contents and paragraphs; new hashes are appended."""
    met = _met(seen, parts)
    rows = parts.join(met, "h").groupBy("row_id").agg(
        F.min(F.when(F.col("whole"), F.nullif(F.least("first", "own"), F.col("row_id")))).alias("full_copy_of"),
        F.count(F.when(~F.col("whole"), 1)).alias("n_paragraphs"), F.count(F.when(~F.col("whole") & (F.col("first") != F.col("own")), 1)).alias("n_shared"),
    )
    rows = materialize(rows, "batch-result")
    seen.append(met.where("first is null").select("h", F.col("own").alias("first")))
    return rows


def by_batch(df: DataFrame, name: str):
    """``df`` (batch, ...) in one folder for each batch, so that a batch is read on its own; gives the function that reads one."""
    spark, path = df.sparkSession, f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows = df.withColumn("part", F.coalesce(F.col("batch").cast("string"), F.lit("none"))).drop("batch")
    rows.write.partitionBy("part").parquet(path)

    def read(b: int | None) -> DataFrame:
        return spark.read.schema(rows.schema).parquet(path).where(F.col("part") == ("none" if b is None else str(b))).drop("part")

    return read


def batches_of(df: DataFrame, batch_col: str) -> list[int | None]:
    """Batch numbers in order; there are as many as loads, not as rows."""
    got = [r[0] for r in df.select(batch_col).distinct().toLocalIterator()]
    return sorted(x for x in got if x is not None) + [None] * (None in got)


def replay(spark: SparkSession, batches: list, check: Callable, feed: Callable, schema: str, seen: SeenHashes) -> DataFrame:
    """The rows of all batches, checked in order, as one table; the history is deleted if it was made for this."""
    paths = [p for b in batches for p in {f.rsplit("/", 1)[0] for f in check(seen, feed(b)).inputFiles()}]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def document_keys(df: DataFrame, row_col: str = "row_id", batch_col: str = "batch_no", item_col: str = "item_id", number_col: str = "doc_number") -> DataFrame:
    """(batch, row_id, h): hashes of the normalised keys of each row; rows without keys have none."""
    ship_package(df.sparkSession)
    base = df.select(F.col(row_col).alias("row_id"), F.col(batch_col).alias("batch"), F.col(item_col).alias("item"), F.col(number_col).alias("number")).where("row_id is not null")
    hashed = base.select("batch", "row_id", F.explode(F.array(F.xxhash64(F.lit("item"), item_key_col("item")), F.xxhash64(F.lit("number"), number_key_col("number")))).alias("h"))
    return hashed.where(~F.col("h").isin(*_null_hashes(df.sparkSession))).distinct()


def repeated_documents(df: DataFrame, row_col: str = "row_id", batch_col: str = "batch_no", item_col: str = "item_id", number_col: str = "doc_number", seen: SeenHashes | None = None) -> DataFrame:
    """Replay the batches of ``df``: (first_row_id, row_id) of every row that repeats a document accepted before.

    With ``seen``, a standing history, what earlier calls accepted counts too, and what this one accepts stays there.
    """
    spark, own = df.sparkSession, seen is None
    seen = seen or SeenHashes(spark, "keys")
    feed = by_batch(document_keys(df, row_col, batch_col, item_col, number_col), "feed-keys")
    out = replay(spark, batches_of(df.where(F.col(row_col).isNotNull()), batch_col), check_batch, feed, "first_row_id long, row_id long", seen)
    if own:
        seen.release()
    return out


def _null_hashes(spark: SparkSession) -> list[int]:
    nothing = F.lit(None).cast("string")
    return list(spark.range(1).select(F.xxhash64(F.lit("item"), nothing), F.xxhash64(F.lit("number"), nothing)).first())


def paragraphs_seen(df: DataFrame, row_col: str, batch_col: str, text_col: str, splitter: str, seen: SeenHashes | None = None) -> DataFrame:
    """Content of every batch against all accepted before: (row_id, full_copy_of, n_paragraphs, n_shared, coverage).

    Paragraphs are the parts of the text between matches of ``splitter`` (a Java pattern), folded alike; those
    without any word are left out. ``full_copy_of`` is the first row with the same folded text, ``coverage`` the part of a row's
    paragraphs that rows of earlier batches have. With ``seen``, a standing history, what earlier calls accepted counts too.
    """
    spark, own = df.sparkSession, seen is None
    ship_package(spark)
    seen = seen or SeenHashes(spark, "paragraphs")
    base = df.select(F.col(row_col).alias("row_id"), F.col(batch_col).alias("batch"), F.col(text_col).alias("text")).where("row_id is not null")
    parts = F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("p")))
    parts = F.concat(parts, F.transform(F.split("text", splitter), lambda p: F.struct(F.lit(False).alias("whole"), p.alias("p"))))
    cut = base.where("text is not null").select("batch", "row_id", F.inline(parts)).withColumn("f", folded_col("p"))
    keep = F.when(F.col("whole"), F.length(F.trim("p")) > 0).otherwise(F.trim("f") != "")
    feed = by_batch(cut.where(keep).select("batch", "row_id", "whole", F.xxhash64("whole", "f").alias("h")).distinct(), "feed-paragraphs")
    out = replay(spark, batches_of(base, "batch"), check_paragraphs, feed, "row_id long, full_copy_of long, n_paragraphs long, n_shared long", seen)
    if own:
        seen.release()
    # rows without any text, or with neither content nor paragraphs, share nothing
    return base.select("row_id").distinct().join(out, "row_id", "left").select(
        "row_id", "full_copy_of", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_paragraphs", "n_shared")], F.round(F.coalesce(F.col("n_shared") / F.nullif("n_paragraphs", F.lit(0)), F.lit(0.0)), 6).alias("coverage"),
    )
