"""Stores the stages write to: pages, diagrams, an audit log, upserted tables, fetched responses; and the rescue of failed items."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators.crawlstate import last_wins, not_known, number_rows, split_rejects, upsert
from lexforge.session import materialize


def pages_to_store(items: DataFrame) -> DataFrame:
    """(item_id, file_html, full_text_html) of items with a page; the others write none."""
    return items.where("full_text_html is not null and full_text_html <> ''").select("item_id", F.concat(F.coalesce("item_id", F.lit("")), F.lit(".html")).alias("file_html"), "full_text_html")


def diagrams_to_store(items: DataFrame) -> DataFrame:
    """(item_id, file_diagram, diagram_json) of items with a valid, non-empty diagram, pretty-printed, letters beyond ASCII kept."""
    v = F.try_parse_json("diagram_json")
    some = items.where(v.isNotNull() & ~F.trim("diagram_json").isin("", "{}", "[]", "null", '""', "0", "false"))
    return some.select("item_id", F.concat(F.coalesce("item_id", F.lit("")), F.lit(".json")).alias("file_diagram"), F.to_json(v, {"pretty": "true"}).alias("diagram_json"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Append (question, answer, ...) to the log, one partition a day."""
    entries.withColumn("logged_at", F.current_timestamp()).withColumn("day", F.date_format(F.current_date(), "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


class UpsertTable:
    """A table by key as versions in one folder: a merge writes the next version beside the last, then points to it.

    A reader of the old version isn't disturbed, and a merge that fails leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        self.current: str | None = None

    def read(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if self.current is None else self.spark.read.schema(self.schema).parquet(self.current)

    def merge(self, new: DataFrame, seq: str | None = None) -> DataFrame:
        """Rows of ``new`` replace those of the same key; of several the last by ``seq`` counts."""
        new = last_wins(new, self.key, seq) if seq else new.dropDuplicates([self.key])
        target = f"{self.path}/v-{uuid.uuid4().hex}"
        columns = self.read().columns
        upsert(self.read(), new.select(*columns), self.key).write.parquet(target)
        self.current = target
        return self.read()


def fetch_missing(requests: DataFrame, cache: UpsertTable, fetch: Callable[[str], tuple[int, str]]) -> DataFrame:
    """(url, status, body) of every distinct url in ``requests``; only urls without a stored response are fetched, in the executors.

    ``fetch`` gives (status, body); its exceptions become status 0 with the message. Server errors and timeouts aren't stored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b.url:
                try:
                    rows.append((u, *fetch(u)))
                except Exception as e:
                    rows.append((u, 0, str(e)))
            yield pd.DataFrame(rows, columns=["url", "status", "body"])

    wanted = requests.where("url is not null").select("url").distinct()
    known = cache.read()
    got = materialize(not_known(wanted, known, "url").mapInPandas(run, "url string, status int, body string"), "fetched")
    out = known.join(wanted, "url", "left_semi").unionByName(got)
    out = materialize(out, "responses")
    cache.merge(got.where(~F.col("status").isin(0, 403, 404, 500, 503)))  # fixed values: statuses that aren't kept
    return out


def item_chain(items: DataFrame, diagrams: DataFrame, pages: DataFrame, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(complete, failed): items joined to the answers of their two look-ups (key, status, body), diagram then page.

    An item comes out complete only if both answered with 200, once for each key; a diagram that isn't JSON is null and doesn't stop its item.
    The others come out as failed, with the look-up that failed and why; the page isn't asked for where the diagram failed.
    """
    reply = lambda df, name: df.where(F.col(key).isNotNull()).select(key, F.struct("status", "body").alias(name)).dropDuplicates([key])
    j = items.where(F.col(key).isNotNull()).dropDuplicates([key]).join(reply(diagrams, "_d"), key, "left").join(reply(pages, "_p"), key, "left")
    fine = lambda name: F.coalesce(F.col(f"{name}.status") == 200, F.lit(False))
    why = lambda name: F.coalesce(F.concat(F.lit("status "), F.col(f"{name}.status").cast("string")), F.lit("no answer"))
    j = j.withColumn("failed_at_step", F.when(~fine("_d"), "diagram").when(~fine("_p"), "page")).withColumn("reason", F.when(~fine("_d"), why("_d")).when(~fine("_p"), why("_p")))
    data = F.to_json(F.coalesce(F.try_variant_get(F.try_parse_json("_d.body"), "$.data", "variant"), F.parse_json(F.lit("{}"))))
    diagram = F.when(F.try_parse_json("_d.body").isNotNull(), data)
    own = [c for c in items.columns if c not in ("diagram_json", "full_text_html")]
    complete = j.where("failed_at_step is null").select(*own, diagram.alias("diagram_json"), F.col("_p.body").alias("full_text_html"))
    return complete, j.where("failed_at_step is not null").select(*own, "failed_at_step", "reason")


def append_failed(failed: DataFrame, path: str) -> None:
    """Append failed items to the list that ``rescue`` starts from, as JSON lines with the time."""
    failed.withColumn("failed_at", F.current_timestamp()).write.mode("append").json(path)


def append_transcript(turns: DataFrame, path: str) -> None:
    """Append (session_id, role, content) to the transcripts; ``read_transcript`` gives them back in order."""
    turns.withColumn("said_at", F.current_timestamp()).withColumn("_n", F.monotonically_increasing_id()).write.mode("append").parquet(path)


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, turn, role, content): the turns of each session, numbered from 1 in the order of writing."""
    w = Window.partitionBy("session_id").orderBy("said_at", "_n")
    return spark.read.parquet(path).select("session_id", F.row_number().over(w).alias("turn"), "role", "content")


def write_markdown(pages: DataFrame, path: str) -> None:
    """One file ``doc_id``.md for each row (doc_id, md) in ``path``; a file of the same name is written anew. ``path`` is one all executors see."""
    conf = pages.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where = path if "://" in path or path.startswith("file:") else f"{conf.rstrip('/')}{path}" if not conf.startswith("file:") else f"file://{path}"
        store, base = fs.FileSystem.from_uri(where.replace("file:///", "file:///", 1))
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, text in zip(b.doc_id, b.md):
                with store.open_output_stream(f"{base}/{str(name).replace('/', '_')}.md") as f:
                    f.write((text or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(b)]})

    pages.where("doc_id is not null").select("doc_id", "md").mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()


def insert_batches(rows: DataFrame, path: str, checks: dict, order: str, size: int = 1000) -> tuple[DataFrame, int]:
    """Insert ``rows`` in batches of ``size`` under ``order``, one folder of ``path`` each; rows that fail a check are set aside one by one.

    Gives the rejected rows with their reasons and the number of stored ones.
    """
    good, bad = split_rejects(rows, checks)
    numbered = number_rows(good, [F.asc(order)]).withColumn("batch_no", F.floor((F.col("position") - 1) / size)).drop("position")
    numbered.write.mode("append").partitionBy("batch_no").parquet(path)
    return bad, rows.sparkSession.read.parquet(path).count()


def rescue(failed: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], key: str, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rescued, still failed): ``attempt(open, round)`` gives the rows that succeed now; at most ``rounds`` rounds, fewer if none is left."""
    open_, done = materialize(failed, "rescue-open"), None
    for r in range(1, rounds + 1):
        if open_.isEmpty():
            break
        got = materialize(attempt(open_, r), "rescue-got")
        done = got if done is None else done.unionByName(got)
        open_ = materialize(not_known(open_, got, key), "rescue-open")
    return (failed.limit(0) if done is None else done), open_
