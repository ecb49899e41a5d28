"""Incremental ingest as a stream: new items once, in micro-batches, resumable from a checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.session import work_dir


def ingest_new_items(spark: SparkSession, path: str, schema, key: str, out: str | None = None, state: str | None = None, files_per_batch: int = 4) -> DataFrame:
    """Append one row of every key under ``path`` to ``out``; keys that ``out`` has stay out. Null keys are dropped.

    What was taken is known from ``out`` itself, of which a batch reads the keys only; the stream holds no state but its place among the
    files, so its memory doesn't grow.
    """
    base = f"{work_dir(spark)}/ingest-{uuid.uuid4().hex}"
    out, state = out or f"{base}/out", state or f"{base}/state"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).where(f"{key} is not null")

    def write(batch: DataFrame, number: int) -> None:
        new, s = batch.dropDuplicates([key]), batch.sparkSession
        if _exists(s, out):
            # a batch done again writes the same place, so its own rows don't count as taken
            taken = s.read.schema(batch.schema).parquet(f"{out}/batch=*").withColumn("_at", F.element_at(F.split(F.input_file_name(), "/"), -2))
            new = new.join(taken.where(F.col("_at") != f"batch={number}").select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*") if _exists(spark, out) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
