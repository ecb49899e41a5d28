"""Session set-up and the few things every operator needs from it."""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build_session(app: str = "lexforge", cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine expects anywhere: AQE, ANSI, UTC, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = os.path.join(sc._temp_dir, "lexforge_src.zip")  # Spark's own folder; its file server sends it on
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset; one is chosen here then."""
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not have and sc._jsc.sc().getCheckpointDir().isDefined():
        have = sc._jsc.sc().getCheckpointDir().get()
    if not have:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = os.path.join(sc._temp_dir, "checkpoints")
        sc.setCheckpointDir(have)
    return have.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one: intermediate tables, of no use after it."""
    return f"{shared_dir(spark)}/lexforge-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that still have to read them must be written before."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of executors. ``release`` deletes it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
