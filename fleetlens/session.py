"""Spark session settings and shipping of this package to Python workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def get_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution; conf keys use "__" for "."."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever they run: its files go out once with the application."""
    sc = spark.sparkContext
    if getattr(sc, "_fleetlens_shipped", None) != sc.applicationId:
        path = Path(tempfile.mkdtemp()) / "fleetlens.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent).as_posix())
        sc.addPyFile(str(path))
        sc._fleetlens_shipped = sc.applicationId
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and all runs in one process (tests), a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp()}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written where every executor can read it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written once as Parquet, so that readers take only the columns they need."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(spark: SparkSession, name: str) -> DataFrame:
    """The catalog's table with its rows counted, so that joins are planned by rows times their width.

    By its files a panel of millions of rows is small (most of its values repeat),
    and a few columns of it would be broadcast through the driver.
    """
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    spark.conf.set("spark.sql.cbo.planStats.enabled", "true")  # or the count is not looked at
    return spark.table(name)


def tabled(df: DataFrame, path: str) -> DataFrame:
    """df, written once to path as a table whose rows are counted."""
    name = f"t_{uuid.uuid4().hex}"
    df.write.option("path", path).format("parquet").saveAsTable(name)
    return sized(df.sparkSession, name)


def bucketed(df: DataFrame, path: str, key: str, order: str | None = None) -> DataFrame:
    """df, written once as a table of as many buckets by key as there are shuffle partitions: windows and joins by key read it without a shuffle.

    The table lies at path and is known to the session's catalog. Rows are dealt
    to buckets before they are written, so a bucket is one file.
    """
    spark = df.sparkSession
    n, name = shuffle_partitions(spark), f"t_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet")
    (writer.sortBy(key, order) if order else writer).saveAsTable(name)
    return sized(spark, name)


def dealt_by_any_key(spark: SparkSession) -> None:
    """Lets a join by several keys use rows that lie dealt by one of them.

    By default a join by station and interval deals the dense panel anew, though
    all of a station's rows are in one task already; with this only the other,
    sparse side moves.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def resumed(df: DataFrame, path: str) -> DataFrame:
    """df, written to path once; where a run has done so already, what it wrote."""
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
