"""Spark session defaults and the shared work folder of a job."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "docloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, submit-time settings win over these."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is absent a temporary folder is set for the session, but on one machine only (local masters): executors of a
    cluster don't share it.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex[:12]}"


def clear_work(spark: SparkSession) -> None:
    """Delete what operators have written to the shared folder; results that weren't saved can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, folders: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    folders: columns whose values are folders, so that a filter on them reads these only. codec: of the files, else the session's.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, partitionBy=folders, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most `most` rows (they are counted), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where a few small files would leave most cores idle."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # its parts are counted when it runs
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def table_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def in_utc(spark: SparkSession) -> None:
    """Timestamps without zone are UTC throughout."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    in_utc(spark)
    return spark.read.parquet(table_path(sf_dir, table))
