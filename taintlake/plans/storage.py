"""Cutting lineage through shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPTION = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.  Only a local master
    may fall back to a folder of its own, since all its tasks share the machine."""
    folder = spark.conf.get(_OPTION, None) or spark.sparkContext.getConf().get(_OPTION)
    if not folder:
        folder = _checkpoint_dir(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_OPTION} to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="taintlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """Bucketed tables of one job, in a database of its own below the shared folder.
    Rows are placed by hash of some columns when they are written; joins on those
    columns read them in place.  A dropped table's files go with it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"taintlake_{name}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_dir(spark)}/{self.name}'")
        self.made = 0

    def save(self, df: DataFrame, by: tuple[str, ...]) -> str:
        """Write a table placed by some columns; its name."""
        self.made += 1
        table = f"{self.name}.t{self.made}"
        df.repartition(self.buckets, *by).write.bucketBy(self.buckets, *by).sortBy(*by).format("parquet").saveAsTable(table)
        return table

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")


def saved(df: DataFrame, name: str, form: str = "parquet") -> DataFrame:
    """Write a DataFrame as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.format(form).save(path)
    return df.sparkSession.read.schema(df.schema).format(form).load(path)
