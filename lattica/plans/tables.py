"""Loading of the tables, and tables kept between jobs in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evenly(df: DataFrame) -> DataFrame:
    """A table's rows over all cores: where a row's work is long, bytes make too few tasks of them.  It asks for the number of partitions, so ``df`` should be a scan."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, but only on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lattica/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, what: str = "kept") -> str:
    return f"{_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables and files that this application's operators have left in the shared folder.

    Results that haven't been written elsewhere can't be read any more.
    """
    _delete(spark, _folder(spark))


class Kept:
    """A table written to the shared folder, which cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, what: str = "kept"):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, what)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


#: Rows of a bucket, about, and buckets of a table at most.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 100_000


class Bucketed:
    """A table of about ``rows`` rows that is partitioned by ``keys`` once, so that joins on them move the other side only; ``drop`` it in the end."""

    def __init__(self, df: DataFrame, keys: list[str], rows: int):
        self.spark, self.name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
        self.path = new_path(self.spark, "bucketed")
        count = min(MOST_BUCKETS, max(1, -(-rows // BUCKET_ROWS)))
        df.repartition(count, *keys).write.bucketBy(count, *keys).sortBy(*keys).option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        _delete(self.spark, self.path)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null, where null equals null; the keys are those of ``left``."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def keep(df: DataFrame, what: str = "kept") -> DataFrame:
    return Kept(df, what).df


def r6(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits) + F.lit(0.0)
