"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, on one machine (master local) a temporary one is set, else it fails:
    a folder of the driver's would be another one on each executor."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def grown(df: DataFrame) -> DataFrame:
    """A side of a join whose rows grow with the tables: it is sorted and merged, not broadcast. By its compressed bytes Spark
    takes a table of a million rows for a small one, and a broadcast is built in the driver's memory."""
    return df.hint("merge")


#: Rows that a task gets of a table dealt by key.
DEALT = 1 << 18


def by_key(rows: DataFrame, key: str | list[str], many: int = 0) -> DataFrame:
    """Rows dealt by a key, of one column or several, before they are grouped, to as many tasks as a shuffle has; to more, if so
    many rows ask for more at DEALT rows each, so that a task's memory does not grow with the table. A key's rows lie apart
    before that, so that sums made there would be about one a row, and tasks that are put together by the bytes they read would
    hold the sums of too many keys."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // DEALT)), *([key] if isinstance(key, str) else key))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what saved() wrote, once nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
