"""Work tables: results that several later plans read, written once to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if set; else a temporary folder on a local master, one in the warehouse on any other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "file://" + tempfile.mkdtemp(prefix="shelfmark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_remove, spark, base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name inside the work folder; it is removed when the driver ends."""
    path = f"{work_folder(spark)}/shelfmark/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what follows neither plans nor computes it again, and a lost
    executor costs none of it. Removed when the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_path = path
    return back


def discard(df: DataFrame) -> None:
    """Removes a saved table that no later plan reads."""
    _remove(df.sparkSession, df.saved_path)
