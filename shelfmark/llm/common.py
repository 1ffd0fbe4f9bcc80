"""What the operators of this subpackage share: the work folder, saved tables, reading inputs."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes that a Python task gets at once at most, as texts can be very long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def in_batches(df: DataFrame, work: Callable, schema) -> DataFrame:
    """``mapInPandas`` with batches bounded in rows and bytes, so that a task's memory does not
    follow the length of the texts. The bounds are settings of the session."""
    _bound_batches(df.sparkSession)
    return df.mapInPandas(work, schema)


def in_arrow(df: DataFrame, work: Callable, schema) -> DataFrame:
    """The same with Arrow batches, which keep columns that pass through as they are: pandas would
    turn whole numbers with a null among them into floats and round the large ones."""
    _bound_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if set.

    Where it is unset, a local master gets a temporary folder and any other master a folder in
    the warehouse, and the setting is made for the rest of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_remove, spark, base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name inside the work folder; it is removed when the driver ends."""
    path = f"{work_dir(spark)}/shelfmark/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def saved(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the work folder and read it back: a cut in the lineage that
    outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes saved tables that no later plan reads."""
    for df in tables:
        _remove(df.sparkSession, df.saved_path)


def most_frequent(counts: DataFrame, size: int) -> dict[str, int]:
    """The most frequent of ``counts(word, n)``, at most ``size`` of them: all that occur more often
    than the first that would not fit, so that ties at the border stay out together.

    The border comes from the number of words of each count, a table of few rows; what reaches the
    driver does not grow with the number of partitions, as the parts of a top-n sort would.
    """
    known = saved(counts.select("word", "n"), "word-counts")
    left, border = size, 0
    for r in sorted(known.groupBy("n").count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            border = r["n"]
            break
    found = {r["word"]: r["n"] for r in known.where(F.col("n") > border).collect()}
    discard(known)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_keys(columns: list[str]) -> list[Column]:
    """_key1, _key2: two 64-bit hashes of all columns, nulls told from values; only repeated rows agree in both."""
    parts = [*columns, *(F.col(c).isNull() for c in columns)]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "_key1"), (2, "_key2"))]


def whole_text(column: str = "text"):
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """The saved rows of ``df`` with an ``id``: 1, 2, 3 and so on, by ``order`` if one is given.

    Tasks number their own rows, and the driver adds up how many each task has; the rows stay where they are.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    own = F.monotonically_increasing_id()
    rows = saved(ranges.select("*", F.spark_partition_id().alias("_part"), own.bitwiseAND((1 << 33) - 1).alias("_nth")), name)
    before, offsets = 0, []
    for r in sorted(rows.groupBy("_part").count().collect()):
        offsets.append((r["_part"], before))
        before += r["count"]
    parts = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return rows.join(F.broadcast(parts), "_part").select(*df.columns, (F.col("_before") + F.col("_nth") + 1).alias("id"))
