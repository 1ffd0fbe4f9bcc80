"""Incremental hashing: files as a stream, a hash table that grows, matches of what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.sources.files import digests, variants


def file_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """path, size, mtime and digests of files as they arrive below a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(most_files)).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *digests(F.col("content")))


def keep_hashes(files: DataFrame, table: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends each batch to the Parquet table in a folder of its number, so that a batch that runs
    again replaces its own rows; ``then`` gets the batch, e.g. to match it."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.dropDuplicates(["path", "size", "mtime"]).write.mode("overwrite").parquet(f"{table}/batch={number}")
        if then:
            then(rows.sparkSession.read.parquet(f"{table}/batch={number}"), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# All variants of a file that are looked for.
VARIANTS = ["whole", "header512", "header16", "swap16", "swap32"]
#: What a row of the hash table is known by; its size and time tell whether the file has changed since.
STATE = ["path", "size", "mtime"]


def with_variants(files: DataFrame) -> DataFrame:
    """A row for each file of ``files(path, size, mtime, content)`` and variant: its size and sha1, or nulls where the file has
    no such variant, which is a finding too and needn't be looked for again."""
    found = F.transform(variants(F.col("content"), F.col("size")), lambda v: F.struct(v["variant"], v))
    rows = files.withColumn("_found", F.map_from_entries(found)).withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    v = F.try_element_at("_found", F.col("variant"))
    return rows.select(*STATE, "variant", v["size"].alias("variant_size"), v["sha1"].alias("sha1"))


def current(spark: SparkSession, table: str) -> DataFrame:
    """The hash table as it stands: of each path the rows of its last batch."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"]).drop("batch")


def unknown(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that the table doesn't have in this size and of this time; what it knows to have no variant is known."""
    return files.join(state.select(*STATE).distinct(), STATE, "left_anti")


def keep_variants(files: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Upserts a stream of files, with their content, into the hash table: a batch writes rows for files that are
    new or have changed, in a folder of its number, and these take the place of a path's earlier rows. A batch
    that runs again writes the same folder again and doesn't take its own rows for known."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates(STATE)
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if there:
            earlier = spark.read.parquet(table).where(F.col("batch") < number)
            last = earlier.groupBy("path").agg(F.max("batch").alias("batch"))
            fresh = unknown(fresh, earlier.join(last, ["path", "batch"]))
        # of several states of a path in a batch the latest counts
        newest = fresh.groupBy("path").agg(F.max("mtime").alias("mtime"))
        with_variants(fresh.join(newest, ["path", "mtime"])).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matched_variants(state: DataFrame, catalogue: DataFrame) -> DataFrame:
    """path, variant, name of files whose variant is a row of ``catalogue(name, size, sha1)``: equal sizes and hashes."""
    right = catalogue.select("name", F.col("size").alias("variant_size"), "sha1")
    return state.where("sha1 is not null").join(right, ["variant_size", "sha1"]).select("path", "variant", "name")


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their sum by type and window of time; events later than ``late`` are not counted."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
