"""What a collection has of what the rules ask for."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combined(target: DataFrame, owned: DataFrame, key: list[str]) -> DataFrame:
    """state of each key: have, missing (asked for, not owned) or outside (owned, not asked for)."""
    both = target.select(*key, F.lit(True).alias("_asked")).join(owned.select(*key, F.lit(True).alias("_owned")), key, "full")
    state = F.when(F.col("_asked") & F.col("_owned"), "have").when(F.col("_asked"), "missing").otherwise("outside")
    return both.select(*key, state.alias("state"))


# States of an owned game, the one that counts first.
STATES = ["have", "incomplete", "excluded"]


def owned_states(items: DataFrame, game: list[str]) -> DataFrame:
    """state of each game over its items' ``action``: have if any is kept, else incomplete, else excluded;
    superseded items follow what they yield to and make no state of their own."""
    rank = F.when(F.col("action") == "keep", 0).when(F.col("action") == "incomplete", 1).when(F.col("action") == "excluded", 2)
    best = items.groupBy(*game).agg(F.min(rank).alias("_rank"))
    return best.where("_rank is not null").select(*game, F.get(F.array(*map(F.lit, STATES)), F.col("_rank")).alias("state"))


def shares(items: DataFrame, group: list[str], state: str) -> DataFrame:
    """games, and how many and what percentage (two decimals) are in each state, by group."""
    counts = items.groupBy(*group).agg(F.count(F.lit(1)).alias("games"), *[F.count_if(F.col(state) == s).alias(s) for s in STATES])
    return counts.withColumn("percent", F.round(F.col("have") * 100 / F.col("games"), 2))


def signature(*parts: object) -> str:
    """A short digest of rules and versions: the same for equal ones in every session, another for any change."""
    plain = [asdict(p) if is_dataclass(p) else p for p in parts]
    return hashlib.sha1(json.dumps(plain, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def kept_totals(catalogues: DataFrame, rules: object, compute: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """The rows of ``compute`` for all ``catalogues(dat, version)`` under ``rules``, from a table in ``folder`` where it has them.

    The table has a partition for each digest of rules, catalogue and version. ``compute`` gets the catalogues that have none yet
    and returns rows with their ``dat``; if all are there, no catalogue is read. Catalogues without rows are marked, so
    they aren't computed again. Results of other rules and versions stay for whoever comes back to them.
    """
    spark = catalogues.sparkSession
    rules_digest = signature(rules)
    asked = catalogues.select("dat", "version").distinct().withColumn("digest", F.left(F.sha2(F.concat_ws("\n", F.lit(rules_digest), "dat", "version"), 256), F.lit(32)))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        missing = asked.join(spark.read.parquet(folder).select("digest").distinct(), "digest", "left_anti")
    else:
        missing = asked
    if not missing.isEmpty():
        found = compute(missing.select("dat", "version"))
        # a row for each catalogue at least: one without rows has nulls
        whole = missing.join(found.withColumn("found", F.lit(True)), "dat", "left").drop("version")
        whole.write.mode("append").partitionBy("digest").parquet(folder)
    return spark.read.parquet(folder).where("found").join(asked.select("digest"), "digest", "left_semi").drop("digest", "found")
