"""Selection rules: eligibility, picking one of a group, top-N with ties, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def codes(rules: dict[str, Column]) -> Column:
    """The codes of the rules that exclude a row, in order of ``rules``; a null condition excludes nothing."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))


def exclusion_counts(rows: DataFrame) -> DataFrame:
    """code, first (rows with it as first code) and any (rows with it), of rows with ``codes``."""
    each = rows.select(F.posexplode("codes").alias("nth", "code"))
    return each.groupBy("code").agg(F.count_if(F.col("nth") == 0).alias("first"), F.count(F.lit(1)).alias("any"))


def best_of(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; ``order`` must end in a unique key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_nth = 1").drop("_nth")


def winners(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """All rows of each group with the name of its first row."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_winner", F.first(name).over(window)).where(F.col(name) == F.col("_winner")).drop("_winner")


def older(rows: DataFrame, group: list[str], version: str) -> DataFrame:
    """Rows strictly older than the newest of their group; adds ``newest``."""
    return rows.withColumn("newest", F.max(version).over(Window.partitionBy(*group))).where(F.col(version) < F.col("newest"))


def top_with_ties(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Rows at or before the n-th by ``order``; equals of the n-th stay.

    The n-th row is found by a top-n sort, and rows are compared with it: no global window.
    """
    keyed = rows.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    last = keyed.select("_key").orderBy("_key").limit(n).agg(F.max("_key").alias("k")).scalar()
    return keyed.where(F.col("_key") <= last).drop("_key")


def coverage(rows: DataFrame, rating: str, steps: int = 20) -> DataFrame:
    """step (1 to ``steps``), threshold (step / 2), and rows rated at least so much."""
    counts = rows.agg(*[F.count_if(F.col(rating) >= k / 2).alias(f"s{k}") for k in range(1, steps + 1)])
    listed = counts.select(F.posexplode(F.array(*[f"s{k}" for k in range(1, steps + 1)])).alias("nth", "games"))
    return listed.select((F.col("nth") + 1).alias("step"), ((F.col("nth") + 1) / 2).alias("threshold"), "games")


def rescue(rows: DataFrame, release: list[str], excluded: str) -> DataFrame:
    """Excluded rows whose release has no row that isn't: they are the only dumps."""
    kept = rows.where(~F.col(excluded)).select(*release).distinct()
    return rows.where(F.col(excluded)).join(kept, release, "left_anti")


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """``action`` of the overrides where there is one, else of the rows."""
    forced = overrides.select(key, F.col("action").alias("_forced"))
    return rows.join(forced, key, "left").withColumn("action", F.coalesce("_forced", "action")).withColumn("forced", F.col("_forced").isNotNull()).drop("_forced")


def vanished(rows: DataFrame, title: list[str], priority: list[str]) -> DataFrame:
    """Titles of which every row has codes: number of rows, and as reason the first code in
    ``priority`` among the rows with the fewest codes."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(priority) for x in (c, i)])
    least = F.min(F.size("codes")).over(Window.partitionBy(*title))
    rows = rows.withColumn("_least", least)
    near = F.when(F.size("codes") == F.col("_least"), F.array_min(F.transform("codes", lambda c: F.struct(rank[c].alias("rank"), c.alias("code")))))
    return rows.groupBy(*title).agg(F.count(F.lit(1)).alias("variants"), F.min("_least").alias("_least"), F.min(near).alias("_reason")).where("_least > 0").select(*title, "variants", F.col("_reason.code").alias("reason"))


def preferred(value: Column, order: list[str]) -> Column:
    """Position of the value in a list of preferences; behind all of them if it isn't there."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(len(order) + 1))


def first_difference(criteria: list[tuple[str, Column, bool]], window) -> Column:
    """The first criterion (label, column, whether larger is better) by which a row differs from the first of its
    ordered window, whose values the window carries along."""
    best = F.first(F.struct(*[c.alias(f"c{i}") for i, (_, c, _) in enumerate(criteria)])).over(window)
    return F.coalesce(*[F.when(~c.eqNullSafe(best[f"c{i}"]), label) for i, (label, c, _) in enumerate(criteria)], F.lit("name order"))


def sorts(criteria: list[tuple[str, Column, bool]]) -> list[Column]:
    return [c.desc() if down else c.asc() for _, c, down in criteria]
