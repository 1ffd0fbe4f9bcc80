"""Search, sort, pages and facets of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, LIMIT_MOST = 100, 1000


def search_text(columns: list[str]) -> Column:
    """All texts of a row in lower case, one a line, so that no search goes across fields."""
    return F.lower(F.concat_ws("\n", *columns))


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    return rows.where(F.contains(search_text(columns), F.lit(query.lower()))) if query else rows


def order_of(kind: str, rating: str, votes: str, name: str, year: str, size: str, key: str) -> list[Column]:
    """The columns of a sort such as ``rating_desc``. Rows without the value come last either way;
    votes turn with the direction, the name never does."""
    field, _, way = kind.partition("_")
    down = way == "desc"

    def by(column: str) -> Column:
        return F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_last()

    folded = F.lower(name)
    if field == "name":
        return [folded.desc() if down else folded.asc(), F.col(key)]
    first = {"rating": [by(rating), by(votes)], "year": [by(year)], "size": [by(size)]}[field]
    return [*first, folded.asc(), F.col(key)]


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = LIMIT) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), LIMIT_MOST))


def facets(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """facet, value, n: rows with the value; a value counts once a row. Columns are arrays of text."""

    def values(name: str, column: Column) -> Column:
        known = F.array_distinct(F.filter(column, lambda v: v.isNotNull()))
        return F.transform(known, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    each = F.explode(F.flatten(F.array(*[values(name, column) for name, column in columns.items()])))
    return rows.select(each.alias("e")).groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n"))


def filtered(rows: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Rows that have, in every column of ``filters``, one of its values, letters folded; columns are texts or arrays
    of them, and an empty list filters nothing."""
    for column, values in filters.items():
        wanted = F.array(*[F.lit(v.lower()) for v in values])
        if values and rows.schema[column].dataType.typeName() == "array":
            rows = rows.where(F.arrays_overlap(F.transform(column, lambda x: F.lower(x)), wanted))
        elif values:
            rows = rows.where(F.array_contains(wanted, F.lower(column)))
    return rows


def results(rows: DataFrame, filters: dict[str, list[str]], text: str, columns: list[str], order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the rows that pass the filters and hold the text in one of ``columns``, each with the number of all
    such rows as ``total``."""
    found = search(filtered(rows, filters), text, columns)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page(found, order, offset, limit).withColumn("total", total)


def _passes(rows: DataFrame, column: str, values: list[str]) -> Column:
    wanted = F.array(*[F.lit(v.lower()) for v in values])
    if rows.schema[column].dataType.typeName() == "array":
        return F.coalesce(F.arrays_overlap(F.transform(column, lambda x: F.lower(x)), wanted), F.lit(False))
    return F.coalesce(F.array_contains(wanted, F.lower(column)), F.lit(False))


def facets_beside(rows: DataFrame, filters: dict[str, list[str]], facet_columns: list[str], text: str = "", columns: list[str] | None = None) -> DataFrame:
    """facet, value, n, chosen beside a page of results: how many rows each value of a facet would leave, the other filters
    being what they are; a facet's own filter doesn't narrow its values.

    Each row gets a bit for each filter it passes, and counts for the facets whose other bits are all set: one pass
    over the rows, whatever the number of facets. ``chosen`` tells the values that are filtered by."""
    active = [c for c, values in filters.items() if values]
    bits = [F.when(_passes(rows, c, filters[c]), 1 << i).otherwise(0) for i, c in enumerate(active)]
    if text:
        bits.append(F.when(F.contains(search_text(columns or []), F.lit(text.lower())), 1 << len(active)).otherwise(0))
    every = (1 << len(bits)) - 1
    mask = F.lit(0)
    for b in bits:
        mask = mask.bitwiseOR(b)

    def values(column: str) -> Column:
        own = 1 << active.index(column) if column in active else 0
        c = F.col(column) if rows.schema[column].dataType.typeName() == "array" else F.array(column)
        known = F.array_distinct(F.filter(c, lambda v: v.isNotNull()))
        listed = F.transform(known, lambda v: F.struct(F.lit(column).alias("facet"), v.alias("value")))
        return F.when(F.col("_mask").bitwiseOR(own) == every, listed).otherwise(F.filter(listed, lambda x: F.lit(False)))

    each = rows.withColumn("_mask", mask).select(F.explode(F.flatten(F.array(*map(values, facet_columns)))).alias("e"))
    counts = each.groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n"))
    chosen = F.lit(False)
    for c in active:
        chosen = chosen | ((F.col("facet") == c) & F.lower("value").isin([v.lower() for v in filters[c]]))
    return counts.withColumn("chosen", chosen)
