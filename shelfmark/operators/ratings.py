"""Ratings: reading their source, one index row for each platform and title, and looking titles up.

Index: plat, key, rating (0 to 5), votes, dbid, name, year, alt (1 for an alternate name).
A title is looked up by its key, then by its key with roman numerals as digits if that means one game
alone, then by the one key it resembles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.names import roman_key, title_key
from shelfmark.operators import fuzzy
from shelfmark.sources.work import saved

LEAST_VOTES = 5
GAME = "Name string, Platform string, DatabaseID string, CommunityRating string, CommunityRatingCount string, ReleaseYear string, ReleaseDate string"
ALTERNATE = "AlternateName string, DatabaseID string"


def read_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Games and alternate names of an XML source as text columns; malformed rows are dropped."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(schema).load(path)
    return read("Game", GAME), read("GameAlternateName", ALTERNATE)


def rated_games(games: DataFrame, platforms: list[str]) -> DataFrame:
    """dbid, name, plat, rating, votes, year of games that have all of them; year 0 if unknown.

    Where a dbid occurs more than once, the row of most votes stays (then by name)."""
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    year = F.coalesce(F.nullif(F.trim("ReleaseYear"), F.lit("")), F.left(F.col("ReleaseDate"), F.lit(4)))
    rows = games.where(F.col("Platform").isin(*platforms)).select(
        F.trim("DatabaseID").try_cast("bigint").alias("dbid"), F.trim("Name").alias("name"), F.col("Platform").alias("plat"), number("CommunityRating").alias("rating"), number("CommunityRatingCount").cast("bigint").alias("votes"), F.coalesce(F.when(year.rlike("^[0-9]+$"), year.try_cast("int")), F.lit(0)).alias("year")
    )
    rows = rows.where("dbid <> 0 and name <> '' and rating > 0 and votes > 0")
    first = Window.partitionBy("dbid").orderBy(F.desc("votes"), "name")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def _joined(a: DataFrame, b: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """A join that sends neither side to the driver: sizes are guessed from the columns that titles are made of, which can be
    far smaller than the titles."""
    return a.hint("merge").join(b, list(on), how)


def build_index(games: DataFrame, alternates: DataFrame) -> DataFrame:
    """One row for each platform and key: own names before alternate ones, then most votes, then the lowest dbid."""
    own = games.select("*", F.col("name").alias("title"), F.lit(0).alias("alt"))
    names = alternates.select(F.trim("DatabaseID").try_cast("bigint").alias("dbid"), F.trim("AlternateName").alias("title"))
    other = _joined(games, names, "dbid").select(*games.columns, "title", F.lit(1).alias("alt"))
    offered = own.unionByName(other).withColumn("key", title_key("title")).where("key <> ''")
    best = Window.partitionBy("plat", "key").orderBy("alt", F.desc("votes"), "dbid")
    return offered.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("plat", "key", "rating", "votes", "dbid", "name", "year", "alt")


def look_up(titles: DataFrame, index: DataFrame) -> DataFrame:
    """Adds rating (0 to 10, one decimal), votes, dbid, found_name, year, kind, score to ``titles(plat, title)``;
    nulls where no game is found for sure. Each distinct title is looked up once.

    kind is exact, alt, roman or fuzzy. Index and titles asked for are saved, as each step reads them.
    """
    index = saved(index, "ratings-index")
    asked = saved(titles.select("plat", "title").distinct().withColumn("key", title_key("title")).where(F.char_length("key") >= 2), "ratings-asked")
    fields = ["rating", "votes", "dbid", "name", "year"]
    exact = _joined(asked, index, "plat", "key").select("plat", "title", *fields, F.when(F.col("alt") == 1, "alt").otherwise("exact").alias("kind"), F.lit(1.0).alias("score"))
    open_ = _joined(asked, index.select("plat", "key"), "plat", "key", how="left_anti")
    # of the keys that read alike, those of one game alone; of its rows any has the game's rating
    one_game = index.groupBy("plat", roman_key("key").alias("roman")).agg(F.min("dbid").alias("low"), F.max("dbid").alias("high"), F.min_by(F.struct(*fields), "key").alias("g")).where("low = high")
    by_roman = _joined(open_.withColumn("roman", roman_key("key")), one_game, "plat", "roman").select("plat", "title", "key", "g.*", F.lit("roman").alias("kind"), F.lit(0.99).alias("score"))
    left = _joined(open_, by_roman.select("plat", "key").distinct(), "plat", "key", how="left_anti")
    near = fuzzy.matches(left.select("plat", "key"), index.select("plat", "key", "dbid"))
    by_likeness = _joined(_joined(left, near, "plat", "key"), index.withColumnRenamed("key", "found").drop("dbid", "alt"), "plat", "found").select("plat", "title", "rating", "votes", F.col("found_id").alias("dbid"), "name", "year", F.lit("fuzzy").alias("kind"), F.round("similarity", 3).alias("score"))
    found = exact.unionByName(by_roman.drop("key")).unionByName(by_likeness)
    found = found.withColumn("rating", F.round(F.col("rating") * 2, 1)).withColumnRenamed("name", "found_name")
    return _joined(titles, found, "plat", "title", how="left")


def usable(rating: Column | str, votes: Column | str, least_votes: int = LEAST_VOTES) -> Column:
    """The rating where it has enough votes, else null."""
    rating, votes = (F.col(x) if isinstance(x, str) else x for x in (rating, votes))
    return F.when(votes >= least_votes, rating)


def shown(rating: Column, votes: Column) -> Column:
    """7.5 (12 votes) as text for a list."""
    return F.concat(F.format_number(rating, 1), F.lit(" · "), votes.cast("string"), F.when(votes == 1, " vote").otherwise(" votes"))


def age_in_days(built_at: Column, now: Column) -> Column:
    """Days between an ISO time and ``now`` (a timestamp); null for texts of another form."""
    built = F.try_to_timestamp(F.left(built_at, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return (F.unix_micros(now) - F.unix_micros(built)) / (86_400 * 1_000_000)


def source_date(last_modified: Column, built_at: Column) -> Column:
    """The day of a source by its HTTP date, else the first ten characters of the time it was built."""
    day = F.try_to_timestamp(F.regexp_extract(last_modified, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4})", 1), F.lit("dd MMM yyyy"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.left(built_at, F.lit(10)), F.lit(""))


# ---- the rating filter over games


def cutoff(units: DataFrame, n: int, least_rating: float | None = None) -> DataFrame:
    """The rank key (rating, votes, title) of the n-th best complete game; no row if there are fewer."""
    pool = units.where("rating is not null and complete")
    pool = pool.where(F.col("rating") >= least_rating) if least_rating is not None else pool
    ranked = pool.select(rank_key().alias("k")).orderBy("k").limit(n)
    return ranked.agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("k")


def rank_key() -> Column:
    """Orders games: rating and votes from the highest, then title."""
    return F.struct((-F.col("rating")).alias("r"), (-F.col("votes")).alias("v"), F.lower("title").alias("t"))


def rating_codes(units: DataFrame, least_rating: float | None = None, n: int | None = None, keep_unrated: bool = False, target: DataFrame | None = None) -> DataFrame:
    """Adds ``codes`` to games (game, rating, votes, title, complete): rating_unrated, rating_low, rating_not_top.

    The n-th best is that of ``target``, the games of the whole catalogue, or of ``units`` themselves; games that
    share its rating, votes and title stay together.
    """
    not_top = F.lit(False)
    if n is not None:
        last = cutoff(units if target is None else target, n, least_rating).scalar()
        not_top = F.coalesce(rank_key() > last, F.lit(False))
    known = F.col("rating").isNotNull()
    low = F.col("rating") < least_rating if least_rating is not None else F.lit(False)
    codes = F.array_compact(F.array(F.when(~known & F.lit(not keep_unrated), "rating_unrated"), F.when(known & low, "rating_low"), F.when(known & not_top, "rating_not_top")))
    return units.withColumn("codes", codes)
