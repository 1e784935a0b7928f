"""J-ARCHIVE: the edition archive as tables.

An edition is one row per date. The un-partitioned windows (numbering and
neighbours) run on a narrow projection of that table, whose size is bounded by
the number of calendar days, and are joined back on ``date``; AQE turns that
join into a broadcast at run time when the narrow side is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.dates import edition_path, long_date_es, month_name_es, short_date_es

REPOS_PREFIX = "/repositorios"


def items_by_rank(items) -> Column:
    """Items sorted by rank ascending; the sort is stable, like JS sort."""
    items = F.col(items) if isinstance(items, str) else items
    return F.array_sort(items, lambda a, b: F.when(a["rank"] < b["rank"], -1)
                        .when(a["rank"] > b["rank"], 1).otherwise(0))


def with_paths(editions: DataFrame) -> DataFrame:
    """S11 derived fields: sorted items, year/month/day, path, counts, lead item."""
    parts = F.split(F.col("date"), "-")
    return (editions
            .withColumn("items", items_by_rank(F.coalesce(F.col("items"), F.array())))
            .withColumn("year", F.element_at(parts, 1))
            .withColumn("month", F.element_at(parts, 2))
            .withColumn("day", F.element_at(parts, 3))
            .withColumn("path", edition_path(F.col("date")))
            .withColumn("n_items", F.size("items"))
            .withColumn("n_repos", F.coalesce(F.size("repos"), F.lit(0)))
            .withColumn("lead_title", F.try_element_at("items", F.lit(1))["title"]))


def edition_index(editions: DataFrame) -> DataFrame:
    """T4 + W1 + W2: every edition, newest first, with its number (oldest = 1) and neighbours."""
    e = with_paths(editions)
    w = Window.orderBy("date")
    nav = (e.select("date", "path")
           .withColumn("numero", F.row_number().over(w))
           .withColumn("newer_path", F.lead("path").over(w))
           .withColumn("older_path", F.lag("path").over(w))
           .drop("path"))
    return e.join(nav, "date").withColumn("long_date", long_date_es(F.col("date"))) \
        .withColumn("short_date", short_date_es(F.col("date"))).orderBy(F.desc("date"))


def repos_edition_index(editions: DataFrame) -> DataFrame:
    """Neighbours only among editions that have repos."""
    e = with_paths(editions).where(F.col("n_repos") > 0) \
        .withColumn("repos_path", edition_path(F.col("date"), REPOS_PREFIX))
    w = Window.orderBy("date")
    nav = (e.select("date", "repos_path")
           .withColumn("repos_newer_path", F.lead("repos_path").over(w))
           .withColumn("repos_older_path", F.lag("repos_path").over(w))
           .drop("repos_path"))
    return e.join(nav, "date")


def latest_edition(editions: DataFrame) -> DataFrame:
    """The front page is the newest edition."""
    return with_paths(editions).orderBy(F.col("date").desc()).limit(1)


def by_month(editions: DataFrame) -> DataFrame:
    """A5 + A8: editions grouped by year-month, newest first inside each group.

    The group holds at most one row per day of the month, so the collected
    list is bounded by 31 whatever the data size.
    """
    e = with_paths(editions).withColumn("month_key", F.concat_ws("-", "year", "month"))
    g = e.groupBy("month_key").agg(
        F.sort_array(F.collect_list(F.struct("date", "n_items")), asc=False).alias("entries"),
        F.sum("n_items").alias("n_items_total"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"))
    return g.select(
        "month_key",
        month_name_es(F.col("month_key")).alias("month_title"),
        F.size("entries").alias("n_editions"),
        F.array_join(F.transform("entries", lambda x: x["date"]), ",").alias("dates_desc"),
        "n_items_total", "first_date", "last_date")


def calendar_grid(editions: DataFrame, path_col: str = "path") -> DataFrame:
    """F27 + J7: every day of every month between the first and last edition,
    with the Monday-first offset of the month, availability, link and flags."""
    e = with_paths(editions).select(F.to_date("date").alias("d"), F.col(path_col).alias("u"))
    span = e.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = span.select(
        F.explode(F.sequence(F.trunc("lo", "MM"), F.last_day("hi"))).alias("d"),
        F.date_format(F.trunc("lo", "MM"), "yyyy-MM").alias("min_ym"),
        F.date_format("hi", "yyyy-MM").alias("max_ym"),
        F.col("hi").alias("current"))
    first = F.trunc("d", "MM")
    ym = F.date_format("d", "yyyy-MM")
    return days.join(e, "d", "left").select(
        F.col("d").alias("date"),
        ym.alias("month_key"),
        F.dayofmonth("d").alias("day"),
        F.weekday(first).alias("offset"),
        F.dayofmonth(F.last_day("d")).alias("days_in_month"),
        F.col("u").isNotNull().alias("available"),
        F.col("u").alias("url"),
        (F.col("d") == F.col("current")).alias("is_current"),
        (ym > F.col("min_ym")).alias("prev_enabled"),
        (ym < F.col("max_ym")).alias("next_enabled"))


def calendar_data(editions: DataFrame, path_col: str = "path") -> DataFrame:
    """the ``[{d, u}]`` list the calendar reads, as JSON text (one row)."""
    e = with_paths(editions)
    return e.agg(F.to_json(F.sort_array(F.collect_list(
        F.struct(F.col("date").alias("d"), F.col(path_col).alias("u"))))).alias("datos"))


def pending_editions(runs: DataFrame, editions: DataFrame) -> DataFrame:
    """Requested edition dates that are not published yet (write-once)."""
    have = editions.select(F.to_date("date").alias("edition_date"))
    return runs.join(have, "edition_date", "left_anti")
