"""J-REPOS: trending repositories for each edition (A6, J4, J5, W6, S7b, F17, F22, trap 9).

The 7-day no-repeat rule is a range condition (published in ``d-7 .. d-1``).
Written as an equi-join on ``name`` plus a range residual, a repository that
trends every day would compare all of its rows against all of its history in
one task. Instead time is cut into buckets of seven days. The seven days that a
publication blocks touch at most two of them, so the history side has at most
two rows for a publication, and the anti-join is an equi-join on ``(name,
bucket)`` with the range as residual, however often a name trends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.dates import REPO_LOOKBACK_DAYS, previous_edition_dates
from broadsheet.functions.social import string_or, strip_fences
from broadsheet.functions.text import js_trim
from broadsheet.operators.topk import top_per_group

# Call kind of the repo call, trending repos read per edition,
# repos picked, placeholder text.
REPOS_CALL = "repos"
TRENDING_LIMIT = 25
PICK = 5
NO_DESCRIPTION = "(sin descripción)"
REPOS_PROMPT_HEADER = ("Elige los {pick} repositorios más interesantes y descríbelos en castellano.\n\n"
                       "Repositorios en tendencia hoy en GitHub:\n\n")


def recent_names(published: DataFrame) -> DataFrame:
    """``(name, edition_date)`` of published repos; empty or missing names
    ignored. The set semantics (U1b) come from the anti-join, which ignores
    duplicates."""
    return published.where(F.col("name").isNotNull() & (F.col("name") != "")) \
        .select("name", "edition_date")


def published_repos(editions: DataFrame) -> DataFrame:
    """A6 input: ``(name, edition_date)`` of every repo in read editions."""
    return editions.select(F.to_date("date").alias("edition_date"), F.explode("repos").alias("r")) \
        .select(F.col("r.name").alias("name"), "edition_date")


def recent_by_edition(archive: DataFrame, editions: DataFrame, days: int = REPO_LOOKBACK_DAYS) -> DataFrame:
    """``(edition_date, name)`` of the repos that the ``days`` editions before each
    ``edition_date`` of ``editions`` published (F17).

    ``archive`` are read editions with the partition column ``edition_date``
    (``read_editions``): only the folders of those days are opened, since the days
    prune the scan at run time. They are broadcast; distinct dates with at most
    ``days`` rows each, so the calendar bounds them, not the data.
    """
    wanted = (editions.select("edition_date").distinct()
              .select("edition_date", F.explode(previous_edition_dates("edition_date", days)).alias("__day"))
              .where(F.col("__day") < F.col("edition_date")))
    repos = archive.select(F.col("edition_date").alias("__day"), "repos")
    return (repos.join(F.broadcast(wanted), "__day").select("edition_date", F.explode("repos").alias("r"))
            .select("edition_date", F.col("r.name").alias("name")).where(F.col("name") != "").distinct())


def drop_recent(trending: DataFrame, recent: DataFrame) -> DataFrame:
    """J5 against ``recent_by_edition``: trending repos that no edition of the window published."""
    return trending.join(recent.hint("merge"), ["edition_date", "name"], "left_anti").select(*trending.columns)


def exclude_recent(trending: DataFrame, published: DataFrame, days: int = REPO_LOOKBACK_DAYS) -> DataFrame:
    """Drop trending repos already published in the previous ``days`` editions.

    The history grows with the archive, so it is never broadcast: the hint asks
    for a shuffle join whoever the caller is.
    """
    def bucket(day: Column) -> Column:
        return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)

    touched = F.array_distinct(F.array(bucket(F.date_add("edition_date", 1)), bucket(F.date_add("edition_date", days))))
    hist = recent_names(published).distinct().select(
        F.col("name").alias("__name"), F.col("edition_date").alias("__published"), F.explode(touched).alias("__bucket"))
    gap = F.datediff(F.col("edition_date"), F.col("__published"))
    return trending.join(hist.hint("merge"), (F.col("name") == F.col("__name"))
                         & (bucket(F.col("edition_date")) == F.col("__bucket")) & gap.between(1, days), "left_anti")


def replay_publications(trending: DataFrame, days: int = REPO_LOOKBACK_DAYS) -> DataFrame:
    """Trap 9: re-simulate history from raw trending data alone.

    A repo is published on a trending date only if its previous publication is
    more than ``days`` days back. That is sequential per repo, so each repo's
    distinct trending dates are folded in order. The fold holds at most one
    entry per calendar day of the history (dates are made distinct map-side
    first), not one per input row.
    """
    dates = trending.select("name", "edition_date").distinct()
    per_name = dates.groupBy("name").agg(F.array_sort(F.collect_list("edition_date")).alias("ds"))
    init = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<date>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        take = acc["last"].isNull() | (F.datediff(d, acc["last"]) > days)
        return F.struct(F.when(take, d).otherwise(acc["last"]).alias("last"),
                        F.when(take, F.array_append(acc["out"], d)).otherwise(acc["out"]).alias("out"))

    return per_name.select("name", F.explode(F.aggregate("ds", init, step)["out"]).alias("edition_date"))


def answer_picks(responses: DataFrame) -> DataFrame:
    """Landed answers of the repo call -> ``edition_date, key, pos, name, description``.

    The call is made once, so only attempt 1 counts. Fences go, ``repos`` must be
    a list; entries whose name is not a string are left out, a description that is
    not a string is null, repeated names stay. Text that is not JSON, a missing
    or other ``repos`` and a list with a null entry give no picks.
    """
    null = F.lit(None).cast("string")
    entries = F.try_variant_get(F.try_parse_json(strip_fences(F.col("raw"))), "$.repos", "array<variant>")
    r = responses.where((F.col("call_kind") == REPOS_CALL) & (F.col("attempt") == 1)) \
        .select("edition_date", "key", entries.alias("entries")) \
        .where(~F.exists("entries", lambda x: x.isNull() | F.is_variant_null(x)))
    return (r.select("edition_date", "key", F.posexplode("entries").alias("pos", "e"))
            .select("edition_date", "key", "pos", string_or("e", "$.name", null).alias("name"),
                    string_or("e", "$.description", null).alias("description"))
            .where(F.col("name").isNotNull()))


def join_picks(picks: DataFrame, trending: DataFrame, pick: int | Column = PICK, most: int | None = None) -> DataFrame:
    """J4 + W6: model picks joined back to the trending rows of the same edition.

    ``picks(edition_date, pos, name, description)`` keeps duplicates; for a name
    listed twice in the trending input the last row wins. Hard data (url,
    language, stars) always comes from the trending row; the description from
    the pick unless blank. Rows left without description are dropped, then the
    first ``pick`` per edition in model order are kept; ``pick`` is a number or a
    column of ``picks`` (S5), at most ``most``.
    """
    last = trending.groupBy("edition_date", "name").agg(
        F.max_by(F.struct("url", "description", "language", "stars"), F.col("seq")).alias("src"))
    picked_desc = F.when(F.col("p_desc").isNotNull() & (js_trim(F.col("p_desc")) != ""), F.col("p_desc")) \
        .otherwise(F.col("src.description"))
    limit = F.lit(pick) if isinstance(pick, int) else pick
    j = (picks.select("edition_date", "pos", "name", F.col("description").alias("p_desc"), limit.alias("__pick"))
         .join(last, ["edition_date", "name"])
         .select("edition_date", "pos", "name", F.col("src.url").alias("url"),
                 js_trim(picked_desc).alias("description"),
                 F.nullif(F.col("src.language"), F.lit("")).alias("language"),
                 F.nullif(F.col("src.stars"), F.lit(0)).alias("stars"), "__pick")
         .where(F.col("description") != ""))
    return top_per_group(j, ["edition_date"], [F.col("pos")], pick if isinstance(pick, int) else F.col("__pick"), "slot",
                         ["pos", "name"], most).drop("__pick")


def with_fallback(scraped: DataFrame, searched: DataFrame) -> DataFrame:
    """Per edition, the scrape when it gave at least one row, else the search."""
    return scraped.unionByName(searched.join(scraped.select("edition_date").distinct(), "edition_date", "left_anti"))


def top_search(search: DataFrame, limit: int | Column = TRENDING_LIMIT, most: int | None = None) -> DataFrame:
    """Newest-created repos by stars desc, ``limit`` per edition."""
    order = [F.col("stars").desc(), F.col("name")]
    return top_per_group(search.drop("seq"), ["edition_date"], order, limit, "seq", ["name"], most)


def repo_prompt_line(pos: Column) -> Column:
    """F22 line: ``i. name (language · stars★)`` and the description or a placeholder."""
    stars_txt = F.when(F.coalesce(F.col("stars"), F.lit(0)) != 0, F.concat(F.col("stars").cast("string"), F.lit("★")))
    meta = F.concat_ws(" · ", F.nullif(F.col("language"), F.lit("")), stars_txt)
    meta_line = F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(F.lit(""))
    desc = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.col("description")).otherwise(F.lit(NO_DESCRIPTION))
    return F.concat(pos.cast("string"), F.lit(". "), F.col("name"), meta_line, F.lit("\n   "), desc)


def repos_prompt(fresh: DataFrame, pick: int | Column = PICK, header: str = REPOS_PROMPT_HEADER) -> DataFrame:
    """F22 + A7: one prompt per edition, lines in trending order. Every fresh row is
    listed; the configured limit applies where the page is read. ``pick`` is a
    number or a column of ``fresh`` that is the same for all rows of an edition."""
    w = Window.partitionBy("edition_date").orderBy("seq")
    lines = fresh.withColumn("__pick", F.lit(pick) if isinstance(pick, int) else pick).withColumn("i", F.row_number().over(w)).select(
        "edition_date", "__pick", F.struct("i", repo_prompt_line(F.col("i")).alias("line")).alias("l"))
    g = lines.groupBy("edition_date").agg(F.array_sort(F.collect_list("l")).alias("ls"), F.max("__pick").alias("__pick"))
    head = F.replace(F.lit(header), F.lit("{pick}"), F.col("__pick").cast("string"))
    return g.select("edition_date", F.concat(head, F.array_join(F.transform("ls", lambda x: x["line"]), "\n\n")).alias("prompt"))
