"""Landed trending pages and search answers -> raw repos.

A trending page is one row; it is split into article blocks with array
functions, so parsing needs no shuffle and the per-page ``limit`` is a
``slice`` on the page's own blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.html import strip_html_repo
from broadsheet.functions.text import JS_SPACE_CLASS, js_trim

# ---------------------------------------------------------------------------
# Page markers and field patterns of the trending page.
BLOCK_MARKER = '<article class="Box-row">'
BLOCK_END = "</article>"
NAME_PATTERN = r'<h2[^>]*>[\s\S]*?href="/([^"]+)"'
DESCRIPTION_PATTERN = r'<p class="col-9[^"]*"[^>]*>([\s\S]*?)</p>'
LANGUAGE_PATTERN = r'programmingLanguage"[^>]*>([^<]+)<'
STARS_PATTERN = r'/stargazers"[\s\S]*?</svg>' + JS_SPACE_CLASS + r'*([\d,]+)' + JS_SPACE_CLASS + r'*</a>'
PERIOD_STARS_PATTERN = (r"(?i)([\d,]+)" + JS_SPACE_CLASS + r"*stars?" + JS_SPACE_CLASS
                        + r"*(?:today|this week|this month)")
TRENDING_LIMIT = 25
# ---------------------------------------------------------------------------


def _count(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0))


def _block(a: Column) -> Column:
    desc = F.regexp_extract(a, DESCRIPTION_PATTERN, 1)
    return F.struct(
        F.regexp_extract(a, NAME_PATTERN, 1).alias("name"),
        F.when(a.rlike(DESCRIPTION_PATTERN), strip_html_repo(desc)).otherwise(F.lit("")).alias("description"),
        js_trim(F.regexp_extract(a, LANGUAGE_PATTERN, 1)).alias("language"),
        _count(F.regexp_extract(a, STARS_PATTERN, 1)).alias("stars"),
        _count(F.regexp_extract(a, PERIOD_STARS_PATTERN, 1)).alias("stars_today"))


def parse_trending(pages: DataFrame, html: str = "html", limit: int = TRENDING_LIMIT) -> DataFrame:
    """One row per named article block, in page order, at most ``limit``
    per page; blocks without a name are skipped before the limit counts."""
    blocks = F.slice(F.split(F.col(html), BLOCK_MARKER, -1), 2, 1 << 30)
    cut = F.transform(blocks, lambda b: F.when(F.locate(BLOCK_END, b) > 0,
                                               F.substring(b, 1, F.locate(BLOCK_END, b) - 1)).otherwise(b))
    parsed = F.slice(F.filter(F.transform(cut, _block), lambda r: r["name"] != ""), 1, limit)
    keep = [c for c in pages.columns if c != html]
    out = pages.select(*keep, F.posexplode(parsed).alias("seq", "r"))
    return out.select(*keep, (F.col("seq") + 1).alias("seq"), F.col("r.name").alias("name"),
                      F.concat(F.lit("https://github.com/"), F.col("r.name")).alias("url"),
                      "r.description", "r.language", "r.stars", "r.stars_today")


# Days before the run that a searched repository may be old (fixed value).
SEARCH_DAYS = 7


def search_repos(answers: DataFrame, days: int = SEARCH_DAYS) -> DataFrame:
    """Search answers (``items`` of full_name, html_url, description,
    language, stargazers_count, and created_at if it was landed) -> raw repos;
    non-string names dropped, missing values become '' / 0 and ``stars_today`` is 0.

    The search asks for repositories created after the day ``days`` before the run
    (``as_of`` if the answers have it, else ``edition_date``). Where the landed items
    carry ``created_at`` (text, ISO 8601) the file may hold older ones: those, and
    items whose date is missing or unreadable, are left out."""
    e = answers.select(*[c for c in answers.columns if c != "items"], F.posexplode("items").alias("pos", "r"))
    keep = [c for c in answers.columns if c != "items"]
    if "created_at" in answers.schema["items"].dataType.elementType.names:
        day = F.to_date("as_of" if "as_of" in keep else "edition_date")
        e = e.where(F.to_date(F.try_to_timestamp("r.created_at")) > F.date_sub(day, days))
    return (e.where(F.col("r.full_name").isNotNull())
            .select(*keep, (F.col("pos") + 1).alias("seq"), F.col("r.full_name").alias("name"),
                    F.coalesce(F.col("r.html_url"), F.concat(F.lit("https://github.com/"), F.col("r.full_name")))
                    .alias("url"),
                    F.coalesce(F.col("r.description"), F.lit("")).alias("description"),
                    F.coalesce(F.col("r.language"), F.lit("")).alias("language"),
                    F.coalesce(F.col("r.stargazers_count"), F.lit(0)).cast("bigint").alias("stars"),
                    F.lit(0).cast("bigint").alias("stars_today")))
