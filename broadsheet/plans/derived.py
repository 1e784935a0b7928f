"""Job inputs derived from the supplied tables.

The driver supplies TPC-H-like tables, not landed feeds. These definitions turn
them into the shapes our jobs consume (see FIXTURES.md), so every registered
query does work that grows with the supplied data. Each one is a single scan
with a narrow projection; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import url_host
from broadsheet.operators.validate import CATEGORIES, MAX_ITEMS, MAX_REPOS, PROVIDERS
from broadsheet.sources.tables import read_table

# Fixed values of the derivation (shared with the SQL oracles).
EPOCH_DAY = "2024-01-01"
EPOCH_SECONDS = 1704067200          # 2024-01-01T00:00:00Z
EDITION_SPAN_DAYS = 30


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def edition_of_page() -> Column:
    return F.date_add(F.lit(EPOCH_DAY).cast("date"), (F.col("page_id") % EDITION_SPAN_DAYS).cast("int"))


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items collected for many editions, built from ``pages``.

    Part 1: one item per page. Part 2: pages with ``page_id % 5 = 0`` and no
    fragment come back a second time from the story source, with a tracking
    parameter, other points and snippet 'late'. Both parts come out of one scan
    through ``inline`` of a one- or two-element array (no union, no rescan).
    """
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    pid = F.col("page_id")
    title = html_title(F.col("html"))
    first = F.struct(
        (pid * 2).alias("seq"),
        title.alias("title"),
        F.when(pid % 4 == 0, F.lit("")).otherwise(title).alias("snippet"),
        F.col("url").alias("url"),
        F.when(pid % 3 == 0, F.lit(None).cast("bigint")).otherwise((pid * 37) % 211).alias("points"),
    )
    late_url = F.concat(F.col("url"), F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")),
                        F.lit("utm_source=hn"))
    second = F.when((pid % 5 == 0) & ~F.col("url").contains("#"), F.struct(
        (pid * 2 + 1).alias("seq"),
        title.alias("title"),
        F.lit("late").alias("snippet"),
        late_url.alias("url"),
        ((pid * 53) % 307).cast("bigint").alias("points"),
    ))
    return (p.select(
        edition_of_page().alias("edition_date"),
        url_host(F.col("url")).alias("source"),
        F.timestamp_seconds(F.lit(EPOCH_SECONDS) + pid * 60).alias("published_at"),
        F.inline(F.filter(F.array(first, second), lambda x: x.isNotNull())))
        .select("edition_date", "seq", "title", "snippet", "url", "source", "published_at", "points"))


def edition_config(items: DataFrame) -> DataFrame:
    """A configuration for each edition of ``items``, in the document's shape: its
    sources are the feeds, enabled unless the name's length is a multiple of 3, and
    the cap runs from 3 to 33 by day. Other settings are left out."""
    feeds = items.select("edition_date", "source").distinct().groupBy("edition_date").agg(F.array_sort(F.collect_list("source")).alias("names"))
    day = F.datediff("edition_date", F.lit(EPOCH_DAY).cast("date"))
    rss = F.transform("names", lambda n: F.struct(n.alias("id"), n.alias("name"), n.alias("url"), (F.length(n) % 3 != 0).alias("enabled"), F.lit(False).alias("fragile")))
    return feeds.select("edition_date", rss.alias("rss"), (day % 7 * 5 + 3).cast("int").alias("candidate_cap"))


ITEMS_PER_EDITION = MAX_ITEMS


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published editions, one per UTC day of ``events``.

    Items: the day's events by value desc, event_id asc, first 20 (a per-day
    top-k, so each group is bounded before it is collected). Days whose error
    count is above the median of all days carry repos (their top error events, as
    many as a document may hold: 8). The result has the digest document shape.
    """
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props") \
        .withColumn("day", F.to_date("ts"))
    top = ev.withColumn("rank", F.row_number().over(
        Window.partitionBy("day").orderBy(F.col("value").desc(), "event_id"))) \
        .where(F.col("rank") <= ITEMS_PER_EDITION)
    item = F.struct(
        F.col("rank").cast("int").alias("rank"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("event_id") % 4 + 1).cast("int"))
        .alias("category"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit("value "), F.col("value").cast("string")).alias("summary"),
        F.col("props").alias("why_it_matters"),
        F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_type").alias("source"))
    items = top.groupBy("day").agg(F.collect_list(item).alias("items"))

    # One row per calendar day: the median over all days is a window on that
    # small table (bounded by the calendar), computed lazily with the query.
    days = ev.groupBy("day").agg(F.max("ts").alias("last_ts"),
                                 F.count_if(F.col("event_type") == "error").alias("n_errors")) \
        .withColumn("median", F.percentile("n_errors", 0.5).over(Window.partitionBy()))

    errs = ev.where(F.col("event_type") == "error").withColumn("r", F.row_number().over(
        Window.partitionBy("day").orderBy(F.col("value").desc(), "event_id"))) \
        .where(F.col("r") <= MAX_REPOS)
    repo = F.struct(
        F.col("r").alias("r"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/r"), F.col("event_id").cast("string"))
        .alias("name"),
        F.concat(F.lit("https://github.com/u"), F.col("user_id").cast("string"), F.lit("/r"),
                 F.col("event_id").cast("string")).alias("url"),
        F.col("props").alias("description"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("Python")).alias("language"),
        F.floor(F.col("value") * 100).cast("bigint").alias("stars"))
    repos = errs.groupBy("day").agg(F.sort_array(F.collect_list(repo)).alias("repos")) \
        .select("day", F.transform("repos", lambda x: x.dropFields("r")).alias("repos"))

    return (days.join(items, "day").join(repos, "day", "left")
            .select(F.date_format("day", "yyyy-MM-dd").alias("date"),
                    F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at"),
                    F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]),
                                 (F.dayofmonth("day") % 2 + 1).cast("int")).alias("provider"),
                    "items",
                    F.when(F.col("n_errors") > F.col("median"), F.col("repos")).alias("repos")))


def repo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repos seen per edition, from ``lineitem``: distinct (part key as name, ship date)."""
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate")
    return li.select(F.col("l_partkey").cast("string").alias("name"),
                     F.to_date("l_shipdate").alias("edition_date")).distinct()


def repos_raw(spark: SparkSession, sf_dir: str, span: int = EDITION_SPAN_DAYS) -> DataFrame:
    """Trending rows from ``part``: name brand/partkey, language p_type ('' when
    p_size % 7 = 0), stars p_size * 100, description p_name, one edition per
    ``p_partkey % span``; ``seq`` is the part key (page order)."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    name = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    return p.select(
        F.date_add(F.lit(EPOCH_DAY).cast("date"), (F.col("p_partkey") % span).cast("int")).alias("edition_date"),
        F.col("p_partkey").alias("seq"),
        name.alias("name"),
        F.concat(F.lit("https://github.com/"), name).alias("url"),
        F.col("p_name").alias("description"),
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_type")).alias("language"),
        (F.col("p_size") * 100).cast("bigint").alias("stars"),
        F.col("p_size").cast("bigint").alias("stars_today"),
        F.col("p_retailprice").alias("p_retailprice"))


def repo_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model picks from ``orders``: order o picks the repo of part ``o_custkey``
    for edition ``o_orderkey % 30``, in order-key order; every fourth pick
    has a blank description (the trending one is used), others carry the
    order priority as description."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_brand")
    j = o.join(p, o["o_custkey"] == p["p_partkey"])
    return j.select(
        F.date_add(F.lit(EPOCH_DAY).cast("date"), (F.col("o_orderkey") % EDITION_SPAN_DAYS).cast("int"))
        .alias("edition_date"),
        F.col("o_orderkey").alias("pos"),
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("description"))


def pages_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed article fetches from ``pages``: status 404 when ``page_id % 11 = 0``,
    a PDF content type when ``page_id % 13 = 0``, otherwise an HTML 200."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return p.select(
        "page_id", edition_of_page().alias("edition_date"), "url",
        F.when(F.col("page_id") % 11 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(F.col("page_id") % 13 == 0, F.lit("application/pdf"))
        .otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        "html")


OTHER_READING = "<p>" + "Lectura de otra jornada. " * 5 + "</p>"


def pages_by_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages_in``, and every page with ``page_id % 4 = 1`` once more: fetched for
    the following edition under ``-page_id`` with another text, so that a join
    that ignores the edition takes the wrong text."""
    again = F.when(F.col("page_id") % 4 == 1, F.struct(
        (-F.col("page_id")).alias("page_id"), F.date_add("edition_date", 1).alias("edition_date"),
        F.lit(OTHER_READING).alias("html")))
    return pages_in(spark, sf_dir).select("url", "status", "content_type", F.inline(F.filter(
        F.array(F.struct("page_id", "edition_date", "html"), again), lambda x: x.isNotNull())))


# Fixed values of the derived model answers.
SORRY = "Lo siento, no puedo ayudar con eso."
RUN_HOUR = "T06:00:00.000Z"


def json_string(c: Column) -> Column:
    """A column as a JSON string literal (quotes and escapes included)."""
    j = F.to_json(F.struct(c.alias("s")))
    return F.substring(j, F.lit(6), F.length(j) - 6)


def edition_runs(cands: DataFrame) -> DataFrame:
    """One run per edition seen in the candidates: date text, run instant, provider."""
    d = cands.select("edition_date").distinct()
    date = F.date_format("edition_date", "yyyy-MM-dd")
    return d.select("edition_date", date.alias("date"), F.concat(date, F.lit(RUN_HOUR)).alias("generated_at"),
                    F.lit("deepseek").alias("provider"))


def digest_answers(ranked: DataFrame, with_context: bool = False) -> DataFrame:
    """Model answers per edition, built from its ranked candidates.

    Scenario by ``(edition_date - 2024-01-01) % 5``:
    0: not JSON, then a repeated rank, then valid; 1: valid inside a code
    fence; 2: bad category + extra key, then valid plus one invented URL;
    3: three answers with only three items; 4: items is a string, then an
    array root, then rank 1.0 and a string rank. Items are the first 20
    candidates (a bounded list per edition).

    With ``with_context`` every attempt also carries what the checker needs
    from its edition: the input ``urls`` and the run's ``date``,
    ``generated_at`` and ``provider``. All of it comes out of one aggregate
    over the ranked candidates (at most ``cap`` rows per edition), so the
    checker needs no join.
    """
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("seq") % 4 + 1).cast("int"))
    item = F.concat(
        F.lit('{"rank":'), F.col("position").cast("string"),
        F.lit(',"category":"'), cat,
        F.lit('","title":'), json_string(F.col("title")),
        F.lit(',"summary":'), json_string(F.concat(F.lit("Resumen de "), F.col("source"))),
        F.lit(',"why_it_matters":'), json_string(F.concat(F.lit("Porque "), F.col("position").cast("string"))),
        F.lit(',"url":'), json_string(F.col("url")),
        F.lit(',"source":'), json_string(F.col("source")), F.lit("}"))
    top = F.col("position") <= ITEMS_PER_EDITION
    per = (ranked.select("edition_date", "url", F.when(top, F.struct("position", item.alias("j"))).alias("it"))
           .groupBy("edition_date").agg(F.collect_list("url").alias("urls"),
                                        F.array_sort(F.collect_list("it")).alias("its"))
           .select("edition_date", "urls", F.transform("its", lambda x: x["j"]).alias("js")))
    date = F.date_format("edition_date", "yyyy-MM-dd")
    head = F.concat(F.lit('{"date":"'), date, F.lit('","generated_at":"'), date, F.lit(RUN_HOUR),
                    F.lit('","provider":"deepseek","items":'))
    js = F.col("js")

    def doc(items: Column) -> Column:
        return F.concat(head, F.lit("["), F.array_join(items, ","), F.lit("]}"))

    def at(i: int, f):
        return F.transform(js, lambda x, k: F.when(k == i, f(x)).otherwise(x))

    valid = doc(js)
    repeated = doc(at(1, lambda x: F.regexp_replace(x, r'^\{"rank":[0-9]+,', '{"rank":1,')))
    bad = doc(F.transform(js, lambda x, k: F.when(k == 0, F.regexp_replace(
        x, r'"category":"[a-z]+"', '"category":"otros"')).when(k == 1, F.regexp_replace(
            x, r"^\{", '{"extra":true,')).otherwise(x)))
    invented = F.concat(F.lit('{"rank":20,"category":"industria","title":"Inventado","summary":"x",'
                              '"why_it_matters":"y","url":"https://invented.example/'), date,
                        F.lit('","source":"x"}'))
    plus_invented = doc(F.concat(js, F.array(invented)))
    few = doc(F.slice(js, 1, 3))
    odd_ranks = doc(F.transform(js, lambda x, k: F.when(k == 0, F.regexp_replace(
        x, r'^\{"rank":[0-9]+,', '{"rank":1.0,')).when(k == 1, F.regexp_replace(
            x, r'^\{"rank":[0-9]+,', '{"rank":"2",')).otherwise(x)))

    def att(*raws: Column) -> Column:
        return F.array(*[F.struct(F.lit(i + 1).alias("attempt"), r.alias("raw")) for i, r in enumerate(raws)])

    k = F.datediff("edition_date", F.lit(EPOCH_DAY).cast("date")) % 5
    attempts = (F.when(k == 0, att(F.lit(SORRY), repeated, valid))
                .when(k == 1, att(F.concat(F.lit("```json\n"), valid, F.lit("\n```"))))
                .when(k == 2, att(bad, plus_invented))
                .when(k == 3, att(few, few, few))
                .otherwise(att(F.concat(head, F.lit('"none"}')), F.lit("[1,2]"), odd_ranks)))
    if not with_context:
        return per.select("edition_date", F.inline(attempts))
    return per.select("edition_date", "urls", date.alias("date"),
                      F.concat(date, F.lit(RUN_HOUR)).alias("generated_at"), F.lit("deepseek").alias("provider"),
                      F.inline(attempts))
