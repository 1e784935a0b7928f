"""Driver queries for rules that no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions.dates import lenient_date, thousands_es
from broadsheet.functions.formats import is_date_time, is_uri, uri_pattern
from broadsheet.functions.html import meta_description
from broadsheet.operators import archive as A
from broadsheet.operators.social import post_requests
from broadsheet.operators.validate import check_attempts
from broadsheet.plans.catalog import iso_ts, query
from broadsheet.plans.derived import editions
from broadsheet.plans.queries_archive import EDITIONS_SQL
from broadsheet.plans.sqlparts import iso
from broadsheet.sources.landed import story_hit_rows
from broadsheet.sources.tables import read_table, spread


@query("lenient_dates", f"""
WITH t AS (SELECT event_id, event_id % 6 AS k, date_trunc('minute', ts) AS m, date_trunc('second', ts) AS s, date_trunc('day', ts) AS d FROM events)
SELECT event_id, CASE WHEN k < 5 THEN {iso("CASE k WHEN 0 THEN m WHEN 1 THEN d WHEN 2 THEN s + INTERVAL 4 HOUR WHEN 3 THEN s ELSE m - INTERVAL 150 MINUTE END")} END AS read_at FROM t
""")
def lenient_dates(spark, sf_dir):
    """free forms of an event's time: month name with a clock of two halves, a day
    alone, a zone name, slashes, an offset after words, and text that is no date."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts")

    def shown(pattern: str):
        return F.date_format("ts", pattern)

    k = F.col("event_id") % 6
    text = (F.when(k == 0, shown("MMMM d, yyyy h:mm a")).when(k == 1, shown("d MMM yyyy")).when(k == 2, shown("EEE, dd MMM yyyy HH:mm:ss 'EDT'"))
            .when(k == 3, shown("M/d/yyyy HH:mm:ss")).when(k == 4, shown("EEE MMM dd yyyy HH:mm 'GMT'+0230 '(far away)'")).otherwise(shown("'in' MMMM d 'or so'")))
    return e.select("event_id", iso_ts(lenient_date(text)).alias("read_at"))


_VARIANT_SQL = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN url || '%zz' WHEN 2 THEN url || '<a>' WHEN 3 THEN url || '/%C3%A9?q=a/b' WHEN 4 THEN replace(url, '://', '://[::' || page_id % 10 || ']:80/')
  WHEN 5 THEN url || ' b' WHEN 6 THEN replace(url, '://', ':') ELSE replace(url, '://', '://[1::2::3]/') END"""
_TIME_SQL = """printf('%04d-%02d-%02d', 2020 + page_id % 9, 1 + page_id % 13, 1 + page_id % 31)"""


@query("schema_formats", f"""
WITH v AS (SELECT page_id, {_VARIANT_SQL} AS uri, {_TIME_SQL} AS d, CASE page_id % 5 WHEN 0 THEN 'T05:00:00Z' WHEN 1 THEN ' 23:59:60Z' WHEN 2 THEN 'T05:00:00' WHEN 3 THEN 'T24:00:00Z' ELSE 't05:00:00.5+02:30' END AS t FROM pages)
SELECT page_id, regexp_matches(uri, '{uri_pattern(java=False).replace("'", "''")}') AS uri_ok,
       coalesce(TRY_CAST(d AS DATE) IS NOT NULL AND page_id % 5 IN (0, 1, 4), false) AS date_time_ok FROM v
""")
def schema_formats(spark, sf_dir):
    """V2 + V4: the formats ``uri`` and ``date-time`` on page addresses and days that
    were bent in several ways."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    i, url = F.col("page_id"), F.col("url")
    uri = (F.when(i % 8 == 0, url).when(i % 8 == 1, F.concat(url, F.lit("%zz"))).when(i % 8 == 2, F.concat(url, F.lit("<a>")))
           .when(i % 8 == 3, F.concat(url, F.lit("/%C3%A9?q=a/b"))).when(i % 8 == 4, F.replace(url, F.lit("://"), F.concat(F.lit("://[::"), (i % 10).cast("string"), F.lit("]:80/"))))
           .when(i % 8 == 5, F.concat(url, F.lit(" b"))).when(i % 8 == 6, F.replace(url, F.lit("://"), F.lit(":"))).otherwise(F.replace(url, F.lit("://"), F.lit("://[1::2::3]/"))))
    day = F.format_string("%04d-%02d-%02d", 2020 + i % 9, 1 + i % 13, 1 + i % 31)
    clock = F.element_at(F.array(*[F.lit(t) for t in ("T05:00:00Z", " 23:59:60Z", "T05:00:00", "T24:00:00Z", "t05:00:00.5+02:30")]), (i % 5 + 1).cast("int"))
    return p.select("page_id", is_uri(uri).alias("uri_ok"), is_date_time(F.concat(day, clock)).alias("date_time_ok"))


@query("story_scan", f"""
SELECT event_id // 20 AS answer, event_type AS query, CAST(row_number() OVER (PARTITION BY event_id // 20, event_type ORDER BY event_id) - 1 AS INTEGER) AS hit_id,
       'T' || event_id AS title, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://e.example/' || user_id END AS url,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS points, {iso("date_trunc('second', ts)")} AS created
FROM events WHERE event_id // 20 % 7 <> 3
""")
def story_scan(spark, sf_dir):
    """S3: landed story answers (arrays of hits, every seventh answer failed) as one row
    for each hit. An answer holds the events of one type among 20 neighbours."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    i = F.col("event_id")
    hit = F.struct(i.alias("i"), F.concat(F.lit("T"), i.cast("string")).alias("title"),
                   F.when(i % 3 != 0, F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string"))).alias("url"),
                   F.when(i % 5 != 0, F.floor("value").cast("bigint")).alias("points"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at_i"),
                   i.cast("string").alias("objectID"))
    answer = F.floor(i / 20).cast("bigint")
    landed = (e.groupBy(answer.alias("answer"), F.col("event_type").alias("query")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
              .withColumn("hits", F.when(F.col("answer") % 7 != 3, F.transform("hits", lambda h: h.dropFields("i"))))
              .withColumn("as_of", F.lit(None).cast("timestamp")).withColumn("query_ordinal", F.lit(1)))
    return story_hit_rows(landed, by=("answer",)).select("answer", "query", "hit_id", "title", "url", "points", iso_ts("created").alias("created"))


_CLOSING = "chr(10) || chr(10) || 'Redacta los posts para X y LinkedIn siguiendo las instrucciones.'"


@query("post_prompts", f"""
SELECT 'item_social' AS call_kind, CAST(o_orderkey AS VARCHAR) AS key, 'Noticia:' || chr(10) || 'Titular: ' || o_orderpriority || chr(10) || 'Resumen: ' || o_orderstatus
       || chr(10) || 'Por qué importa: ' || o_custkey || chr(10) || 'Fuente: ' || o_orderpriority || {_CLOSING} AS prompt FROM orders
UNION ALL
SELECT 'repo_social', p_brand || '/' || p_partkey, 'Repositorio:' || chr(10) || 'Nombre: ' || p_brand || '/' || p_partkey || chr(10) || 'Descripción: ' || p_name || chr(10)
       || CASE WHEN p_size % 7 = 0 THEN '' ELSE 'Lenguaje: ' || p_type || chr(10) END || CASE WHEN p_size % 5 = 0 THEN '' ELSE 'Estrellas: ' || p_size * 100 || chr(10) END
       || 'URL: https://github.com/' || p_partkey || {_CLOSING} FROM part
""")
def post_prompts(spark, sf_dir):
    """F23 + F24: the post requests of items and of repos with and without language and stars."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    items = o.select(F.lit(None).cast("date").alias("edition_date"), F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"),
                     F.col("o_custkey").cast("string").alias("why_it_matters"), F.col("o_orderpriority").alias("source"))
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    repos = p.select(F.lit(None).cast("date").alias("edition_date"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("description"),
                     F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("language"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 100).alias("stars"),
                     F.concat(F.lit("https://github.com/"), F.col("p_partkey").cast("string")).alias("url"))
    return post_requests(items, repos).select("call_kind", "key", "prompt")


@query("star_counts", """
SELECT o_orderkey, regexp_replace(CASE WHEN n < 0 THEN '-' ELSE '' END || format('{:,}', abs(n)), ',', '.', 'g') AS shown
FROM (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * o_orderkey * o_custkey AS n FROM orders)
""")
def star_counts(spark, sf_dir):
    """numbers with dots for the thousands."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    n = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1) * F.col("o_orderkey") * F.col("o_custkey")
    return o.select("o_orderkey", thousands_es(n).alias("shown"))


@query("page_descriptions", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 4 THEN 'og ' || page_id ELSE 'P & "Q" ' || page_id END AS description FROM pages
""")
def page_descriptions(spark, sf_dir):
    """descriptions in a page's head, by either property and in either order; the
    social one comes first where both are there."""
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    k, text = F.col("page_id") % 5, F.concat(F.lit("  P &amp; &quot;Q&quot; "), F.col("page_id").cast("string"), F.lit(" "))
    plain = F.concat(F.lit('<meta name="description" content="'), text, F.lit('">'))
    head = (F.when(k == 0, F.lit('<meta name="description" content="">')).when(k == 1, plain)
            .when(k == 2, F.concat(F.lit("<META content='"), text, F.lit("' data-x=1 NAME='description'>")))
            .when(k == 3, F.concat(F.lit('<meta property="og:description" content="'), text, F.lit('"/>')))
            .otherwise(F.concat(plain, F.lit('<meta content="og '), F.col("page_id").cast("string"), F.lit('" property="og:description">'))))
    return p.select("page_id", meta_description(F.concat(F.lit("<head>"), head, F.lit("</head>"), F.col("html"))).alias("description"))


@query("calendar_data", f"""
WITH {EDITIONS_SQL}
SELECT '[' || string_agg('{{"d":"' || date || '","u":"/' || strftime(day, '%Y/%m/%d') || '/"}}', ',' ORDER BY date) || ']' AS datos FROM ed
""")
def calendar_data(spark, sf_dir):
    """the list that the calendar reads, as JSON."""
    return A.calendar_data(editions(spark, sf_dir))


# Social blocks and repos of the derived answers with what they violate.
SOCIAL_CASES = [("null", "V5"), ('{"x":"a","linkedin":"b"}', ""), ('{"x":"a"}', "V5"), ('{"x":"","linkedin":"b"}', "V5"), ('"text"', "V5"), ('{"x":"a","linkedin":"b","z":1}', "V5")]
_REPO = '"name":"o/r","url":"https://github.com/o/r","description":"d"'
REPO_CASES = [
    ('[{' + _REPO + ',"language":"Go","stars":3}]', []), ('[{"name":"o/r","description":"d"}]', ["V6:repos[0].required:url"]),
    ('[{' + _REPO + '},{' + _REPO + ',"stars":-1,"language":5}]', ["V6:repos[1].language", "V6:repos[1].stars"]),
    ('[' + ",".join(['{' + _REPO + '}'] * 9) + ']', ["V6:max"]), ('{}', ["V6:type"]),
    ('[{"name":"","url":"https://x/%zz","description":"' + "d" * 401 + '","z":1}]', ["V6:repos[0].description", "V6:repos[0].extra:z", "V6:repos[0].name", "V6:repos[0].url"]),
    ('[{' + _REPO + ',"stars":2.5,"social":{"x":"a"}}, 7]', ["V6:repos[0].social", "V6:repos[0].stars", "V6:repos[1].type"]),
]
_SQL_CASES = "\n".join(
    f"  WHEN {s * len(REPO_CASES) + r} THEN '{','.join(sorted(([f'V5:items[2].social'] if social[1] else []) + repos[1]))}'"
    for s, social in enumerate(SOCIAL_CASES) for r, repos in enumerate(REPO_CASES))


@query("post_and_repo_checks", f"""
SELECT p_partkey, CASE p_partkey % {len(SOCIAL_CASES)} * {len(REPO_CASES)} + p_size % {len(REPO_CASES)}
{_SQL_CASES} END AS errors FROM part
""")
def post_and_repo_checks(spark, sf_dir):
    """V5 + V6: an answer for each part with one of six post blocks and one of seven
    repo lists, and the rules it violates."""
    p = spread(read_table(spark, sf_dir, "part", "p_partkey", "p_size"))
    items = [f'{{"rank":{k},"category":"industria","title":"T","summary":"S","why_it_matters":"W","url":"https://n.example/{k}","source":"A"' for k in range(1, 7)]

    def pick(cases, by):
        return F.element_at(F.array(*[F.lit(c[0]) for c in cases]), (F.col(by) % len(cases) + 1).cast("int"))

    raw = F.concat(F.lit('{"items":[' + "},".join(items[:2]) + "}," + items[2] + ',"social":'), pick(SOCIAL_CASES, "p_partkey"),
                   F.lit("}," + "},".join(items[3:]) + '}],"repos":'), pick(REPO_CASES, "p_size"), F.lit("}"))
    attempts = p.select("p_partkey", F.lit("2026-07-18").cast("date").alias("edition_date"), F.lit(1).alias("attempt"), raw.alias("raw"),
                        F.array(*[F.lit(f"https://n.example/{k}") for k in range(1, 7)]).alias("urls"), F.lit("2026-07-18").alias("date"),
                        F.lit("2026-07-18T05:00:00.000Z").alias("generated_at"), F.lit("deepseek").alias("provider"))
    return check_attempts(attempts).select("p_partkey", F.array_join("errors", ",").alias("errors"))
