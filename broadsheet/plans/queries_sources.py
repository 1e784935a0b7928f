"""Driver queries for the source union and the model-answer exchange
(U1, S3, S4, P6, A2, A1, T1, S10, J6, A10).

Runs are the UTC days of ``events`` (as in ``queries_ingest``): feed entries
and story hits come from ``events``; the trending-model list of run D is the
suppliers with ``s_suppkey % 30 = D - 2024-01-01``, in key order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions.social import _BOLD, _PLAIN
from broadsheet.operators import ingest as I
from broadsheet.operators.collect import MAJOR_BITS, MINOR_BITS, MODEL_KIND, STORY_KIND, collect_all
from broadsheet.operators.dedup import CANDIDATE_CAP, dedup_candidates, rank_per_edition
from broadsheet.operators.social import attach_item_social, post_coverage
from broadsheet.operators.validate import PROVIDERS
from broadsheet.plans.catalog import iso_ts, query
from broadsheet.plans.derived import EDITION_SPAN_DAYS, EPOCH_DAY, digest_answers, editions
from broadsheet.plans.queries_accept import ANSWERS_SQL, CHECKED_SQL
from broadsheet.plans.queries_ingest import FEED_SQL, STORY_QUERIES, STORY_SQL, feed_entries, story_hits_input
from broadsheet.plans.queries_rank import _DEDUP_SQL
from broadsheet.plans.sqlparts import COLLECTED, iso
from broadsheet.sources.landed import model_rows, unwrap_answer
from broadsheet.sources.tables import read_table

HIGH = MAJOR_BITS + MINOR_BITS
QLIST = "[" + ", ".join(f"'{q}'" for q in STORY_QUERIES) + "]"


def model_answers(spark, sf_dir):
    """One landed model row per supplier (see module doc); ids, counts and
    dates are missing or unreadable on fixed key residues."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    run = F.date_add(F.lit(EPOCH_DAY).cast("date"), (k % EDITION_SPAN_DAYS).cast("int"))
    as_of = run.cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    return s.select(
        run.alias("run_date"), as_of.alias("as_of"), k.alias("item_ordinal"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("org/m"), k.cast("string"))).alias("id"),
        F.concat(F.lit("mirror/m"), k.cast("string")).alias("modelId"),
        F.when(k % 5 != 0, k * 10).alias("downloads"),
        F.when(k % 3 != 0, k % 97).alias("likes"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 13 == 0, F.lit("yesterday"))
        .otherwise(iso_ts(as_of - F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int")))).alias("lastModified"))


def _sources(spark, sf_dir):
    by = ("run_date",)
    feeds = I.map_feed_items(feed_entries(spark, sf_dir)).select(
        "run_date",
        F.array_position(F.array(*[F.lit(q) for q in STORY_QUERIES]), F.col("feed")).alias("source_ordinal"),
        F.col("event_id").alias("item_ordinal"), F.concat(F.lit("feed-"), F.col("feed")).alias("source"),
        "title", "snippet", "url", "published_at")
    stories = I.merge_story_hits(I.story_hits(story_hits_input(spark, sf_dir)))
    models = model_rows(model_answers(spark, sf_dir), by=by)
    return collect_all(feeds, stories, models, by=by)


SOURCES_SQL = f"""{FEED_SQL},
{STORY_SQL},
sm AS (SELECT run_date, trim(url) AS url, first(title ORDER BY qo, hit_pos) AS title,
              first(created ORDER BY qo, hit_pos) AS published_at, max(coalesce(points, 0)) AS points,
              first(qo ORDER BY qo, hit_pos) AS qo1, first(hit_pos ORDER BY qo, hit_pos) AS hp1
       FROM top WHERE regexp_matches(trim(url), '^https?://') GROUP BY run_date, trim(url)),
ms AS (SELECT date '{EPOCH_DAY}' + CAST(s_suppkey % {EDITION_SPAN_DAYS} AS INTEGER) AS run_date, s_suppkey AS k,
              CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN '' ELSE 'org/m' || s_suppkey END AS id,
              'mirror/m' || s_suppkey AS model_id,
              CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 10 END AS downloads,
              CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 97 END AS likes
       FROM supplier),
ms2 AS (SELECT *, CAST(run_date AS TIMESTAMP) + INTERVAL 12 HOUR AS as_of, coalesce(id, model_id) AS mid FROM ms),
ms3 AS (SELECT *, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 13 = 0 THEN 'yesterday'
                       ELSE {iso('as_of - k * INTERVAL 1 MINUTE')} END AS last_modified FROM ms2),
srcs AS (
  SELECT run_date, (list_position({QLIST}, event_type)::BIGINT << {MINOR_BITS}) | event_id AS seq,
         trim(title) AS title, left(trim(props), 500) AS snippet, url, 'feed-' || event_type AS source,
         coalesce(pts, as_of) AS published_at, CAST(NULL AS BIGINT) AS points
  FROM p
  WHERE regexp_matches(url, '^https?://') AND (pts IS NULL OR pts >= as_of - INTERVAL 24 HOUR) AND trim(title) <> ''
  UNION ALL
  SELECT run_date, ({STORY_KIND}::BIGINT << {HIGH}) | (qo1::BIGINT << {MINOR_BITS}) | hp1, title, '', url,
         'Hacker News', published_at, points
  FROM sm
  UNION ALL
  SELECT run_date, ({MODEL_KIND}::BIGINT << {HIGH}) | k, 'Modelo en tendencia: ' || mid,
         'Descargas: ' || coalesce(CAST(downloads AS VARCHAR), '?') || ', likes: ' || coalesce(CAST(likes AS VARCHAR), '?'),
         'https://huggingface.co/' || mid, 'Hugging Face (trending)',
         CASE WHEN last_modified IS NULL THEN as_of ELSE try_strptime(last_modified, '%Y-%m-%dT%H:%M:%S.%gZ') END,
         CAST(NULL AS BIGINT)
  FROM ms3 WHERE mid <> ''
)"""


@query("collected_sources", f"""
WITH {SOURCES_SQL}
SELECT run_date, seq, title, snippet, url, source, {iso('published_at')} AS published_at, points FROM srcs
""")
def collected_sources(spark, sf_dir):
    """Feeds, stories and trending models of every run in one table, with
    the packed arrival key ``seq``."""
    u = _sources(spark, sf_dir)
    return u.select("run_date", "seq", "title", "snippet", "url", "source",
                    iso_ts("published_at").alias("published_at"), "points")


_SOURCES_DEDUP_SQL = _DEDUP_SQL.format(by="edition_date,").replace(
    f"WITH {COLLECTED},",
    f"WITH {SOURCES_SQL},\ncollected AS (SELECT run_date AS edition_date, * EXCLUDE (run_date) FROM srcs),", 1)


@query("candidates_from_sources", _SOURCES_DEDUP_SQL + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY edition_date
                     ORDER BY coalesce(points, 0) DESC, published_at DESC, seq) AS position FROM merged)
SELECT edition_date, position, seq, title, snippet, url, source, {iso('published_at')} AS published_at, points
FROM ranked WHERE position <= {CANDIDATE_CAP}
""")
def candidates_from_sources(spark, sf_dir):
    """J-INGEST + J-RANK over the source union: dedup by canonical URL inside
    each run, then the top ``cap`` by signal."""
    u = _sources(spark, sf_dir).withColumnRenamed("run_date", "edition_date")
    r = rank_per_edition(dedup_candidates(u), cap=CANDIDATE_CAP)
    return r.select("edition_date", F.col("position").cast("bigint").alias("position"), "seq", "title", "snippet",
                    "url", "source",
                    iso_ts("published_at").alias("published_at"), "points")


@query("answer_unwrap", ANSWERS_SQL + f""",
env AS (SELECT edition_date, attempt, raw,
               {PROVIDERS}[(datediff('day', date '{EPOCH_DAY}', edition_date) + attempt) % 2 + 1] AS provider
        FROM att),
wrapped AS (SELECT *, CASE
    WHEN provider = 'claude-code' AND attempt = 1 THEN raw
    WHEN provider = 'claude-code' THEN to_json({{'type': 'result', 'result': raw}})::VARCHAR
    WHEN attempt = 3 THEN to_json({{'choices': [{{'message': {{'content': ''}}}}]}})::VARCHAR
    ELSE to_json({{'id': 'x', 'choices': [{{'index': 0, 'message': {{'role': 'assistant', 'content': raw}}}}]}})::VARCHAR
  END AS envelope FROM env)
SELECT edition_date, CAST(attempt AS INTEGER) AS attempt, provider,
       CASE WHEN provider = 'claude-code' AND attempt = 1 THEN envelope
            WHEN provider = 'claude-code' THEN json_extract_string(envelope, '$.result')
            ELSE nullif(json_extract_string(envelope, '$.choices[0].message.content'), '') END AS text
FROM wrapped
""")
def answer_unwrap(spark, sf_dir):
    """Every derived model answer inside the envelope of its provider
    (chat API or command-line tool), unwrapped again. The command-line tool's
    first attempt is plain text; the chat API's third attempt is empty."""
    from broadsheet.plans.queries_accept import _ranked
    att = digest_answers(_ranked(spark, sf_dir))
    day = F.datediff("edition_date", F.lit(EPOCH_DAY).cast("date"))
    provider = F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), ((day + F.col("attempt")) % 2 + 1).cast("int"))
    raw = F.col("raw")
    chat = F.to_json(F.struct(F.lit("x").alias("id"), F.array(F.struct(
        F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), raw.alias("content")).alias("message")))
        .alias("choices")))
    empty_chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("").alias("content")).alias("message")))
                                    .alias("choices")))
    cli = F.to_json(F.struct(F.lit("result").alias("type"), raw.alias("result")))
    a = att.withColumn("provider", provider)
    envelope = (F.when((F.col("provider") == "claude-code") & (F.col("attempt") == 1), raw)
                .when(F.col("provider") == "claude-code", cli)
                .when(F.col("attempt") == 3, empty_chat)
                .otherwise(chat))
    return a.select("edition_date", F.col("attempt").cast("int").alias("attempt"), "provider",
                    unwrap_answer(envelope, F.col("provider")).alias("text"))


def _digest_items(spark, sf_dir):
    e = editions(spark, sf_dir)
    return e.select(F.col("date"), F.explode("items").alias("i")).select(
        F.to_date("date").alias("edition_date"), "i.rank", "i.title", "i.summary", "i.why_it_matters", "i.url",
        "i.source")


def _post_responses(items):
    """One post answer per item: ranks divisible by 5 got none, by 7 a non-JSON
    text, by 6 a JSON null; the rest a fenced object whose hooks come from
    the item."""
    r = F.col("rank")
    body = F.to_json(F.struct(F.col("title").alias("hook_x"),
                              F.concat(F.lit("**"), F.col("source"), F.lit("** "), F.col("title")).alias("hook_linkedin"),
                              F.array(F.col("source"), F.lit("IA")).alias("hashtags")))
    raw = (F.when(r % 7 == 0, F.lit("sin respuesta")).when(r % 6 == 0, F.lit("null"))
           .otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))))
    return items.where(r % 5 != 0).select("edition_date", F.lit("item_social").alias("call_kind"),
                                          r.cast("string").alias("key"), F.lit(1).alias("attempt"), raw.alias("raw"))


_POSTS_SQL = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day FROM events),
top AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS rank
        FROM ev QUALIFY rank <= 20),
posts AS (SELECT day AS edition_date, rank, event_type || ' ' || event_id AS title,
                 'https://e.example/' || user_id AS url, '#' || event_type || ' #IA' AS t,
                 rank % 5 <> 0 AND rank % 7 <> 0 AND rank % 6 <> 0 AS ok, event_type
          FROM top)"""


@query("item_posts", f"""
WITH {_POSTS_SQL}
SELECT edition_date, CAST(rank AS INTEGER) AS rank,
       CASE WHEN ok THEN title || chr(10) || chr(10) || t || chr(10) || url END AS x,
       CASE WHEN ok THEN translate(event_type, '{_PLAIN}', '{_BOLD}') || ' ' || title || chr(10) || chr(10) || t
                         || chr(10) || chr(10) || url END AS linkedin
FROM posts
""")
def item_posts(spark, sf_dir):
    """J6 + F10 + F14 + F15 on every digest item: the post answer of the item
    (fenced JSON, missing, not JSON or JSON null) becomes its social struct."""
    items = _digest_items(spark, sf_dir)
    posted = attach_item_social(items, _post_responses(items))
    return posted.select("edition_date", F.col("rank").cast("int").alias("rank"),
                         F.col("social.x").alias("x"), F.col("social.linkedin").alias("linkedin"))


@query("post_coverage", f"""
WITH {_POSTS_SQL}
SELECT edition_date, count(*) FILTER (WHERE ok) AS n_posted, count(*) AS n_total FROM posts GROUP BY edition_date
""")
def post_coverage_q(spark, sf_dir):
    """A10: posts made out of items, per edition."""
    items = _digest_items(spark, sf_dir)
    return post_coverage(attach_item_social(items, _post_responses(items)))


@query("edition_documents", CHECKED_SQL + """,
acc AS (SELECT edition_date, date, generated_at, provider, kept FROM checked WHERE len(errs) = 0 AND attempt <= 3
        QUALIFY row_number() OVER (PARTITION BY edition_date ORDER BY attempt) = 1),
acc_items AS (SELECT edition_date, date, generated_at, provider, i AS pos, kept[i] AS x
              FROM acc, range(1, 21) t(i) WHERE i <= len(kept)),
ty AS (SELECT *, CAST(json_extract(x, '$.rank') AS INTEGER) AS rank, json_extract_string(x, '$.title') AS title
       FROM acc_items)
SELECT edition_date, date, generated_at, provider, count(*) AS n_items,
       string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos) AS ranks,
       first(title ORDER BY pos) AS lead_title,
       count(*) FILTER (WHERE rank % 5 <> 0 AND rank % 7 <> 0 AND rank % 6 <> 0) AS n_social
FROM ty GROUP BY edition_date, date, generated_at, provider
""")
def edition_documents(spark, sf_dir):
    """F13 + J6 + document assembly: the first valid answer of each edition
    becomes its document, posts attached per item; summarised per edition."""
    from broadsheet.operators import validate as V
    from broadsheet.operators.edition import accepted_items, assemble_editions
    from broadsheet.plans.queries_accept import _checked
    accepted = V.first_valid(_checked(spark, sf_dir))
    items = accepted_items(accepted)
    posted = attach_item_social(items, _post_responses(items))
    docs = assemble_editions(posted, accepted.select("edition_date", "date", "generated_at", "provider"))
    ranks = F.transform("items", lambda i: i["rank"].cast("string"))
    return docs.select("edition_date", "date", "generated_at", "provider", F.size("items").cast("bigint").alias("n_items"),
                       F.array_join(ranks, ",").alias("ranks"), F.col("items")[0]["title"].alias("lead_title"),
                       F.size(F.filter("items", lambda i: i["social"].isNotNull())).cast("bigint").alias("n_social"))
