"""Driver queries for J-ACCEPT and J-PROMPT."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions.formats import uri_pattern
from broadsheet.functions.prompts import digest_prompts
from broadsheet.operators import validate as V
from broadsheet.operators.dedup import CANDIDATE_CAP, dedup_candidates, rank_per_edition
from broadsheet.operators.enrich import enrich
from broadsheet.plans.catalog import query
from broadsheet.plans.derived import collected, digest_answers, edition_runs, pages_by_edition
from broadsheet.plans.queries_enrich import ENRICH_TAIL, _ENRICH_SQL
from broadsheet.plans.queries_rank import _DEDUP_SQL

_CATS = "['lanzamientos', 'investigacion', 'industria', 'herramientas']"
_ITEM_KEYS = "['rank', 'category', 'title', 'summary', 'why_it_matters', 'url', 'source', 'social']"
_ITEM_REQ = "['rank', 'category', 'title', 'summary', 'why_it_matters', 'url', 'source']"
_ROOT_KEYS = "['date', 'generated_at', 'provider', 'items', 'repos']"
_FENCE = r"^```(?:json)?\s*([\s\S]*?)\s*```$"
_URI = uri_pattern(java=False).replace("'", "''")

ANSWERS_SQL = _DEDUP_SQL.format(by="edition_date,") + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY edition_date
                     ORDER BY coalesce(points, 0) DESC, published_at DESC, seq) AS position FROM merged),
cand AS (SELECT * FROM ranked WHERE position <= {CANDIDATE_CAP}),
inputs AS (SELECT edition_date, list(url) AS urls FROM cand GROUP BY edition_date),
runs AS (SELECT DISTINCT edition_date, strftime(edition_date, '%Y-%m-%d') AS date,
                strftime(edition_date, '%Y-%m-%d') || 'T06:00:00.000Z' AS generated_at, 'deepseek' AS provider
         FROM cand),
it AS (SELECT edition_date, position,
              '{{"rank":' || position || ',"category":"' || {_CATS}[seq % 4 + 1] || '","title":' || to_json(title)::VARCHAR
              || ',"summary":' || to_json('Resumen de ' || source)::VARCHAR
              || ',"why_it_matters":' || to_json('Porque ' || position)::VARCHAR
              || ',"url":' || to_json(url)::VARCHAR || ',"source":' || to_json(source)::VARCHAR || '}}' AS j
       FROM cand WHERE position <= 20),
ed AS (SELECT edition_date, strftime(edition_date, '%Y-%m-%d') AS date, list(j ORDER BY position) AS js,
              datediff('day', date '2024-01-01', edition_date) % 5 AS k,
              '{{"date":"' || strftime(edition_date, '%Y-%m-%d') || '","generated_at":"' || strftime(edition_date, '%Y-%m-%d')
              || 'T06:00:00.000Z","provider":"deepseek","items":' AS head
       FROM it GROUP BY edition_date),
docs AS (SELECT *,
    head || '[' || array_to_string(js, ',') || ']}}' AS valid,
    head || '[' || array_to_string(list_transform(js, lambda x, i: CASE WHEN i = 2
        THEN regexp_replace(x, '^\\{{"rank":[0-9]+,', '{{"rank":1,') ELSE x END), ',') || ']}}' AS repeated,
    head || '[' || array_to_string(list_transform(js, lambda x, i: CASE
        WHEN i = 1 THEN regexp_replace(x, '"category":"[a-z]+"', '"category":"otros"')
        WHEN i = 2 THEN regexp_replace(x, '^\\{{', '{{"extra":true,') ELSE x END), ',') || ']}}' AS bad,
    head || '[' || array_to_string(list_append(js, '{{"rank":20,"category":"industria","title":"Inventado","summary":"x",'
        || '"why_it_matters":"y","url":"https://invented.example/' || date || '","source":"x"}}'), ',') || ']}}'
        AS plus_invented,
    head || '[' || array_to_string(js[1:3], ',') || ']}}' AS few,
    head || '[' || array_to_string(list_transform(js, lambda x, i: CASE
        WHEN i = 1 THEN regexp_replace(x, '^\\{{"rank":[0-9]+,', '{{"rank":1.0,')
        WHEN i = 2 THEN regexp_replace(x, '^\\{{"rank":[0-9]+,', '{{"rank":"2",') ELSE x END), ',') || ']}}' AS odd_ranks
  FROM ed),
att AS (
  SELECT edition_date, 1 AS attempt, 'Lo siento, no puedo ayudar con eso.' AS raw FROM docs WHERE k = 0
  UNION ALL SELECT edition_date, 2, repeated FROM docs WHERE k = 0
  UNION ALL SELECT edition_date, 3, valid FROM docs WHERE k = 0
  UNION ALL SELECT edition_date, 1, '```json' || chr(10) || valid || chr(10) || '```' FROM docs WHERE k = 1
  UNION ALL SELECT edition_date, 1, bad FROM docs WHERE k = 2
  UNION ALL SELECT edition_date, 2, plus_invented FROM docs WHERE k = 2
  UNION ALL SELECT edition_date, a, few FROM docs, range(1, 4) t(a) WHERE k = 3
  UNION ALL SELECT edition_date, 1, head || '"none"}}' FROM docs WHERE k = 4
  UNION ALL SELECT edition_date, 2, '[1,2]' FROM docs WHERE k = 4
  UNION ALL SELECT edition_date, 3, odd_ranks FROM docs WHERE k = 4),
p AS (SELECT a.edition_date, CAST(a.attempt AS INTEGER) AS attempt, a.raw, i.urls, r.date, r.generated_at, r.provider,
             CASE WHEN regexp_matches(trim(a.raw), '{_FENCE}') THEN regexp_extract(trim(a.raw), '{_FENCE}', 1)
                  ELSE trim(a.raw) END AS txt
      FROM att a LEFT JOIN inputs i USING (edition_date) LEFT JOIN runs r USING (edition_date)),
q AS (SELECT *, CASE WHEN json_valid(txt) THEN txt::JSON END AS v FROM p),
r0 AS (SELECT *, coalesce(json_type(v) = 'OBJECT', false) AS root_obj,
              CASE WHEN json_type(v, '$.items') = 'ARRAY' THEN json_extract(v, '$.items[*]') END AS items_arr
       FROM q),
s AS (SELECT *, CASE WHEN root_obj THEN list_filter(items_arr, lambda x: NOT coalesce(
                     json_type(x, '$.url') = 'VARCHAR' AND NOT list_contains(urls, json_extract_string(x, '$.url')), false))
                END AS kept
      FROM r0)"""


def _text(x: str, k: str, lo: int, hi: int | None) -> str:
    s = f"json_extract_string({x}, '$.{k}')"
    cond = f"json_type({x}, '$.{k}') = 'VARCHAR' AND length({s}) >= {lo}"
    return cond + (f" AND length({s}) <= {hi}" if hi else "")


def _item_errs(x: str, idx: str) -> str:
    pre = f"('V4:items[' || {idx} || '].')"
    rank_t = f"json_type({x}, '$.rank')"
    rank_v = f"TRY_CAST(json_extract({x}, '$.rank') AS DOUBLE)"
    url = f"json_extract_string({x}, '$.url')"
    sx = f"json_extract({x}, '$.social')"
    checks = {
        "rank": f"({rank_t} IN ('BIGINT', 'UBIGINT') OR ({rank_t} = 'DOUBLE' AND {rank_v} % 1 = 0)) "
                f"AND {rank_v} BETWEEN 1 AND 20",
        "category": f"json_type({x}, '$.category') = 'VARCHAR' "
                    f"AND list_contains({_CATS}, json_extract_string({x}, '$.category'))",
        "title": _text(x, "title", 1, 200),
        "summary": _text(x, "summary", 1, 800),
        "why_it_matters": _text(x, "why_it_matters", 1, 400),
        "url": f"json_type({x}, '$.url') = 'VARCHAR' AND regexp_matches({url}, '^https?://') "
               f"AND regexp_matches({url}, '{_URI}')",
        "source": _text(x, "source", 1, None),
        "social": f"coalesce(json_type({sx}) = 'OBJECT', false) AND len(json_keys({sx})) = 2 "
                  f"AND list_contains(json_keys({sx}), 'x') AND list_contains(json_keys({sx}), 'linkedin') "
                  f"AND {_text(sx, 'x', 1, None)} AND {_text(sx, 'linkedin', 1, None)}",
    }
    fields = ", ".join(
        f"CASE WHEN list_contains(json_keys({x}), '{k}') AND NOT coalesce({c}, false) THEN "
        + (f"'V5:items[' || {idx} || '].social'" if k == "social" else f"{pre} || '{k}'") + " END"
        for k, c in checks.items())
    return (f"CASE WHEN coalesce(json_type({x}), '') <> 'OBJECT' THEN [{pre} || 'type'] ELSE list_concat(list_concat("
            f"list_transform(list_sort(list_filter(json_keys({x}), lambda kk: NOT list_contains({_ITEM_KEYS}, kk))),"
            f" lambda kk: {pre} || 'extra:' || kk), "
            f"list_transform(list_filter({_ITEM_REQ}, lambda kk: NOT list_contains(json_keys({x}), kk)),"
            f" lambda kk: {pre} || 'required:' || kk)), [{fields}]) END")


CHECKED_SQL = ANSWERS_SQL + f""",
e0 AS (SELECT *,
  list_filter(list_concat(list_concat(list_concat(
    list_transform(list_sort(list_filter(coalesce(json_keys(v), []), lambda kk: NOT list_contains({_ROOT_KEYS}, kk))),
                   lambda kk: 'V1:extra:' || kk),
    [CASE WHEN NOT coalesce(regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(date AS DATE) IS NOT NULL, false)
          THEN 'V2:date' END,
     CASE WHEN TRY_CAST(generated_at AS TIMESTAMP) IS NULL THEN 'V2:generated_at' END,
     CASE WHEN NOT coalesce(provider IN ('deepseek', 'claude-code'), false) THEN 'V2:provider' END]),
    CASE WHEN NOT list_contains(coalesce(json_keys(v), []), 'items') THEN ['V1:required:items']
         WHEN kept IS NULL THEN ['V3:type']
         ELSE list_concat([CASE WHEN len(kept) < 6 THEN 'V3:min' END, CASE WHEN len(kept) > 20 THEN 'V3:max' END],
                          flatten(list_transform(kept, lambda x, i: {_item_errs('x', '(i - 1)')}))) END),
    CASE WHEN NOT list_contains(coalesce(json_keys(v), []), 'repos') THEN []
         WHEN json_type(v, '$.repos') <> 'ARRAY' THEN ['V6:type'] ELSE [CASE WHEN json_array_length(v, '$.repos') > 8 THEN 'V6:max' END] END),
    lambda ee: ee IS NOT NULL) AS schema_errs,
  list_filter(list_append(
    list_transform(kept, lambda x, i: CASE WHEN NOT list_contains(urls, json_extract_string(x, '$.url'))
                                           THEN 'J3:items[' || (i - 1) || '].url' END),
    CASE WHEN len(list_distinct(list_transform(kept, lambda x: TRY_CAST(json_extract(x, '$.rank') AS DOUBLE))))
              <> len(kept) THEN 'A4:rank' END), lambda ee: ee IS NOT NULL) AS late_errs
  FROM s),
checked AS (SELECT *, list_sort(CASE WHEN v IS NULL THEN ['F12:json'] WHEN NOT root_obj THEN ['V1:type']
                                     WHEN len(schema_errs) > 0 THEN schema_errs ELSE late_errs END) AS errs
            FROM e0)"""


def _ranked(spark, sf_dir):
    return rank_per_edition(dedup_candidates(collected(spark, sf_dir)), CANDIDATE_CAP)


def _checked(spark, sf_dir):
    return V.check_attempts(digest_answers(_ranked(spark, sf_dir), with_context=True))


@query("digest_validation", CHECKED_SQL + """
SELECT edition_date, attempt, len(errs) = 0 AS ok, array_to_string(errs, ';') AS errors,
       CASE WHEN root_obj THEN len(items_arr) END AS n_in,
       CASE WHEN root_obj AND items_arr IS NOT NULL THEN len(items_arr) - len(kept) END AS n_dropped
FROM checked
""")
def digest_validation(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "edition_date", F.col("attempt").cast("int").alias("attempt"), "ok",
        F.array_join("errors", ";").alias("errors"), F.col("n_in").cast("bigint").alias("n_in"),
        F.col("n_dropped").cast("bigint").alias("n_dropped"))


@query("foreign_url_drop", ANSWERS_SQL + """
SELECT edition_date, CAST(attempt AS INTEGER) AS attempt, json_extract_string(x, '$.url') AS dropped_url
FROM (SELECT edition_date, attempt, urls, unnest(items_arr) AS x FROM s WHERE root_obj AND items_arr IS NOT NULL)
WHERE json_type(x, '$.url') = 'VARCHAR' AND NOT list_contains(urls, json_extract_string(x, '$.url'))
""")
def foreign_url_drop(spark, sf_dir):
    """J2 + J3: every item dropped because its URL was not an input."""
    c = _checked(spark, sf_dir)
    items = F.try_variant_get(F.col("v"), "$.items", "array<variant>")
    urls = F.coalesce(F.col("urls"), F.array().cast("array<string>"))
    dropped = F.filter(items, lambda x: F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.url", "variant"))
                                                   == "STRING", F.lit(False))
                       & ~F.array_contains(urls, F.try_variant_get(x, "$.url", "string")))
    return c.select("edition_date", F.col("attempt").cast("int").alias("attempt"),
                    F.explode(F.transform(dropped, lambda x: F.try_variant_get(x, "$.url", "string")))
                    .alias("dropped_url"))


@query("first_valid_attempt", CHECKED_SQL + """
SELECT edition_date, attempt, len(kept) AS n_items FROM checked WHERE len(errs) = 0 AND attempt <= 3
QUALIFY row_number() OVER (PARTITION BY edition_date ORDER BY attempt) = 1
""")
def first_valid_attempt(spark, sf_dir):
    return V.first_valid(_checked(spark, sf_dir)).select(
        "edition_date", F.col("attempt").cast("int").alias("attempt"), F.size("items").cast("bigint").alias("n_items"))


def _prompt_sql(final_select: str, base: str = _ENRICH_SQL) -> str:
    return base + f""",
pr_runs AS (SELECT DISTINCT edition_date, strftime(edition_date, '%Y-%m-%d') AS date,
                   strftime(edition_date, '%Y-%m-%d') || 'T06:00:00.000Z' AS generated_at, 'deepseek' AS provider
            FROM cand),
lines AS (SELECT e.edition_date, e.position,
                 e.position || '. [' || c.source || ']' || CASE WHEN c.points IS NOT NULL THEN ' (' || c.points || ' pts)' ELSE '' END
                 || ' ' || c.title
                 || CASE WHEN left(regexp_replace(CASE WHEN coalesce(e.content, '') <> '' THEN e.content ELSE coalesce(c.snippet, '') END, '\\s+', ' ', 'g'), 600) <> ''
                         THEN chr(10) || '   ' || left(regexp_replace(CASE WHEN coalesce(e.content, '') <> '' THEN e.content ELSE coalesce(c.snippet, '') END, '\\s+', ' ', 'g'), 600)
                         ELSE '' END
                 || chr(10) || '   URL: ' || e.url AS line
          FROM enriched e JOIN cand c ON c.edition_date = e.edition_date AND c.url = e.url),
base AS (SELECT l.edition_date,
                'Datos de cabecera para el JSON de salida (cópialos tal cual):' || chr(10) || '- date: ' || r.date || chr(10)
                || '- generated_at: ' || r.generated_at || chr(10) || '- provider: ' || r.provider || chr(10) || chr(10)
                || 'Ítems recogidos en las últimas 24 h (' || count(*) || '). Copia las URL LITERALMENTE:' || chr(10) || chr(10)
                || string_agg(l.line, chr(10) || chr(10) ORDER BY l.position) AS prompt
         FROM lines l JOIN pr_runs r USING (edition_date) GROUP BY l.edition_date, r.date, r.generated_at, r.provider)
{final_select}"""


def _base_prompts(spark, sf_dir):
    ranked = rank_per_edition(dedup_candidates(collected(spark, sf_dir)), CANDIDATE_CAP)
    enriched = enrich(ranked, pages_by_edition(spark, sf_dir))
    return digest_prompts(enriched, edition_runs(ranked))


@query("prompt_text", _prompt_sql("SELECT edition_date, prompt FROM base"))
def prompt_text(spark, sf_dir):
    return _base_prompts(spark, sf_dir)


@query("retry_prompts", _prompt_sql("""
SELECT c.edition_date, c.attempt + 1 AS attempt,
       b.prompt || chr(10) || chr(10) || '---' || chr(10) || 'La respuesta anterior NO fue válida. Corrige EXACTAMENTE '
       || 'estos problemas y responde de nuevo solo con el JSON:' || chr(10) || '- ' || array_to_string(c.errs, chr(10) || '- ')
       AS prompt
FROM checked c JOIN base b USING (edition_date)
WHERE len(c.errs) > 0 AND c.attempt < 3
""", base=CHECKED_SQL + "," + ENRICH_TAIL))
def retry_prompts(spark, sf_dir):
    """base prompt plus the last attempt's errors, for every failed attempt before the third."""
    return V.retry_prompts(_checked(spark, sf_dir), _base_prompts(spark, sf_dir)) \
        .withColumn("attempt", F.col("attempt").cast("int"))
