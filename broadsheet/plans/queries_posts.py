"""Driver queries for J-POSTS (F8-F10, F14, F15, T6) over ``documents``.

Each document stands for one digest entry: the hook is its whole text, the
link ``https://d.example/<doc_id>``, the raw hashtags ``'#' || lang`` and
``source`` (cleaned by F14).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions.social import _BOLD, _PLAIN, assemble_linkedin, assemble_x, clean_hashtags
from broadsheet.functions.text import js_trim
from broadsheet.plans.catalog import query
from broadsheet.sources.tables import read_table

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_BOLD_RE = r"\*\*([^\n\r\x{2028}\x{2029}]+?)\*\*"

HOOKS_SQL = f"""
h AS (SELECT doc_id, trim(text, {_WS}) AS hook, 'https://d.example/' || doc_id AS url,
             list_slice(list_filter(list_transform(list_filter(['#' || lang, source], lambda x: x IS NOT NULL),
                 lambda x: CASE WHEN starts_with(x, '#') THEN x ELSE '#' || x END),
                 lambda x: length(x) > 1), 1, 4) AS tags
      FROM documents),
h2 AS (SELECT *, coalesce(array_to_string(tags, ' '), '') AS t FROM h)"""


def hooks(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return d.select(
        "doc_id", js_trim(F.col("text")).alias("hook"),
        F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string")).alias("url"),
        clean_hashtags(F.array(F.concat(F.lit("#"), F.col("lang")), F.col("source"))).alias("tags"))


@query("x_posts", f"""
WITH {HOOKS_SQL}
SELECT doc_id,
       (CASE WHEN length(CASE WHEN t <> '' THEN hook || chr(10) || chr(10) || t ELSE hook END) + 24 <= 280
             THEN CASE WHEN t <> '' THEN hook || chr(10) || chr(10) || t ELSE hook END
             WHEN length(hook) + 24 <= 280 THEN hook
             ELSE rtrim(left(hook, 255), {_WS}) || '…' END) || chr(10) || url AS x
FROM h2
""")
def x_posts(spark, sf_dir):
    h = hooks(spark, sf_dir)
    return h.select("doc_id", assemble_x(F.col("hook"), F.col("tags"), F.col("url")).alias("x"))


@query("linkedin_posts", f"""
WITH {HOOKS_SQL},
bm AS (SELECT *, regexp_extract_all(hook, '{_BOLD_RE}', 0) AS m FROM h2),
b AS (SELECT doc_id, url, t,
             CASE WHEN contains(hook, '**') THEN array_to_string(list_transform(string_split_regex(hook, '{_BOLD_RE}'),
                 lambda piece, i: piece || coalesce(translate(regexp_extract(m[i], '{_BOLD_RE}', 1),
                                                              '{_PLAIN}', '{_BOLD}'), '')), '')
                  ELSE hook END AS bolded
      FROM bm)
SELECT doc_id, concat_ws(chr(10) || chr(10), bolded, nullif(t, ''), url) AS linkedin FROM b
""")
def linkedin_posts(spark, sf_dir):
    h = hooks(spark, sf_dir)
    return h.select("doc_id", assemble_linkedin(F.col("hook"), F.col("tags"), F.col("url")).alias("linkedin"))
