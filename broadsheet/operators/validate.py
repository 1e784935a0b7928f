"""J-ACCEPT: model answers checked against the digest rules (S10, F11-F13, J2, J3,
V1-V6, A4, W5, F21).

Answers stay VARIANT until the rules pass: typed parsing would hide the very
errors we must report. Type tests use ``schema_of_variant``, never a cast
(``'5'`` casts to 5, ``1.5`` casts to 1). Every rule yields a rule id in one
``errors`` array; ``ok`` is ``size(errors) = 0``.

The input-URL set of an edition (U1b) is bounded by the candidate cap, so it
travels as one ``array<string>`` per edition next to the attempts. Attempts are
the landed model answers (S9): ``responses(edition_date, call_kind, key,
attempt, raw)``, the other half of the exchange by tables (U2) whose requests
are written by ``functions.prompts`` and ``operators.social.post_requests``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.formats import is_date, is_date_time, is_uri
from broadsheet.functions.social import strip_fences

# ---------------------------------------------------------------------------
# Fixed values (digest schema).
CATEGORIES = ["lanzamientos", "investigacion", "industria", "herramientas"]
PROVIDERS = ["deepseek", "claude-code"]
DEFAULT_PROVIDER = "deepseek"
ROOT_KEYS = ["date", "generated_at", "provider", "items", "repos"]
ITEM_REQUIRED = ["rank", "category", "title", "summary", "why_it_matters", "url", "source"]
ITEM_KEYS = ITEM_REQUIRED + ["social"]
REPO_REQUIRED = ["name", "url", "description"]
REPO_KEYS = REPO_REQUIRED + ["language", "stars", "social"]
MIN_ITEMS, MAX_ITEMS, MAX_REPOS = 6, 20, 8
RANK_MIN, RANK_MAX = 1, 20
TEXT_BOUNDS = {"title": (1, 200), "summary": (1, 800), "why_it_matters": (1, 400)}
REPO_DESCRIPTION_MAX = 400
MAX_ATTEMPTS = 3
URL_PATTERN = r"^https?://"
RETRY_NOTE = ("\n\n---\nLa respuesta anterior NO fue válida. Corrige EXACTAMENTE estos problemas y "
              "responde de nuevo solo con el JSON:\n- ")
# ---------------------------------------------------------------------------

_INT_TYPES = r"^(TINYINT|SMALLINT|INT|BIGINT)$"
_NUM_TYPES = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def resolve_provider(name) -> Column:
    """Lower-cased provider name; anything unknown falls back to the default."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.when(n.isin(*PROVIDERS), n).otherwise(F.lit(DEFAULT_PROVIDER))


def parse_answer(raw) -> Column:
    """F11 + F12: fences removed, then JSON parsed; null when it is not JSON."""
    return F.try_parse_json(strip_fences(raw))


def _fields(v: Column) -> Column:
    """The fields of an object as a map, null for anything else. The checks take all
    they need of an object from its map, which is built once."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _keys(m: Column) -> Column:
    return F.coalesce(F.map_keys(m), F.array().cast("array<string>"))


def _is_string(m: Column, key: str) -> Column:
    return F.coalesce(F.schema_of_variant(m[key]) == "STRING", F.lit(False))


def _str(m: Column, key: str) -> Column:
    return F.try_variant_get(m[key], "$", "string")


def _lit_array(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _text_ok(m: Column, key: str, lo: int, hi: int | None) -> Column:
    n = F.length(_str(m, key))
    return _is_string(m, key) & (n.between(lo, hi) if hi is not None else n >= lo)


def _url_ok(m: Column, key: str) -> Column:
    s = _str(m, key)
    return _is_string(m, key) & s.rlike(URL_PATTERN) & is_uri(s)


def _integer(m: Column, key: str) -> Column:
    t = F.schema_of_variant(m[key])
    return F.coalesce(t.rlike(_INT_TYPES), F.lit(False)) | \
        (F.coalesce(t.rlike(_NUM_TYPES), F.lit(False)) & (_double(m, key) % 1 == 0))


def _double(m: Column, key: str) -> Column:
    return F.try_variant_get(m[key], "$", "double")


def _social_ok(m: Column) -> Column:
    s = _fields(m["social"])
    return (F.size(F.map_keys(s)) == 2) & _text_ok(s, "x", 1, None) & _text_ok(s, "linkedin", 1, None)


def _object_errors(rule: str, place: Column, m: Column, required: list[str], allowed: list[str],
                   checks: dict[str, Column], rules: dict[str, str] | None = None) -> Column:
    """Error ids of one object (``m``: its fields): unknown and missing keys, and each
    present key whose check fails, under ``rule`` or the key's own in ``rules``."""
    prefix = F.concat(F.lit(f"{rule}:"), place)
    extra = F.transform(F.array_sort(F.array_except(F.map_keys(m), _lit_array(allowed))),
                        lambda k: F.concat(prefix, F.lit("extra:"), k))
    missing = F.transform(F.array_except(_lit_array(required), F.map_keys(m)),
                          lambda k: F.concat(prefix, F.lit("required:"), k))
    fields = F.array(*[F.when(F.map_contains_key(m, k) & ~F.coalesce(ok, F.lit(False)),
                              F.concat(F.lit(f"{(rules or {}).get(k, rule)}:"), place, F.lit(k)))
                       for k, ok in checks.items()])
    return F.when(m.isNull(), F.array(F.concat(prefix, F.lit("type")))) \
        .otherwise(F.concat(extra, missing, fields))


def item_errors(m: Column, i: Column) -> Column:
    """V4 + V5 for the fields of one item (index ``i`` after J2)."""
    checks = {
        "rank": _integer(m, "rank") & _double(m, "rank").between(RANK_MIN, RANK_MAX),
        "category": _is_string(m, "category") & _str(m, "category").isin(*CATEGORIES),
        **{k: _text_ok(m, k, lo, hi) for k, (lo, hi) in TEXT_BOUNDS.items()},
        "url": _url_ok(m, "url"),
        "source": _text_ok(m, "source", 1, None),
        "social": _social_ok(m),
    }
    place = F.concat(F.lit("items["), i.cast("string"), F.lit("]."))
    return _object_errors("V4", place, m, ITEM_REQUIRED, ITEM_KEYS, checks, {"social": "V5"})


def repo_errors(m: Column, i: Column) -> Column:
    """V6 for the fields of one repo."""
    checks = {
        "name": _text_ok(m, "name", 1, None),
        "url": _url_ok(m, "url"),
        "description": _text_ok(m, "description", 1, REPO_DESCRIPTION_MAX),
        "language": _is_string(m, "language"),
        "stars": _integer(m, "stars") & (_double(m, "stars") >= 0),
        "social": _social_ok(m),
    }
    place = F.concat(F.lit("repos["), i.cast("string"), F.lit("]."))
    return _object_errors("V6", place, m, REPO_REQUIRED, REPO_KEYS, checks)


def drop_invented(items: Column, input_urls: Column) -> Column:
    """Drop items whose url is a string not found in the input; anything
    else (missing or non-string url, non-object item) is left to the schema."""
    url = F.try_variant_get
    return F.filter(items, lambda x: ~(F.coalesce(F.schema_of_variant(url(x, "$.url", "variant")) == "STRING", F.lit(False))
                                       & ~F.array_contains(input_urls, url(x, "$.url", "string"))))


def check_attempts(attempts: DataFrame, inputs: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Validate every attempt.

    ``attempts(edition_date, attempt, raw)``, ``inputs(edition_date, urls
    array<string>)`` and ``runs(edition_date, date, generated_at, provider)``.
    When ``attempts`` already carries ``urls`` (or the run columns), pass
    ``None`` for that table and no join is planned.
    Adds ``v`` (parsed answer), ``items`` (after J2), ``n_in``, ``n_dropped``,
    ``errors`` (sorted rule ids) and ``ok``.
    """
    a = attempts
    if inputs is not None:
        a = a.join(inputs, "edition_date", "left")
    if runs is not None:
        a = a.join(runs, "edition_date", "left")
    a = a.withColumn("v", parse_answer(F.col("raw"))).withColumn("__root", _fields(F.col("v")))
    v, root = F.col("v"), F.col("__root")
    urls = F.coalesce(F.col("urls"), F.array().cast("array<string>"))
    root_obj = root.isNotNull()
    items_arr = F.try_variant_get(v, "$.items", "array<variant>")
    kept = drop_invented(items_arr, urls)
    a = a.withColumn("items", F.when(root_obj, kept)) \
        .withColumn("n_in", F.when(root_obj & items_arr.isNotNull(), F.size(items_arr))) \
        .withColumn("n_dropped", F.when(root_obj & items_arr.isNotNull(), F.size(items_arr) - F.size(kept))) \
        .withColumn("__items", F.transform("items", _fields))
    items = F.col("__items")
    keys = _keys(root)
    root_extra = F.transform(F.array_sort(F.array_except(keys, _lit_array(ROOT_KEYS))),
                             lambda k: F.concat(F.lit("V1:extra:"), k))
    meta = F.array(
        F.when(~is_date(F.col("date")), F.lit("V2:date")),
        F.when(~is_date_time(F.col("generated_at")), F.lit("V2:generated_at")),
        F.when(~F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False)), F.lit("V2:provider")))
    has_items = F.array_contains(keys, "items")
    items_errs = F.when(~has_items, F.array(F.lit("V1:required:items"))) \
        .when(items.isNull(), F.array(F.lit("V3:type"))) \
        .otherwise(F.concat(
            F.array(F.when(F.size(items) < MIN_ITEMS, F.lit("V3:min")),
                    F.when(F.size(items) > MAX_ITEMS, F.lit("V3:max"))),
            F.flatten(F.transform(items, item_errors))))
    repos_arr = F.try_variant_get(v, "$.repos", "array<variant>")
    repos_errs = F.when(~F.array_contains(keys, "repos"), F.array().cast("array<string>")) \
        .when(repos_arr.isNull(), F.array(F.lit("V6:type"))) \
        .otherwise(F.concat(F.array(F.when(F.size(repos_arr) > MAX_REPOS, F.lit("V6:max"))),
                            F.flatten(F.transform(F.transform(repos_arr, _fields), repo_errors))))
    a = a.withColumn("__schema", F.when(root_obj, F.filter(F.concat(root_extra, meta, items_errs, repos_errs),
                                                           lambda e: e.isNotNull())))
    schema_errs = F.col("__schema")
    # URL and rank checks only run on schema-clean answers.
    ranks = F.transform(items, lambda m: _double(m, "rank"))
    late = F.filter(F.concat(
        F.transform(items, lambda m, i: F.when(~F.array_contains(urls, _str(m, "url")),
                                                F.concat(F.lit("J3:items["), i.cast("string"), F.lit("].url")))),
        F.array(F.when(F.size(F.array_distinct(ranks)) != F.size(ranks), F.lit("A4:rank")))),
        lambda e: e.isNotNull())
    errors = F.when(v.isNull(), F.array(F.lit("F12:json"))) \
        .when(~root_obj, F.array(F.lit("V1:type"))) \
        .when(F.size(schema_errs) > 0, schema_errs) \
        .otherwise(late)
    return a.withColumn("errors", F.array_sort(errors)).drop("__root", "__items", "__schema") \
        .withColumn("ok", F.size("errors") == 0)


def first_valid(checked: DataFrame) -> DataFrame:
    """The first valid attempt of each edition, among at most three."""
    w = Window.partitionBy("edition_date").orderBy("attempt")
    return checked.where(F.col("ok") & (F.col("attempt") <= MAX_ATTEMPTS)) \
        .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def retry_prompts(checked: DataFrame, base_prompts: DataFrame) -> DataFrame:
    """the next prompt after a failed attempt is the **base** prompt plus
    the last errors as a bullet list (not cumulative)."""
    failed = checked.where(~F.col("ok") & (F.col("attempt") < MAX_ATTEMPTS))
    return failed.join(base_prompts, "edition_date").select(
        "edition_date", (F.col("attempt") + 1).alias("attempt"),
        F.concat(F.col("prompt"), F.lit(RETRY_NOTE), F.array_join("errors", "\n- ")).alias("prompt"))
