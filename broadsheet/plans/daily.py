"""The daily edition as two Spark jobs (section 3.1 of the survey).

The original runs collect -> normalise -> enrich -> curate -> posts -> write in
one process, calling the language model in the middle. Here the model call is
an exchange by tables (U2), so the day splits into:

* ``prepare``: J-INGEST, J-RANK, J-ENRICH, J-PROMPT. Landed feeds, story
  answers, model lists and article pages become ranked, enriched candidates,
  per-source status, run gates (P7) and the curation prompt of every edition
  that may go on.
* ``accept`` and ``publish``: J-ACCEPT, J-POSTS, K1. Landed answers are checked, the first
  valid one per edition is kept and its post requests are written (``accept``);
  once the post answers have landed, the edition document is assembled with
  its posts and repo picks and appended write-once (``publish``). Failed
  attempts below the limit give the next prompts.

Every step is one of the library's DataFrame functions; any number of
editions run at once, and nothing is collected to the driver. The two tables
that several steps read (candidates, checked attempts) are checkpointed in the
shared ``spark.checkpoint.dir``, so later steps neither recompute them nor
depend on a long lineage when executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.prompts import digest_prompts
from broadsheet.operators import validate as V
from broadsheet.operators.collect import collect_all
from broadsheet.operators.dedup import CANDIDATE_CAP, ENRICH_TOP, dedup_candidates, rank_per_edition
from broadsheet.operators.edition import accepted_items, assemble_editions
from broadsheet.operators.enrich import enrich
from broadsheet.operators.ingest import (
    STORY_MIN_POINTS, WINDOW_HOURS, idle_runs, map_feed_items, merge_story_hits, run_status, source_failures, story_hits)
from broadsheet.operators.repos import (
    PICK, REPOS_CALL, answer_picks, drop_recent, join_picks, recent_by_edition, repos_prompt, top_search, with_fallback)
from broadsheet.operators.social import attach_item_social, attach_repo_social, post_requests
from broadsheet.operators.topk import top_per_group
from broadsheet.session import materialize
from broadsheet.sources.config import edition_settings, largest
from broadsheet.sources.editions import write_editions
from broadsheet.sources.feeds import configured_docs, feed_entries, parse_feed_docs
from broadsheet.sources.landed import model_items, story_hit_rows, unwrap_answer

# Call kind and key of the curation call, source names.
DIGEST_CALL = "digest"
STORY_SOURCE_NAME = "Hacker News"
MODEL_SOURCE_NAME = "Hugging Face (trending)"
BY = ("edition_date",)
# Reasons of failed sources.
FEED_UNREADABLE = "no document of the feed could be read"
NO_STORIES = "no query had an answer with a usable story"
NO_MODELS = "the model list could not be read"


def run_meta(runs: DataFrame) -> DataFrame:
    """F13 + P8: the run's own date text, instant and provider; these always
    replace whatever an answer says."""
    return runs.select("edition_date", F.date_format("edition_date", "yyyy-MM-dd").alias("date"),
                       F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at"),
                       V.resolve_provider(F.col("provider")).alias("provider"))


def _left(df: DataFrame, published: DataFrame | None) -> DataFrame:
    """K3 before any work: rows of editions that are not published yet."""
    return df if published is None else df.join(published.select(*BY).distinct(), list(BY), "left_anti")


def prepare(feed_docs: DataFrame, pages: DataFrame, runs: DataFrame, story_answers: DataFrame | None = None,
            model_answers: DataFrame | None = None, cap: int = CANDIDATE_CAP,
            enrich_top: int = ENRICH_TOP, config: DataFrame | None = None,
            published: DataFrame | None = None) -> dict[str, DataFrame]:
    """Collect, rank, enrich and write prompts for every run in ``runs``.

    ``feed_docs(edition_date, as_of, source, source_ordinal, body)``,
    ``pages(edition_date, page_id, url, status, content_type, html)`` (``page_id``
    in fetch order: the first page of an edition's URL wins), ``runs(edition_date, as_of,
    provider)``, optional landed story answers (``read_story_answers``) and
    model lists (``read_model_answers``).

    ``config`` (S5) replaces ``cap``, ``enrich_top`` and the other fixed limits by each
    edition's own, leaves out disabled feeds, stories and models, and gives feeds their
    order and ``fragile``. ``published`` (K3: ``published_dates``) are editions
    that exist: their landed documents are not read, let alone parsed. Runs
    that do nothing (P7: published, or ``runs.has_credential`` is not true) appear in
    ``run_status`` with that status.
    """
    idle = idle_runs(runs, published)
    open_ = runs.join(idle.select(*BY), list(BY), "left_anti")
    skip = idle.select(*BY) if published is not None or "has_credential" in runs.columns else None
    feed_docs = _left(feed_docs, skip)
    story_answers = None if story_answers is None else _left(story_answers, skip)
    model_answers = None if model_answers is None else _left(model_answers, skip)
    settings, most = None, {}
    hours, points, limits = WINDOW_HOURS, STORY_MIN_POINTS, {}
    if config is not None:
        settings = materialize(edition_settings(config, open_))
        most = largest(settings)
        feed_docs = configured_docs(feed_docs, config).join(settings.select(*BY, "window_hours"), list(BY))
        hours, points = F.col("window_hours"), F.col("min_points")
        limits = {c: settings.select(*BY, c) for c in ("candidate_cap", "enrich_top", "models_limit")}
    # status and items both read the parsed documents: parse each one once
    parsed = materialize(parse_feed_docs(feed_docs))
    feeds = map_feed_items(feed_entries(parsed), hours)
    stories = models = None
    fragile = F.bool_or("fragile") if "fragile" in parsed.columns else F.bool_or(F.lit(False))
    status = [parsed.groupBy(*BY, "source").agg(F.bool_or("parsed").alias("ok"), fragile.alias("fragile"))
              .join(feeds.groupBy(*BY, "source").agg(F.count("*").alias("n_items")), [*BY, "source"], "left")
              .select(*BY, "source", "ok", "fragile", F.when(~F.col("ok"), FEED_UNREADABLE).alias("reason"),
                      F.coalesce("n_items", F.lit(0)).alias("n_items"))]
    if story_answers is not None:
        if settings is not None:
            story_answers = story_answers.join(settings.where("stories_enabled").select(*BY, "window_hours", "min_points"), list(BY))
        hits = story_hit_rows(story_answers, (*BY, *(c for c in ("window_hours", "min_points") if settings is not None)))
        stories = merge_story_hits(story_hits(hits, hours, points, by=BY), by=BY)
        counts = story_answers.groupBy(*BY).agg(F.lit(STORY_SOURCE_NAME).alias("source")) \
            .join(stories.groupBy(*BY).agg(F.count("*").alias("n_items")), list(BY), "left")
        ok = F.coalesce("n_items", F.lit(0)) > 0
        status.append(counts.select(*BY, "source", ok.alias("ok"), F.lit(False).alias("fragile"),
                                    F.when(~ok, NO_STORIES).alias("reason"), F.coalesce("n_items", F.lit(0)).alias("n_items")))
    if model_answers is not None:
        models = model_items(model_answers, by=BY)
        if settings is not None:
            on = settings.where("models_enabled").select(*BY)
            model_answers = model_answers.join(on, list(BY), "left_semi")
            models = models.join(on, list(BY), "left_semi").join(limits["models_limit"], list(BY)) \
                .where(F.col("item_ordinal") <= F.col("models_limit"))
        counts = model_answers.groupBy(*BY).agg(F.bool_or(F.col("models").isNotNull()).alias("ok"),
                                                F.lit(MODEL_SOURCE_NAME).alias("source")) \
            .join(models.groupBy(*BY).agg(F.count("*").alias("n_items")), list(BY), "left")
        status.append(counts.select(*BY, "source", "ok", F.lit(False).alias("fragile"), F.when(~F.col("ok"), NO_MODELS).alias("reason"),
                                    F.coalesce("n_items", F.lit(0)).alias("n_items")))
    source_status = status[0]
    for s in status[1:]:
        source_status = source_status.unionByName(s)

    collected = collect_all(feeds, stories, models, by=BY)
    merged = dedup_candidates(collected)
    gates = run_status(source_status, merged)
    ready = merged.join(gates.where(F.col("status") == "ready").select(*BY), list(BY), "left_semi")
    if settings is None:
        ranked, top = rank_per_edition(ready, cap=cap), enrich_top
    else:
        ranked = rank_per_edition(ready.join(limits["candidate_cap"], list(BY)), F.col("candidate_cap"), most=most["candidate_cap"])
        ranked, top = ranked.drop("candidate_cap").join(limits["enrich_top"], list(BY)), F.col("enrich_top")
    # every later step (prompts, answer checks, publishing) reads the
    # candidates: compute them once and cut the lineage there
    candidates = materialize(enrich(ranked, pages, top=top).drop("enrich_top"))
    prompts = digest_prompts(candidates, run_meta(runs)).select(
        *BY, F.lit(DIGEST_CALL).alias("call_kind"), F.lit("").alias("key"), F.lit(1).alias("attempt"), "prompt")
    return {"collected": collected, "source_status": source_status, "source_failures": source_failures(source_status),
            "run_status": gates.unionByName(idle, allowMissingColumns=True), "candidates": candidates, "prompts": prompts}


def accept(responses: DataFrame, candidates: DataFrame, runs: DataFrame,
           envelopes: bool = False, published: DataFrame | None = None) -> dict[str, DataFrame]:
    """J-ACCEPT: check every landed curation answer (``call_kind = 'digest'``).

    ``responses(edition_date, call_kind, key, attempt, raw)``; with
    ``envelopes`` the raw text is still inside the provider's envelope (S10).
    Returns the checked attempts, the first valid one per edition, the next
    prompt (after the latest failed attempt) for editions still without one,
    and the post requests of the accepted items. Answers for editions that are
    ``published`` (K3) are not looked at.
    """
    meta = run_meta(runs)
    digest = _left(responses.where(F.col("call_kind") == DIGEST_CALL), published)
    if envelopes:
        digest = digest.join(meta.select(*BY, "provider"), list(BY), "left") \
            .withColumn("raw", unwrap_answer(F.col("raw"), F.col("provider"))).drop("provider")
    inputs = candidates.groupBy(*BY).agg(F.collect_list("url").alias("urls"))
    checked = materialize(V.check_attempts(digest.select(*BY, "attempt", "raw"), inputs, meta))
    accepted = V.first_valid(checked)
    last = checked.groupBy(*BY).agg(F.max("attempt").alias("attempt"))
    retries = V.retry_prompts(checked.join(last, [*BY, "attempt"], "left_semi"), digest_prompts(candidates, meta)) \
        .join(accepted.select(*BY), list(BY), "left_anti")
    return {"checked": checked, "accepted": accepted, "retry_prompts": retries,
            "post_requests": post_requests(accepted_items(accepted))}


def prepare_repos(scraped: DataFrame, searched: DataFrame | None = None, archive: DataFrame | None = None,
                  pick: int = PICK, config: DataFrame | None = None, published: DataFrame | None = None) -> dict[str, DataFrame]:
    """J-REPOS before the model: trending rows (``parse_trending``), or the search
    (``search_repos``) for editions without any, less what the read editions of
    ``archive`` published in the previous seven days, and one prompt per edition.

    An ``archive`` with the partition column ``edition_date`` (``read_editions``) is
    read for those days only. ``config`` (S5) gives each edition's limit and pick and
    leaves out editions without repos; ``published`` (K3) editions are left out.
    """
    scraped = _left(scraped, published)
    searched = None if searched is None else _left(searched, published)
    settings, most, columns = None, {}, scraped.columns
    if config is not None:
        days = scraped.select(*BY) if searched is None else scraped.select(*BY).unionByName(searched.select(*BY))
        settings = materialize(edition_settings(config, days).where("repos_enabled").select(*BY, "repos_limit", "pick"))
        most = {c: v or 0 for c, v in settings.agg(F.max("repos_limit").alias("repos_limit"), F.max("pick").alias("pick")).first().asDict().items()}
        scraped = top_per_group(scraped.withColumnRenamed("seq", "__seq").join(settings, list(BY)), BY, [F.col("__seq")], F.col("repos_limit"),
                                "__at", ["__seq", "name"], most["repos_limit"]).withColumnRenamed("__seq", "seq").select(*columns)
    rows = scraped
    if searched is not None:
        best = top_search(searched) if settings is None else \
            top_search(searched.join(settings, list(BY)), F.col("repos_limit"), most["repos_limit"]).drop("repos_limit", "pick")
        rows = with_fallback(scraped, best)
    if archive is not None:
        rows = materialize(rows)
        if "edition_date" not in archive.columns:
            archive = archive.withColumn("edition_date", F.to_date("date"))
        rows = drop_recent(rows, recent_by_edition(archive, rows))
    fresh = materialize(rows if settings is None else rows.join(settings.select(*BY, "pick"), list(BY)))
    prompts = repos_prompt(fresh, pick if settings is None else F.col("pick")).select(
        *BY, F.lit(REPOS_CALL).alias("call_kind"), F.lit("").alias("key"), F.lit(1).alias("attempt"), "prompt")
    return {"trending": fresh, "prompts": prompts}


def accept_repos(responses: DataFrame, trending: DataFrame, pick: int = PICK) -> dict[str, DataFrame]:
    """J-REPOS after the model: the landed repo answers joined back to the fresh
    trending rows, at most ``pick`` per edition (its own, where ``trending`` comes from
    a configured ``prepare_repos``), ready for ``publish``, and the post requests of
    these picks."""
    answers = answer_picks(responses)
    if "pick" in trending.columns:
        own = trending.select(*BY, "pick").distinct()
        most = own.agg(F.max("pick")).first()[0] or 0
        picks = join_picks(answers.join(own, list(BY)), trending, F.col("pick"), most)
    else:
        picks = join_picks(answers, trending, pick)
    return {"picks": picks, "post_requests": post_requests(repos=picks)}


def publish(accepted: DataFrame, responses: DataFrame, runs: DataFrame, output: str,
            repos: DataFrame | None = None) -> DataFrame:
    """J-POSTS + K1: attach the landed post answers (best effort) to the
    accepted items and to the picked repos (``join_picks`` output), assemble
    one document per edition and append the editions not yet written.
    Returns the editions written by this call."""
    items = attach_item_social(accepted_items(accepted), responses)
    picked = attach_repo_social(repos, responses).withColumn("seq", F.col("slot")) if repos is not None else None
    docs = assemble_editions(items, run_meta(runs).join(accepted.select(*BY), list(BY), "left_semi"), picked)
    return write_editions(docs, output)
