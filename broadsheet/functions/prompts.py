"""Prompt text for the outside language model.

The system prompts are supplied by the user; these are the user-message
templates, built per row with native string functions and aggregated per
edition in order. Each edition's list is bounded by the candidate cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import collapse_ws

# ---------------------------------------------------------------------------
# User-message templates.
DIGEST_HEADER = ("Datos de cabecera para el JSON de salida (cópialos tal cual):\n"
                 "- date: {date}\n- generated_at: {generated_at}\n- provider: {provider}\n\n"
                 "Ítems recogidos en las últimas 24 h ({n}). Copia las URL LITERALMENTE:\n\n")
ITEM_TEXT_CHARS = 600
SOCIAL_CLOSING = "Redacta los posts para X y LinkedIn siguiendo las instrucciones."
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def item_line(pos, source, points, title, content, snippet, url) -> Column:
    """One numbered candidate: ``i. [source] (pts) title``, text, URL.

    Points show whenever present; the text is the article content or, when
    empty, the snippet, white space collapsed, first 600 characters, not trimmed.
    """
    content, snippet = _c(content), _c(snippet)
    text = F.substring(collapse_ws(F.when(F.coalesce(content, F.lit("")) != "", content)
                                   .otherwise(F.coalesce(snippet, F.lit("")))), 1, ITEM_TEXT_CHARS)
    pts = F.when(_c(points).isNotNull(), F.concat(F.lit(" ("), _c(points).cast("string"), F.lit(" pts)"))) \
        .otherwise(F.lit(""))
    snip = F.when(text != "", F.concat(F.lit("\n   "), text)).otherwise(F.lit(""))
    return F.concat(_c(pos).cast("string"), F.lit(". ["), _c(source), F.lit("]"), pts, F.lit(" "), _c(title),
                    snip, F.lit("\n   URL: "), _c(url))


def _header(date: Column, generated_at: Column, provider: Column, n: Column) -> Column:
    parts = DIGEST_HEADER.split("{")
    out = [F.lit(parts[0])]
    values = {"date}": date, "generated_at}": generated_at, "provider}": provider, "n}": n.cast("string")}
    for p in parts[1:]:
        key, rest = p.split("}", 1)
        out += [values[key + "}"], F.lit(rest)]
    return F.concat(*out)


def digest_prompts(cands: DataFrame, runs: DataFrame) -> DataFrame:
    """F20 + A7: the base curation prompt of every edition.

    ``cands`` has ``edition_date, position, source, points, title, content,
    snippet, url``; ``runs`` has ``edition_date, date, generated_at, provider``.
    Every candidate is listed: ``rank_per_edition`` is the one place for the cap.
    """
    lines = cands.select("edition_date", F.struct(
        "position", item_line("position", "source", "points", "title", "content", "snippet", "url")
        .alias("line")).alias("l"))
    g = lines.groupBy("edition_date").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return g.join(runs, "edition_date").select(
        "edition_date",
        F.concat(_header(F.col("date"), F.col("generated_at"), F.col("provider"), F.size("ls")),
                 F.array_join(F.transform("ls", lambda x: x["line"]), "\n\n")).alias("prompt"))


def social_prompt(title, summary, why, source) -> Column:
    """the post request for one digest item."""
    return F.concat(F.lit("Noticia:\nTitular: "), _c(title), F.lit("\nResumen: "), _c(summary),
                    F.lit("\nPor qué importa: "), _c(why), F.lit("\nFuente: "), _c(source),
                    F.lit("\n\n" + SOCIAL_CLOSING))


def repo_social_prompt(name, description, language, stars, url) -> Column:
    """the post request for one repo; language and stars lines only when known."""
    meta = F.concat_ws("\n", F.when(F.coalesce(_c(language), F.lit("")) != "",
                                    F.concat(F.lit("Lenguaje: "), _c(language))),
                       F.when(_c(stars).isNotNull(), F.concat(F.lit("Estrellas: "), _c(stars).cast("string"))))
    return F.concat(F.lit("Repositorio:\nNombre: "), _c(name), F.lit("\nDescripción: "), _c(description),
                    F.lit("\n"), F.when(meta != "", F.concat(meta, F.lit("\n"))).otherwise(F.lit("")),
                    F.lit("URL: "), _c(url), F.lit("\n\n" + SOCIAL_CLOSING))
