"""Landed feed documents -> feed entries (S1, S2, S5, A3 input).

A landed feed document is one row ``(source, source_ordinal, as_of, body)``;
the XML is parsed per row with ``from_xml`` against an explicit schema (RSS
``channel.item`` or Atom ``entry``), and entries come out with ``posexplode``,
so there is no shuffle and a document never leaves its task. A document that
does not parse yields no entries and marks its source as failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.html import strip_tags

RSS_SCHEMA = ("channel struct<item: array<struct<title: string, link: string, guid: string, "
              "pubDate: string, isoDate: string, description: string, encoded: string>>>")
ATOM_SCHEMA = ("entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, "
               "id: string, published: string, updated: string, summary: string, content: string>>")
ENTRY_FIELDS = ("title", "link", "guid", "isoDate", "pubDate", "contentSnippet", "content")


def _rss_entries(body: Column) -> Column:
    items = F.from_xml(body, RSS_SCHEMA)["channel"]["item"]
    return F.transform(items, lambda i: F.struct(
        i["title"].alias("title"), i["link"].alias("link"), i["guid"].alias("guid"),
        i["isoDate"].alias("isoDate"), i["pubDate"].alias("pubDate"),
        F.when(i["description"].isNotNull(), strip_tags(i["description"])).alias("contentSnippet"),
        F.coalesce(i["encoded"], i["description"]).alias("content")))


def _atom_link(links: Column) -> Column:
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.try_element_at(alternate, F.lit(1)), F.try_element_at(links, F.lit(1)))["_href"]


def _atom_entries(body: Column) -> Column:
    entries = F.from_xml(body, ATOM_SCHEMA)["entry"]
    return F.transform(entries, lambda e: F.struct(
        e["title"].alias("title"), _atom_link(e["link"]).alias("link"), e["id"].alias("guid"),
        F.coalesce(e["published"], e["updated"]).alias("isoDate"), F.lit(None).cast("string").alias("pubDate"),
        F.when(F.coalesce(e["summary"], e["content"]).isNotNull(),
               strip_tags(F.coalesce(e["summary"], e["content"]))).alias("contentSnippet"),
        e["content"].alias("content")))


def parse_feed_docs(docs: DataFrame, body: str = "body") -> DataFrame:
    """Parse every landed document; adds ``entries`` (null when the XML does
    not parse) and ``parsed``. Atom is recognised by its ``<feed`` root, so
    only one parse runs per document."""
    b = F.col(body)
    is_atom = F.regexp_like(b, F.lit(r"^\s*(<\?xml[^>]*>\s*)?<feed[\s>]"))
    entries = F.when(is_atom, _atom_entries(b)).otherwise(_rss_entries(b))
    return docs.withColumn("entries", entries).withColumn("parsed", F.col("entries").isNotNull()).drop(body)


def feed_entries(parsed: DataFrame) -> DataFrame:
    """One row per entry with its position in the document (``item_ordinal``)."""
    keep = [c for c in parsed.columns if c not in ("entries", "parsed")]
    e = parsed.where("parsed").select(*keep, F.posexplode("entries").alias("item_ordinal", "e"))
    return e.select(*keep, (F.col("item_ordinal") + 1).alias("item_ordinal"),
                    *[F.col("e")[f].alias(f) for f in ENTRY_FIELDS])


def configured_docs(docs: DataFrame, config: DataFrame) -> DataFrame:
    """S5 on landed documents: those of enabled feeds (by name, and edition where the
    configuration has one), with the configured ordinal and ``fragile``. Of feeds
    that share a name the first one counts."""
    keys = [c for c in ("edition_date", "source") if c == "source" or c in config.columns]
    feeds = enabled_sources(config).groupBy(*keys).agg(
        F.min("source_ordinal").alias("source_ordinal"), F.min_by("fragile", "source_ordinal").alias("fragile"))
    return docs.drop("source_ordinal", "fragile").join(feeds, keys)


def enabled_sources(config: DataFrame) -> DataFrame:
    """Configured feeds in config order, enabled ones only.

    ``config`` is the configuration (``config.read_config``), with an
    ``edition_date`` where it differs by edition; ``source_ordinal`` keeps the
    arrival order that the collection follows.
    """
    day = [c for c in config.columns if c == "edition_date"]
    return (config.select(*day, F.posexplode("rss").alias("source_ordinal", "s"))
            .where(F.col("s.enabled"))
            .select(*day, "source_ordinal", F.col("s.id").alias("source_id"), F.col("s.name").alias("source"),
                    F.col("s.url").alias("url"), F.coalesce(F.col("s.fragile"), F.lit(False)).alias("fragile")))
