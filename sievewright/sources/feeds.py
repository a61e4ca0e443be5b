"""Syndication readers: Atom, RSS and JSON feeds to one item shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, not_blank
from .html import html_text, read_html

ATOM = (
    "id string, updated string, published string, title string, summary string, content string, author array<struct<name:string>>, "
    "link array<struct<_href:string,_rel:string,_type:string>>"
)
RSS = "title string, link string, guid string, description string, author string, pubDate string, `content:encoded` string"
JSON_FEED = (
    "items array<struct<id:string,url:string,external_url:string,title:string,summary:string,content_text:string,content_html:string,"
    "authors:array<struct<name:string>>,date_published:string>>"
)
ITEM = ("url", "title", "summary", "authors", "published_at", "content_html")


def parse_time(text: Column) -> Column:
    """ISO 8601, ``Jan 2, 2026``, ``January 2, 2026`` and RFC 2822; junk is null.

    A weekday is dropped unread (feeds get it wrong); naive times are UTC.
    """
    t = F.regexp_replace(F.trim(text), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,\s*", "")
    t = F.regexp_replace(t, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))
    forms = [F.try_to_timestamp(F.when(~t.rlike(r"^\d{4}-"), t), F.lit(f)) for f in ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(iso, *forms)


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries with a link and a title; the first alternate link, else the id."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    link = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)).getField("_href")
    items = rows.select(
        F.coalesce(not_blank(link), not_blank(F.col("id"))).alias("url"), not_blank(normalize_text(F.col("title"))).alias("title"), not_blank(normalize_text(F.col("summary"))).alias("summary"),
        F.filter(F.transform("author", lambda a: F.trim(a["name"])), lambda a: a != "").alias("authors"), F.coalesce(parse_time(F.col("published")), parse_time(F.col("updated"))).alias("published_at"), F.col("content").alias("content_html"),
    )
    return items.where("url is not null and title is not null")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items with a link (or guid) and a title."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    items = rows.select(
        F.coalesce(not_blank(F.col("link")), not_blank(F.col("guid"))).alias("url"), not_blank(normalize_text(F.col("title"))).alias("title"), not_blank(normalize_text(F.col("description"))).alias("summary"),
        F.filter(F.array(not_blank(F.col("author"))), lambda a: a.isNotNull()).alias("authors"), parse_time(F.col("pubDate")).alias("published_at"), F.col("`content:encoded`").alias("content_html"),
    )
    return items.where("url is not null and title is not null")


def cut(column: str, most: int | None) -> Column:
    """The first characters of a text; None keeps it whole."""
    return F.col(column) if most is None else F.substring(column, 1, most)


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    """``items[]`` of JSON Feed documents; summary, else text, else stripped HTML."""
    rows = spark.read.schema(JSON_FEED).json(path, multiLine=True).select(F.explode("items").alias("i"))
    items = rows.select(
        F.coalesce(*[not_blank(F.col(f"i.{c}")) for c in ("url", "external_url", "id")]).alias("url"), not_blank(normalize_text(F.col("i.title"))).alias("title"),
        F.coalesce(not_blank(F.col("i.summary")), not_blank(F.col("i.content_text")), not_blank(html_text(F.col("i.content_html")))).alias("summary"),
        F.transform("i.authors", lambda a: a["name"]).alias("authors"), parse_time(F.col("i.date_published")).alias("published_at"), F.col("i.content_html").alias("content_html"),
    )
    return items.where("url is not null and title is not null")


def sniff(spark: SparkSession, path: str) -> str:
    """``atom`` or ``rss`` by a document's root tag; anything else is an error."""
    head = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.substring("value", 1, 4000), r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<([A-Za-z:]+)", 1).alias("t")).first()
    tag = (head.t if head else "").split(":")[-1].lower()
    if tag == "feed":
        return "atom"
    if tag in ("rss", "rdf"):
        return "rss"
    raise ValueError(f"not a syndication feed: {path}")


def read_syndication(spark: SparkSession, path: str) -> DataFrame:
    return {"atom": read_atom, "rss": read_rss}[sniff(spark, path)](spark, path)


def read_listing(spark: SparkSession, path: str, base: str, reader: str = "listing", **rules) -> DataFrame:
    """HTML files of one source by a reader of ``sources.html``."""
    pages = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.lit(base).alias("url"))
    return read_html(pages, reader, **rules).select("url", "title", "summary", F.array().cast("array<string>").alias("authors"), "published_at", F.lit(None).cast("string").alias("content_html"))


#: Adapter name -> reader(spark, path, source settings).
ADAPTERS = {
    "syndication": lambda s, p, c: read_syndication(s, p), "atom": lambda s, p, c: read_atom(s, p), "rss": lambda s, p, c: read_rss(s, p), "json_feed": lambda s, p, c: read_json_feed(s, p),
    "html_listing": lambda s, p, c: read_listing(s, p, c["url"], "listing", include=c.get("include", ()), exclude=c.get("exclude", ()), title_classes=c.get("title_classes", ())),
    "html_cards": lambda s, p, c: read_listing(s, p, c["url"], "cards", include=c.get("include", ()), exclude=c.get("exclude", ())),
    "html_headings": lambda s, p, c: read_listing(s, p, c["url"], "sections", heading_tags=tuple(c.get("heading_tags", ("h3",)))),
}


def read_source(spark: SparkSession, path: str, source: dict) -> DataFrame:
    """One configured source's items: read, required fields, then the limit, then cut summaries.

    source: id, adapter, url, language, source_type, evidence_tier, and
    optionally require_date, require_summary, max_items, max_summary_chars.
    """
    rows = ADAPTERS[source["adapter"]](spark, path, source)
    if source.get("require_date"):
        rows = rows.where("published_at is not null")
    if source.get("require_summary"):
        rows = rows.where("summary is not null")
    rows = rows.withColumn("ord", F.monotonically_increasing_id())
    if source.get("max_items"):
        rows = rows.orderBy("ord").limit(source["max_items"])
    return rows.select(
        F.lit(source["id"]).alias("source_id"), "url", "title", cut("summary", source.get("max_summary_chars", 2500)).alias("summary"), "authors", "published_at",
        F.lit(source.get("language", "en")).alias("language"), "content_html", F.lit(source.get("source_type", "official")).alias("source_type"), F.lit(source.get("evidence_tier", "primary")).alias("evidence_tier"), "ord",
    )


def limit_items(rows: DataFrame, keep: Column, order: str, most: Column | int, source: str = "source_id") -> DataFrame:
    """Rows of many sources: those kept, then the first ``most`` of each source."""
    nth = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return rows.where(keep).withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """All sources' items, numbered source after source."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("ord", F.col("ord") + F.lit(i * (1 << 48)))
        out = p if out is None else out.unionByName(p)
    return out
