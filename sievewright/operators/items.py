"""Raw items to article and evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import content_hash, hex_id
from ..functions.text import computed, normalize_text, not_blank
from ..functions.urls import canonicalize_url
from ..sources.html import whole_html_text

#: Characters of an abstract and of an evidence excerpt.
ABSTRACT, EXCERPT = 2500, 2000


def normalize_items(items: DataFrame, collected_at: Column, abstract: int | None = ABSTRACT, excerpt: int | None = EXCERPT, preserve_fragment: bool = False) -> tuple[DataFrame, DataFrame]:
    """items(source_id, url, title, summary, content_html, authors, published_at, language, source_type, evidence_tier) -> (articles, evidence).

    Both are selections of rows that are written once.  The abstract is the readable text of
    content_html, else the summary, with single spaces, cut to ``abstract``
    characters; None keeps it whole.  Ids follow from the canonical URL and the
    content hash, so equal items give equal rows.
    """
    from ..sources.store import written

    def cut(text: Column, most: int | None) -> Column:
        return text if most is None else F.substring(text, 1, most)

    body = F.coalesce(not_blank(F.when(F.col("content_html") != "", whole_html_text(F.col("content_html")))), F.col("summary"), F.lit(""))
    rows = computed(items, _title=normalize_text(F.col("title")), _abstract=not_blank(cut(normalize_text(body), abstract)), _url=canonicalize_url(F.col("url"), preserve_fragment))
    rows = computed(rows, _hash=content_hash(F.col("_title"), F.col("_abstract")))
    ids = rows.withColumns({"_article": hex_id("article", F.col("_url")), "_evidence": F.concat(F.lit("evidence-"), F.substring("_hash", 1, 20))})
    ids = written(ids.drop("title", "summary", "content_html", "url"), "items")  # texts are normalised once for both
    authors = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), normalize_text), lambda a: a != "")
    articles = ids.select(
        F.col("_article").alias("id"), "source_id", "source_type", "evidence_tier", F.col("_url").alias("canonical_url"), "language", "published_at", collected_at.alias("collected_at"),
        F.col("_title").alias("title"), authors.alias("authors"), F.col("_abstract").alias("abstract"), F.array("_evidence").alias("evidence_ids"), F.col("_hash").alias("content_hash"),
    )
    evidence = ids.select(
        F.col("_evidence").alias("id"), F.col("_article").alias("article_id"), "source_id", F.col("_url").alias("url"), cut(F.coalesce("_abstract", "_title"), excerpt).alias("excerpt"), collected_at.alias("retrieved_at"),
    )
    return articles, evidence
