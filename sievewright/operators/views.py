"""Read-time projections and counts: what a page of the product shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import keyed_fingerprint
from ..functions.text import not_blank
from .scoring import display_ready
from .selection import top_topics, within


def shown(rows: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Adds shown_title, shown_summary, status and topic_labels (three at most)."""
    names = F.create_map(*[F.lit(x) for k, v in (labels or {}).items() for x in (k, v)]) if labels else None
    topics = top_topics(F.col("topic_scores"))
    return rows.withColumns({
        "shown_title": F.coalesce(not_blank(F.col("title_zh")), F.col("title")), "shown_summary": F.coalesce(not_blank(F.col("summary_zh")), not_blank(F.col("abstract")), F.lit("")),
        "status": F.when(display_ready(), "ready").otherwise("pending"), "topic_labels": topics if names is None else F.transform(topics, lambda t: F.coalesce(F.try_element_at(names, t), t)),
    })


def home_signals(rows: DataFrame, sources: DataFrame, anchor: Column) -> DataFrame:
    """One row: articles, sources, regions, enriched rows, rows of a day and of a week, the newest time."""
    at = F.coalesce("published_at", "collected_at")
    joined = rows.join(sources.select(F.col("id").alias("source_id"), "region"), "source_id", "left")
    return joined.agg(
        F.count("*").alias("articles"), F.count_distinct("source_id").alias("sources"), F.count_distinct("region").alias("regions"), F.count_if(not_blank(F.col("title_zh")).isNotNull()).alias("enriched"),
        F.count_if(within(at, anchor, "24h")).alias("day"), F.count_if(within(at, anchor, "7d")).alias("week"), F.max(at).alias("newest"),
    )


def top_topic_counts(rows: DataFrame, n: int = 4) -> DataFrame:
    """The n topics with the most rows; names decide ties."""
    return rows.select(F.explode(F.map_keys("topic_scores")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(n)


def brief_sources(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: distinct sources behind all sections' evidence."""
    ids = sections.select(F.explode("evidence_ids").alias("id"))
    return evidence.join(ids, "id", "left_semi").agg(F.count_distinct("source_id").alias("sources"))


def trace_rows(requests: DataFrame, secret: str) -> DataFrame:
    """Query log rows: the question's keyed fingerprint and length, never its text."""
    keep = [c for c in requests.columns if c != "question"]
    return requests.select(*keep, keyed_fingerprint(secret)(F.col("question")).alias("question_fingerprint"), F.length("question").alias("question_chars"))


def provider_status(rows: DataFrame) -> DataFrame:
    """(provider, ready, pending) of enriched rows; rows without a provider are ``none``."""
    return rows.groupBy(F.coalesce("provider", F.lit("none")).alias("provider")).agg(F.count_if(display_ready()).alias("ready"), F.count_if(~display_ready()).alias("pending"))
