"""Weekly briefs: windows, candidates, evidence rules and the state machine."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import display_ready

LOCAL = timezone(timedelta(hours=8))


def weekly_window(at: Column) -> Column:
    """The seven-day window that starts on Saturdays at 09:00 local time (01:00 UTC)."""
    return F.window(at, "7 days", "7 days", "49 hours")


def last_complete_week(now: datetime) -> tuple[datetime, datetime]:
    """Start and end of the newest window that ended by ``now``, in UTC."""
    local = now.astimezone(LOCAL)
    end = (local - timedelta(days=(local.weekday() - 5) % 7)).replace(hour=9, minute=0, second=0, microsecond=0)
    end = end if end <= local else end - timedelta(days=7)
    return (end - timedelta(days=7)).astimezone(timezone.utc), end.astimezone(timezone.utc)


def candidates(articles: DataFrame, start: Column, end: Column) -> DataFrame:
    """Display-ready rows with evidence in the half-open window."""
    at = F.coalesce("published_at", "collected_at")
    return articles.where((at >= start) & (at < end) & (F.size("evidence_ids") > 0) & display_ready())


def enough(rows: DataFrame) -> DataFrame:
    """One row: counts, and whether four rows of two sources are there."""
    n = rows.agg(F.count("*").alias("articles"), F.count_distinct("source_id").alias("sources"))
    return n.withColumn("enough", (F.col("articles") >= 4) & (F.col("sources") >= 2))


def section_evidence(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """(section, articles, sources, problems) of each section's evidence list.

    sections(section, evidence_ids); evidence(id, article_id, source_id, tier).
    A section needs known, unrepeated evidence of two sources, and one primary
    source or two secondary ones.
    """
    rows = sections.select("section", F.posexplode("evidence_ids").alias("place", "id")).join(evidence, "id", "left")
    agg = rows.groupBy("section").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("distinct"), F.count_if(F.col("article_id").isNull()).alias("unknown"), F.count_distinct("article_id").alias("articles"),
        F.count_distinct("source_id").alias("sources"), F.count_distinct(F.when(F.col("tier") == "primary", F.col("source_id"))).alias("primary"),
        F.count_distinct(F.when(F.col("tier") != "primary", F.col("source_id"))).alias("secondary"),
    )
    problems = F.filter(F.array(
        F.when(F.col("distinct") < F.col("n"), "repeated_evidence"), F.when(F.col("unknown") > 0, "unknown_evidence"), F.when(F.col("sources") < 2, "too_few_sources"),
        F.when((F.col("primary") < 1) & (F.col("secondary") < 2), "tier_rule"),
    ), lambda p: p.isNotNull())
    return agg.select("section", "articles", "sources", problems.alias("problems"))


def evidence_chain(sections: DataFrame, evidence: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Sections' evidence in order with its article's title and source's name."""
    rows = sections.select("section", F.posexplode("evidence_ids").alias("place", "evidence_id"))
    e = evidence.select(F.col("id").alias("evidence_id"), "article_id")
    a = articles.select(F.col("id").alias("article_id"), "title", "source_id")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return rows.join(e, "evidence_id").join(a, "article_id").join(s, "source_id", "left").select("section", "place", "evidence_id", "article_id", "title", "source_name")


def brief_state(now: datetime, current: tuple[datetime, datetime] | None, has_enough: bool, carried: bool) -> str:
    """current, generated, insufficient, carried or not_due."""
    period = last_complete_week(now)
    if current == period:
        return "current"
    local = now.astimezone(LOCAL)
    due = local.weekday() == 5 and local.hour >= 9
    if not due:
        return "carried" if carried else "not_due"
    return "generated" if has_enough else ("carried" if carried else "insufficient")


WEEK = 7 * 86_400
#: Saturdays 09:00 local time, in seconds after the epoch.
_FIRST = 49 * 3600


def period_end(now: Column) -> Column:
    """End of the newest complete week at ``now``, by expressions."""
    seconds = F.unix_micros(now.cast("timestamp")) / F.lit(1_000_000)
    return F.timestamp_seconds(F.floor((seconds - _FIRST) / WEEK) * WEEK + _FIRST)


def due(now: Column) -> Column:
    """Saturdays from 09:00 local time on."""
    local = now.cast("timestamp") + F.make_interval(hours=F.lit(8))
    return (F.dayofweek(local) == 7) & (F.hour(local) >= 9)


def week_readiness(articles: DataFrame, least_articles: int = 4, least_sources: int = 2) -> DataFrame:
    """(week_end, ready_at, articles, sources, signature) of each week that has candidates.

    ``ready_at`` is the time from which enough of the week's candidates, of
    enough sources, have been collected; null if they never are.  It needs the
    few earliest collection times of a week only.  The signature stands for
    the set of content hashes; it is made of sums, so a week's hashes are never
    gathered.
    """
    rows = articles.where(F.col("published_at").isNotNull() & (F.size("evidence_ids") > 0) & display_ready())
    week = F.timestamp_seconds(F.floor((F.unix_micros(F.col("published_at").cast("timestamp")) / F.lit(1_000_000) - _FIRST) / WEEK) * WEEK + _FIRST + WEEK)
    rows = rows.select(week.alias("week_end"), "source_id", "collected_at", "content_hash")
    early = Window.partitionBy("week_end").orderBy("collected_at")
    nth = rows.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= least_articles).groupBy("week_end").agg(F.max(F.when(F.col("_n") == least_articles, F.col("collected_at"))).alias("_articles_at"))
    first = rows.groupBy("week_end", "source_id").agg(F.min("collected_at").alias("collected_at"))
    nth_source = first.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= least_sources).groupBy("week_end").agg(F.max(F.when(F.col("_n") == least_sources, F.col("collected_at"))).alias("_sources_at"))
    parts = [F.sum(F.conv(F.substring("content_hash", at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13, 25)]
    all_ = rows.groupBy("week_end").agg(F.count("*").alias("articles"), F.count_distinct("source_id").alias("sources"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(p.cast("string") for p in parts)), 256).alias("signature"))
    ready = F.when(F.col("_articles_at").isNotNull() & F.col("_sources_at").isNotNull(), F.greatest("_articles_at", "_sources_at"))
    return all_.join(nth, "week_end").join(nth_source, "week_end").select("week_end", ready.alias("ready_at"), "articles", "sources", "signature")


def weekly_runs(runs: DataFrame, weeks: DataFrame) -> DataFrame:
    """The state of the weekly brief after each run, and the brief that stands then.

    runs(run_id, now, forced, able): ``able`` if a brief could be written
    then; weeks as of :func:`week_readiness`.  Adds period_start, period_end,
    state and brief_id.  A week's brief is written by its first run that is
    due (or forced), able, and has enough evidence; that run is ``generated``
    and the week's later runs ``current``.  Any other run carries the last
    brief, if there is one: ``carried`` (not due or not able) or
    ``insufficient_carried``; without one it is ``not_due`` or
    ``insufficient``.  Which run writes depends on its own week alone, so
    windows say it without stepping from run to run.  Runs of one time are
    ordered by run_id; runs without a time are left out.
    """
    timed = runs.where(F.col("now").isNotNull()).withColumn("period_end", period_end(F.col("now")))
    rows = timed.join(weeks.withColumnRenamed("week_end", "period_end"), "period_end", "left")
    asked = (due(F.col("now")) | F.coalesce("forced", F.lit(False))) & F.coalesce("able", F.lit(True))
    rows = rows.withColumn("_asked", asked).withColumn("_writes", F.col("_asked") & F.coalesce(F.col("ready_at") <= F.col("now"), F.lit(False)))
    in_week = Window.partitionBy("period_end").orderBy("now", "run_id")
    rows = rows.withColumn("_nth", F.sum(F.col("_writes").cast("int")).over(in_week.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_first", F.col("_writes") & (F.col("_nth") == 1))
    brief = F.concat(F.lit("brief-"), F.date_format(F.col("period_end") - F.expr("INTERVAL 7 DAYS"), "yyyy-MM-dd"), F.lit("-"), F.substring("signature", 1, 12))
    rows = rows.withColumn("_brief", F.when(F.col("_nth") > 0, brief))
    # a week's last brief goes on to the weeks after it
    by_week = rows.groupBy("period_end").agg(F.max("_brief").alias("_made"))
    before = Window.orderBy("period_end").rowsBetween(Window.unboundedPreceding, -1)  # one row a week
    carried = by_week.select("period_end", F.last("_made", ignorenulls=True).over(before).alias("_carried"))
    rows = rows.join(carried, "period_end")
    state = (
        F.when(F.col("_first"), "generated").when(F.col("_nth") > 0, "current")
        .when(~F.col("_asked"), F.when(F.col("_carried").isNull(), "not_due").otherwise("carried"))
        .otherwise(F.when(F.col("_carried").isNull(), "insufficient").otherwise("insufficient_carried"))
    )
    return rows.select("run_id", "now", (F.col("period_end") - F.expr("INTERVAL 7 DAYS")).alias("period_start"), "period_end", state.alias("state"), F.coalesce("_brief", "_carried").alias("brief_id"))


def apply_overlay(articles: DataFrame, overlay: DataFrame, fields, key: str = "content_hash") -> DataFrame:
    """``articles`` with the overlay's fields; an overlay row of no article is an error."""
    over = overlay.select(key, F.struct(*fields).alias("_o"))
    unknown = over.join(articles.select(key).distinct(), key, "left_anti")
    bad = unknown.agg(F.count("*").alias("_bad"))
    joined = articles.join(over, key, "left").crossJoin(F.broadcast(bad))  # one row
    checked = joined.where(F.when(F.col("_bad") > 0, F.raise_error(F.lit("the overlay names unknown content")).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*[F.coalesce(F.col("_o").getField(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in articles.columns])
