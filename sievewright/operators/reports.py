"""Quality audits, release guards, clusters and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.numbers import month_key, rounded
from ..functions.text import not_blank, title_terms
from .scoring import display_ready
from .selection import within


def story_clusters(articles: DataFrame, least_shared: int = 2, least_overlap: float = 0.45, n: int = 20) -> DataFrame:
    """Pairs of articles of different sources whose titles share enough terms.

    The smaller title of a pair (n terms) shares s = max(least_shared, the
    overlap's part of n) terms, so one of its n - s + 1 rarest is among the
    other's, of which the least_shared - 1 most frequent can be left out too.
    Only those meet by an equi-join; a term that many titles have is seldom
    among them.  Whole term lists decide.  The n first pairs are numbered:
    articles are taken in order, 16 and then ever more at once, each with all
    later ones, until n pairs are found, so pairs behind the n-th aren't made.
    """
    terms = articles.select("id", "source_id", "ord", title_terms(F.col("title")).alias("t")).where(F.size("t") >= least_shared).checkpoint()
    each = terms.select("ord", F.explode("t").alias("term"))
    ranked = each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("t"))
    rows = ranked.join(terms.select("id", "source_id", "ord"), "ord").withColumn("n", F.size("t")).checkpoint()
    top, last, size = None, None, 16
    while True:
        later = rows if last is None else rows.where(F.col("ord") > last)
        last = later.select("ord").orderBy("ord").limit(size).agg(F.max("ord")).first()[0]
        found = _pairs(later, F.lit(last).cast(rows.schema["ord"].dataType), size <= 1024, least_shared, least_overlap).orderBy("o1", "o2").limit(n).checkpoint()
        top = found if top is None else top.unionByName(found)
        if last is None or top.count() >= n:
            break
        size *= 8
    top = top.orderBy("o1", "o2").limit(n)
    return top.withColumn("cluster", F.row_number().over(Window.orderBy("o1", "o2"))).select("cluster", "left_id", "right_id", "shared", "overlap", "terms")


def _pairs(rows: DataFrame, last: Column, small: bool, least_shared: int, least_overlap: float) -> DataFrame:
    """The pairs of story clusters whose earlier article has an ord up to ``last``."""
    need = F.greatest(F.lit(least_shared), F.ceil(F.col("n") * (least_overlap - 0.0001))).cast("int")  # shares are rounded to four places
    few = rows.select("ord", "source_id", "n", F.explode(F.slice("t", F.lit(1), F.col("n") - need + 1)).alias("term"))
    most = rows.select("ord", "source_id", "n", F.explode(F.slice("t", F.lit(1), F.col("n") - (least_shared - 1))).alias("term"))

    def meet(first: DataFrame, second: DataFrame, sizes: str) -> DataFrame:
        first = first.where(F.col("ord") <= last)
        met = (F.broadcast(first) if small else first).alias("a").join(second.alias("b"), "term")
        return met.where(f"{sizes} and a.ord < b.ord and a.source_id <> b.source_id").select(F.col("a.ord").alias("o1"), F.col("b.ord").alias("o2"))

    met = meet(few, most, "a.n <= b.n").unionByName(meet(most, few, "b.n < a.n")).distinct()
    side = lambda k: rows.select(F.col("ord").alias(f"o{k}"), F.col("id").alias("left_id" if k == 1 else "right_id"), F.col("t").alias(f"t{k}"), F.col("n").alias(f"n{k}"))
    both = F.array_intersect("t1", "t2")
    earlier = side(1).where(F.col("o1") <= last)
    pairs = met.join(side(2), "o2").join(F.broadcast(earlier) if small else earlier, "o1").select("o1", "o2", "left_id", "right_id", "n1", "n2", F.size(both).cast("long").alias("shared"), F.slice(F.array_sort(both), 1, 6).alias("terms"))
    share = rounded(F.col("shared") / F.least("n1", "n2"))
    return pairs.where(F.col("shared") >= least_shared).withColumn("overlap", share).where(F.col("overlap") >= least_overlap)


def audit(articles: DataFrame, sources: DataFrame, anchor: Column) -> DataFrame:
    """One row: inventory counts, rates, issues and the gate (pass, observe, fail)."""
    at = F.coalesce("published_at", "collected_at")
    missing = not_blank(F.col("abstract")).isNull()
    base = articles.agg(
        F.count("*").alias("articles"), F.count_distinct("source_id").alias("contributing_sources"), F.count_if(missing).alias("missing_abstract"), F.count_if(display_ready()).alias("display_ready"),
        F.count_if(within(at, anchor, "30d")).alias("within_30d"), F.count_if(within(at, anchor, "30d") & display_ready()).alias("within_30d_ready"),
        F.count_if(within(at, anchor, "24h") & display_ready()).alias("visible_24h"), F.count_if(within(at, anchor, "48h") & display_ready()).alias("visible_48h"),
        F.max(at).alias("newest"), F.count_distinct("content_hash").alias("distinct_contents"),
    )
    silent = sources.select(F.col("id").alias("source_id")).join(articles.select("source_id").distinct(), "source_id", "left_anti").agg(F.sort_array(F.collect_list("source_id")).alias("silent_sources"))
    rate = F.when(F.col("articles") == 0, F.lit(1.0)).otherwise(rounded(F.col("missing_abstract") / F.col("articles")))
    out = base.crossJoin(silent).withColumn("missing_abstract_rate", rate)  # one row by one row
    issues = F.filter(F.array(
        F.when(F.col("articles") < 20, "too_few_articles"), F.when(F.col("contributing_sources") < 5, "too_few_sources"), F.when(F.col("missing_abstract_rate") > 0.5, "abstracts_missing"),
        F.when(F.size("silent_sources") > 0, "silent_sources"), F.when(F.col("within_30d_ready") < F.col("within_30d"), "readiness_gap"), F.when(F.col("distinct_contents") < F.col("articles"), "repeated_contents"),
    ), lambda i: i.isNotNull())
    failed = (F.col("articles") < 20) | (F.col("contributing_sources") < 5) | (F.col("missing_abstract_rate") > 0.5)
    return out.withColumn("issues", issues).withColumn("gate", F.when(failed, "fail").when(F.size("issues") > 0, "observe").otherwise("pass"))


def counts_with_zero(dimension: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """(key, n) of every dimension row, those without facts included."""
    n = facts.groupBy(key).agg(F.count("*").alias("n"))
    return dimension.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def topic_counts(articles: DataFrame, topics=T.TOPICS) -> DataFrame:
    """(topic, n), every configured topic included."""
    spark = articles.sparkSession
    names = spark.createDataFrame([(t[0],) for t in topics], "topic string")
    return counts_with_zero(names, "topic", articles.select(F.explode(F.map_keys("topic_scores")).alias("topic")))


def event_counts(articles: DataFrame) -> DataFrame:
    return articles.select(F.explode("key_signal.event_types").alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


def release_guard(baseline: DataFrame, candidate: DataFrame, base_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row: may a candidate replace the baseline; thresholds follow the baseline.

    baseline and candidate are audits; the rows have content_hash, title_zh
    and the columns of :func:`display_ready`.
    """
    b = baseline.select(F.col("display_ready").alias("b_ready"), F.col("articles").alias("b_n"), F.col("missing_abstract_rate").alias("b_missing"))
    c = candidate.select(F.col("display_ready").alias("c_ready"), F.col("articles").alias("c_n"), F.col("missing_abstract_rate").alias("c_missing"), F.col("gate").alias("c_gate"))
    was = base_rows.where(display_ready()).select("content_hash").distinct()
    lost = new_rows.where(~display_ready()).join(was, "content_hash", "left_semi").agg(F.count("*").alias("lost_ready"))
    fresh = new_rows.join(base_rows.select("content_hash"), "content_hash", "left_anti").agg(F.count("*").alias("new_rows"))
    r = b.crossJoin(c).crossJoin(lost).crossJoin(fresh)  # one row each
    rate = lambda p, n: F.when(F.col(n) > 0, F.col(p) / F.col(n)).otherwise(F.lit(0.0))
    r = r.withColumns({
        "required_ready": F.when(F.col("b_ready") > 0, F.least(F.col("b_ready"), F.greatest(F.lit(12), F.ceil(F.lit(0.8) * F.col("b_ready"))))).otherwise(F.lit(0)).cast("long"),
        "min_ready_rate": rounded(F.least(F.lit(0.8), F.greatest(F.lit(0.55), rate("b_ready", "b_n") - 0.4))), "max_missing_rate": rounded(F.least(F.lit(0.5), F.greatest(F.lit(0.2), F.col("b_missing") + 0.1))),
        "ready_rate": rounded(rate("c_ready", "c_n")),
    })
    reasons = F.filter(F.array(
        F.when(F.col("c_gate") == "fail", "quality_failed"), F.when(F.col("c_ready") < F.col("required_ready"), "ready_count"), F.when(F.col("ready_rate") < F.col("min_ready_rate"), "ready_rate"),
        F.when(F.col("c_missing") > F.col("max_missing_rate"), "missing_rate"), F.when(F.col("lost_ready") > 0, "lost_ready"),
    ), lambda x: x.isNotNull())
    return r.withColumn("failures", reasons).withColumn("gate", F.when(F.size("failures") > 0, "fail").otherwise("pass"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """One row: call and token sums; the cost only if every call has one."""
    return calls.agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.when(F.count("cost_micros") == F.count("*"), F.coalesce(F.sum("cost_micros"), F.lit(0))).alias("cost_micros"),
    )


def committed_budget(requests: DataFrame, now: Column) -> DataFrame:
    """(month, committed_micros, reserved, settled): what a month's requests tie up."""
    value = F.when(F.col("state") == "settled", F.coalesce("actual_micros", "estimated_micros")).when((F.col("state") == "reserved") & (F.col("expires_at") > now), F.col("estimated_micros")).otherwise(F.lit(0))
    return requests.groupBy(month_key(F.col("created_at")).alias("month")).agg(F.sum(value).alias("committed_micros"), F.count_if(F.col("state") == "reserved").alias("reserved"), F.count_if(F.col("state") == "settled").alias("settled"))


def capability(committed: Column, soft: int, hard: int) -> Column:
    """What a month's committed budget leaves: available, saving or paused."""
    return F.when(committed >= hard, "paused").when(committed >= soft, "saving").otherwise("available")


def conditional_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with a count for each named condition."""
    return rows.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
