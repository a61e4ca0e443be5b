"""Topic, event and value scores of articles, and the gates built on them.

Input columns: id, source_id, source_type, evidence_tier, language, title,
abstract, title_zh, summary_zh, published_at, collected_at, ord.  All of it is
expressions; each pattern table is one regular expression, evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.numbers import age_hours, bonus, bounded, rounded, total
from ..functions.text import computed, contains_affirmed, contains_any, has_chinese, haystack, normalize_text, not_blank

ARTICLE = {
    "id": "string", "source_id": "string", "source_type": "string", "evidence_tier": "string", "language": "string", "title": "string", "abstract": "string",
    "title_zh": "string", "summary_zh": "string", "published_at": "timestamp", "collected_at": "timestamp", "ord": "long",
}


def with_article_columns(rows: DataFrame) -> DataFrame:
    """``rows`` with a null column for each article column that is missing."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in ARTICLE.items() if c not in rows.columns})


def topic_scores(text: Column, topics=T.TOPICS) -> Column:
    """Map topic -> weight * min(1, hits / 2), topics without a hit left out."""
    scores = []
    for name, weight, words in topics:
        hits = total([F.when(F.contains(text, F.lit(w.lower())), F.lit(1)).otherwise(F.lit(0)) for w in words])
        score = rounded(F.lit(float(weight)) * F.least(F.lit(1.0), hits.cast("double") / F.lit(2.0)))
        scores.append(F.when(hits > 0, F.struct(F.lit(name).alias("k"), score.alias("v"))))
    return F.map_from_entries(F.filter(F.array(*scores), lambda s: s.isNotNull()))


def select_by_topics(rows: DataFrame, topics=T.TOPICS, least: float = 0.1) -> DataFrame:
    """Rows with a topic score of ``least`` or more; all rows if there are no topics."""
    if not topics:
        return rows.withColumn("topic_scores", F.create_map().cast("map<string,double>"))
    scored = computed(computed(rows, _hay=haystack(F.col("title"), F.col("abstract"))), topic_scores=topic_scores(F.col("_hay"), topics))
    return scored.drop("_hay").where(F.array_max(F.map_values("topic_scores")) >= least)


def effective_type() -> Column:
    return F.when(F.col("source_id") == T.ACADEMIC_SOURCE, F.lit("academic")).otherwise(F.col("source_type"))


def display_ready() -> Column:
    """Chinese characters in the enriched title and summary, or in a Chinese original."""
    enriched = has_chinese(not_blank(F.col("title_zh"))) & has_chinese(not_blank(F.col("summary_zh")))
    native = F.coalesce(F.lower("language").startswith("zh"), F.lit(False)) & has_chinese(F.col("title")) & has_chinese(F.col("abstract"))
    return enriched | native


def with_events(rows: DataFrame) -> DataFrame:
    """Adds the columns ``_e_types``, ``_e_significance``, ``_e_decision`` and ``_e_adoption``."""
    lead = F.lower(normalize_text(F.concat(F.col("title"), F.lit(". "), F.substring(F.coalesce("abstract", F.lit("")), 1, 500))))
    base = computed(
        rows, _text=haystack(F.col("title"), F.col("abstract")), _lead=lead, _title=F.lower(normalize_text(F.col("title"))), _type=effective_type(),
        _primary=F.coalesce(F.col("evidence_tier") == "primary", F.lit(False)),
    )
    text, lead, title = F.col("_text"), F.col("_lead"), F.col("_title")
    base = computed(base, **{
        "_auth": F.col("_type").isin("official", "research_institute") & F.col("_primary"), "_res": F.col("_type").isin("academic", "research_institute") & F.col("_primary"),
        "_q": text.rlike(T.QUANTITATIVE), "_aq": text.rlike(T.ADOPTION_QUANTITY), "_bench": contains_affirmed(text, T.BENCHMARK), "_comp": contains_affirmed(text, T.COMPARISON),
        "_art": contains_affirmed(text, T.ARTIFACT), "_broad": contains_affirmed(lead, T.BROAD), "_dec": contains_affirmed(text, T.DECISION), "_major": contains_affirmed(lead, T.MAJOR_SUBJECT),
        "_scale": contains_affirmed(text, T.ADOPTION_SCALE), "_subject": contains_affirmed(lead, T.PRODUCT_SUBJECT),
    })
    c = F.col
    base = base.withColumn("_m", total([F.lit(0.66), bonus(c("_aq"), 0.12), bonus(c("_auth") | c("_res"), 0.10), bonus(c("_scale"), 0.08)]))
    events = [
        ("policy_regulation", contains_affirmed(lead, T.POLICY_SUBJECT) & contains_affirmed(lead, T.POLICY_ACTION),
         [F.lit(0.70), bonus(c("_auth"), 0.14), bonus(c("_dec"), 0.08)], [F.lit(0.82), bonus(c("_dec"), 0.10)]),
        ("product_launch", contains_affirmed(lead, T.PRODUCT_RELEASE) & c("_subject"),
         [F.lit(0.60), bonus(c("_auth"), 0.10), bonus(c("_major"), 0.12), bonus(c("_broad"), 0.08), bonus(c("_q") | c("_bench"), 0.06)],
         [F.lit(0.56), bonus(c("_major"), 0.12), bonus(c("_dec"), 0.10), bonus(c("_broad"), 0.08)]),
        ("capability_update", (contains_affirmed(title, T.CAPABILITY) | contains_affirmed(lead, T.STRONG_CAPABILITY)) & c("_subject"),
         [F.lit(0.52), bonus(c("_auth"), 0.12), bonus(c("_dec"), 0.10), bonus(c("_broad"), 0.10), bonus(c("_q") | c("_bench"), 0.08)],
         [F.lit(0.52), bonus(c("_dec"), 0.16), bonus(c("_broad"), 0.10)]),
        ("adoption_momentum", contains_affirmed(text, T.ADOPTION) & (c("_aq") | c("_scale")), [F.lit(0.62), F.lit(0.25) * c("_m")], [F.lit(0.58), F.lit(0.22) * c("_m")]),
        ("technical_breakthrough", contains_affirmed(text, T.ADVANCEMENT) & c("_comp") & (c("_q") | c("_bench")),
         [F.lit(0.60), bonus(c("_res"), 0.10), bonus(c("_q"), 0.08), bonus(c("_art"), 0.08)], [F.lit(0.48), bonus(c("_art"), 0.12)]),
        ("market_structure", contains_affirmed(lead, T.MARKET), [F.lit(0.64), bonus(c("_auth"), 0.12), bonus(c("_q"), 0.08)], [F.lit(0.68), bonus(c("_q"), 0.08)]),
        ("security_risk", contains_affirmed(lead, T.RISK), [F.lit(0.68), bonus(c("_auth") | c("_res"), 0.10), bonus(c("_q"), 0.08)], [F.lit(0.82)]),
    ]
    found = F.filter(
        F.array(*[F.when(when, F.struct((-total(score)).alias("minus"), F.lit(name).alias("name"), total(decision).alias("decision"))) for name, when, score, decision in events]),
        lambda e: e.isNotNull(),
    )
    base = base.withColumn("_events", F.array_sort(found))
    best = F.coalesce(F.array_max(F.transform("_events", lambda e: -e["minus"])), F.lit(0.0))
    several = F.least(F.lit(0.08), F.greatest(F.lit(0), F.size("_events") - 1) * F.lit(0.04))
    adopts = F.exists("_events", lambda e: e["name"] == "adoption_momentum")
    return base.withColumns({
        "_e_types": F.slice(F.transform("_events", lambda e: e["name"]), 1, 5),
        "_e_significance": F.when(F.size("_events") > 0, bounded(best + several)).otherwise(F.lit(0.0)),
        "_e_decision": bounded(F.coalesce(F.array_max(F.transform("_events", lambda e: e["decision"])), F.lit(0.0))),
        "_e_adoption": F.when(adopts, bounded(F.col("_m"))).otherwise(F.lit(0.0)),
    })


def with_breakdown(rows: DataFrame, anchor: Column) -> DataFrame:
    """Adds the eleven scores as columns ``_b_<name>``, and ``content_score``; needs topic_scores and events."""
    c = F.col
    tables = {"_p_narrow": T.NARROW, "_p_adv": T.ADVANCEMENT, "_p_comp": T.COMPARISON, "_p_bench": T.BENCHMARK, "_p_art": T.ARTIFACT, "_p_eng": T.ENGINEERING, "_p_eff": T.EFFICIENCY, "_p_gen": T.GENERALITY, "_p_impact": T.PRODUCT_IMPACT}
    rows = computed(rows, **{k: contains_any(c("_text"), v) for k, v in tables.items()})
    nd = c("_p_narrow")
    topics = F.size(F.map_keys("topic_scores"))
    affinity = F.create_map(*[F.lit(x) for k, v in T.AFFINITY.items() for x in (k, v)])
    relevance = F.coalesce(F.array_max(F.transform(F.map_entries("topic_scores"), lambda e: F.least(F.lit(1.0), e["value"]) * F.coalesce(F.try_element_at(affinity, e["key"]), F.lit(T.OTHER_AFFINITY)))), F.lit(0.0))
    relevance = relevance + F.least(F.lit(0.08), F.greatest(F.lit(0), topics - 1) * F.lit(0.03))
    primary = F.arrays_overlap(F.map_keys("topic_scores"), F.array(*[F.lit(t) for t in T.PRIMARY_TOPICS]))
    size = F.length(F.trim(F.coalesce("abstract", F.lit(""))))
    based = lambda table: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), c("_type")), F.lit(0.0))
    engineering = total([F.lit(0.08), bonus(c("_p_eng"), 0.30), bonus(c("_p_eff"), 0.22), bonus(c("_p_art"), 0.18), bonus(c("_p_impact"), 0.14)])
    general = total([F.lit(0.18), bonus(c("_p_gen"), 0.35), bonus(c("_p_art"), 0.15), bonus(topics >= 2, 0.12)])
    impact = total([based(T.IMPACT_BASE), bonus(c("_p_impact"), 0.33), bonus(c("_p_eng"), 0.16), bonus(c("_q"), 0.14), bonus(c("_e_significance") >= 0.7, 0.16), F.lit(0.12) * c("_e_adoption")])
    trusted = (c("_e_significance") >= 0.7) & c("_primary") & c("_type").isin("official", "research_institute", "academic")
    evidence = total([based(T.EVIDENCE_BASE), bonus(c("_q"), 0.18), bonus(c("_p_bench"), 0.16), bonus(c("_p_art"), 0.14), bonus(size >= 500, 0.07), bonus(trusted, 0.12)])
    age = age_hours(anchor, F.coalesce("published_at", "collected_at"))
    parts = {
        "target_relevance": F.when(nd, F.least(relevance, F.lit(0.45))).otherwise(relevance),
        "technical_advancement": total([F.lit(0.12), bonus(c("_p_adv"), 0.23), bonus(c("_q"), 0.22), bonus(c("_p_comp"), 0.18), bonus(c("_p_bench"), 0.15), bonus(c("_p_art"), 0.10)]),
        "engineering_applicability": F.when(nd & ~F.coalesce(primary, F.lit(False)), F.least(engineering, F.lit(0.4))).otherwise(engineering),
        "technical_generality": F.when(nd, general * F.lit(0.45)).otherwise(general),
        "product_industry_impact": F.when(nd, F.least(impact, F.lit(0.35))).otherwise(impact),
        "event_significance": c("_e_significance"), "decision_impact": c("_e_decision"), "adoption_momentum": c("_e_adoption"),
        "freshness": F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(168.0)),
        "completeness": F.when(size >= 240, F.lit(1.0)).when(size >= 120, F.lit(0.65)).when(size > 0, F.lit(0.35)).otherwise(F.lit(0.0)),
        "evidence_maturity": F.when(size < 120, F.least(evidence, F.lit(0.3))).otherwise(evidence),
    }
    scored = rows.withColumns({f"_b_{k}": bounded(v) for k, v in parts.items()})
    weights = (
        ("target_relevance", 0.20), ("event_significance", 0.15), ("technical_advancement", 0.08), ("technical_generality", 0.05), ("engineering_applicability", 0.08),
        ("product_industry_impact", 0.08), ("decision_impact", 0.06), ("adoption_momentum", 0.10), ("freshness", 0.10), ("evidence_maturity", 0.07), ("completeness", 0.03),
    )
    return scored.withColumn("content_score", bounded(total([F.col(f"_b_{k}") * F.lit(w) for k, w in weights])))


def _labels(*cases) -> Column:
    return F.filter(F.array(*cases), lambda r: r.isNotNull())


def _event_labels() -> Column:
    names = F.create_map(*[F.lit(x) for k, v in T.EVENT_LABELS.items() for x in (k, v)])
    return F.transform(F.slice(F.col("_e_types"), 1, 2), lambda t: F.try_element_at(names, t))


def with_reasons(rows: DataFrame) -> DataFrame:
    """Adds ``selection_reasons``: the five strongest signals in words."""
    b = lambda k: F.col(f"_b_{k}")
    cases = _labels(
        F.when(b("event_significance") >= 0.8, "重大变化信号明确").when(b("event_significance") >= 0.7, "变化事件较为显著"), F.when(b("decision_impact") >= 0.75, "可能影响产品或技术决策"),
        F.when(b("adoption_momentum") >= 0.7, "采用与扩散证据较强"), F.when(b("target_relevance") >= 0.7, "目标主题高度相关").when(b("target_relevance") >= 0.45, "目标主题相关"),
        F.when(b("technical_advancement") >= 0.7, "技术改进信号明确"), F.when(b("engineering_applicability") >= 0.65, "具备工程落地价值"), F.when(b("technical_generality") >= 0.65, "适用范围较广"),
        F.when(b("product_industry_impact") >= 0.65, "产品或行业影响较高"), F.when(b("freshness") >= 0.85, "24 小时内发布").when(b("freshness") >= 0.55, "近期发布"),
        F.when(b("evidence_maturity") >= 0.7, "证据与对照较充分").when(b("completeness") == 0, "仅保留来源标题"),
    )
    return rows.withColumn("selection_reasons", F.slice(F.concat(_event_labels(), cases), 1, 5))


def _weak_relation(b) -> Column:
    return (b("target_relevance") < 0.35) & (b("product_industry_impact") < 0.65)


def with_key_signal(rows: DataFrame, anchor: Column | None) -> DataFrame:
    """Adds struct ``key_signal``: scores, reasons, gate failures, eligibility."""
    b, c = (lambda k: F.col(f"_b_{k}")), F.col
    user = bounded(total([b("target_relevance") * 0.25, b("engineering_applicability") * 0.20, b("decision_impact") * 0.30, b("product_industry_impact") * 0.25]))
    change = bounded(total([b("event_significance") * 0.65, b("technical_advancement") * 0.20, b("adoption_momentum") * 0.15]))
    action = bounded(total([b("decision_impact") * 0.50, b("engineering_applicability") * 0.25, b("product_industry_impact") * 0.25]))
    scored = rows.withColumns({"_user": user, "_change": change, "_action": action})
    score = bounded(total([c("_user") * 0.20, c("_change") * 0.30, c("_action") * 0.20, b("technical_generality") * 0.10, b("freshness") * 0.10, b("evidence_maturity") * 0.10]))
    if anchor is None:
        inside = b("freshness") >= F.lit(round(1 - 5 / 7, 4))
    else:
        inside = age_hours(anchor, F.coalesce("published_at", "collected_at")) <= 120
    scored = scored.withColumns({"_score": score, "_inside": inside})
    durable = (
        c("_primary") & c("_type").isin("official", "research_institute") & c("_inside") & (b("event_significance") >= 0.85)
        & (F.greatest(b("decision_impact"), b("adoption_momentum")) >= 0.75) & (c("_score") >= 0.55)
    )
    scored = scored.withColumn("_durable", durable)
    size = F.length(F.trim(F.coalesce("abstract", F.lit(""))))
    academic = (c("_type") == "academic") & (~F.array_contains("_e_types", "technical_breakthrough") | (b("target_relevance") < 0.65) | (b("technical_generality") < 0.55))
    gates = (
        c("_type").isin(*T.CORROBORATED_TYPES), b("event_significance") < 0.7, F.greatest(b("decision_impact"), b("adoption_momentum"), b("technical_advancement")) < 0.6,
        _weak_relation(b), ~c("_inside"), (b("evidence_maturity") < 0.5) | (size < 120), academic, (c("_score") < 0.65) & ~c("_durable"),
    )
    failures = _labels(F.when(~display_ready(), T.NOT_READY), *[F.when(g, label) for g, label in zip(gates, T.GATES)])
    reasons = F.concat(_event_labels(), _labels(
        F.when(c("_user") >= 0.7, "目标用户价值较高"), F.when(c("_change") >= 0.7, "变化幅度较大"), F.when(c("_action") >= 0.65, "具备可行动性"),
        F.when(b("technical_generality") >= 0.65, "技术普适性较强"), F.when(b("freshness") >= 0.85, "24 小时内发布").when(c("_durable"), "重大一手事件仍在 5 日观察窗"),
    ))
    return scored.withColumn("_failures", failures).withColumn("key_signal", F.struct(
        (F.size("_failures") == 0).alias("eligible"), c("_score").alias("score"), c("_user").alias("user_value"), c("_change").alias("change_magnitude"), c("_action").alias("actionability"),
        b("technical_generality").alias("generality"), b("freshness").alias("freshness"), c("_e_types").alias("event_types"), F.slice(reasons, 1, 5).alias("reasons"), F.slice("_failures", 1, 8).alias("gate_failures"),
    ))


def significance_candidate() -> Column:
    """Is an event large and documented enough, whatever its display state."""
    b = lambda k: F.col(f"breakdown.{k}")
    type_ = effective_type()
    floor = F.when(type_ == "professional_media", F.lit(0.35)).otherwise(F.lit(0.5))
    academic = (type_ == "academic") & (~F.array_contains("key_signal.event_types", "technical_breakthrough") | (b("target_relevance") < 0.65) | (b("technical_generality") < 0.55))
    return (b("event_significance") >= 0.7) & (b("evidence_maturity") >= floor) & (b("freshness") > 0) & (F.length(F.trim(F.coalesce("abstract", F.lit("")))) >= 120) & ~_weak_relation(b) & ~academic


#: Floors of the two translation candidates.
TRANSLATION_DAYS = 3
TRUSTED_TYPES = ("official", "research_institute", "professional_media")


def trusted_fresh_candidate(anchor: Column) -> Column:
    """A row of three days at most, of a trusted source type, that readers can use though it isn't in Chinese."""
    b, at = (lambda k: F.col(f"breakdown.{k}")), F.coalesce("published_at", "collected_at")
    relevant = (b("target_relevance") >= 0.5) & (F.greatest(b("technical_advancement"), b("engineering_applicability"), b("product_industry_impact")) >= 0.7)
    useful = (b("engineering_applicability") >= 0.65) & (b("product_industry_impact") >= 0.55) & (b("evidence_maturity") >= 0.6)
    fresh = at >= anchor - F.expr(f"INTERVAL {TRANSLATION_DAYS} DAYS")
    return F.coalesce(fresh & F.col("source_type").isin(*TRUSTED_TYPES) & (F.coalesce("content_score", F.lit(0.0)) >= 0.35) & (relevant | useful), F.lit(False))


def priority_topic_candidate(anchor: Column, evidence: Column, focus) -> Column:
    """A row of three days at most, of a focus topic and a trusted or qualified academic source, with 50 characters of evidence."""
    b, at = (lambda k: F.col(f"breakdown.{k}")), F.coalesce("published_at", "collected_at")
    value = F.coalesce("content_score", F.lit(0.0))
    academic = (F.col("source_type") == "academic") & (F.col("evidence_tier") == "primary") & (value >= 0.35) & (b("target_relevance") >= 0.6) & (F.greatest(b("technical_advancement"), b("engineering_applicability")) >= 0.65)
    fresh = at >= anchor - F.expr(f"INTERVAL {TRANSLATION_DAYS} DAYS")
    on_topic = F.arrays_overlap(F.map_keys("topic_scores"), F.array(*map(F.lit, focus)))
    return F.coalesce(
        fresh & (F.col("source_type").isin("official", "research_institute") | academic) & on_topic & (value >= 0.22) & (b("target_relevance") >= 0.6) & (F.length(F.trim(evidence)) >= 50), F.lit(False)
    )


def waiting_for_chinese() -> Column:
    return F.col("key_signal.gate_failures") == F.array(F.lit(T.NOT_READY))


def score_articles(rows: DataFrame, anchor: Column, topics=T.TOPICS) -> DataFrame:
    """All scores of articles; topic_scores are computed if absent."""
    rows = with_article_columns(rows)
    if "topic_scores" not in rows.columns:
        rows = computed(computed(rows, _hay=haystack(F.col("title"), F.col("abstract"))), topic_scores=topic_scores(F.col("_hay"), topics)).drop("_hay")
    scored = with_key_signal(with_reasons(with_breakdown(with_events(rows), anchor)), anchor)
    # structs come last: the steps above share plain columns, which the optimizer computes once
    event = F.struct(*[F.col(f"_e_{k}").alias(k) for k in ("types", "significance", "decision", "adoption")])
    breakdown = F.struct(*[F.col(c).alias(c[3:]) for c in scored.columns if c.startswith("_b_")])
    scored = scored.withColumns({"event": event, "breakdown": breakdown})
    return scored.select(*[c for c in scored.columns if not c.startswith("_")])


def relevance_filter() -> Column:
    """The academic source needs relevance of 0.60, in narrow domains 0.65."""
    narrow = contains_any(haystack(F.col("title"), F.col("abstract")), T.NARROW)
    return (F.col("source_id") != T.ACADEMIC_SOURCE) | (F.col("breakdown.target_relevance") >= F.when(narrow, F.lit(0.65)).otherwise(F.lit(0.6)))
