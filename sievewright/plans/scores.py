"""Queries of the scoring operators, with SQL for all scores, gates and reasons.

The articles' abstracts begin with phrases that the pattern tables look for, some of them
negated, because the invented prose has few.  SQL has no look-behind: there
the stretch that a negator covers is taken out before the tables are searched.
event_profile's SQL marks all negators first, so that one within another's
stretch counts too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import scoring, selection
from .catalog import ANCHOR, HASH, TOPIC_SQL, TOPICS, WHOLE_ARTICLES, articles, hashed, query

#: Phrases for the beginning of an abstract, in turn.
PHRASES = (
    "The regulator said the new regulation of the API takes effect and requires compliance. The open source platform is in production: latency reduced by 40% on a benchmark, widely used, with 20 million active users of the runtime. ",
    "We introduce a new architecture. It outperforms the baseline by 12% on a benchmark, and the code is open source on github.com. ",
    "The company launched a new model platform, generally available to all customers and developers with lower latency in production. ", "This is not a new benchmark and does not improve the baseline. ", "",
    "The service saw adoption: 20 million users and 3000 customers in production, adopted by many teams. ", "The acquisition of a startup costs 3 billion; the merger follows. ", "A vulnerability and a data breach: 40% of the agent service is affected. ",
    "The API now supports native support for tools, a breaking change; pricing is reduced by 50% for developers. ", "Without a dataset nothing is evaluated. Latency is 20 ms. ",
)


def _q(value: str) -> str:
    return value.replace("'", "''")


def _d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({column}, '{_q(p)}')" for p in patterns) + ")"


_NEGATORS = r"(?:\bno\b|\bnot\b|\bwithout\b|\blacks?\b|\bdoes not\b|\bdid not\b|未|没有|缺少)[^.!?。！？]{0,120}"

#: Java's word boundaries, which know all letters, in RE2's notation: before a word (some characters are read) and after it.
_WORD = r"\pL\p{Nd}_\p{Mn}"
_BEFORE = rf"(?:(?:^|[^{_WORD}\x{{fdd0}}])\p{{Mn}}*|_\p{{Mn}}+)"
_AFTER = rf"(?:$|[^{_WORD}\x{{fdd0}}])"
_WORD_NEGATORS = "no|not|without|lacks?"


def _unnegated(column: str) -> str:
    """The text without the places where a negated term can begin, by the rule of text.NEGATORS.

    A mark (U+FDD0) is put behind each negator; two in turn share the space
    between them, so words are marked twice.  A term in Chinese right behind a
    word loses its first character.  What goes is a mark, what its sentence
    has up to 120 characters behind it or behind a mark in there, and the
    character or the word after that, where a term could still begin.
    """
    def replace(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    mark = chr(0xFDD0)
    out = column
    for _ in range(2):
        out = replace(out, f"({_BEFORE})({_WORD_NEGATORS})({_AFTER})", rf"\1\2{mark}\3")
    out = replace(out, "(未|没有|缺少)", rf"\1{mark}")
    out = replace(out, rf"({_BEFORE})({_WORD_NEGATORS})\p{{Han}}", rf"\1\2{chr(0xFDD1)}")
    gap = rf"[^.!?。！？\x{{fdd0}}]{{0,120}}"
    return replace(out, rf"\x{{fdd0}}(?:{gap}\x{{fdd0}})*{gap}(?:[a-z0-9]+|[^\x{{fdd0}}])?", " ⁂ ")


def _bounds(pattern: str) -> str:
    r"""A pattern of quantities with Java's \b: before a word, after it, and between two with up to 32 characters of a sentence."""
    other = rf"[^.!?{_WORD}]"
    return pattern.replace(r"\b[^.!?]{0,32}\b", rf"(?:{other}|{other}[^.!?]{{0,30}}{other})").replace(r"\b|", f"{_AFTER}|").replace(r"\b", _BEFORE)


def _affirmed(column: str, patterns) -> str:
    def term(p: str) -> str:
        literal = "".join(c if c.isalnum() or c == " " or ord(c) > 127 else "\\" + c for c in p)
        ends = [x.isascii() and x.isalnum() for x in (p[0], p[-1])]
        return f"{'(?:^|[^a-z0-9])' if ends[0] else ''}{literal}{'(?:[^a-z0-9]|$)' if ends[1] else ''}"

    return f"regexp_matches({column}, '{_q('|'.join(map(term, patterns)))}')"


def _sum(*parts: str) -> str:
    return "(" + " + ".join(parts) + ")"


def _bonus(condition: str, value: float) -> str:
    return f"CASE WHEN {condition} THEN {_d(value)} ELSE 0.0::DOUBLE END"


def _bounded(x: str) -> str:
    return f"floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


def _based(table: dict) -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN {_d(v)}" for k, v in table.items()) + " ELSE 0.0::DOUBLE END"


_EVENTS = (
    ("policy_regulation", f"{_affirmed('lead', T.POLICY_SUBJECT)} AND {_affirmed('lead', T.POLICY_ACTION)}", _sum(_d(0.7), _bonus("auth", 0.14), _bonus("dec", 0.08)), _sum(_d(0.82), _bonus("dec", 0.1))),
    ("product_launch", f"{_affirmed('lead', T.PRODUCT_RELEASE)} AND subj", _sum(_d(0.6), _bonus("auth", 0.1), _bonus("major", 0.12), _bonus("broad", 0.08), _bonus("q OR bench", 0.06)), _sum(_d(0.56), _bonus("major", 0.12), _bonus("dec", 0.1), _bonus("broad", 0.08))),
    ("capability_update", f"({_affirmed('ttl', T.CAPABILITY)} OR {_affirmed('lead', T.STRONG_CAPABILITY)}) AND subj", _sum(_d(0.52), _bonus("auth", 0.12), _bonus("dec", 0.1), _bonus("broad", 0.1), _bonus("q OR bench", 0.08)), _sum(_d(0.52), _bonus("dec", 0.16), _bonus("broad", 0.1))),
    ("adoption_momentum", f"{_affirmed('txt', T.ADOPTION)} AND (aq OR scl)", _sum(_d(0.62), f"{_d(0.25)} * m"), _sum(_d(0.58), f"{_d(0.22)} * m")),
    ("technical_breakthrough", f"{_affirmed('txt', T.ADVANCEMENT)} AND comp AND (q OR bench)", _sum(_d(0.6), _bonus("res", 0.1), _bonus("q", 0.08), _bonus("art", 0.08)), _sum(_d(0.48), _bonus("art", 0.12))),
    ("market_structure", _affirmed("lead", T.MARKET), _sum(_d(0.64), _bonus("auth", 0.12), _bonus("q", 0.08)), _sum(_d(0.68), _bonus("q", 0.08))),
    ("security_risk", _affirmed("lead", T.RISK), _sum(_d(0.68), _bonus("auth OR res", 0.1), _bonus("q", 0.08)), _d(0.82)),
)
_TYPES = "[" + ", ".join(f"'{x}'" for x in T.IMPACT_BASE) + "]"
_PHRASE = "[" + ", ".join(f"'{_q(p)}'" for p in PHRASES) + f"][(ord % {len(PHRASES)}) + 1]"
_NEG = lambda c: f"regexp_replace({c}, '{_NEGATORS}', ' ⁂ ', 'g')"
_N = " + ".join(f"CAST(t_{n} > 0 AS INT)" for n, _, _ in TOPICS)
_REL = "greatest(" + ", ".join(f"least(1.0::DOUBLE, t_{n}) * {_d(T.AFFINITY.get(n, T.OTHER_AFFINITY))}" for n, _, _ in TOPICS) + ")"
_JAVA = lambda p: _q(p.removeprefix("(?i)"))
_WEIGHTS = (
    ("target_relevance", 0.20), ("event_significance", 0.15), ("technical_advancement", 0.08), ("technical_generality", 0.05), ("engineering_applicability", 0.08),
    ("product_industry_impact", 0.08), ("decision_impact", 0.06), ("adoption_momentum", 0.10), ("freshness", 0.10), ("evidence_maturity", 0.07), ("completeness", 0.03),
)
_PARTS = {
    "target_relevance": f"CASE WHEN narrow THEN least(rel, {_d(0.45)}) ELSE rel END",
    "technical_advancement": _sum(_d(0.12), _bonus("p_adv", 0.23), _bonus("q", 0.22), _bonus("p_comp", 0.18), _bonus("p_bench", 0.15), _bonus("p_art", 0.1)),
    "engineering_applicability": f"CASE WHEN narrow THEN least(eng, {_d(0.4)}) ELSE eng END", "technical_generality": f"CASE WHEN narrow THEN gen * {_d(0.45)} ELSE gen END",
    "product_industry_impact": f"CASE WHEN narrow THEN least(imp, {_d(0.35)}) ELSE imp END", "event_significance": "sig", "decision_impact": "deci", "adoption_momentum": "adop",
    "freshness": f"greatest(0.0::DOUBLE, 1.0::DOUBLE - greatest(0.0::DOUBLE, (epoch_us({ANCHOR}) - epoch_us(published_at)) / 3.6e9::DOUBLE) / 168.0::DOUBLE)",
    "completeness": "CASE WHEN size >= 240 THEN 1.0::DOUBLE WHEN size >= 120 THEN 0.65::DOUBLE WHEN size > 0 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END",
    "evidence_maturity": f"CASE WHEN size < 120 THEN least(evi, {_d(0.3)}) ELSE evi END",
}
_LABEL = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EVENT_LABELS.items()) + " END"


def _labels(*cases: tuple[str, ...]) -> str:
    made = [f"CASE {' '.join(f'WHEN {a} THEN {chr(39)}{b}{chr(39)}' for a, b in zip(c[::2], c[1::2]))} END" for c in cases]
    return f"list_filter([{', '.join(made)}], lambda x: x IS NOT NULL)"


_ACADEMIC = "type = 'academic' AND (NOT list_contains(types, 'technical_breakthrough') OR target_relevance < 0.65::DOUBLE OR technical_generality < 0.55::DOUBLE)"
_WEAK = "target_relevance < 0.35::DOUBLE AND product_industry_impact < 0.65::DOUBLE"
_GATES = (
    "type IN (" + ", ".join(f"'{x}'" for x in T.CORROBORATED_TYPES) + ")", "event_significance < 0.7::DOUBLE", "greatest(decision_impact, adoption_momentum, technical_advancement) < 0.6::DOUBLE", _WEAK, "NOT inside",
    "evidence_maturity < 0.5::DOUBLE OR size < 120", _ACADEMIC, "sc < 0.65::DOUBLE AND NOT durable",
)
_READY = "ord % 3 = 0"
_DURABLE = "prim AND type IN ('official', 'research_institute') AND inside AND event_significance >= 0.85::DOUBLE AND greatest(decision_impact, adoption_momentum) >= 0.75::DOUBLE AND sc >= 0.55::DOUBLE"
SCORES = TOPIC_SQL.replace("FROM a)", f"FROM (SELECT * REPLACE ({_PHRASE} || abstract AS abstract) FROM a))", 1) + f""",
  e0 AS (SELECT *, {_TYPES}[(ord % 5) + 1] AS type, ord % 2 = 0 AS prim, lower(trim(regexp_replace(title || '. ' || substring(abstract, 1, 500), '\\s+', ' ', 'g'))) AS lead0, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS ttl0, length(trim(abstract, ' ')) AS size FROM s),
  e1 AS (SELECT *, {_NEG('h')} AS txt, {_NEG('lead0')} AS lead, {_NEG('ttl0')} AS ttl, type IN ('official', 'research_institute') AND prim AS auth, type IN ('academic', 'research_institute') AND prim AS res,
    regexp_matches(h, '{_JAVA(T.QUANTITATIVE)}') AS q, regexp_matches(h, '{_JAVA(T.ADOPTION_QUANTITY)}') AS aq FROM e0),
  e2 AS (SELECT *, {_affirmed('txt', T.BENCHMARK)} AS bench, {_affirmed('txt', T.COMPARISON)} AS comp, {_affirmed('txt', T.ARTIFACT)} AS art, {_affirmed('lead', T.BROAD)} AS broad, {_affirmed('txt', T.DECISION)} AS dec,
    {_affirmed('lead', T.MAJOR_SUBJECT)} AS major, {_affirmed('txt', T.ADOPTION_SCALE)} AS scl, {_affirmed('lead', T.PRODUCT_SUBJECT)} AS subj,
    {', '.join(f"{_any('h', p)} AS {n}" for n, p in (('narrow', T.NARROW), ('p_adv', T.ADVANCEMENT), ('p_comp', T.COMPARISON), ('p_bench', T.BENCHMARK), ('p_art', T.ARTIFACT), ('p_eng', T.ENGINEERING), ('p_eff', T.EFFICIENCY), ('p_gen', T.GENERALITY), ('p_imp', T.PRODUCT_IMPACT)))} FROM e1),
  e3 AS (SELECT *, {_sum(_d(0.66), _bonus('aq', 0.12), _bonus('auth OR res', 0.1), _bonus('scl', 0.08))} AS m FROM e2),
  e4 AS (SELECT *, list_sort(list_filter([{', '.join(f"CASE WHEN {w} THEN {{'m': -{s}, 'name': '{n}', 'd': {d}}} END" for n, w, s, d in _EVENTS)}], lambda x: x IS NOT NULL)) AS ev FROM e3),
  e5 AS (SELECT *, list_slice(list_transform(ev, lambda x: x.name), 1, 5) AS types, CASE WHEN len(ev) > 0 THEN {_bounded("-ev[1].m + least(0.08::DOUBLE, greatest(0, len(ev) - 1) * 0.04::DOUBLE)")} ELSE 0.0::DOUBLE END AS sig,
    {_bounded("coalesce(list_max(list_transform(ev, lambda x: x.d)), 0.0::DOUBLE)")} AS deci, CASE WHEN len(list_filter(ev, lambda x: x.name = 'adoption_momentum')) > 0 THEN {_bounded('m')} ELSE 0.0::DOUBLE END AS adop FROM e4),
  e6 AS (SELECT *, {_REL} + least(0.08::DOUBLE, greatest(0, ({_N}) - 1) * 0.03::DOUBLE) AS rel, {_sum(_d(0.08), _bonus('p_eng', 0.3), _bonus('p_eff', 0.22), _bonus('p_art', 0.18), _bonus('p_imp', 0.14))} AS eng,
    {_sum(_d(0.18), _bonus('p_gen', 0.35), _bonus('p_art', 0.15), _bonus(f'({_N}) >= 2', 0.12))} AS gen,
    {_sum(_based(T.IMPACT_BASE), _bonus('p_imp', 0.33), _bonus('p_eng', 0.16), _bonus('q', 0.14), _bonus('sig >= 0.7::DOUBLE', 0.16), f'{_d(0.12)} * adop')} AS imp,
    {_sum(_based(T.EVIDENCE_BASE), _bonus('q', 0.18), _bonus('p_bench', 0.16), _bonus('p_art', 0.14), _bonus('size >= 500', 0.07), _bonus("sig >= 0.7::DOUBLE AND prim AND type IN ('official', 'research_institute', 'academic')", 0.12))} AS evi FROM e5),
  e7 AS (SELECT *, {', '.join(f'{_bounded(v)} AS {k}' for k, v in _PARTS.items())} FROM e6),
  e8 AS (SELECT *, {_bounded(_sum(*(f'{k} * {_d(w)}' for k, w in _WEIGHTS)))} AS content_score, {_bounded(_sum('target_relevance * 0.25::DOUBLE', 'engineering_applicability * 0.2::DOUBLE', 'decision_impact * 0.3::DOUBLE', 'product_industry_impact * 0.25::DOUBLE'))} AS usr,
    {_bounded(_sum('event_significance * 0.65::DOUBLE', 'technical_advancement * 0.2::DOUBLE', 'adoption_momentum * 0.15::DOUBLE'))} AS chg, {_bounded(_sum('decision_impact * 0.5::DOUBLE', 'engineering_applicability * 0.25::DOUBLE', 'product_industry_impact * 0.25::DOUBLE'))} AS act,
    greatest(0.0::DOUBLE, (epoch_us({ANCHOR}) - epoch_us(published_at)) / 3.6e9::DOUBLE) <= 120 AS inside FROM e7),
  e9 AS (SELECT *, {_bounded(_sum('usr * 0.2::DOUBLE', 'chg * 0.3::DOUBLE', 'act * 0.2::DOUBLE', 'technical_generality * 0.1::DOUBLE', 'freshness * 0.1::DOUBLE', 'evidence_maturity * 0.1::DOUBLE'))} AS sc FROM e8),
  z AS (SELECT *, {_DURABLE} AS durable, list_slice(list_concat({_labels((f'NOT ({_READY})', T.NOT_READY))}, {_labels(*((g.replace('NOT durable', f'NOT ({_DURABLE})'), label) for g, label in zip(_GATES, T.GATES)))}), 1, 8) AS failures FROM e9)"""

#: The same over whole abstracts.
WHOLE_SCORES = f"WITH {WHOLE_ARTICLES}{SCORES}"
#: The same with the query's own rules on negators, on the words beside quantities and on the one letter that becomes two in lower case.
EVENTS = WHOLE_SCORES
for _old, _new in (
    *((f"{_NEG(c)} AS {n}", f"{_unnegated(c)} AS {n}") for c, n in (("h", "txt"), ("lead0", "lead"), ("ttl0", "ttl"))),
    *((t, t.replace(c, f"replace({c}, 'İ', 'i̇')")) for c in ("title || chr(10) || abstract", "title || '. ' || substring(abstract, 1, 500)", "title") for t in (f"lower({c}) AS h", f"lower(trim(regexp_replace({c},")),
    (f"'{_JAVA(T.QUANTITATIVE)}'", f"'{_bounds(_JAVA(T.QUANTITATIVE))}'"), (f"'{_JAVA(T.ADOPTION_QUANTITY)}'", f"'{_bounds(_JAVA(T.ADOPTION_QUANTITY))}'"),
):
    EVENTS = EVENTS.replace(_old, _new)


def rows(spark, sf, longest=2500):
    """Articles with phrases, source types, tiers and, for a third of them, Chinese titles and summaries."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("ord") % len(PHRASES) + 1).cast("int"))
    return articles(spark, sf, longest).withColumns({
        "abstract": F.concat(phrase, F.col("abstract")), "source_type": F.element_at(F.array(*map(F.lit, T.IMPACT_BASE)), (F.col("ord") % 5 + 1).cast("int")), "evidence_tier": F.when(F.col("ord") % 2 == 0, "primary").otherwise("secondary"),
        "title_zh": F.when(F.col("ord") % 3 == 0, F.concat(F.lit("标题"), F.col("title"))), "summary_zh": F.when(F.col("ord") % 3 == 0, F.lit("摘要")),
    })


def scored(spark, sf, longest=2500):
    return scoring.score_articles(hashed(rows(spark, sf, longest)), F.expr(ANCHOR), TOPICS)


@query(WHOLE_SCORES + " SELECT id, content_score, " + ", ".join(_PARTS) + " FROM z")
def value_score(spark, sf):
    return scored(spark, sf, None).select("id", "content_score", "breakdown.*")


@query(EVENTS + " SELECT id, array_to_string(types, '|') AS types, sig AS significance, deci AS decision, adop AS adoption FROM z")
def event_profile(spark, sf):
    return scored(spark, sf, None).select("id", F.array_join("event.types", "|").alias("types"), "event.significance", "event.decision", "event.adoption")


_REASONS = _labels(
    ("event_significance >= 0.8::DOUBLE", "重大变化信号明确", "event_significance >= 0.7::DOUBLE", "变化事件较为显著"), ("decision_impact >= 0.75::DOUBLE", "可能影响产品或技术决策"), ("adoption_momentum >= 0.7::DOUBLE", "采用与扩散证据较强"),
    ("target_relevance >= 0.7::DOUBLE", "目标主题高度相关", "target_relevance >= 0.45::DOUBLE", "目标主题相关"), ("technical_advancement >= 0.7::DOUBLE", "技术改进信号明确"), ("engineering_applicability >= 0.65::DOUBLE", "具备工程落地价值"),
    ("technical_generality >= 0.65::DOUBLE", "适用范围较广"), ("product_industry_impact >= 0.65::DOUBLE", "产品或行业影响较高"), ("freshness >= 0.85::DOUBLE", "24 小时内发布", "freshness >= 0.55::DOUBLE", "近期发布"),
    ("evidence_maturity >= 0.7::DOUBLE", "证据与对照较充分", "completeness = 0", "仅保留来源标题"),
)


@query(SCORES + f" SELECT id, array_to_string(list_slice(list_concat(list_transform(list_slice(types, 1, 2), lambda x: {_LABEL}), {_REASONS}), 1, 5), '|') AS reasons FROM z")
def selection_reasons(spark, sf):
    return scored(spark, sf).select("id", F.array_join("selection_reasons", "|").alias("reasons"))


@query(WHOLE_SCORES + f""" SELECT id, len(failures) = 0 AS eligible, sc AS score, array_to_string(failures, '|') AS failures, failures = ['{T.NOT_READY}'] AS waiting,
  event_significance >= 0.7::DOUBLE AND evidence_maturity >= CASE WHEN type = 'professional_media' THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END AND freshness > 0 AND size >= 120 AND NOT ({_WEAK}) AND NOT ({_ACADEMIC}) AS candidate FROM z""")
def key_signal_gate(spark, sf):
    return scored(spark, sf, None).select("id", "key_signal.eligible", "key_signal.score", F.array_join("key_signal.gate_failures", "|").alias("failures"), scoring.significance_candidate().alias("candidate"), scoring.waiting_for_chinese().alias("waiting"))


@query(SCORES + """, p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY content_score DESC, published_at DESC, ord) AS place FROM z)
  SELECT id, source_id, content_score FROM p WHERE place <= 8 ORDER BY content_score DESC, published_at DESC, ord LIMIT 40""")
def content_quotas(spark, sf):
    ready = scoring.select_by_topics(rows(spark, sf), TOPICS, 0.0)
    return selection.apply_quotas(ready, F.expr(ANCHOR)).select("id", "source_id", "content_score")


@query(SCORES + f" SELECT id, sc AS score FROM z WHERE len(failures) = 0 AND published_at BETWEEN {ANCHOR} - INTERVAL 120 HOUR AND {ANCHOR} ORDER BY published_at DESC, sc DESC, content_score DESC, ord LIMIT 1")
def feed_key_signal(spark, sf):
    return selection.key_signal_row(scored(spark, sf), F.expr(ANCHOR)).select("id", "key_signal.score")


_FRESH = f"published_at >= {ANCHOR} - INTERVAL 3 DAY"


@query(SCORES + f""" SELECT id, {_FRESH} AND type IN ('official', 'research_institute', 'professional_media') AND content_score >= 0.35::DOUBLE AND (target_relevance >= 0.5::DOUBLE AND greatest(technical_advancement, engineering_applicability, product_industry_impact) >= 0.7::DOUBLE
  OR engineering_applicability >= 0.65::DOUBLE AND product_industry_impact >= 0.55::DOUBLE AND evidence_maturity >= 0.6::DOUBLE) AS trusted, {_FRESH} AND (type IN ('official', 'research_institute') OR type = 'academic' AND prim AND content_score >= 0.35::DOUBLE AND target_relevance >= 0.3::DOUBLE * 2
  AND greatest(technical_advancement, engineering_applicability) >= 0.65::DOUBLE) AND t_english > 0 AND content_score >= 0.22::DOUBLE AND target_relevance >= 0.6::DOUBLE AND size >= 50 AS topical FROM z""")
def translation_candidates(spark, sf):
    anchor = F.expr(ANCHOR)
    return scored(spark, sf).select("id", scoring.trusted_fresh_candidate(anchor).alias("trusted"), scoring.priority_topic_candidate(anchor, F.col("abstract"), ("english",)).alias("topical"))
