"""Evaluation runs from questions to a gate, and review packets with labels that come back.

A run plans, retrieves and assesses all questions in one plan; its cases (a
row a question) carry everything that metrics, packets and summaries need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import rounded
from ..sources.store import written
from . import evaluation, retrieval

#: Characters of an excerpt, and candidates a case, that a reviewer sees.
EXCERPT, SHOWN = 320, 5
#: What a reviewer fills in.
LABELS = ("answer_correct", "answer_complete", "notes")


def run_cases(questions: DataFrame, expected: DataFrame, corpus: DataFrame, year: int, mode: str = "bm25", least: float = 0.08, k: int = 10, embed=None) -> DataFrame:
    """One row a question: plan, rounds, ranked items, verdict, and the first plain score.

    questions(query_id, text, category, answerable); expected(query_id,
    article_id); corpus(chunk_id, article_id, text).  Columns: those of
    questions, route, rounds (0 if the question isn't looked up), sufficient,
    reason, stop_reason, top_score (best score of the question as it is, null
    without candidates), articles (in order, each once), expected_ids, and
    candidates (rank, chunk_id, article_id, score).
    """
    plans = written(retrieval.plan_questions(questions, year), "plans")
    ranked, verdicts = retrieval.answer_planned(plans, corpus, least, k, mode, embed)
    plain = retrieval.search(mode, questions.select("query_id", "text"), corpus, 1, embed).groupBy("query_id").agg(F.max("score").alias("top_score"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "article_id", "score")))  # k of a question at most
    found = ranked.groupBy("query_id").agg(listed.alias("candidates"))
    wanted = expected.groupBy("query_id").agg(F.array_sort(F.collect_set("article_id")).alias("expected_ids"))
    rows = plans.join(verdicts, "query_id", "left").join(plain, "query_id", "left").join(found, "query_id", "left").join(wanted, "query_id", "left")
    nothing = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("rank"), *(F.lit(None).cast(dict(ranked.dtypes)[c]).alias(c) for c in ("chunk_id", "article_id", "score")))), lambda x: F.lit(False))
    candidates = F.coalesce("candidates", nothing)
    return rows.select(
        *questions.columns, "route", F.when(F.col("preflight_reason").isNull(), F.size("subqueries")).otherwise(0).alias("rounds"), "sufficient", "reason", "stop_reason", "top_score",
        F.array_distinct(F.transform(candidates, lambda c: c["article_id"])).alias("articles"), F.coalesce("expected_ids", F.array().cast(f"array<{dict(expected.dtypes)['article_id']}>")).alias("expected_ids"), candidates.alias("candidates"),
    )


def run_report(cases: DataFrame, least: float = 0.08) -> DataFrame:
    """One row: retrieval metrics over answerable questions, refusals over the others, mean rounds.

    An answerable question without expected items counts 0.  Means over no
    question are null.
    """
    n = F.size("expected_ids")
    hit = F.transform("articles", lambda a: F.array_contains("expected_ids", a).cast("int"))
    place = F.array_position(hit, 1)
    gain = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda s, i: s + F.when(F.get(hit, i - 1) == 1, F.lit(1.0) / F.log2(i + F.lit(1.0))).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda s, i: s + F.when(i <= n, F.lit(1.0) / F.log2(i + F.lit(1.0))).otherwise(0.0))
    among = lambda k: F.aggregate(F.slice(hit, 1, k), F.lit(0), lambda s, x: s + x)
    of = lambda value: F.when(F.col("answerable"), F.when(n > 0, value).otherwise(0.0))
    refused = lambda ok: F.when(~F.col("answerable"), ok.cast("double"))
    mean = lambda c, digits=4: rounded(F.avg(c), digits)
    low = F.coalesce(F.col("top_score") < least, F.lit(True))
    return cases.agg(
        F.count("*").alias("questions"), mean(of(among(5) / n)).alias("recall_at_5"), mean(of(among(10) / n)).alias("recall_at_10"), mean(of((among(5) > 0).cast("double"))).alias("hit_at_5"),
        mean(of(F.when(place > 0, F.lit(1.0) / place).otherwise(0.0))).alias("mrr"), mean(of(gain / ideal)).alias("ndcg_at_10"),
        mean(refused(~F.col("sufficient"))).alias("no_answer_accuracy"), mean(refused(low)).alias("low_score_refusal_accuracy"), mean(F.when(F.col("answerable"), F.col("sufficient").cast("double"))).alias("answerable_pass_rate"),
        mean(F.col("rounds"), 2).alias("average_rounds"),
    )


def run_gate(report: DataFrame, health: DataFrame, answers: DataFrame, kind: str, reviewed: bool, p95_ms: Column) -> DataFrame:
    """``report`` with health, answer quality (of ``evaluation.review_summary``) and the release gate."""
    quality = answers.select("citation_coverage", "citation_validity", F.col("citation_faithfulness").alias("faithfulness"), F.col("answer_correctness").alias("correctness"), F.col("answer_completeness").alias("completeness"), "review_complete")
    one = report.crossJoin(health.select("healthy")).crossJoin(quality)  # a row each
    return evaluation.release_gate(one.withColumns({"p95_ms": p95_ms, "reviewed": F.lit(reviewed), "dataset_kind": F.lit(kind)}))


def review_packet(cases: DataFrame, chunks: DataFrame, titles: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One nested row a case for human review, with blank labels and a digest of all that isn't a label.

    chunks(chunk_id, text) and titles(article_id, title) of the candidates;
    answers(query_id, answer).  The first SHOWN candidates are the evidence
    that citations count from 1.  status: refused (not answerable, or
    evidence insufficient), generated, or pending.
    """
    each = cases.select("query_id", F.explode(F.slice("candidates", 1, SHOWN)).alias("c")).select("query_id", "c.*")
    each = each.join(chunks.select("chunk_id", F.substring("text", 1, EXCERPT).alias("excerpt")), "chunk_id", "left").join(titles.select("article_id", "title"), "article_id", "left")
    shown = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "article_id", F.coalesce("title", F.lit("")).alias("title"), "score", "excerpt"))).alias("evidence"))
    rows = cases.drop("candidates", "articles").join(shown, "query_id", "left")
    rows = rows.join(answers.select("query_id", "answer"), "query_id", "left") if answers is not None else rows.withColumn("answer", F.lit(None).cast("string"))
    refused = ~F.col("answerable") | ~F.col("sufficient")
    rows = rows.withColumns({"answer": F.when(~refused, F.col("answer")), "status": F.when(refused, "refused").when(F.col("answer").isNotNull(), "generated").otherwise("pending")})
    said = evaluation.claims(rows.where("answer IS NOT NULL").select("query_id", "answer", F.coalesce(F.size("evidence"), F.lit(0)).alias("citation_count")))
    said = said.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("claim", "text", "requires_citation", "cited", "valid", "citation_present", "citation_valid"))).alias("claims"))
    rows = rows.join(said, "query_id", "left")
    rows = rows.withColumn("digest", packet_digest(rows))
    blank = F.transform("claims", lambda c: F.lit(None).cast("boolean"))
    return rows.withColumns({"supported": blank, "answer_correct": F.lit(None).cast("boolean"), "answer_complete": F.lit(None).cast("boolean"), "notes": F.lit(None).cast("string")})


def packet_digest(rows: DataFrame) -> Column:
    """SHA-256 of a case's JSON without labels and digest, fields by name."""
    facts = sorted(c for c in rows.columns if c not in (*LABELS, "supported", "digest"))
    return F.sha2(F.to_json(F.struct(*facts)), 256)


def write_packet(packet: DataFrame, path: str) -> None:
    """One JSON object a case; null fields stay, so that a reviewer sees them."""
    packet.select(F.to_json(F.struct(*packet.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_packet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def merge_reviews(packet: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``packet`` with the labels of ``reviewed``, joined by case and by claim.

    Refused (an error when rows are read): a reviewed case that the packet
    hasn't, or has twice; one whose facts no longer give its digest, or
    another digest than the packet's; labels for another number of claims.
    Labels that are still blank stay what they were.
    """
    given = reviewed.withColumn("_fresh", packet_digest(reviewed)).groupBy("query_id").agg(
        F.count("*").alias("_times"), F.first(F.struct("_fresh", "digest", "supported", *LABELS)).alias("_r")
    )
    both = packet.join(given, "query_id", "full")
    r = F.col("_r")
    wrong = (
        F.when(F.col("digest").isNull(), "unknown case").when(F.col("_times") > 1, "repeated case")
        .when((r["_fresh"] != F.col("digest")) | ~r["digest"].eqNullSafe(F.col("digest")), "changed case")
        .when(r["supported"].isNotNull() & (F.size(r["supported"]) != F.coalesce(F.size("claims"), F.lit(0))), "other claims")
    )
    checked = both.withColumn("_ok", F.when(wrong.isNotNull() & r.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.col("query_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))).where("_ok")
    label = {c: F.coalesce(r[c], F.col(c)) for c in LABELS}
    label["supported"] = F.when(r["supported"].isNull(), F.col("supported")).otherwise(F.zip_with(r["supported"], "supported", lambda a, b: F.coalesce(a, b)))
    return checked.withColumns(label).select(*packet.columns)


def packet_summary(packet: DataFrame) -> DataFrame:
    """``evaluation.review_summary`` of a packet."""
    cases = packet.select(F.col("query_id").alias("case_id"), "answerable", (F.col("status") == "generated").alias("generated"), (F.col("status") == "pending").alias("pending"), "answer_correct", "answer_complete")
    claims = packet.where("claims IS NOT NULL").select(F.col("query_id").alias("case_id"), F.explode(F.arrays_zip("claims", "supported")).alias("z"))
    return evaluation.review_summary(cases, claims.select("case_id", "z.claims.*", F.col("z.supported").alias("supported")))
