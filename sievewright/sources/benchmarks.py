"""Public question sets to corpus, questions and gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hex_id
from ..operators.dedup import first_by


def adapt_corpus(corpus: DataFrame) -> DataFrame:
    """corpus(url, title, body, source, category, published_at, ord): the first row of each URL, with an id."""
    named = F.concat_ws(" | ", *[F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("")) for c in ("title", "source", "category", "published_at")])
    return first_by(corpus, "url").select(hex_id("doc", F.col("url")).alias("article_id"), "url", "title", F.concat(named, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"), "ord")


def adapt_questions(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """questions(query, question_type, evidence_list, ord) with expected ids in order.

    Evidence URLs of no document drop out, repeated ones count once.
    """
    urls = questions.select("ord", F.posexplode("evidence_list").alias("place", "e")).select("ord", "place", F.col("e.url").alias("url"))
    known = urls.join(corpus.select("url", "article_id"), "url")
    first = known.groupBy("ord", "article_id").agg(F.min("place").alias("place"))
    ids = first.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "article_id"))), lambda x: x["article_id"]).alias("expected"))
    out = questions.join(ids, "ord", "left")
    return out.select(F.format_string("question-%05d", F.col("ord").cast("long")).alias("query_id"), F.col("query").alias("text"), "question_type", F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))


def gold(questions: DataFrame) -> DataFrame:
    """(query_id, question_type, expected_id) of questions that have evidence."""
    return questions.select("query_id", "question_type", F.explode("expected").alias("expected_id"))


def reference_means(rows: DataFrame, item: str, n: int, label: str, *scores: str) -> DataFrame:
    """One row over a hash-ordered sample: positive rate, label coverage and means."""
    sample = rows.orderBy(F.sha2(F.col(item).cast("string"), 256)).limit(n)
    return sample.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate"), F.avg(F.col(label).isNotNull().cast("double")).alias("coverage"), *[F.avg(s).alias(f"mean_{s}") for s in scores])
