"""Bounded values, input checks and model answers as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import not_blank, strip_fence

#: Bounds of inputs.
QUESTION_CHARS = (2, 500)
RANGES = ("7d", "30d", "all")
INTERESTS = 8


def bounded_string(value: Column, most: int) -> Column:
    """Trimmed and cut to ``most`` characters; blank is null."""
    return F.substring(not_blank(value), 1, most)


def string_list(values: Column, most: int, chars: int) -> Column:
    """The first ``most`` distinct non-blank strings, each cut to ``chars``."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: bounded_string(v, chars))
    return F.slice(F.array_distinct(F.filter(clean, lambda v: v.isNotNull())), 1, most)


def nonnegative(value: Column) -> Column:
    """A whole number of 0 or more, from text or number; anything else is 0."""
    n = value.cast("string").try_cast("long")
    return F.when(n >= 0, n).otherwise(F.lit(0))


def setting(value: Column, default: float, low: float, high: float) -> Column:
    """A numeric setting: the default where it is absent or no number, else clamped."""
    n = F.trim(value).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(float(default))).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), n)))


def first_problem(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that is true; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in checks])


def check_questions(rows: DataFrame) -> DataFrame:
    """Adds ``problem`` to requests (question, range, article_id, language); null is valid."""
    size = F.length(F.trim("question"))
    return rows.withColumn("problem", first_problem(
        (F.col("question").isNull(), "question_missing"), ((size < QUESTION_CHARS[0]) | (size > QUESTION_CHARS[1]), "question_length"),
        (~F.coalesce("range", F.lit("all")).isin(*RANGES), "range"), (F.col("article_id").isNotNull() & ~F.col("article_id").rlike(r"^[A-Za-z0-9._:\-]{1,128}$"), "article_id"),
        (~F.coalesce("language", F.lit("zh-CN")).rlike(r"^[a-z]{2}(?:-[A-Z]{2})?$"), "language"),
    ))


def check_profiles(rows: DataFrame, topics: list[str]) -> DataFrame:
    """Adds ``problem`` to profiles (interests map<string,int>): known topics, weights 1 to 5, eight at most."""
    keys, values = F.map_keys("interests"), F.map_values("interests")
    known = F.array(*[F.lit(t) for t in topics])
    return rows.withColumn("problem", first_problem(
        (F.col("interests").isNull(), "interests_missing"), (F.size(keys) > INTERESTS, "too_many"), (F.size(F.array_except(keys, known)) > 0, "unknown_topic"), (F.exists(values, lambda v: (v < 1) | (v > 5)), "weight"),
    ))


PROFILE = "summary string, interests array<struct<topic:string,weight:int>>, tone string"


def profile_completion(answer: Column, topics: list[str]) -> Column:
    """A model's JSON answer as a struct: bounded texts, known distinct topics; junk is null."""
    parsed = F.from_json(strip_fence(answer), PROFILE)
    known = F.filter(parsed["interests"], lambda i: i["topic"].isin(*topics) & i["weight"].between(1, 5))
    names = F.slice(F.array_distinct(F.transform(known, lambda i: i["topic"])), 1, INTERESTS)
    return F.when(bounded_string(parsed["summary"], 320).isNotNull(), F.struct(bounded_string(parsed["summary"], 320).alias("summary"), bounded_string(parsed["tone"], 40).alias("tone"), F.coalesce(names, F.array().cast("array<string>")).alias("topics")))


def untrusted_block(text: Column, most: int = 12_000) -> Column:
    """Evidence for a prompt: tags removed, cut, and wrapped in markers that it can't close."""
    return F.concat(F.lit("<evidence>\n"), F.substring(F.regexp_replace(text, "<[^>]*>", " "), 1, most), F.lit("\n</evidence>"))
