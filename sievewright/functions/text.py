"""Text expressions: pure Columns, no Python code on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: all characters that count as white space.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"
#: Words that say little about a title.
STOP_TERMS = (
    "about after and are can for from has have how into news new our that the their this use using was were what when where which "
    "who why with your 发布 推出 更新 模型 人工智能"
).split()
CJK = r"[㐀-鿿]"


def normalize_text(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def haystack(title: Column, abstract: Column) -> Column:
    """The lower-case text that patterns are looked for in."""
    return F.lower(F.concat(title, F.lit("\n"), F.coalesce(abstract, F.lit(""))))


def comparison_text(title: Column, abstract: Column) -> Column:
    """Letters, digits and underscores of the title and 500 characters of abstract."""
    return F.regexp_replace(F.lower(F.concat(title, F.lit(" "), F.substring(F.coalesce(abstract, F.lit("")), 1, 500))), r"[^\p{L}\p{N}_]+", "")


def lexical_tokens(text: Column) -> Column:
    """Latin tokens in order, then the bigrams of each CJK run (a single character stays)."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9._+\-]*)"))
    runs = F.regexp_extract_all(low, F.lit(f"({CJK}+)"))
    pairs = F.transform(runs, lambda run: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda i: F.substring(run, i, F.lit(2))))
    return F.concat(latin, F.flatten(pairs))


def title_terms(title: Column) -> Column:
    """Distinct terms of a title without stop terms, sorted."""
    low = F.replace(F.lower(title), F.lit("-"), F.lit(" "))
    found = F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9]{2,}|[一-鿿]{2,6})"))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(t) for t in STOP_TERMS])))


def trigrams(text: Column) -> Column:
    """The set of character trigrams; a short text is one gram."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substring(text, i, F.lit(3))))


def quoted(pattern: str) -> str:
    """A literal inside a Java regular expression."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in pattern)


def alternation(patterns) -> str:
    """Any of the literals; their first characters are tested before them."""
    heads = "".join(quoted(c) for c in dict.fromkeys(p[0] for p in patterns))
    return f"(?=[{heads}])(?:{'|'.join(map(quoted, patterns))})"


def contains_any(text: Column, patterns) -> Column:
    """Is any of the patterns a substring of the (lower-case) text; plain searches, no regex."""
    return or_all([F.contains(text, F.lit(p)) for p in patterns])


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once, whatever is built on them.

    A one-row generator keeps the optimizer from copying the expressions into
    filters and other expressions above.
    """
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


#: Words that negate what follows in the same sentence; a term in Chinese may follow one without a space.
#: U+10000 is no sentence's end anyway: Java counts a look-behind in characters, not in UTF-16 units, only if its pattern has such a character.
_SAME_SENTENCE = "[[^.!?。！？]\U00010000]{0,120}"
NEGATORS = rf"(?:\b(?:no|not|without|lacks?)(?:\b{_SAME_SENTENCE})?|(?:未|没有|缺少){_SAME_SENTENCE})"


def contains_affirmed(text: Column, patterns) -> Column:
    """Is any pattern in the lower-case text as a whole term, with no negator before it in its sentence.

    Plain searches find the texts that have a pattern at all.  For those, one
    regular expression a table: a look-ahead finds candidates, then a bounded
    look-behind rejects negated ones.
    """
    groups: dict[tuple[bool, bool], list[str]] = {}
    for p in patterns:
        groups.setdefault((p[0].isascii() and p[0].isalnum(), p[-1].isascii() and p[-1].isalnum()), []).append(p)
    terms = [f"{'(?<![a-z0-9])' if left else ''}{alternation(own)}{'(?![a-z0-9])' if right else ''}" for (left, right), own in groups.items()]
    return contains_any(text, patterns) & text.rlike(f"(?={'|'.join(terms)})(?<!{NEGATORS})")


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def or_all(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def not_blank(text: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def token_estimate(text: Column) -> Column:
    """A third of the characters, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 3)).cast("long")


def sentences(answer: Column) -> Column:
    """Sentences of an answer; a citation stays with the sentence before it."""
    parts = F.split(answer, r"(?<=[。！？!?；;])(?!\s*\[\d+\])\s*|\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t\-*•]+|[ \t\-*•]+$", "")), lambda s: s != "")


def strip_fence(text: Column) -> Column:
    """JSON without the code fence that a model may put around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""))
