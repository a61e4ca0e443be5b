"""Metrics, gates, claims and reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio, rounded
from ..functions.text import sentences


def binary_metrics(rows: DataFrame, truth: Column, found: Column, *groups: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy."""
    n = lambda c: F.count_if(c)
    agg = rows.groupBy(*groups).agg(n(truth & found).alias("tp"), n(~truth & found).alias("fp"), n(truth & ~found).alias("fn"), n(~truth & ~found).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.withColumns({"precision": rounded(p), "recall": rounded(r), "f1": rounded(ratio(F.lit(2.0) * p * r, p + r)), "accuracy": rounded(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))})


def failing_ids(rows: DataFrame, ok: Column, item: str, order: str) -> DataFrame:
    """One row: the ids of failing cases in order, and the share of exact matches."""
    failed = F.transform(F.array_sort(F.collect_list(F.when(~ok, F.struct(F.col(order).alias("o"), F.col(item).alias("i"))))), lambda x: x["i"])
    return rows.agg(failed.alias("failing"), rounded(F.avg(ok.cast("double"))).alias("exact_match"))


def retrieval_metrics(gold: DataFrame, ranked: DataFrame, *groups: str) -> DataFrame:
    """Means of recall@5, recall@10, hit@5, reciprocal rank and NDCG@10 over questions.

    gold(query_id, expected_id, *groups) has a row for each expected item;
    ranked(query_id, item_id, rank).  Items repeated in a ranking count at
    their first place.  Questions without expected items aren't counted.
    """
    first = ranked.groupBy("query_id", F.col("item_id").alias("expected_id")).agg(F.min("rank").alias("rank"))
    distinct = gold.select("query_id", "expected_id", *groups).distinct()
    each = distinct.join(first, ["query_id", "expected_id"], "left").groupBy("query_id", *groups).agg(F.count("*").alias("n"), *_hits())
    return _means(each, *groups)


def labelled_metrics(queries: DataFrame, items: DataFrame, ranked: DataFrame, *groups: str) -> DataFrame:
    """:func:`retrieval_metrics` where all items of a query's kind are expected.

    queries(query_id, kind), items(item_id, kind).  Expected items are counted
    a kind and looked up for ranked ones only, so no row is made for each pair
    of a query and an expected item.
    """
    asked, known = queries.select("query_id", "kind").distinct(), items.select("item_id", "kind").distinct()
    sizes = known.groupBy("kind").agg(F.count("*").alias("n"))
    first = ranked.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    hits = first.join(known, "item_id").join(asked, ["query_id", "kind"]).groupBy("query_id", "kind").agg(*_hits())
    each = asked.join(sizes, "kind").join(hits, ["query_id", "kind"], "left")
    return _means(each.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("h5", "h10", "dcg")}), *groups)


def _hits():
    place = F.col("rank")
    gain = F.sum(F.when(place <= 10, F.lit(1.0) / F.log2(place + F.lit(1.0))))
    return F.count_if(place <= 5).alias("h5"), F.count_if(place <= 10).alias("h10"), F.min("rank").alias("best"), F.coalesce(gain, F.lit(0.0)).alias("dcg")


def _means(each: DataFrame, *groups: str) -> DataFrame:
    """each(query_id, *groups, n, h5, h10, best, dcg) -> the means over questions."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    return each.groupBy(*groups).agg(
        F.count("*").alias("questions"), rounded(F.avg(F.col("h5") / F.col("n"))).alias("recall_at_5"), rounded(F.avg(F.col("h10") / F.col("n"))).alias("recall_at_10"),
        rounded(F.avg((F.col("h5") > 0).cast("double"))).alias("hit_at_5"), rounded(F.avg(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)))).alias("mrr"), rounded(F.avg(F.col("dcg") / ideal)).alias("ndcg_at_10"),
    )


def latency_percentiles(rows: DataFrame, millis: Column, *groups: str) -> DataFrame:
    """Nearest-rank p50 and p95 in whole milliseconds, 1 at least."""
    whole = lambda x: F.greatest(F.lit(1), F.floor(x + 0.5)).cast("long")
    marked = rows.withColumn("_ms", millis)
    at = lambda q: whole(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY _ms)"))
    return marked.groupBy(*groups).agg(F.count("_ms").alias("n"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def corpus_health(expected: DataFrame, articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: missing expected ids, share of articles with chunks, healthy or not."""
    missing = expected.select("article_id").distinct().join(articles.select(F.col("id").alias("article_id")), "article_id", "left_anti").agg(F.sort_array(F.collect_list("article_id")).alias("missing"))
    covered = articles.select(F.col("id").alias("article_id")).distinct().join(chunks.select("article_id").distinct().withColumn("has", F.lit(1)), "article_id", "left")
    share = covered.agg(rounded(F.coalesce(F.avg(F.coalesce("has", F.lit(0)).cast("double")), F.lit(0.0))).alias("coverage"))
    return missing.crossJoin(share).withColumn("healthy", (F.size("missing") == 0) & (F.col("coverage") >= 0.95))


#: What a release of retrieval needs.
RELEASE = {"recall_at_5": 0.75, "hit_at_5": 0.85, "no_answer_accuracy": 0.8, "answerable_pass_rate": 0.9, "citation_coverage": 0.95, "citation_validity": 1.0, "faithfulness": 0.9, "correctness": 0.9, "completeness": 0.9}


def release_gate(report: DataFrame) -> DataFrame:
    """Adds ``gate``: observe for demo sets, else pass or fail by RELEASE.

    report: a column for each of RELEASE, and p95_ms, healthy, reviewed,
    review_complete, dataset_kind.  A null metric fails.
    """
    ok = (F.col("p95_ms") <= 4000) & F.col("healthy") & F.col("reviewed") & F.col("review_complete")
    for k, v in RELEASE.items():
        ok = ok & (F.col(k) >= v)
    return report.withColumn("gate", F.when(F.col("dataset_kind") == "demo", "observe").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail"))


def claims(answers: DataFrame, answer: str = "answer", count: str = "citation_count") -> DataFrame:
    """A row for each sentence: its citations, and whether they are there and valid."""
    keep = [c for c in answers.columns if c != answer]
    rows = answers.select(*keep, F.posexplode(sentences(F.col(answer))).alias("claim", "text"))
    cited = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]")), lambda x: x.cast("int"))
    valid = F.filter("cited", lambda x: (x >= 1) & (x <= F.col(count)))
    return rows.withColumn("cited", cited).withColumn("valid", valid).withColumns({
        "requires_citation": (F.size("cited") > 0) | ~F.rtrim("text").rlike("[:：]$"), "citation_present": F.size("cited") > 0,
        "citation_valid": (F.size("cited") > 0) & (F.size("cited") == F.size("valid")),
    })


#: The least shares that a reviewed set of answers passes with.
REVIEW = {"citation_coverage": 0.95, "citation_validity": 1.0, "citation_faithfulness": 0.9, "answer_correctness": 0.9, "answer_completeness": 0.9}


def review_summary(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """One row over answer cases and their claims: counts, shares and the gate.

    cases(case_id, answerable, generated, pending, answer_correct,
    answer_complete); the last two are a reviewer's, null while open.
    claims(case_id, requires_citation, citation_present, citation_valid, cited,
    valid, supported), ``supported`` being a reviewer's.  Claims count if they
    need a citation and their case is answerable and has an answer; a claim is
    cited if its citation is there and valid.  A share is null without a basis
    or before all of it is reviewed.  The gate is pending until every
    answerable case has an answer and a whole review, then pass or fail.
    """
    case = cases.where("answerable").agg(
        F.count("*").alias("answerable_cases"), F.count_if("generated").alias("generated_cases"), F.count_if("pending").alias("pending_cases"),
        F.count_if(F.col("generated") & F.col("answer_correct").isNotNull() & F.col("answer_complete").isNotNull()).alias("_seen"),
        F.count_if(F.col("generated") & F.col("answer_correct")).alias("_correct"), F.count_if(F.col("generated") & F.col("answer_complete")).alias("_complete"),
    )
    counted = claims.where("requires_citation").join(cases.where("answerable and generated").select("case_id"), "case_id", "left_semi")
    claim = counted.agg(
        F.count("*").alias("claims"), F.count_if(F.col("citation_present") & F.col("citation_valid")).alias("cited_claims"), F.coalesce(F.sum(F.size("cited")), F.lit(0)).alias("citations"),
        F.coalesce(F.sum(F.size("valid")), F.lit(0)).alias("valid_citations"), F.count("supported").alias("_marked"), F.count_if("supported").alias("_supported"),
    )
    both = case.crossJoin(claim)  # one row by one row

    def share(part: str, whole: str, ready: Column = F.lit(True)) -> Column:
        return F.when((F.col(whole) > 0) & ready, rounded(F.col(part) / F.col(whole)))

    seen, marked = F.col("_seen") == F.col("generated_cases"), F.col("_marked") == F.col("claims")
    both = both.withColumns({
        "citation_coverage": share("cited_claims", "claims"), "citation_validity": share("valid_citations", "citations"), "citation_faithfulness": share("_supported", "claims", marked),
        "answer_correctness": share("_correct", "generated_cases", seen), "answer_completeness": share("_complete", "generated_cases", seen),
        "review_complete": (F.col("generated_cases") > 0) & seen & marked,
    })
    whole = F.col("review_complete") & (F.col("pending_cases") == 0) & (F.col("generated_cases") == F.col("answerable_cases"))
    passed = F.coalesce(_all(F.col(c) >= least for c, least in REVIEW.items()), F.lit(False))
    return both.withColumn("gate", F.when(~whole, "pending").when(passed, "pass").otherwise("fail")).drop("_seen", "_correct", "_complete", "_marked", "_supported")


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def terminology(articles: DataFrame, terms: DataFrame, original: str, translated: str) -> DataFrame:
    """One row: of (article, term) pairs whose original has the term, the share that uses an allowed form.

    terms(source, preferred, aliases) is the dictionary, a few rows.
    """
    pairs = articles.select(F.lower(F.col(original)).alias("o"), F.lower(F.col(translated)).alias("t")).join(terms, F.contains("o", F.lower("source")))
    forms = F.concat(F.array("source", "preferred"), F.col("aliases"))
    good = F.exists(forms, lambda f: F.contains(F.col("t"), F.lower(f)))
    return pairs.agg(F.count("*").alias("checked"), F.count_if(good).alias("matched")).withColumn("score", F.when(F.col("checked") == 0, F.lit(1.0)).otherwise(rounded(F.col("matched") / F.col("checked"))))


def terminology_hint(text: Column, terms) -> Column:
    """``source=preferred`` of the terms that the text has, in dictionary order."""
    low = F.lower(text)
    return F.array_join(F.filter(F.array(*[F.when(F.contains(low, F.lit(s.lower())), F.lit(f"{s}={p}")) for s, p, _ in terms]), lambda x: x.isNotNull()), "; ")
