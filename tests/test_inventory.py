import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions import tables
from sievewright.operators import selection
from sievewright.plans import catalog

TOTAL, FOCUS = 10, ("data-agent", "data-platform")
COLUMNS = "source_id string, content_hash string, canonical_url string, content_score double, ord long, incoming boolean, _ready boolean, _at long, _relevance double, _age double, _topics array<string>"


@pytest.mark.parametrize("seed", range(3))
def test_contenders_are_enough(spark, seed):
    """The choice among contenders is the choice among all rows, with groups of copies that lead the orders."""
    draw = random.Random(seed)
    rows = []
    for i in range(1500):
        copy = draw.random() < 0.5
        rows.append((
            f"s{draw.randrange(3)}", f"copy{draw.randrange(3)}" if copy else f"h{draw.randrange(900)}", f"u{i}", draw.randrange(50, 60) / 60 if copy else draw.randrange(50) / 60, i, draw.random() < 0.4,
            draw.random() < 0.1, draw.randrange(100), draw.randrange(10) / 10, draw.randrange(20) / 1.0, draw.sample([*FOCUS, "other"], draw.randrange(3)),
        ))
    frame = spark.createDataFrame(rows, COLUMNS)

    frame = frame.repartition(4)
    cut = selection.contenders(frame, TOTAL, FOCUS, 3)
    few = [tuple(r) for r in cut.select(frame.columns).collect()]
    assert chosen(few) == scan(rows) == chosen(rows) and len(few) < len(rows)


def chosen(some):
    some = [{"source_id": r[0], "content_hash": r[1], "canonical_url": r[2], "score": r[3], "ord": r[4], "incoming": r[5], "ready": r[6], "at": r[7], "relevance": r[8], "age_days": r[9], "topics": set(r[10])} for r in some]
    return [some[i]["canonical_url"] for i in selection.merge_choice(some, TOTAL, 5, 3, 6, FOCUS)]


def scan(rows, source_cap=5, academic_cap=3, ready_wanted=6):
    """URLs by definition: each step looks at all rows that may still be taken and takes the best one."""
    taken = []

    def free(r):
        cap = academic_cap if r[0] == tables.ACADEMIC_SOURCE else source_cap
        return len(taken) < TOTAL and r not in taken and r[1] not in [t[1] for t in taken] and sum(t[0] == r[0] for t in taken) < cap

    for topic in sorted(FOCUS):
        week = [r for r in rows if r[5] and r[9] <= 7 and r[8] >= 0.5 and topic in r[10]]
        if week:
            best = max(week, key=lambda r: (r[8], r[7], r[3], -r[4]))
            taken += [best] * free(best)
    while sum(t[6] for t in taken) < ready_wanted and (open_ := [r for r in rows if r[6] and free(r)]):
        taken.append(max(open_, key=lambda r: (r[7], r[3], -r[4])))
    while open_ := [r for r in rows if free(r)]:
        taken.append(max(open_, key=lambda r: (r[3], r[7], -r[4])))
    return [r[2] for r in sorted(taken, key=lambda r: (-r[6], -r[7], -r[3], r[4]))]


@pytest.mark.parametrize("copies", [0.0, 0.95])
def test_contenders_of_many_sources_are_few(spark, copies):
    """Thousands of sources with a row or two each, most of them copies of few contents."""
    draw = random.Random(9)
    rows = [(f"s{draw.randrange(2500)}", f"copy{draw.randrange(4)}" if draw.random() < copies else f"h{i}", f"u{i}", draw.randrange(50) / 50, i, True, draw.random() < 0.5, draw.randrange(100), draw.randrange(10) / 10, 3.0, [draw.choice(FOCUS)]) for i in range(5000)]
    frame = spark.createDataFrame(rows, COLUMNS)
    few = [tuple(r) for r in selection.contenders(frame, TOTAL, FOCUS, 3).select(frame.columns).collect()]
    assert len(few) <= (len(FOCUS) + 2) * TOTAL * (2 * (TOTAL // 3) + 2)
    assert chosen(few) == scan(rows)


def test_rows_below_a_large_copy_group(spark):
    """400 newer copies under other URLs; one of them and the five rows below are taken, a URL's last row counts."""
    rows = [(i, f"c{i}", "s1", "en", "Copied data agent platform title", "The same abstract of every copy. " * 6, 0, f"https://s1.example.org/c{i}") for i in range(400)]
    rows += [(400 + i, f"d{i}", "s1", "en", f"Another row {i}", f"Own abstract {i}", 20, f"https://s1.example.org/d{i}") for i in range(5)]
    rows += [(500, "again", "s1", "en", "Another row again", "Own abstract again", 20, "https://s1.example.org/d0")]
    frame = spark.createDataFrame(rows, "ord long, id string, source_id string, language string, title string, abstract string, days int, canonical_url string")
    frame = frame.withColumn("published_at", F.expr(catalog.ANCHOR) - F.make_dt_interval(days="days")).drop("days")
    frame = catalog.with_ready(frame, 10**6)
    got = [r.id for r in selection.merge_inventory(frame.limit(0), frame, F.expr(catalog.ANCHOR)).collect()]
    assert len(got) == 6 and {"d1", "d2", "d3", "d4", "again"} < set(got)


def unscored(rows):
    """Does the plan read scores instead of making them?"""
    return "Contains(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_made_once(spark):
    small = "/root/testdata/sf0.001"
    scored = catalog.scored_articles(spark, small)
    assert not unscored(scored) and unscored(selection.priority_rows(scored))
    rows = catalog.with_ready(catalog.articles(spark, small), 3)
    assert unscored(selection.merge_inventory(rows.where("ord % 2 = 1"), rows.where("ord % 2 = 0"), F.expr(catalog.ANCHOR)))


def test_items_are_normalised_once(spark):
    from sievewright.operators import items

    raw = spark.createDataFrame(
        [("s", "HTTP://e.org/a/?utm_source=x", " T  t ", "a  b", "", ["A  B"], None, "en", "official", "primary")],
        "source_id string, url string, title string, summary string, content_html string, authors array<string>, published_at timestamp, language string, source_type string, evidence_tier string",
    )
    rows, evidence = items.normalize_items(raw, F.expr(catalog.ANCHOR))
    assert "regexp_replace" not in evidence._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.title, r.abstract) for r in rows.collect()] == [("T t", "a b")] and evidence.first().excerpt == "a b"
