"""Operators against sequential or hand-made expectations."""

import random
import re
from collections import Counter
from datetime import date, datetime, timedelta, timezone
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievewright.functions import arrow, numbers, text, urls
from sievewright.operators import briefs, dedup, evaluation, ledger, reports, retrieval, scoring, selection
from sievewright.sources import benchmarks, feeds, html, store


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("given,want", [
    ("HTTPS://Example.ORG/a/b/?utm_source=x&b=2&a=1&a=#frag", "https://example.org/a/b?a=&a=1&b=2"), ("http://e.org", "http://e.org/"), ("http://e.org/?q=a%20b&REF=1", "http://e.org/?q=a+b"),
    ("ftp://e.org/x", None), ("https:///x", None), ("http://e.org/?k=%7E%2A", "http://e.org/?k=~%2A"),
])
def test_canonical_url(spark, given, want):
    assert one(spark, urls.canonicalize_url(F.col("u")), u=given) == want


@pytest.mark.parametrize("given,want", [("https://e.org/", True), ("http://e.org/", False), ("https://localhost/", False), ("https://10.0.0.1/", False), ("https://user@192.168.1.1:8/", False), ("https://8.8.8.8/", True), ("https://172.20.1.1", False)])
def test_public_url(spark, given, want):
    assert one(spark, urls.is_public_url(F.col("u")), u=given) is want


def test_text_functions(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="  a　 b\x1c\n\x85c ") == "a b c"
    assert one(spark, text.lexical_tokens(F.col("t")), t="GPT-4 v1.2 数据湖 好") == ["gpt-4", "v1.2", "数据", "据湖", "好"]
    assert one(spark, text.title_terms(F.col("t")), t="The new data-lake of 数据平台 ai") == ["data", "lake", "数据平台"]
    assert one(spark, text.sentences(F.col("t")), t="- One. [1] Two![2]\n\n* 三。四；") == ["One. [1] Two![2]", "三。", "四；"]


@pytest.mark.parametrize("given,want", [
    ("it outperforms", False), ("it did outperform others", True), ("does not outperform. we outperform", True), ("without any way to outperform", False), ("没有提升", False), ("明显提升", True), ("no gain; still outperform", False), ("no! outperform", True),
])
def test_affirmed_terms(spark, given, want):
    assert one(spark, text.contains_affirmed(F.col("t"), ("outperform", "提升")), t=given) is want


@pytest.mark.parametrize("given,want", [
    ("not " + "😀" * 70 + " outperform", False), ("not " + "😀" * 119 + " outperform", True), ("does not提升", False), ("lacks提升", False), ("cannot提升", True), ("no no " + "x" * 116 + " outperform", False), ("noñadoeses outperform", True),
])
def test_negators_reach_over_characters(spark, given, want):
    """120 characters, whatever their UTF-16 length; a term in Chinese needs no space; words go on with accented letters."""
    assert one(spark, text.contains_affirmed(F.col("t"), ("outperform", "提升")), t=given) is want


def test_embedder_and_matcher(spark):
    frame = spark.createDataFrame([("tide", "diet"), ("same", "same"), (None, "x")], "a string, b string")
    got = frame.select(arrow.matcher_ratio("a", "b").alias("r"), arrow.hashing_embedder(16)("a").alias("v")).collect()
    assert got[0].r == SequenceMatcher(None, "tide", "diet", autojunk=False).ratio() and got[1].r == 1.0
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-12 and got[2].v is None


@pytest.mark.parametrize("seed", range(4))
def test_exact_dedup_equals_a_sequential_scan(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("abcdef"), r.choice("uvwxyz")) for i in range(40)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            want.append(i)
            seen_a.add(a)
            seen_b.add(b)
    frame = spark.createDataFrame(rows, "ord long, canonical_url string, content_hash string")
    assert sorted(x.ord for x in dedup.exact_deduplicate(frame).collect()) == want


@pytest.mark.parametrize("threshold", [0.92, 0.75])
def test_fuzzy_dedup_equals_a_sequential_scan(spark, threshold):
    r, rows = random.Random(5), []
    for i in range(50):
        if rows and r.random() < 0.6:
            t = list(r.choice(rows)[1])
            for _ in range(r.randint(0, 3)):
                if t:
                    t[r.randrange(len(t))] = r.choice("abcxyz ")
            t = "".join(t)
        else:
            t = " ".join(r.choice(["data", "agent", "lake", "a", "x1", "semantic"]) for _ in range(r.choice([1, 2, 12, 40])))
        rows.append((i, t, ""))
    plain = lambda t: re.sub(r"[^\w]+", "", t.lower())
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))}
    want: list[int] = []
    for i, t, _ in rows:
        a = plain(t)
        for j in want:
            b = plain(rows[j][1])
            shares = min(len(a), len(b)) < 3 or len(grams(a) & grams(b)) / max(1, min(len(grams(a)), len(grams(b)))) >= 0.45
            if a == b or (shares and SequenceMatcher(None, a, b, autojunk=False).ratio() >= threshold):
                break
        else:
            want.append(i)
    frame = spark.createDataFrame(rows, "ord long, title string, abstract string")
    assert sorted(x.ord for x in dedup.fuzzy_deduplicate(frame, threshold).collect()) == want


def article(**more):
    base = {
        "id": "x", "source_id": "s", "source_type": "official", "evidence_tier": "primary", "language": "en", "title": "t", "abstract": "a", "title_zh": None, "summary_zh": None,
        "published_at": datetime(2026, 8, 1, tzinfo=timezone.utc), "collected_at": datetime(2026, 8, 1, tzinfo=timezone.utc), "ord": 0,
    }
    return base | more


def scored(spark, **more):
    frame = spark.createDataFrame([article(**more)], ", ".join(f"{k} {v}" for k, v in scoring.ARTICLE.items()))
    return scoring.score_articles(frame, F.expr("TIMESTAMP '2026-08-01 12:00:00'")).first()


def test_launch_is_an_eligible_key_signal(spark):
    pad = "The release brings a data platform and semantic layer to enterprise developers with an API, deployment workflow and pricing. " * 3
    row = scored(spark, title="Data platform agent is generally available to all customers", abstract=pad + "It reduces latency by 40% in a benchmark.", title_zh="数据平台正式发布", summary_zh="全面开放")
    assert "product_launch" in row.event.types and row.event.significance >= 0.8
    assert row.key_signal.eligible, row.key_signal.gate_failures


def test_negated_and_stale_events_are_not_eligible(spark):
    row = scored(spark, title="The model is not generally available", abstract="word " * 40, published_at=datetime(2026, 7, 1, tzinfo=timezone.utc))
    assert row.event.types == [] and not row.key_signal.eligible and row.breakdown.freshness == 0.0


def test_topic_scores(spark):
    row = scored(spark, title="Semantic layer and metrics layer", abstract="storage")
    assert row.topic_scores["semantic-layer"] == 1.2 and row.topic_scores["rag-eval"] == 0.55  # rag is a substring of storage


def test_quotas(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}", float(-i)) for i in range(20)], "ord long, source_id string, v double")
    got = [r.ord for r in selection.quota_select(rows, [F.desc("v"), F.asc("ord")], total=5, per_source=3, limits={"s1": 1}).collect()]
    assert got == [0, 1, 2, 4]


def test_diverse_order():
    order = selection.diverse_order(["a", "a", "a", "a", "b", "b", "c"])
    shown = ["aaaabbc"[i] for i in order]
    assert sorted(order) == list(range(7)) and not any(x == y == z for x, y, z in zip(shown, shown[1:], shown[2:]))


def test_upsert_and_overlay(spark):
    old, new = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert sorted(map(tuple, selection.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, briefs.apply_overlay(old, new, ("v",), "id").collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="unknown content"):
        briefs.apply_overlay(old, spark.createDataFrame([(9, "z")], "id long, v string"), ("v",), "id").collect()


def test_rollover(spark):
    days = spark.createDataFrame([("l", date(2026, 1, 1), 1, 8), ("l", date(2026, 1, 4), 1, 3), ("l", date(2026, 1, 4), 2, 9)], "ledger string, day date, run long, calls long")
    got = [(r.before, r.credit, r.limit, r.used, r.after) for r in ledger.rollover(days, 5, 10, 10, 5).orderBy("day", "run").collect()]
    assert got == [(5, 5, 10, 8, 2), (10, 5, 10, 3, 10), (10, 0, 10, 9, 1)]


def test_budget_and_leases(spark):
    rows = spark.createDataFrame([(i, "m", e, datetime(2026, 1, 1) + timedelta(seconds=10 * i)) for i, e in enumerate([50, 60, 40, 10])], "ord long, month string, estimated_micros long, at timestamp")
    assert [r.admitted for r in ledger.budget_admission(rows, 100).orderBy("ord").collect()] == [True, False, True, True]
    assert [r.granted for r in ledger.lease_admission(rows, "month", 1, 25).orderBy("ord").collect()] == [True, False, False, True]


def test_quota_admission(spark):
    at = datetime(2026, 1, 1)
    rows = spark.createDataFrame([(i, c, at + timedelta(minutes=i)) for i, c in enumerate("aaabbbccc")], "i long, c string, at timestamp")
    got = [r.admitted for r in ledger.quota_admission(rows, "c", "at", 2, 5, "i").orderBy("i").collect()]
    assert got == [True, True, False, True, True, False, True, False, False]


def test_retrieval_and_context(spark):
    corpus = spark.createDataFrame([("c1", "a1", "data lake house"), ("c2", "a1", "lake lake"), ("c3", "a2", "nothing here")], "chunk_id string, article_id string, text string")
    asked = spark.createDataFrame([("q", "lake lake")], "query_id string, text string")
    got = retrieval.Bm25(corpus).top(asked, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c2", "c1", "c3"] and got[2].score == 0.0
    ranked = spark.createDataFrame([("q", 1, "c1", "a1", 60), ("q", 2, "c2", "a2", 50), ("q", 3, "c3", "a1", 30), ("q", 4, "c4", "a1", 1)], "query_id string, rank long, chunk_id string, article_id string, size long")
    row = retrieval.pack_context(ranked, budget=100).first()
    assert row.chunk_ids == ["c1", "c3"] and row.used == 92


def test_bm25_top_makes_no_row_a_pair(spark, monkeypatch):
    """The best of all scores, ties by id, for blocks of queries with ids of any type; no table of all pairs is made."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["湖泊数据"]
    docs = [(f"c{i}", " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(1200)] + [("null", None), ("empty", "")]
    corpus = spark.createDataFrame(docs, "chunk_id string, text string")
    asked = spark.createDataFrame([((i, "x"), " ".join(rng.choices([*words, "nowhere"], k=i % 5))) for i in range(140)], "query_id struct<a: int, b: string>, text string")
    index = retrieval.Bm25(corpus)
    scored = index.scores(asked).select("query_id.a", "chunk_id", numbers.rounded(F.col("score"), 6).alias("score")).collect()
    want = {a: sorted(((-r.score, r.chunk_id) for r in scored if r.a == a))[:10] for a in range(140)}
    monkeypatch.setattr(retrieval.Bm25, "scores", lambda *_: pytest.fail("scores of all pairs"))
    got = index.top(asked).select("query_id.a", "chunk_id", "score", "rank").collect()
    assert len(got) == 1400
    for a, best in want.items():
        rows = sorted((r.rank, -r.score, r.chunk_id) for r in got if r.a == a and r.score > 0)
        assert [r[0] for r in rows] == list(range(1, len(best) + 1)) and [r[2] for r in rows] == [x for _, x in best]
        assert all(abs(x[1] - y[0]) < 1e-9 for x, y in zip(rows, best))


def test_texts_of_a_batch_become_objects_by_slices():
    """A batch of Arrow texts is read a few at a time, nulls stay, and an empty batch gives an empty one."""
    import pyarrow as pa

    alive, most = [], []

    def one(text):
        alive.append(text)
        most.append(len(alive))
        return text.upper()

    class Texts:
        def __init__(self, held):
            self.held = held

        def __len__(self):
            return len(self.held)

        def slice(self, low, rows):
            alive.clear()
            return self.held.slice(low, rows)

    texts = pa.array([None, *(f"t{i}" for i in range(999))])
    assert arrow.by_slices(one, Texts(texts), pa.string()).to_pylist() == [None, *(f"T{i}" for i in range(999))] and max(most) <= 128
    assert arrow.by_slices(one, texts.slice(0, 0), pa.string()).to_pylist() == []


def test_planner(spark):
    asked = spark.createDataFrame([("a", "明天天气如何"), ("b", "语义层和数据湖分别解决什么"), ("c", "price in 2030?"), ("d", "who")], "query_id string, text string")
    got = {r.query_id: r for r in retrieval.plan_questions(asked, 2026).collect()}
    assert got["a"].preflight_reason == "outside_product_scope" and got["b"].route == "comparison" and len(got["b"].subqueries) == 2
    assert got["c"].requirements == ["future_year:2030", "price"] and got["c"].route == "timeline" and got["d"].subqueries == ["who"]


def test_metrics(spark):
    gold = spark.createDataFrame([("q1", "x"), ("q1", "y"), ("q2", "z")], "query_id string, expected_id string")
    ranked = spark.createDataFrame([("q1", "n", 1), ("q1", "x", 2), ("q1", "x", 3)], "query_id string, item_id string, rank long")
    row = evaluation.retrieval_metrics(gold, ranked).first()
    assert (row.questions, row.recall_at_5, row.hit_at_5, row.mrr) == (2, 0.25, 0.5, 0.25)


def test_labelled_metrics_make_no_row_a_pair(spark):
    """All items of a query's kind are expected: the means of the general form, without its pairs."""
    items = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(60)], "item_id long, kind int")
    asked = items.where("item_id % 5 = 0").withColumnRenamed("item_id", "query_id")
    ranked = spark.createDataFrame([(q, (q * 3 + r * r) % 60, r) for q in range(0, 60, 5) for r in range(1, 13)], "query_id long, item_id long, rank long")
    gold = asked.join(items, "kind").select("query_id", "kind", F.col("item_id").alias("expected_id"))
    for groups in ((), ("kind",)):
        got = evaluation.labelled_metrics(asked, items, ranked, *groups)
        assert sorted(got.collect()) == sorted(evaluation.retrieval_metrics(gold, ranked, *groups).collect())
    many = items.crossJoin(spark.range(300)).select((F.col("item_id") * 300 + F.col("id")).alias("item_id"), "kind")
    got = evaluation.labelled_metrics(many.withColumnRenamed("item_id", "query_id"), many, ranked)
    assert got.first().questions == 15_300  # 78 million pairs


def test_claims(spark):
    rows = spark.createDataFrame([("A [1]. B [7]! Head:\nNone", 3)], "answer string, citation_count int")
    got = [(r.text, r.requires_citation, r.citation_present, r.citation_valid) for r in evaluation.claims(rows).orderBy("claim").collect()]
    assert got == [("A [1]. B [7]!", True, True, False), ("Head:", False, False, False), ("None", True, False, False)]


def test_weekly_window():
    now = datetime(2026, 8, 5, 12, tzinfo=timezone.utc)  # a Wednesday
    start, end = briefs.last_complete_week(now)
    assert end == datetime(2026, 8, 1, 1, tzinfo=timezone.utc) and end - start == timedelta(days=7)
    assert briefs.brief_state(now, (start, end), False, False) == "current" and briefs.brief_state(now, None, True, False) == "not_due"


def test_feeds(spark, tmp_path):
    atom = tmp_path / "a.xml"
    atom.write_text('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i1</id><title> One  title </title><summary>s</summary><updated>2026-08-01T00:00:00Z</updated><author><name>N</name></author><link rel="self" href="http://s"/><link href="http://e.org/1"/></entry><entry><id>i2</id></entry></feed>')
    rss = tmp_path / "r.xml"
    rss.write_text("<rss><channel><item><title>T</title><guid>http://g</guid><description>d</description><pubDate>Fri, 01 Aug 2026 08:00:00 +0000</pubDate></item></channel></rss>")
    js = tmp_path / "f.json"
    js.write_text('{"items": [{"id": "1", "external_url": "http://x", "title": "J", "content_html": "<p>body</p>", "date_published": "2026-08-01T00:00:00+08:00"}]}')
    a = feeds.read_syndication(spark, str(atom)).collect()
    assert [(r.url, r.title, r.authors) for r in a] == [("http://e.org/1", "One title", ["N"])] and a[0].published_at == datetime(2026, 8, 1)
    r = feeds.read_syndication(spark, str(rss)).first()
    assert (r.url, r.published_at) == ("http://g", datetime(2026, 8, 1, 8))
    j = feeds.read_source(spark, str(js), {"id": "s", "adapter": "json_feed", "url": "", "max_items": 5}).first()
    assert (j.url, j.summary, j.published_at) == ("http://x", "body", datetime(2026, 7, 31, 16))
    with pytest.raises(ValueError, match="not a syndication feed"):
        feeds.read_syndication(spark, str(js))


@pytest.mark.parametrize("given,want", [("Aug 1, 2026", datetime(2026, 8, 1)), ("August 1, 2026", datetime(2026, 8, 1)), ("junk", None), ("2026-08-01", datetime(2026, 8, 1)), ("Fri, 01 Aug 2026 08:00:00 GMT", datetime(2026, 8, 1, 8))])
def test_times(spark, given, want):
    assert one(spark, feeds.parse_time(F.col("t")), t=given) == want


def test_html_rules():
    assert html.listing('<a href="/1"><h3>A heading long enough</h3><p>s</p></a><a href="/1">A heading long enough</a><a href="/2">short</a>', "https://e.org")[0][:3] == ("https://e.org/1", "A heading long enough", "s")
    rows = html.sections("<h2>Date: 2026-01-02</h2><h3 id=a>Alpha</h3><p>Body</p><hr>x<h3 id=b>Beta</h3>", "https://e.org/p")
    assert [(r[0], r[1], r[2]) for r in rows] == [("https://e.org/p#a", "Alpha", "Body"), ("https://e.org/p#b", "Beta", None)] and rows[1][3].day == 2
    assert html.readable_text("<nav>x</nav><p>a  b<br>c</p><script>1</script>") == "a b\nc"


def test_store(spark, tmp_path):
    root, rows = str(tmp_path / "db"), spark.createDataFrame([("a", "u1", "h1"), ("b", "u2", "h2")], "id string, canonical_url string, content_hash string")
    store.publish(spark, root, "s1", {"articles": rows})
    store.publish(spark, root, "s1", {"articles": rows})
    assert store.load(spark, root, "articles").count() == 2
    with pytest.raises(ValueError, match="other content"):
        store.publish(spark, root, "s1", {"articles": rows.limit(1)})
    with pytest.raises(ValueError, match="duplicate_articles_id"):
        store.publish(spark, root, "s2", {"articles": rows.union(rows)})


def test_benchmark_adapter(spark):
    docs = spark.createDataFrame([("u1", "t", "b", "s", None, None, 0), ("u1", "t2", "b2", "s", None, None, 1), ("u2", "v", "w", "s", None, None, 2)], "url string, title string, body string, source string, category string, published_at string, ord long")
    asked = spark.createDataFrame([("q", "k", [("u2",), ("u1",), ("u2",), ("zz",)], 0), ("r", "k", [], 1)], "query string, question_type string, evidence_list array<struct<url:string>>, ord long")
    c = benchmarks.adapt_corpus(docs)
    q = benchmarks.adapt_questions(asked, c)
    ids = {r.url: r.article_id for r in c.collect()}
    assert {r.text: r.expected for r in q.collect()} == {"q": [ids["u2"], ids["u1"]], "r": []} and benchmarks.gold(q).count() == 2


def test_streams(spark, tmp_path):
    from sievewright.streaming import events

    rows = pd.DataFrame({"request_id": ["1", "2", "2", "3"], "user": ["a"] * 4, "ts": pd.to_datetime(["2026-01-01 10:00", "2026-01-01 10:01", "2026-01-01 10:01", "2026-01-01 10:02"])})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("request_id string, user string, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.admit_quota(stream(), "user", "ts", 2).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r.request, r.admitted) for r in spark.table("admitted").collect()) == [("1", True), ("2", True), ("3", False)]
    merge = lambda old, new: new if old is None else new.unionByName(old)
    events.rolling_merge(stream(), merge, str(tmp_path / "db"), "request_id", str(tmp_path / "c2")).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "db/v0")).count() == 3


def test_numbers(spark):
    assert one(spark, numbers.rounded(F.lit(0.12345))) == 0.1235 and one(spark, numbers.bounded(F.lit(1.7))) == 1.0


def test_validation(spark):
    from sievewright.functions import validation

    row = spark.createDataFrame([(" ab ", ["x", "", " x ", "y"], "-3", "7", " 12.5 ", "junk")], "s string, l array<string>, m string, n string, d string, j string").select(
        validation.bounded_string(F.col("s"), 1).alias("s"), validation.string_list(F.col("l"), 5, 9).alias("l"), validation.nonnegative(F.col("m")).alias("m"), validation.nonnegative(F.col("n")).alias("n"),
        validation.setting(F.col("d"), 1, 0, 10).alias("d"), validation.setting(F.col("j"), 1, 0, 10).alias("j"),
    ).first()
    assert tuple(row) == ("a", ["x", "y"], 0, 7, 10.0, 1.0)
    asked = spark.createDataFrame([(None, "7d", None, "en"), ("a good question", "1y", None, "en"), ("a good question", None, "bad id", None), ("a good question", "30d", "a-1", "zh-CN")], "question string, range string, article_id string, language string")
    assert [r.problem for r in validation.check_questions(asked).collect()] == ["question_missing", "range", "article_id", None]
    profiles = spark.createDataFrame([({"a": 3},), ({"z": 3},), ({"a": 9},), (None,)], "interests map<string,int>")
    assert [r.problem for r in validation.check_profiles(profiles, ["a"]).collect()] == [None, "unknown_topic", "weight", "interests_missing"]
    answers = spark.createDataFrame([('```json\n{"summary": " S ", "interests": [{"topic": "a", "weight": 2}, {"topic": "q", "weight": 2}]}\n```',), ("junk",)], "t string")
    got = [r.p for r in answers.select(validation.profile_completion(F.col("t"), ["a"]).alias("p")).collect()]
    assert got[0].summary == "S" and got[0].topics == ["a"] and got[1] is None


def test_command_line(spark, tmp_path, capsys):
    from sievewright.__main__ import main

    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["run", "nothing", "--tables", "x"]) == 2 and main(["run", "set_difference", "--tables", str(tmp_path)]) == 2
    assert main(["run", "set_difference", "--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0 and main(["doctor"]) == 0


def test_story_clusters_make_no_pairs_behind_the_last(spark, monkeypatch):
    """Alike titles: the first articles' pairs are enough; unlike ones first: all are looked at."""
    made, inner = [], reports._pairs
    monkeypatch.setattr(reports, "_pairs", lambda *a: made.append(inner(*a)) or made[-1])
    frame = lambda titles: spark.createDataFrame([(f"a{i}", f"s{i % 2}", i, t) for i, t in enumerate(titles)], "id string, source_id string, ord long, title string")
    got = reports.story_clusters(frame(["alpha beta gamma"] * 300)).collect()
    assert [(r.cluster, r.left_id, r.right_id) for r in got] == [(k + 1, "a0", f"a{2 * k + 1}") for k in range(20)]
    assert len(made) == 1 and made[0].count() < 16 * 300
    late = [f"only{i} once{i}" for i in range(40)] + ["alpha beta gamma", "alpha beta delta", "other thing", "alpha beta gamma"]
    assert [(r.left_id, r.right_id, r.shared) for r in reports.story_clusters(frame(late)).collect()] == [("a40", "a41", 2), ("a40", "a43", 3)]
    assert reports.story_clusters(frame(["x"])).count() == 0


def test_long_texts_match_as_in_difflib():
    from sievewright.functions.arrow import matched

    r = random.Random(3)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        b = "".join(r.choice("abcd") if r.random() < 0.1 else c for c in a)[r.randint(0, 3) :]
        want = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert matched(a, b, 0) == matched(a, b) == want


def test_fuzzy_dedup_hands_a_group_of_like_texts_over_once_a_text(spark, monkeypatch):
    """Of 120 like texts the matcher sees 119 pairs, not 7,140."""
    r = random.Random(7)
    base = "".join(r.choice("abcdefgh") for _ in range(300))
    rows = [(i, base[:i] + "z" + base[i + 1 :], "") for i in range(120)]
    alike, seen = dedup._alike, []

    def counted(pairs, sized, *more, **kw):
        if not kw.get("bounds_only"):
            seen.append(pairs.count())
        return alike(pairs, sized, *more, **kw)

    monkeypatch.setattr(dedup, "_alike", counted)
    frame = spark.createDataFrame(rows, "ord long, title string, abstract string")
    assert [x.ord for x in dedup.fuzzy_deduplicate(frame).collect()] == [0]
    assert seen == [119]


def test_fuzzy_dedup_needs_few_rounds_for_candidates_that_are_not_alike(spark, monkeypatch):
    """40 accepted texts, each a candidate of all others: the matcher is called twice, not 39 times."""
    r, called = random.Random(9), []
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(200)), "") for i in range(40)]
    alike = dedup._alike

    def counted(pairs, *more, **kw):
        called.append(pairs.count())
        return alike(pairs, *more, **kw)

    monkeypatch.setattr(dedup, "_alike", counted)
    pairs = spark.createDataFrame([(i, k) for i in range(40) for k in range(i)], "hi long, lo long")
    monkeypatch.setattr(dedup, "candidate_pairs", lambda *_: pairs)
    frame = spark.createDataFrame(rows, "ord long, title string, abstract string")
    assert sorted(x.ord for x in dedup.fuzzy_deduplicate(frame).collect()) == list(range(40))
    assert called == [39, 741]


def test_blocks_meet_as_a_plain_count_says():
    """Pairs of two blocks of texts in two alphabets, by the bounds on characters and q-grams one pair at a time."""
    r, q, threshold, texts = random.Random(11), 5, 0.92, []
    for i in range(150):
        if texts and r.random() < 0.5:
            t = list(r.choice(texts))
            for _ in range(r.randint(0, 12)):
                t[r.randrange(len(t))] = r.choice("abcxyz")
            texts.append("".join(t))
        else:
            texts.append("".join(r.choice(("abcdef", "uvwxyz")[i % 2]) for _ in range(r.randint(60, 90))))
    letters, bits, lost = zip(*(dedup._sketch(t, q)[:3] for t in texts))
    block = dedup._shortened({
        "letters": np.array([list(x) for x in letters], dtype=np.uint8), "bits": np.array([np.frombuffer(x, np.uint64) for x in bits]), "lost": np.array(lost), "n": np.array([len(t) for t in texts]),
    })
    got = set(zip(*map(np.ndarray.tolist, dedup._meet(block, block, True, threshold, q))))
    count = lambda t, k: Counter(t[i : i + k] for i in range(len(t) - k + 1))
    want = {
        (i, k) for k in range(150) for i in range(k)
        if all(sum((count(texts[i], n) & count(texts[k], n)).values()) >= dedup._least(n, threshold, len(texts[i]) + len(texts[k])) for n in (1, q))
    }
    assert len(want) > 50 and got == want
