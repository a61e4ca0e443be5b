"""Evaluation runs and review packets against sequential versions."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sievewright.operators import evalruns
from sievewright.plans import runs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def asked(spark):
    """Questions of several routes over a small corpus, run in one plan."""
    questions = [(1, "price of alpha", "a", True), (2, "agentic 和 beta 如何", "a", True), (3, "alpha 2031", "b", False), (4, "weather today", "b", False), (5, "gamma delta", "a", True), (6, "推理 alpha", "a", True), (7, "unknownword", "b", False), (8, "beta gamma", "a", True)]
    corpus = [(f"c{i}", f"d{i // 2}", t) for i, t in enumerate(["alpha costs $ 5 price", "alpha beta", "beta agent agentic 如何", "gamma delta", "gamma", "reasoning inference alpha", "delta delta delta", "2031 something"])]
    expected = [(1, "d0"), (2, "d1"), (2, "d0"), (5, "d3"), (6, "d2"), (6, "d9")]
    q = spark.createDataFrame(questions, "query_id long, text string, category string, answerable boolean")
    c = spark.createDataFrame(corpus, "chunk_id string, article_id string, text string")
    e = spark.createDataFrame(expected, "query_id long, article_id string")
    return evalruns.run_cases(q, e, c, 2026, least=0.3, k=4), c


def test_cases_and_report(asked):
    cases = {r.query_id: r for r in asked[0].collect()}
    assert cases[4].rounds == 0 and cases[4].candidates == [] and cases[4].reason == "outside_product_scope" and not cases[4].sufficient
    assert cases[3].reason == "required_future_date_evidence_missing" or cases[3].sufficient
    assert cases[6].rounds == 2 and cases[1].rounds == 1 and cases[2].route == "comparison"
    for r in cases.values():
        assert [c["rank"] for c in r.candidates] == list(range(1, len(r.candidates) + 1)) and len(r.candidates) <= 4
        assert r.articles == list(dict.fromkeys(c.article_id for c in r.candidates))
        if r.rounds == 1:
            assert not r.candidates or r.top_score == r.candidates[0].score
    some = [r for r in cases.values() if r.answerable]
    none = [r for r in cases.values() if not r.answerable]

    def mean(values, digits=4):
        return math.floor(sum(values) / len(values) * 10**digits + 0.5) / 10**digits

    def hits(r, k):
        return len(set(r.articles[:k]) & set(r.expected_ids))

    def gain(r):
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(10, len(r.expected_ids)) + 1))
        return sum(1 / math.log2(i + 1) for i, a in enumerate(r.articles[:10], 1) if a in r.expected_ids) / ideal if ideal else 0

    report = evalruns.run_report(asked[0], 0.3).first()
    assert report.questions == 8
    assert report.recall_at_5 == mean([hits(r, 5) / len(r.expected_ids) if r.expected_ids else 0 for r in some])
    assert report.hit_at_5 == mean([float(hits(r, 5) > 0) for r in some])
    assert report.mrr == mean([next((1 / i for i, a in enumerate(r.articles, 1) if a in r.expected_ids), 0) for r in some])
    assert report.ndcg_at_10 == pytest.approx(mean([gain(r) for r in some]), abs=1e-4)
    assert report.no_answer_accuracy == mean([float(not r.sufficient) for r in none])
    assert report.low_score_refusal_accuracy == mean([float(r.top_score is None or r.top_score < 0.3) for r in none])
    assert report.answerable_pass_rate == mean([float(r.sufficient) for r in some])
    assert report.average_rounds == mean([r.rounds for r in cases.values()], 2)
    empty = evalruns.run_report(asked[0].limit(0)).first()
    assert empty.questions == 0 and empty.recall_at_5 is None and empty.no_answer_accuracy is None


def test_only_comparisons_lead_with_their_rounds(asked):
    cases = {r.query_id: r for r in asked[0].collect()}
    scores = [c.score for c in cases[6].candidates]
    assert scores == sorted(scores, reverse=True)


def test_packet_goes_out_and_comes_back(spark, asked, tmp_path):
    cases, corpus = asked
    answers = spark.createDataFrame([(1, "Alpha costs 5 [1]. See:\nWrong [9]."), (5, "Gamma."), (3, "never shown")], "query_id long, answer string")
    packet = evalruns.review_packet(cases, corpus, spark.createDataFrame([("d0", "Title")], "article_id string, title string"), answers)
    evalruns.write_packet(packet, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == 8 and all(k in lines[0] for k in (*evalruns.LABELS, "supported", "digest"))
    by_id = {x["query_id"]: x for x in lines}
    assert by_id[1]["status"] == "generated" and by_id[2]["status"] in ("pending", "refused") and by_id[4]["status"] == "refused" and by_id[3]["answer"] is None
    assert [c["cited"] for c in by_id[1]["claims"]] == [[1], [9]] and len(by_id[1]["evidence"]) <= 5
    before = evalruns.packet_summary(packet).first()
    assert before.gate == "pending" and before.answer_correctness is None
    for x in lines:
        if x["claims"]:
            x |= {"supported": [True] * len(x["claims"]), "answer_correct": x["query_id"] == 1, "answer_complete": True, "notes": "seen"}

    def merged(rows):
        path = tmp_path / f"in{len(list(tmp_path.iterdir()))}"
        path.mkdir()
        (path / "part.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
        return evalruns.merge_reviews(packet, evalruns.read_packet(spark, str(path), packet.schema))

    done = merged(lines[::-1])
    rows = {r.query_id: r for r in done.collect()}
    assert len(rows) == 8 and rows[1].notes == "seen" and rows[1].supported == [True] * 2 and rows[4].notes is None
    summary = evalruns.packet_summary(done).first()
    generated = [x for x in lines if x["status"] == "generated"]
    assert summary.review_complete and summary.answer_correctness == math.floor(1 / len(generated) * 1e4 + 0.5) / 1e4 and summary.citation_faithfulness == 1.0
    assert {r.query_id for r in merged([]).collect()} == set(rows)
    changed = [dict(x) for x in lines]
    changed[0]["reason"] = "better"
    other = [dict(x, digest="0" * 64) for x in lines]
    for bad, why in ((changed, "changed case"), (other, "changed case"), ([dict(lines[0], query_id=77)], "unknown case"), ([lines[0], lines[0]], "repeated case")):
        with pytest.raises(Exception, match=why):
            merged(bad).collect()


def test_packets_of_the_tables(spark):
    """The query's summary from its packet, counted by hand."""
    rows = runs.reviewed_packet(spark, SMALL).collect()
    generated = [r for r in rows if r.answerable and r.status == "generated"]
    claims = [(c, s) for r in generated for c, s in zip(r.claims, r.supported) if c.requires_citation]
    got = runs.review_packets(spark, SMALL).first()
    assert (got.answerable_cases, got.generated_cases, got.pending_cases) == (sum(r.answerable for r in rows), len(generated), sum(r.answerable and r.status == "pending" for r in rows))
    assert got.claims == len(claims) and got.cited_claims == sum(c.citation_present and c.citation_valid for c, _ in claims)
    assert got.citations == sum(len(c.cited) for c, _ in claims) and got.valid_citations == sum(len(c.valid) for c, _ in claims)
    assert got.citation_faithfulness == math.floor(sum(s for _, s in claims) / len(claims) * 1e4 + 0.5) / 1e4
    assert got.answer_correctness == math.floor(sum(r.query_id % 3 != 0 for r in generated) / len(generated) * 1e4 + 0.5) / 1e4


def test_gold_finds_passages_that_begin_within_a_word(spark, tmp_path):
    from sievewright.plans import runs

    passages = [(1, "one two three four five six"), (2, "short one"), (3, "one two three four"), (4, "a  b\tc d e f"), (5, None)]
    texts = [(10, "(one two three four five sixth"), (11, "a very short ones"), (12, "none two three four five"), (13, "xa  b\tc d e f"), (14, "one two three  four five six"), (15, None)]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(q, d) for q, p in passages for d, t in texts if p and t and p in t}
    got = [tuple(r) for r in runs.gold(spark, str(tmp_path)).select("query_id", "article_id").collect()]
    assert set(got) == want and len(got) == len(want) and len(want) == 5
