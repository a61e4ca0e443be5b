"""Queries of whole runs: lineage, weekly briefs, guarded requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrow import hashing_embedder
from ..operators import briefs, dedup, evalruns, guardrails, lineage, retrieval, selection
from ..sources import plugins, store
from .catalog import BM25, HASH, SQL, TOPIC_SQL, articles, corpus, hashed, query, questions, table, topical, with_ready

#: Collected some hours after publication.
LAG = "(ord * 37) % 200"


@query(TOPIC_SQL + """, e AS (SELECT 0 AS place, 'normalize' AS stage, (SELECT count(*) FROM documents) AS i, (SELECT count(*) FROM s WHERE title <> '') AS o),
  u AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY ord) AS first FROM s WHERE title <> ''), k AS (SELECT * FROM u WHERE first = 1), q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY best DESC, published_at DESC, ord) AS nth FROM k WHERE best >= 0.1),
  c AS (SELECT (SELECT o FROM e) AS n0, (SELECT count(*) FROM k) AS n1, (SELECT count(*) FROM q) AS n2, (SELECT count(*) FROM q WHERE nth <= 8) AS n3, (SELECT least(40, count(*)) FROM q WHERE nth <= 8) AS n4)
  SELECT place::INT AS place, stage, 'succeeded' AS status, i AS input_count, o AS output_count FROM (SELECT * FROM e UNION ALL SELECT 1, 'deduplicate', n0, n1 FROM c UNION ALL SELECT 2, 'select_topics', n1, n2 FROM c UNION ALL SELECT 3, 'limit_sources', n2, n3 FROM c UNION ALL SELECT 4, 'publish', n3, n4 FROM c)""")
def run_lineage(spark, sf):
    """Counts in and out of a run's five stages, as observed while they were written."""
    best = F.array_max(F.map_values("topic_scores"))
    order = [F.desc("topic_score"), F.desc("published_at"), F.asc("ord")]
    stages = [
        ("normalize", lambda rows: hashed(rows).where("title <> ''")),
        ("deduplicate", lambda rows: dedup.first_by(rows, "content_hash")),
        ("select_topics", lambda rows: topical(rows).withColumn("topic_score", best).where("topic_score >= 0.1")),
        ("limit_sources", lambda rows: selection.limit_per(rows, "source_id", order, 8)),
        ("publish", lambda rows: rows.orderBy(*order).limit(40)),
    ]
    path = store.scratch(spark, "runs")
    _, run_id = lineage.run_stages(articles(spark, sf), stages, path)
    return lineage.run_rows(spark, path, run_id).select("place", "stage", "status", "input_count", "output_count")


@query(f""", w AS (SELECT ord, source_id, {HASH} AS content_hash, published_at + to_hours({LAG}) AS collected_at, to_timestamp(floor((epoch(published_at) - 176400) / 604800) * 604800 + 176400 + 604800)::TIMESTAMP AS week_end FROM a WHERE ord % 25 = 0),
  n AS (SELECT week_end, count(*) AS articles, sha256(count(*) || ':' || sum(('0x' || substring(content_hash, 1, 12))::BIGINT)::BIGINT || ':' || sum(('0x' || substring(content_hash, 13, 12))::BIGINT)::BIGINT || ':' || sum(('0x' || substring(content_hash, 25, 12))::BIGINT)::BIGINT) AS signature FROM w GROUP BY 1),
  x AS (SELECT week_end, collected_at FROM w QUALIFY row_number() OVER (PARTITION BY week_end ORDER BY collected_at) = 4), y AS (SELECT week_end, first FROM (SELECT week_end, source_id, min(collected_at) AS first FROM w GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY week_end ORDER BY first) = 2),
  k AS (SELECT n.week_end, signature, greatest(x.collected_at, y.first) AS ready_at FROM n JOIN x USING (week_end) JOIN y USING (week_end)),
  r AS (SELECT run_id, now, to_timestamp(floor((epoch(now) - 176400) / 604800) * 604800 + 176400)::TIMESTAMP AS period_end, dayofweek(now + INTERVAL 8 HOUR) = 6 AND hour(now + INTERVAL 8 HOUR) >= 9 AS due, forced, able FROM (SELECT min(event_id) AS run_id, date_trunc('hour', ts)::TIMESTAMP AS now, count(*) % 17 = 0 AS forced, count(*) % 5 <> 0 AS able FROM events GROUP BY date_trunc('hour', ts))),
  g AS (SELECT r.*, signature, (due OR forced) AND able AS asked, (due OR forced) AND able AND coalesce(ready_at <= now, false) AS writes FROM r LEFT JOIN k ON k.week_end = r.period_end),
  i AS (SELECT row_number() OVER (ORDER BY now, run_id) AS i, * FROM g),
  z AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS run_id, NULL::TIMESTAMP AS now, NULL::TIMESTAMP AS period_end, ''::VARCHAR AS state, NULL::TIMESTAMP AS held, NULL::VARCHAR AS brief UNION ALL
    SELECT i.i, i.run_id, i.now, i.period_end, CASE WHEN z.held = i.period_end THEN 'current' WHEN NOT asked THEN CASE WHEN z.brief IS NULL THEN 'not_due' ELSE 'carried' END WHEN NOT writes THEN CASE WHEN z.brief IS NULL THEN 'insufficient' ELSE 'insufficient_carried' END ELSE 'generated' END,
    CASE WHEN writes THEN i.period_end ELSE z.held END, CASE WHEN z.held = i.period_end OR NOT writes THEN z.brief ELSE 'brief-' || strftime(i.period_end - INTERVAL 7 DAY, '%Y-%m-%d') || '-' || substring(signature, 1, 12) END FROM z JOIN i ON i.i = z.i + 1)
  SELECT run_id, now, period_end - INTERVAL 7 DAY AS period_start, period_end, state, brief AS brief_id FROM z WHERE i > 0""")
def weekly_brief_runs(spark, sf):
    """A run an hour that has events, over all weeks."""
    rows = with_ready(articles(spark, sf), 25).withColumns({"collected_at": F.expr(f"published_at + make_interval(0, 0, 0, 0, {LAG})"), "evidence_ids": F.array("id")})
    hours = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("now")).agg(F.min("event_id").alias("run_id"), (F.count("*") % 17 == 0).alias("forced"), (F.count("*") % 5 != 0).alias("able"))
    return briefs.weekly_runs(hours, briefs.week_readiness(rows))


SQL["weekly_brief_runs"] = SQL["weekly_brief_runs"].replace("WITH ", "WITH RECURSIVE ", 1)


#: Bounds of the guarded requests below.
LIMITS = guardrails.Limits(hard_micros=3_000_000, soft_micros=2_000_000, concurrent=3, lease_seconds=7200, per_client=4, per_day=40, per_day_saving=25)


def requests(spark, sf):
    """Each event asks for a generation; two in four are settled, one is released, one just ends."""
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 7).cast("string").alias("ledger"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.concat(F.lit("q"), F.floor(F.col("event_id") / 11 * 10).cast("string")).alias("request_id"),
        F.concat(F.lit("c"), "user_id").alias("client"), F.round(F.col("value") * 1000).cast("long").alias("micros"),
    )
    asked = e.select("ledger", "at", (F.col("event_id") * 2).alias("ord"), "request_id", "client", F.lit("reserve").alias("action"), "micros")
    kind = F.col("event_id") % 4
    ended = e.where(kind < 3).select(
        "ledger", (F.col("at") + F.expr("make_interval(0, 0, 0, 0, 0, event_id % 150)")).alias("at"), (F.col("event_id") * 2 + 1).alias("ord"), "request_id", "client",
        F.when(kind == 2, "release").otherwise("settle").alias("action"), F.when(kind == 1, F.col("micros") * 2).alias("micros"),
    )
    return asked.unionByName(ended)


@query()
def guarded_requests(spark, sf):
    """Budget, leases, quotas and final states of all requests, ledger by ledger."""
    return guardrails.guarded(requests(spark, sf), LIMITS).select("ledger", "ord", "request_id", "action", "outcome", "committed")


#: A question counts as answered by its evidence from three quarters of this score on.
LEAST = 160.0


def gold(spark, sf):
    """(query_id, article_id): the documents that hold a question's passage.

    They meet by three words from inside the passage: its first and last word
    may be parts of a document's words.  Passages with fewer words inside are
    held against all documents.
    """
    words = lambda c: F.split(c, " ")
    gram = lambda c, i: F.array_join(F.slice(c, i, 3), " ")
    asked = questions(spark, sf).select("query_id", F.col("text").alias("passage"), words(F.col("text")).alias("_w")).where("passage is not null")
    documents = table(spark, sf, "documents").select("doc_id", "text")
    long = F.broadcast(asked.where(F.size("_w") >= 5).select("query_id", "passage", gram("_w", 2).alias("_gram")))
    parts = documents.select("doc_id", words(F.col("text")).alias("_w"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - 2)), lambda i: gram("_w", i)))
    met = parts.select("doc_id", F.explode(grams).alias("_gram")).join(long, "_gram").select("query_id", "doc_id", "passage").distinct().join(documents, "doc_id")
    met = met.unionByName(documents.crossJoin(F.broadcast(asked.where(F.size("_w") < 5).select("query_id", "passage"))))
    return met.where(F.contains("text", "passage")).select("query_id", F.col("doc_id").alias("article_id"))


def cases(spark, sf):
    expected = gold(spark, sf)
    known = expected.select("query_id").distinct().withColumn("answerable", F.lit(True))
    asked = questions(spark, sf).join(known, "query_id", "left").select("query_id", "text", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.coalesce("answerable", F.lit(False)).alias("answerable"))
    return store.written(evalruns.run_cases(asked, expected, corpus(spark, sf).select("chunk_id", F.col("chunk_id").alias("article_id"), "text"), 2024, least=LEAST), "cases")


_MEAN = "floor(avg({}) * {}.0::DOUBLE + 0.5::DOUBLE) / {}.0::DOUBLE"


@query(BM25 + f""", e AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), n AS (SELECT query_id, count(*) AS n FROM e GROUP BY 1), t AS (SELECT query_id, max(score) AS top FROM bm GROUP BY 1),
  h AS (SELECT e.query_id, count_if(rank <= 5) AS h5, count(rank) AS h10, min(rank) AS best, coalesce(sum(1.0::DOUBLE / log2(rank + 1)), 0) AS dcg FROM e LEFT JOIN bm ON bm.query_id = e.query_id AND bm.chunk_id = e.doc_id GROUP BY 1),
  z AS (SELECT item_id AS query_id, n.n, h5, h10, best, dcg, coalesce(top, 0) AS top, list_sum(list_transform(range(1, least(n.n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ideal FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN h ON h.query_id = item_id LEFT JOIN t ON t.query_id = item_id)
  SELECT count(*) AS questions, {_MEAN.format("h5 / n", 10000, 10000)} AS recall_at_5, {_MEAN.format("h10 / n", 10000, 10000)} AS recall_at_10, {_MEAN.format("CASE WHEN n > 0 THEN (h5 > 0)::INT::DOUBLE END", 10000, 10000)} AS hit_at_5,
  {_MEAN.format("CASE WHEN n > 0 THEN coalesce(1.0::DOUBLE / best, 0) END", 10000, 10000)} AS mrr, {_MEAN.format("dcg / ideal", 10000, 10000)} AS ndcg_at_10, {_MEAN.format(f"CASE WHEN n IS NULL THEN (top < {LEAST} * 0.75)::INT::DOUBLE END", 10000, 10000)} AS no_answer_accuracy,
  {_MEAN.format(f"CASE WHEN n IS NULL THEN (top < {LEAST})::INT::DOUBLE END", 10000, 10000)} AS low_score_refusal_accuracy, {_MEAN.format(f"CASE WHEN n > 0 THEN (top >= {LEAST} * 0.75)::INT::DOUBLE END", 10000, 10000)} AS answerable_pass_rate, 1.0::DOUBLE AS average_rounds FROM z""")
def evaluation_run(spark, sf):
    """All questions, planned, looked up, judged and measured."""
    return evalruns.run_report(cases(spark, sf), LEAST)


def reviewed_packet(spark, sf):
    """The answers' packet, written, reviewed and merged back; an answer is a conversation's first one, with citations added."""
    said = table(spark, sf, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("answer"))
    said = said.where("query_id % 5 <> 0").withColumn("answer", F.concat("answer", F.lit(" One claim [1]. Another [2][9]! Head:")))
    packet = store.written(evalruns.review_packet(cases(spark, sf), corpus(spark, sf), articles(spark, sf).select(F.col("ord").alias("article_id"), "title"), said), "packet")
    path = store.scratch(spark, "packet")
    evalruns.write_packet(packet, path)
    back = evalruns.read_packet(spark, path, packet.schema)
    marked = back.withColumns({"answer_correct": F.col("query_id") % 3 != 0, "answer_complete": F.lit(True), "supported": F.transform("claims", lambda c: c["claim"] % 4 != 0)})
    return evalruns.merge_reviews(back, marked)


@query()
def review_packets(spark, sf):
    """Summary of all answers' reviewed packet."""
    return evalruns.packet_summary(reviewed_packet(spark, sf))


@query()
def page_links(spark, sf):
    """Links of all pages, by the table function over the html column."""
    plugins.register(spark)
    pages = table(spark, sf, "pages").select("page_id", "url", "html").withColumnRenamed("url", "page")
    return spark.sql("SELECT p.page_id, i.url, i.title, i.summary, i.ord FROM {pages} p, LATERAL page_items(p.html, p.page, 'listing') i", pages=pages)


@query()
def page_listings(spark, sf):
    """Links of all pages, written as JSON lines and read by the data source."""
    plugins.register(spark)
    path = store.scratch(spark, "pages")
    table(spark, sf, "pages").select("url", "html").write.json(path)
    return spark.read.format(plugins.NAME).option("reader", "listing").load(path).select("page", "url", "title", "ord")


@query()
def embedded_index(spark, sf):
    """Documents cut into chunks, embedded, written as an index and read back: the nearest chunks of each question."""
    embed = hashing_embedder()
    chunks = retrieval.chunk_paragraphs(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text"))
    path = store.scratch(spark, "index")
    store.write_index(store.build_index(chunks, embed), path, "snapshot-1", "hashing-384", 384, retrieval.CHUNKING)
    index = store.load_index(spark, path, "hashing-384", 384, retrieval.CHUNKING)
    found = retrieval.dense_top(index.select(F.col("id").alias("chunk_id"), F.col("vector").alias("v")), questions(spark, sf).select("query_id", embed("text").alias("qv")), 5)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))
