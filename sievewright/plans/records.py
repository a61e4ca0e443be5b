"""More queries of the catalogue: feeds, stores, reviews, plans, limits and records.

As in :mod:`.catalog`, each query has SQL that gives the same rows.  Queries
that read files write them first, to the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrow, numbers, text, validation
from ..functions import tables as T
from ..functions.arrow import redact_json
from ..operators import briefs, dedup, evaluation, items, ledger, reports, retrieval, scoring, selection, views
from ..sources import benchmarks, feeds, store
from .catalog import ANCHOR, BM25, DENSE, HASH, LEX, SQL, TOPIC_SQL, TOPICS, articles, corpus, hashed, query, questions, table, topical, vector_queries, vectors, with_ready


#: Characters that XML 1.0 can't hold, in RE2's and Java's notation alike.
UNHELD = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FEED = rf"f AS (SELECT ord, canonical_url || '/' || ord AS url, trim(regexp_replace(regexp_replace(title, '{UNHELD}', '', 'g'), ' +', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(abstract, '{UNHELD}', '', 'g'), ' +', ' ', 'g')) AS summary, published_at FROM a)"


def feed_items(spark, sf):
    """Whole titles and abstracts, in any script."""
    def held(c):
        return F.trim(F.regexp_replace(F.regexp_replace(c, UNHELD, ""), " +", " "))

    return articles(spark, sf).select("ord", F.concat("canonical_url", F.lit("/"), F.col("ord").cast("string")).alias("url"), held("title").alias("title"), held("abstract").alias("summary"), "published_at")


def _escaped(column: str):
    out = F.col(column)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _files(spark, rows, item, head: str, tail: str, name: str) -> str:
    """One document, and file, for each 100 places in the order."""
    path = store.scratch(spark, name)
    whole = rows.groupBy(F.floor(F.col("ord") / 100).alias("file")).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))), lambda r: r["x"]), "," if name == "json" else ""), F.lit(tail)).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


FEED_SQL = f", {FEED} SELECT url, title, nullif(summary, '') AS summary, published_at FROM f WHERE title <> ''"


@query(FEED_SQL)
def feed_rss(spark, sf):
    item = F.concat(F.lit("<item><title>"), _escaped("title"), F.lit("</title><link>"), _escaped("url"), F.lit("</link><description>"), _escaped("summary"), F.lit("</description><pubDate>"), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    path = _files(spark, feed_items(spark, sf), item, "<rss version='2.0'><channel>", "</channel></rss>", "rss")
    return feeds.read_rss(spark, path).select("url", "title", "summary", "published_at")


@query(FEED_SQL)
def feed_atom(spark, sf):
    item = F.concat(F.lit("<entry><id>x</id><title>"), _escaped("title"), F.lit("</title><link rel='self' href='http://other/'/><link href='"), _escaped("url"), F.lit("'/><summary>"), _escaped("summary"), F.lit("</summary><updated>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"))
    path = _files(spark, feed_items(spark, sf), item, "<feed xmlns='http://www.w3.org/2005/Atom'>", "</feed>", "atom")
    return feeds.ADAPTERS["atom"](spark, path, {}).select("url", "title", "summary", "published_at")


@query(f", {FEED} SELECT 'feed-1' AS source_id, url, title, nullif(summary, '') AS summary, published_at, 'de' AS language FROM f WHERE title <> '' AND summary <> ''")
def feed_json(spark, sf):
    rows = feed_items(spark, sf)
    item = F.to_json(F.struct("url", "title", "summary", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published")))
    path = _files(spark, rows, item, '{"items":[', "]}", "json")
    read = feeds.read_source(spark, path, {"id": "feed-1", "adapter": "json_feed", "language": "de", "require_summary": True, "require_date": True, "max_summary_chars": None})
    return read.select("source_id", "url", "title", "summary", "published_at", "language")


@query(f"""SELECT /*a*/ 'article-' || substring(sha256(canonical_url), 1, 20) AS id, {HASH} AS content_hash, 'evidence-' || substring({HASH}, 1, 20) AS evidence_id, nullif(abstract, '') AS abstract, substring(coalesce(nullif(abstract, ''), title), 1, 2000) AS excerpt, 1 AS authors
  FROM (SELECT ord, title, rtrim(abstract, ' ') AS abstract, canonical_url FROM a)""")
def normalized_items(spark, sf):
    raw = articles(spark, sf).select(
        "source_id", F.concat(F.upper(F.substring("canonical_url", 1, 5)), F.substring(F.col("canonical_url"), 6, F.length("canonical_url")), F.lit("/?utm_source=x#part")).alias("url"), F.concat(F.lit("  "), "title").alias("title"),
        F.col("abstract").alias("summary"), F.lit("").alias("content_html"), F.array(F.lit(" A  B "), F.lit(" ")).alias("authors"), "published_at", "language", F.lit("official").alias("source_type"), F.lit("primary").alias("evidence_tier"),
    )
    rows, evidence = items.normalize_items(raw, F.expr(ANCHOR))
    both = rows.withColumn("place", F.monotonically_increasing_id()).select("id", "content_hash", "abstract", F.size("authors").alias("authors"), F.col("evidence_ids")[0].alias("evidence_id"))
    return both.join(evidence.select(F.col("id").alias("evidence_id"), F.col("article_id").alias("id"), "excerpt").distinct(), ["id", "evidence_id"]).select("id", "content_hash", "evidence_id", "abstract", "excerpt", "authors")


ROUNDS = """WITH c AS (SELECT user_id AS query_id, event_id % 3 AS round, CAST((event_id * 7) % 31 AS VARCHAR) AS chunk_id, CAST(((event_id * 7) % 31) % 3 AS VARCHAR) AS article_id, max(value) AS score FROM events GROUP BY ALL),
  l0 AS (SELECT * FROM c WHERE round = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1),
  l1 AS (SELECT c.* FROM c LEFT JOIN l0 USING (query_id) WHERE c.round = 1 QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(c.article_id = l0.article_id, false), c.score DESC, c.chunk_id) = 1),
  l2 AS (SELECT c.* FROM c LEFT JOIN l0 USING (query_id) LEFT JOIN l1 USING (query_id) WHERE c.round = 2
    QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(c.article_id = l0.article_id, false) OR coalesce(c.article_id = l1.article_id, false), c.score DESC, c.chunk_id) = 1),
  led AS (SELECT *, true AS leader FROM l0 UNION ALL SELECT *, true FROM l1 UNION ALL SELECT *, true FROM l2),
  rest AS (SELECT c.*, false AS leader FROM c WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.query_id = c.query_id AND led.chunk_id = c.chunk_id) QUALIFY row_number() OVER (PARTITION BY c.query_id, c.chunk_id ORDER BY score DESC, round) = 1),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY leader DESC, score DESC, chunk_id, round) AS rank FROM (SELECT * FROM led UNION ALL SELECT * FROM rest))
  SELECT query_id, chunk_id, rank, leader, round(score, 6) AS score FROM n WHERE rank <= 8"""


@query(ROUNDS)
def round_leaders(spark, sf):
    chunk = F.col("event_id") * 7 % 31
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 3).alias("round"), chunk.cast("string").alias("chunk_id"), (chunk % 3).cast("string").alias("article_id")).agg(F.max("value").alias("score"))
    return retrieval.fuse_rounds(rows, 8).select("query_id", "chunk_id", "rank", "leader", F.round("score", 6).alias("score"))


CONTEXT = """WITH RECURSIVE r AS (SELECT conv_id AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, conv_id || '-' || turn AS chunk, role, '[chunkId=' || conv_id || '-' || turn || ';articleId=' || role || ';score=' || printf('%.4f', turn / 8.0::DOUBLE) || ']' || chr(10) || text AS block FROM conversations),
  f AS (SELECT DISTINCT q, 0 AS n, 0 AS used, []::VARCHAR[] AS ids, []::VARCHAR[] AS arts, []::VARCHAR[] AS blocks FROM r UNION ALL
    SELECT q, n, CASE WHEN ok THEN cost ELSE used END, CASE WHEN ok THEN list_append(ids, chunk) ELSE ids END, CASE WHEN ok THEN list_append(arts, role) ELSE arts END, CASE WHEN ok THEN list_append(blocks, block) ELSE blocks END
    FROM (SELECT f.q, r.n, f.used, f.ids, f.arts, f.blocks, r.chunk, r.role, r.block, f.used + length(r.block) + CASE WHEN len(f.ids) > 0 THEN 2 ELSE 0 END AS cost,
      f.used + length(r.block) + CASE WHEN len(f.ids) > 0 THEN 2 ELSE 0 END <= 1200 AND len(list_filter(f.arts, lambda x: x = r.role)) < 2 AS ok FROM f JOIN r ON r.q = f.q AND r.n = f.n + 1))
  SELECT q AS query_id, array_to_string(ids, ',') AS chunk_ids, CAST(used AS BIGINT) AS used, sha256(array_to_string(blocks, chr(10) || chr(10))) AS context FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC) = 1"""


@query(CONTEXT)
def context_pack(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("long").alias("rank"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("role").alias("article_id"), (F.col("turn") / 8).alias("score"), "text")
    out = retrieval.assemble_context(turns, budget=1200)
    return out.select("query_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), "used", F.sha2("context", 256).alias("context"))


@query("""WITH cs AS (SELECT DISTINCT conv_id, conv_id % 3 <> 0 AS answerable, conv_id % 5 <> 0 AS generated, conv_id % 5 = 0 AS pending, conv_id % 7 <> 0 AS ok, true AS whole FROM conversations),
  cl AS (SELECT c.*, turn % 4 <> 0 AS req, turn % 2 = 0 AS there, turn % 6 <> 2 AS fine, turn % 3 AS cited, CASE WHEN turn % 6 <> 2 THEN turn % 3 ELSE 0 END AS valid, turn % 5 <> 1 AS sup FROM conversations JOIN cs c USING (conv_id)),
  a AS (SELECT count_if(answerable) AS answerable_cases, count_if(answerable AND generated) AS generated_cases, count_if(answerable AND pending) AS pending_cases, count_if(answerable AND generated AND ok) AS k FROM cs),
  b AS (SELECT count(*) AS claims, count_if(there AND fine) AS cited_claims, coalesce(sum(cited), 0)::BIGINT AS citations, coalesce(sum(valid), 0)::BIGINT AS valid_citations, count_if(sup) AS s FROM cl WHERE req AND answerable AND generated)
  SELECT answerable_cases, generated_cases, pending_cases, claims, cited_claims, citations, valid_citations, floor(cited_claims / claims::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS citation_coverage,
  floor(valid_citations / citations::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS citation_validity, floor(s / claims::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS citation_faithfulness,
  floor(k / generated_cases::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS answer_correctness, 1.0::DOUBLE AS answer_completeness, true AS review_complete, 'pending' AS gate FROM a, b""")
def answer_review(spark, sf):
    c = table(spark, sf, "conversations")
    cases = c.select(F.col("conv_id").alias("case_id")).distinct().withColumns({
        "answerable": F.col("case_id") % 3 != 0, "generated": F.col("case_id") % 5 != 0, "pending": F.col("case_id") % 5 == 0, "answer_correct": F.col("case_id") % 7 != 0, "answer_complete": F.lit(True),
    })
    fine = F.col("turn") % 6 != 2
    ids = F.array_repeat(F.lit(1), (F.col("turn") % 3).cast("int"))
    claims = c.select(
        F.col("conv_id").alias("case_id"), (F.col("turn") % 4 != 0).alias("requires_citation"), (F.col("turn") % 2 == 0).alias("citation_present"), fine.alias("citation_valid"),
        ids.alias("cited"), F.when(fine, ids).otherwise(F.array().cast("array<int>")).alias("valid"), (F.col("turn") % 5 != 1).alias("supported"),
    )
    return evaluation.review_summary(cases, claims)


@query("SELECT count(*) AS calls, CAST(sum(round(value)) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 7) AS BIGINT) AS completion_tokens, CAST(sum(round(round(value) * 0.5 + event_id % 7 * 1.5)) AS BIGINT) AS cost_micros FROM events")
def enrichment_usage(spark, sf):
    e = table(spark, sf, "events").select(F.round("value").cast("long").alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"))
    return reports.usage_totals(e.withColumn("cost_micros", numbers.cost_micros(F.col("prompt_tokens"), F.col("completion_tokens"), 0.5, 1.5)))


@query("SELECT /*a*/ CASE WHEN ord % 3 = 0 THEN 'none' ELSE 'p' || (ord % 4) END AS provider, count_if(ord % 5 = 0) AS ready, count_if(ord % 5 <> 0) AS pending FROM a GROUP BY 1")
def status_counts(spark, sf):
    rows = with_ready(articles(spark, sf), 5).withColumn("provider", F.when(F.col("ord") % 3 != 0, F.concat(F.lit("p"), (F.col("ord") % 4).cast("string"))))
    return views.provider_status(rows)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").where("o_totalprice > 200000").select("o_custkey"))


PHRASES = ("", " 和 cost", " weather", " when", " legal advice", " 2031", " 收购 多少")
ASKED = "q AS (SELECT item_id AS query_id, text || list_extract([" + ", ".join(f"'{p}'" for p in PHRASES) + f"], CAST(item_id % {len(PHRASES)} + 1 AS BIGINT)) AS text FROM benchmark), w AS (SELECT query_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low, list_max(list_transform(regexp_extract_all(lower(text), '\\b(20\\d\\d)\\b', 1), lambda y: CAST(y AS INT))) AS latest FROM q)"


@query(f"""WITH {ASKED}, p AS (SELECT *, CASE WHEN regexp_matches(low, '{'|'.join(T.POLICY_QUESTIONS)}') THEN 'policy_scope' WHEN regexp_matches(low, '{'|'.join(T.OUTSIDE)}') THEN 'outside_product_scope' END AS reason, coalesce(latest > 2024, false) AS future FROM w)
  SELECT query_id, reason, CASE WHEN reason IS NOT NULL THEN 'policy_scope' WHEN regexp_matches(low, '分别|对比|比较|共同|和|与') THEN 'comparison' WHEN future OR regexp_matches(low, '何时|时间线|最新|when') THEN 'timeline' ELSE 'single_fact' END AS route,
  CASE WHEN reason IS NOT NULL THEN '' ELSE concat_ws('|', CASE WHEN future THEN 'future_year:' || latest END, CASE WHEN regexp_matches(low, '价格|订阅|price|pricing|cost') THEN 'price' END, CASE WHEN regexp_matches(low, '收购|acquire|acquisition') THEN 'acquisition' END, CASE WHEN regexp_matches(low, '多少|how many|数量') THEN 'numeric' END) END AS requirements FROM p""")
def plan_route(spark, sf):
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("query_id") % len(PHRASES) + 1).cast("int"))
    plans = retrieval.plan_questions(questions(spark, sf).withColumn("text", F.concat("text", phrase)), 2024)
    return plans.select("query_id", F.col("preflight_reason").alias("reason"), "route", F.array_join("requirements", "|").alias("requirements"))


_EXPANDED = "concat_ws(' ', " + ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{v}' END" for k, v in T.EXPANSIONS.items()) + ")"


@query(f"WITH q AS (SELECT item_id AS query_id, text || CASE item_id % 3 WHEN 0 THEN ' 价格 agentic' WHEN 1 THEN ' 推理' ELSE '' END AS text, lower(text || CASE item_id % 3 WHEN 0 THEN ' 价格 agentic' WHEN 1 THEN ' 推理' ELSE '' END) AS low FROM benchmark) SELECT query_id, CASE WHEN {_EXPANDED} = '' THEN text ELSE text || ' ' || {_EXPANDED} END AS text FROM q")
def expanded_queries(spark, sf):
    phrase = F.when(F.col("query_id") % 3 == 0, " 价格 agentic").when(F.col("query_id") % 3 == 1, " 推理").otherwise("")
    return questions(spark, sf).withColumn("text", F.concat("text", phrase)).select("query_id", retrieval.expand_query(F.col("text")).alias("text"))


@query()
def hybrid_rrf(spark, sf):
    """The questions against whole documents: BM25 and the embedder's vectors of the same texts, fused."""
    embed = arrow.hashing_embedder()
    docs, asked = corpus(spark, sf), questions(spark, sf)
    found = retrieval.retrieve("hybrid", asked.withColumn("qv", embed("text")), retrieval.Bm25(docs), docs.select("chunk_id", embed("text").alias("v")))
    return found.select("query_id", "chunk_id", "score", "rank")


@query("""WITH e AS (SELECT user_id % 50 AS query_id, event_id AS chunk_id, value AS score FROM events), b AS (SELECT query_id FROM e WHERE chunk_id % 2 = 0 GROUP BY 1 HAVING max(score) < 40)
  SELECT query_id, chunk_id, score FROM e WHERE CASE WHEN query_id IN (SELECT query_id FROM b) THEN chunk_id % 2 = 1 ELSE chunk_id % 2 = 0 END AND query_id IN (SELECT query_id FROM e WHERE chunk_id % 2 = 0)""")
def article_fallback(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return retrieval.with_article_fallback(e.where("chunk_id % 2 = 0"), e.where("chunk_id % 2 = 1"), 40)


@query("SELECT user_id AS query_id, event_id % 97 AS chunk_id, max(value) AS score, arg_max(event_id % 5, (value, -(event_id % 5))) AS round FROM events GROUP BY 1, 2")
def best_rounds(spark, sf):
    e = table(spark, sf, "events")
    return dedup.best_round(e.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("chunk_id"), F.col("value").alias("score"), (F.col("event_id") % 5).alias("round")))


@query("""SELECT (SELECT string_agg(DISTINCT 'doc-' || (item_id * 3), ',' ORDER BY 'doc-' || (item_id * 3)) FROM benchmark WHERE item_id * 3 NOT IN (SELECT doc_id FROM documents)) AS missing,
  (SELECT floor(avg(CASE WHEN doc_id % 9 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE FROM documents) AS coverage, false AS healthy""")
def corpus_health(spark, sf):
    a = articles(spark, sf)
    wanted = table(spark, sf, "benchmark").select(F.concat(F.lit("doc-"), (F.col("item_id") * 3).cast("string")).alias("article_id"))
    out = evaluation.corpus_health(wanted, a, a.where("ord % 9 <> 0").select(F.col("id").alias("article_id")))
    return out.select(F.nullif(F.array_join("missing", ","), F.lit("")).alias("missing"), "coverage", "healthy")


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'observe' WHEN value % 10 >= 0 AND 0.5 + (event_id % 6) / 10.0::DOUBLE >= 0.95 AND event_id % 2 = 0 AND event_id * 7 % 5000 <= 4000 THEN 'pass' ELSE 'fail' END AS gate FROM events""")
def release_gates(spark, sf):
    e = table(spark, sf, "events")
    share = F.lit(0.5) + F.col("event_id") % 6 / F.lit(10.0)
    report = e.select("event_id", *[(F.lit(1.0) if k == "citation_validity" else share).alias(k) for k in evaluation.RELEASE], (F.col("event_id") * 7 % 5000).alias("p95_ms"), (F.col("event_id") % 2 == 0).alias("healthy"), F.lit(True).alias("reviewed"), F.lit(True).alias("review_complete"), F.when(F.col("event_id") % 11 == 0, "demo").otherwise("gold").alias("dataset_kind"))
    return evaluation.release_gate(report).select("event_id", "gate")


@query("""WITH s AS (SELECT * FROM labels ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT 60) SELECT count(*) AS n, avg(toxic::DOUBLE) AS positive_rate, avg((toxic IS NOT NULL)::INT::DOUBLE) AS coverage, avg(quality) AS mean_quality FROM s""")
def reference_means(spark, sf):
    return benchmarks.reference_means(table(spark, sf, "labels"), "doc_id", 60, "toxic", "quality")


@query("""SELECT string_agg('d' || doc_id, ',' ORDER BY doc_id) FILTER (quality <> toxic) AS failing, floor(avg((quality = toxic)::INT::DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS exact_match FROM labels""")
def failing_cases(spark, sf):
    rows = table(spark, sf, "labels").withColumn("item", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return evaluation.failing_ids(rows, F.col("quality") == F.col("toxic"), "item", "doc_id").select(F.array_join("failing", ",").alias("failing"), "exact_match")


TOP3 = "list_slice(list_sort(list_filter([" + ", ".join(f"{{'v': -t_{n}, 'k': '{n}'}}" for n, _, _ in TOPICS) + "], lambda x: x.v < 0)), 1, 3)"


@query(TOPIC_SQL + f" SELECT id, array_to_string(list_transform({TOP3}, lambda x: x.k), ',') AS topics FROM s WHERE best >= 0.1")
def topic_labels(spark, sf):
    return topical(articles(spark, sf)).select("id", F.array_join(selection.top_topics(F.col("topic_scores")), ",").alias("topics"))


@query("SELECT /*a*/ id FROM a ORDER BY published_at DESC, ord % 10 DESC, ord LIMIT 50")
def latest_articles(spark, sf):
    rows = scoring.with_article_columns(articles(spark, sf)).withColumn("content_score", F.when(F.col("ord") % 10 > 0, F.col("ord") % 10 / F.lit(10.0)))
    return rows.orderBy(*selection.latest_first()).limit(50).select("id")


@query("SELECT event_id AS id, 'versions/' || user_id || '.json' AS path FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0")
def archive_rows(spark, sf):
    path = F.when(F.col("event_id") % 4 == 0, "../secret.json").otherwise(F.concat(F.lit("versions/"), F.col("user_id").cast("string"), F.lit(".json")))
    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("id"), F.col("ts").alias("generated_at"), path.alias("path"))
    return store.archive_entries(rows).select("id", "path")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'b' || doc_id WHEN doc_id % 2 = 0 THEN 'a' || doc_id END AS answer FROM documents")
def cached_answers(spark, sf):
    docs, path = table(spark, sf, "documents").select("doc_id"), store.scratch(spark, "cache")
    for every, mark in ((2, "a"), (4, "b")):
        store.cache_put(docs.where(F.col("doc_id") % every == 0).withColumn("answer", F.concat(F.lit(mark), F.col("doc_id").cast("string"))), path)
    return store.cache_get(docs, spark.read.parquet(path), "doc_id", "answer")


@query(f", h AS (SELECT *, {HASH} AS content_hash FROM a) SELECT min(id) AS id, content_hash FROM h WHERE ord % 2 = 0 GROUP BY content_hash")
def published_snapshot(spark, sf):
    """Two versions are published; the newest is read."""
    rows, root = hashed(articles(spark, sf)), store.scratch(spark, "snapshots")
    for version, part in (("v1", "ord % 2 = 1"), ("v2", "ord % 2 = 0")):
        one = rows.where(part).groupBy("content_hash").agg(F.min("id").alias("id"))
        store.publish(spark, root, version, {"articles": one.withColumn("canonical_url", F.concat(F.lit("https://x.org/"), F.col("id")))})
    return store.load(spark, root, "articles").select("id", "content_hash")


@query("SELECT doc_id, '{\"docId\":' || doc_id || ',\"sourceName\":\"' || source || '\"}' AS value FROM documents")
def camel_records(spark, sf):
    rows = store.camel_columns(table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_name")))
    back = store.snake_columns(rows)
    return store.to_json(rows).select(F.get_json_object("value", "$.docId").cast("long").alias("doc_id"), "value").join(back.select("doc_id"), "doc_id", "left_semi")


@query("SELECT o_orderkey AS url, 0 AS part FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 0")
def source_union(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("url"), F.monotonically_increasing_id().alias("ord"))
    return feeds.union_in_order([o.where("url % 2 = 0"), o.where("url % 3 = 0")]).select("url", F.floor(F.col("ord") / F.lit(1 << 48)).cast("int").alias("part"))


@query(f"""SELECT /*a*/ count(*) AS articles, count(DISTINCT source_id) AS sources, count(*) >= 4 AND count(DISTINCT source_id) >= 2 AS enough FROM a WHERE published_at >= {ANCHOR} - INTERVAL 9 DAY AND published_at < {ANCHOR} - INTERVAL 2 DAY AND ord % 3 = 0 AND ord % 4 <> 0""")
def brief_candidates(spark, sf):
    rows = with_ready(articles(spark, sf), 3).withColumn("evidence_ids", F.when(F.col("ord") % 4 != 0, F.array("id")).otherwise(F.array().cast("array<string>")))
    return briefs.enough(briefs.candidates(rows, F.expr(f"{ANCHOR} - INTERVAL 9 DAY"), F.expr(f"{ANCHOR} - INTERVAL 2 DAY")))


@query("SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents")
def casefolded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", arrow.casefold(F.col("text")).alias("folded"))


@query("""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: substring(trim(x), 1, 8)), lambda x: x <> '') AS l FROM documents)
  SELECT doc_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 5), '|') AS words FROM w""")
def bounded_lists(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("l"))
    return d.select("doc_id", F.array_join(validation.string_list(F.transform("l", lambda x: F.trim(x)), 5, 8), "|").alias("words"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(round(value) AS BIGINT)::VARCHAR WHEN 1 THEN '-3' WHEN 2 THEN 'many' END AS t FROM events)
  SELECT event_id, greatest(0, coalesce(TRY_CAST(t AS BIGINT), 0)) AS whole, CASE WHEN TRY_CAST(t AS DOUBLE) IS NULL THEN 5.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(20.0::DOUBLE, TRY_CAST(t AS DOUBLE))) END AS setting FROM v""")
def settings(spark, sf):
    kind = F.col("event_id") % 4
    t = F.when(kind == 0, F.round("value").cast("long").cast("string")).when(kind == 1, "-3").when(kind == 2, "many")
    return table(spark, sf, "events").select("event_id", t.alias("t")).select("event_id", validation.nonnegative(F.col("t")).alias("whole"), validation.setting(F.col("t"), 5, 1, 20).alias("setting"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'interests_missing' WHEN doc_id % 10 = 1 THEN 'unknown_topic' WHEN doc_id % 7 NOT BETWEEN 1 AND 5 THEN 'weight' END AS problem FROM documents")
def profile_checks(spark, sf):
    kind = F.col("doc_id") % 10
    m = F.when(kind != 0, F.create_map(F.when(kind == 1, "cooking").otherwise("english"), (F.col("doc_id") % 7).cast("int")))
    return validation.check_profiles(table(spark, sf, "documents").select("doc_id", m.alias("interests")), [t[0] for t in TOPICS]).select("doc_id", "problem")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'S' || doc_id END AS summary, CASE WHEN doc_id % 3 <> 0 THEN 'english' END AS topics FROM documents")
def profile_answers(spark, sf):
    body = F.concat(F.lit('```json\n{"summary": " S'), F.col("doc_id").cast("string"), F.lit('", "tone": "calm", "interests": [{"topic": "english", "weight": 3}, {"topic": "x", "weight": 2}, {"topic": "english", "weight": 5}]}\n```'))
    answer = F.when(F.col("doc_id") % 3 == 0, "not json").otherwise(body)
    got = validation.profile_completion(answer, [t[0] for t in TOPICS])
    return table(spark, sf, "documents").select("doc_id", got.alias("p")).select("doc_id", "p.summary", F.nullif(F.array_join("p.topics", ","), F.lit("")).alias("topics"))


@query("SELECT page_id, '<evidence>' || chr(10) || substring(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1, 12000) || chr(10) || '</evidence>' AS block FROM pages")
def evidence_blocks(spark, sf):
    return table(spark, sf, "pages").select("page_id", validation.untrusted_block(F.col("html")).alias("block"))


@query("""SELECT event_id, '{"a": [{"password": "[redacted]"}], "k": ' || user_id || ', "Token": "[redacted]"}' AS log FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1""")
def redacted_logs(spark, sf):
    """Keys are sorted by code point, so ``Token`` would come first: it is moved behind here."""
    whole = F.concat(F.lit('{"Token": "t", "k": '), F.col("user_id").cast("string"), F.lit(', "a": [{"password": "p"}]}'))
    got = table(spark, sf, "events").select("event_id", redact_json(F.when(F.col("event_id") % 2 == 0, whole).otherwise("junk")).alias("log"))
    return got.select("event_id", F.regexp_replace("log", r'^\{("Token": "[^"]*"), (.*)\}$', r"{$2, $1}").alias("log"))


@query("SELECT item_id, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(regexp_replace(text, '[^ -~]', '', 'g'), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT) AS hash FROM benchmark")
def fnv_hashes(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", numbers.fnv1a(F.regexp_replace("text", "[^ -~]", "")).alias("hash"))


@query("SELECT /*a*/ id, concat_ws(chr(10) || chr(10), CASE WHEN ord % 3 = 0 THEN '标题' END, CASE WHEN ord % 3 = 0 THEN '摘要' END, nullif(title, ''), nullif(rtrim(abstract, ' '), '')) AS text FROM a")
def readable_articles(spark, sf):
    shown = F.col("ord") % 3 == 0
    return articles(spark, sf).select("id", retrieval.readable_text(F.when(shown, "标题"), F.when(shown, "摘要"), F.col("title"), F.col("abstract")).alias("text"))


_HINT = "concat_ws('; ', " + ", ".join(f"CASE WHEN contains(lower(text), '{s.lower()}') THEN '{s}={p}' END" for s, p, _ in T.TERMS) + ")"


@query(f"SELECT doc_id, {_HINT} AS hint FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' Rerank and Lakehouse' ELSE '' END AS text FROM documents)")
def terminology_hints(spark, sf):
    text_ = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " Rerank and Lakehouse").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", evaluation.terminology_hint(text_, T.TERMS).alias("hint"))


@query("SELECT vec_id AS id, len(embedding) AS dimensions FROM embeddings")
def dense_index(spark, sf):
    """Built, written with its description, and loaded under the same model and dimensions."""
    e, path = table(spark, sf, "embeddings"), store.scratch(spark, "index")
    dimensions = len(e.select("embedding").first().embedding)
    index = store.build_index(e.select(F.col("vec_id").alias("id"), "embedding"), lambda c: c.cast("array<double>"), "embedding").drop("embedding")
    store.write_index(index, path, "s1", "given", dimensions, retrieval.CHUNKING)
    return store.load_index(spark, path, "given", dimensions, retrieval.CHUNKING).select("id", F.size("vector").cast("long").alias("dimensions"))


@query("SELECT user_id AS ledger, max(ts)::DATE AS last_settled_date, count(*) % 7 AS balance FROM events GROUP BY 1")
def stored_ledgers(spark, sf):
    path, e = store.scratch(spark, "ledger"), table(spark, sf, "events")
    for low in (2, 1):
        store.write_ledger(e.groupBy(F.col("user_id").alias("ledger")).agg(F.to_date(F.max("ts")).alias("last_settled_date"), (F.count("*") % 7 * low).alias("balance")), path)
    return store.load_ledger(spark, path)


@query("SELECT 's' || s_suppkey AS id, s_name AS name, 'https://h' || s_suppkey || '.org/' AS homepage, s_suppkey % 2 = 0 AS enabled FROM supplier")
def source_rows(spark, sf):
    """Each supplier as a source."""
    key = F.col("s_suppkey").cast("string")
    made = table(spark, sf, "supplier").select(F.concat(F.lit("s"), key).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://h"), key, F.lit(".org/feed.xml")).alias("url"), (F.col("s_suppkey") % 2 == 0).alias("enabled"))
    return store.with_homepage(made).select("id", "name", "homepage", "enabled")


@query("""WITH RECURSIVE r AS (SELECT strftime(ts, '%Y-%m') AS month, event_id AS request_id, CAST(round(value * 1000) AS BIGINT) AS e, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY event_id) AS n FROM events),
  f AS (SELECT DISTINCT month, 0::BIGINT AS n, 0::BIGINT AS committed, NULL::BIGINT AS request_id, false AS admitted FROM r UNION ALL SELECT f.month, r.n, CASE WHEN f.committed + r.e <= 10000000 THEN f.committed + r.e ELSE f.committed END, r.request_id, f.committed + r.e <= 10000000 FROM f JOIN r ON r.month = f.month AND r.n = f.n + 1)
  SELECT request_id, month, admitted, committed FROM f WHERE n > 0""")
def budget_admission(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("event_id").alias("ord"), numbers.month_key(F.col("ts")).alias("month"), F.round(F.col("value") * 1000).cast("long").alias("estimated_micros"))
    return ledger.budget_admission(rows, 10_000_000).select("request_id", "month", "admitted", "committed")


@query("""WITH RECURSIVE r AS (SELECT event_type AS pool, event_id AS ord, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT DISTINCT pool, 0::BIGINT AS n, []::TIMESTAMP[] AS open, NULL::BIGINT AS ord, false AS granted FROM r UNION ALL
    SELECT pool, n, CASE WHEN len(kept) < 3 THEN list_append(kept, t + INTERVAL 1800 SECOND) ELSE kept END, ord, len(kept) < 3 FROM (SELECT f.pool, r.n, r.ord, CAST(r.ts AS TIMESTAMP) AS t, list_filter(f.open, lambda x: x > r.ts) AS kept FROM f JOIN r ON r.pool = f.pool AND r.n = f.n + 1))
  SELECT ord, granted FROM f WHERE n > 0""")
def lease_admission(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    return ledger.lease_admission(rows, "event_type", 3, 1800).select("ord", "granted")


@query("""WITH RECURSIVE d AS (SELECT user_id AS ledger, ts::DATE AS day, count(*) AS calls FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY day) AS n FROM d),
  f AS (SELECT DISTINCT ledger, 0::BIGINT AS n, NULL::DATE AS day, 0::BIGINT AS "before", 0::BIGINT AS credit, 0::BIGINT AS "limit", 0::BIGINT AS used, 5::BIGINT AS "after" FROM r UNION ALL
    SELECT ledger, n, day, b, 5, least(10, b + 5), least(calls, least(10, b + 5)), least(10, greatest(0, b + 5 - least(calls, least(10, b + 5))))
    FROM (SELECT f.ledger, r.n, r.day, r.calls, CASE WHEN f.day IS NULL THEN 5 ELSE least(10, f."after" + (datediff('day', f.day, r.day) - 1) * 5) END AS b FROM f JOIN r ON r.ledger = f.ledger AND r.n = f.n + 1))
  SELECT ledger, day, 1::BIGINT AS run, "before", credit, "limit", used, "after" FROM f WHERE n > 0""")
def budget_rollover(spark, sf):
    days = table(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("ledger"), F.to_date("ts").alias("day")).agg(F.count("*").alias("calls")).withColumn("run", F.lit(1).cast("long"))
    return ledger.rollover(days, 5, 10, 10, 5)


@query(f""", h AS (SELECT ord, id, canonical_url, {HASH} AS content_hash, row_number() OVER (ORDER BY ord) AS n FROM a),
  f AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS urls, []::VARCHAR[] AS hashes, NULL::BIGINT AS ord, false AS ok UNION ALL
    SELECT n, CASE WHEN ok THEN list_append(urls, canonical_url) ELSE urls END, CASE WHEN ok THEN list_append(hashes, content_hash) ELSE hashes END, ord, ok
    FROM (SELECT h.n, h.ord, h.canonical_url, h.content_hash, f.urls, f.hashes, NOT list_contains(f.urls, h.canonical_url) AND NOT list_contains(f.hashes, h.content_hash) AS ok FROM f JOIN h ON h.n = f.n + 1))
  SELECT h.ord, h.id, h.canonical_url, h.content_hash FROM f JOIN h ON h.ord = f.ord WHERE ok""")
def dedup_exact_two_key(spark, sf):
    return dedup.exact_deduplicate(hashed(articles(spark, sf))).select("ord", "id", "canonical_url", "content_hash")


SQL["dedup_exact_two_key"] = SQL["dedup_exact_two_key"].replace("WITH ", "WITH RECURSIVE ", 1)

