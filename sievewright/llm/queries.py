"""Queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import covertree, html_blocks, langid, licenses, media, merkle, mixing, packing, planes, prefix_trie, simhash, substrings, warc_zip


#: Target weights of op7's query: domains by 4:3:2:1; languages and sources are even.
MIX_WEIGHTS = {(f"domain{i}",): 4.0 - i for i in range(mixing.DOMAINS)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, epochs=2)
    return chosen.select("doc_id", "mix_domain", "lang", "source", "mix_tokens", "mix_epoch")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_files(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_html, op3_warc, op4_media, op5_packing, op6_licenses, op7_mixing, op8_langid, op9_covertree, op10_planes, op11_prefix_trie, op12_merkle, op13_substrings)}


_FIVE = " + ".join(f"{16 >> k} * CAST(substring(b, CAST(i * 5 + {k + 1} AS BIGINT), 1) AS BIGINT)" for k in range(5))
#: op3_warc in SQL; a test uses it, for a null long reads otherwise from the two engines where a table has no repeated page.
OP3 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), d AS (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS b FROM p)
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
_OP9 = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(v) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95::DOUBLE),
  r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
  SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id <= coalesce(c.low, vec_id) AS kept FROM e LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.a = vec_id"""


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of ASCII text: a byte's exclusive-or, then eight shifts."""
    steps = f"flatten(list_concat([[4294967295::BIGINT]], list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda r, v: CASE WHEN v >= 0 THEN xor(r, v) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END), 4294967295::BIGINT)"


_OP11 = f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, conv_id - conv_id % 100 AS origin, {_crc32("conv_id::VARCHAR")} % 6 AS h, count(*) AS n FROM t GROUP BY conv_id), m AS (SELECT c.conv_id, c.origin, c.h, c.n, least(c.h, coalesce(o.n, 0)) AS m FROM c LEFT JOIN c o ON o.conv_id = c.origin),
  r AS (SELECT m.conv_id, t.idx AS pos, t.role, t.text FROM m JOIN t ON t.conv_id = m.origin AND t.idx < m.m UNION ALL SELECT m.conv_id, t.idx - m.h + m.m, t.role, t.text FROM m JOIN t ON t.conv_id = m.conv_id AND t.idx >= m.h),
  p AS (SELECT conv_id, pos + 1 AS depth, length(text) AS chars, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM r), s AS (SELECT conv_id, 0 AS depth, 0 AS chars, '' AS k FROM c UNION ALL SELECT * FROM p),
  l AS (SELECT conv_id, max(depth) AS last FROM s GROUP BY conv_id),
  n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(CASE WHEN last = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM s JOIN l USING (conv_id) GROUP BY depth, k),
  e AS (SELECT n.depth, n.k, p.conv_id AS parent, p.k AS pk FROM n JOIN s ON s.conv_id = n.conv_id AND s.depth = n.depth - 1 JOIN n p ON p.depth = s.depth AND p.k = s.k), kids AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS kids FROM e GROUP BY ALL),
  v AS (SELECT n.*, coalesce(kids, 0) AS n_children, (n.n_convs - 1) * n.chars AS saved FROM n LEFT JOIN kids USING (depth, k)),
  u AS (SELECT s.depth, s.k, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens FROM v JOIN s ON s.conv_id = v.conv_id AND s.depth <= v.depth GROUP BY s.depth, s.k)
  SELECT v.conv_id, v.depth::BIGINT AS depth, e.parent AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256 FROM v JOIN u USING (depth, k) LEFT JOIN e USING (depth, k)"""
_OP12 = f"""WITH RECURSIVE f AS (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS fields FROM documents),
  d AS (SELECT doc_id, coalesce('=' || source, '') AS key, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, fields FROM f),
  a AS (SELECT doc_id, key, leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 AND low IS NOT NULL THEN sha256(fields || strlen(low) || ':' || low) ELSE leaf END AS altered, row_number() OVER (PARTITION BY key ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM d),
  t AS (SELECT key, 0 AS level, pos AS idx, leaf AS hash, n FROM a UNION ALL SELECT key, level + 1, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY key, level, n, idx // 16),
  s AS (SELECT key, hash AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1), w AS (SELECT 0 AS level, pos AS idx, subroot AS hash, n FROM s UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (n + 15) // 16 FROM w WHERE n > 1 GROUP BY level, n, idx // 16),
  tops AS (SELECT key, max(level) AS top FROM t GROUP BY key), runs AS (SELECT t.key, t.level, t.idx // 16 AS up, list(hash ORDER BY idx) AS run FROM t WHERE n > 1 GROUP BY ALL UNION ALL SELECT s.key, tops.top + w.level, w.idx // 16, list(w.hash ORDER BY w.idx) FROM s JOIN tops USING (key) JOIN w ON w.n > 1 AND w.idx // 16 = s.pos // (16 ** (w.level + 1))::BIGINT GROUP BY ALL),
  g AS (SELECT a.doc_id, a.key, 0 AS level, a.altered AS folded, '' AS proof, a.pos AS idx, s.pos AS spos, tops.top FROM a JOIN s USING (key) JOIN tops USING (key)
    UNION ALL SELECT g.doc_id, g.key, g.level + 1, sha256(array_to_string(list_concat(run[:idx % 16], [folded], run[idx % 16 + 2:]), '')), proof || array_to_string(list_concat(run[:idx % 16], run[idx % 16 + 2:]), ''), CASE WHEN g.level + 1 = top THEN spos ELSE idx // 16 END, spos, top
    FROM (SELECT doc_id, key, level, folded, proof, CASE WHEN level = 0 AND top = 0 THEN spos ELSE idx END AS idx, spos, top FROM g) g JOIN runs ON runs.key = g.key AND runs.level = g.level AND runs.up = g.idx // 16),
  z AS (SELECT doc_id, max(level) AS level FROM g GROUP BY doc_id)
  SELECT a.doc_id, a.leaf, s.subroot, r.hash AS root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = r.hash AS verified FROM a JOIN s USING (key) JOIN z USING (doc_id) JOIN g ON g.doc_id = z.doc_id AND g.level = z.level, (SELECT hash FROM w WHERE n = 1) r"""

_OP13 = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
  s AS (SELECT *, md5(string_agg(word, ' ') OVER f) AS k, count(*) OVER f AS size FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
  e AS (SELECT k, min(doc_id) AS first FROM s WHERE size = 50 GROUP BY k), g AS (SELECT s.*, coalesce(size = 50 AND first < doc_id, false) AS hit FROM s LEFT JOIN e USING (k)),
  r AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
  t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express whole, on unique ids as in the given tables."""
    return {"op9_covertree": _OP9, "op11_prefix_trie": _OP11, "op12_merkle": _OP12, "op13_substrings": _OP13}
