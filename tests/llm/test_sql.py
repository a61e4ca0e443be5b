import duckdb

from sievewright.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_archive_rows(spark, tmp_path):
    """Pages, some of them again under other ids, against SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{SMALL}/pages.parquet' UNION ALL SELECT page_id + 1000, url, html FROM '{SMALL}/pages.parquet' WHERE page_id % 3 = 0 UNION ALL SELECT 2000, 'http://x/', NULL UNION ALL SELECT 2001, NULL, ''")
    con.execute(f"COPY (SELECT * FROM pages) TO '{tmp_path}/pages.parquet' (FORMAT PARQUET)")
    want = con.execute(queries.OP3).fetchall()
    got = queries.op3_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.refers_to is not None for r in got)


def test_links(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op9_covertree"]).fetchall()
    assert sorted(tuple(r) for r in queries.op9_covertree(spark, SMALL).select("vec_id", "n_links", "component_id", "kept").collect()) == sorted(want)
