"""Page plug-ins against the plain reader, and the index of embedded chunks by hand."""

import json

import pytest

import __spark_entry__ as entry
from sievewright.sources import html, plugins

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    plugins.register(spark)
    return spark.read.parquet(f"{SMALL}/pages.parquet")


def plain(pages, reader):
    """Items of every page by the reader's own function, page by page."""
    return sorted((r.url, *row[:3], n) for r in pages.collect() for n, row in enumerate(html.READERS[reader](r.html or "", r.url or "")))


def test_queries_give_every_item(spark, pages):
    by_id = {r.page_id: r for r in pages.collect()}
    want = sorted((p, row[0], row[1], row[2] or "", n) for p, r in by_id.items() for n, row in enumerate(html.READERS["listing"](r.html or "", r.url or "")))
    got = entry.queries()["page_links"](spark, SMALL).collect()
    assert sorted((r.page_id, r.url, r.title, r.summary or "", r.ord) for r in got) == want
    got = entry.queries()["page_listings"](spark, SMALL).collect()
    assert sorted((r.page, r.url, r.title, r.ord) for r in got) == sorted((p, u, t, n) for p, u, t, _, n in plain(pages, "listing"))
    assert want and got


def test_source_reads_files_filters_and_limits(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2), ("empty", 0)):
        body = "".join(f"<a href='/{name}{i}'>A long enough title {i}</a>" for i in range(n))
        rows = [{"url": f"https://{name}.org/", "html": body}, {"url": None, "html": None}, {"url": "https://x.org/", "html": "<p>é日本"}]
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")
    (tmp_path / "_SUCCESS").write_text("")
    read = lambda **o: spark.read.format("page_items").options(**o).load(str(tmp_path))
    assert sorted(r.url for r in read().collect()) == [f"https://{x}.org/{x}{i}" for x, n in (("a", 3), ("b", 2)) for i in range(n)]
    assert read().rdd.getNumPartitions() == 3
    one = read().where(f"file = '{tmp_path}/b.json'")
    assert [r.title for r in one.orderBy("ord").collect()] == ["A long enough title 0", "A long enough title 1"]
    assert read(limit=1).count() == 2 and read(limit=0).count() == 0
    assert read(rules=json.dumps({"include": ["a1$"]})).count() == 1
    empty = tmp_path / "nothing"
    empty.mkdir()
    assert spark.read.format("page_items").load(str(empty)).count() == 0
    with pytest.raises(Exception, match="unknown reader"):
        read(reader="poem").count()


def test_table_function_on_odd_rows(spark, pages):
    rows = spark.createDataFrame([(1, None, None), (2, "", "u"), (3, "<h3 id=a>Section title</h3>Some text", None)], "id long, html string, page string")
    got = spark.sql("SELECT r.id, i.title FROM {r} r, LATERAL page_items(r.html, r.page, 'sections') i", r=rows).collect()
    assert all(r.id == 3 for r in got)


def test_embedded_index_by_hand(spark):
    from sievewright.functions.arrow import chunk_text
    from tests.test_brute import embedded

    chunks = {(str(r.doc_id), i): t for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() for i, t in enumerate(chunk_text(r.text))}
    ids = {(r.article_id, r.position): r.id for r in entry.queries()["chunk_paragraph"](spark, SMALL).collect()}
    assert set(ids) == set(chunks)
    vectors = {ids[k]: embedded(t) for k, t in chunks.items()}
    got = entry.queries()["embedded_index"](spark, SMALL).collect()
    asked = sorted(spark.read.parquet(f"{SMALL}/benchmark.parquet").collect(), key=lambda r: r.item_id)[:6]
    for r in asked:
        qv = embedded(r.text)
        scores = {c: round(sum(a * b for a, b in zip(qv, v)), 6) for c, v in vectors.items()}
        want = sorted(scores, key=lambda c: (-scores[c], c))[:5]
        assert [x.chunk_id for x in sorted((x for x in got if x.query_id == r.item_id), key=lambda x: x["rank"])] == want
