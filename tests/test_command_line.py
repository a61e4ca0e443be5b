"""Commands over published versions, texts and article tables."""

from pyspark.sql import functions as F

from sievewright.__main__ import main
from sievewright.plans import catalog
from sievewright.sources import store

SMALL = "/root/testdata/sf0.001"


def test_validate_snapshot(spark, tmp_path, capsys):
    root = str(tmp_path / "root")
    good = spark.createDataFrame([("a", "u1", "h1"), ("b", "u2", "h2")], "id string, canonical_url string, content_hash string")
    store.publish(spark, root, "v1", {"articles": good})
    assert main(["validate-snapshot", root]) == 0 and "articles=2" in capsys.readouterr().out
    good.withColumn("content_hash", F.lit("h1")).write.parquet(f"{root}/versions/v2/articles")  # past the check of publish
    assert main(["validate-snapshot", root, "--id", "v2"]) == 1 and "duplicate_articles_content_hash" in capsys.readouterr().err
    assert main(["validate-snapshot", root, "--id", "v3"]) == 2 and main(["validate-snapshot", str(tmp_path / "none")]) == 2


def test_build_index(spark, tmp_path, capsys):
    texts = str(tmp_path / "texts")
    spark.createDataFrame([("a", "One.\n\nTwo."), ("b", "x" * 2000), ("c", ""), ("d", None)], "article_id string, text string").write.parquet(texts)
    assert main(["build-index", texts, "--out", str(tmp_path / "index")]) == 0 and "4 chunks" in capsys.readouterr().out
    index = store.load_index(spark, str(tmp_path / "index"), "hashing-384", 384)
    assert {r.article_id for r in index.collect()} == {"a", "b"} and all(len(r.vector) == 384 for r in index.collect())
    assert main(["build-index", texts, "--out", str(tmp_path / "index")]) == 1
    assert main(["build-index", str(tmp_path / "none"), "--out", str(tmp_path / "other")]) == 2


def test_compare_quality(spark, tmp_path, capsys):
    old, new, bad, sources = (str(tmp_path / n) for n in ("old", "new", "bad", "sources"))
    rows = catalog.articles(spark, SMALL)
    catalog.with_ready(rows, 3).write.parquet(old)
    catalog.with_ready(rows, 3).write.parquet(new)
    catalog.with_ready(rows.where("ord % 2 = 0"), 40).write.parquet(bad)
    catalog.sources(spark, SMALL).write.parquet(sources)
    at = ["--sources", sources, "--at", "2024-02-01 00:00:00"]
    assert main(["compare-quality", old, new, *at]) in (0, 1) and "gate" in capsys.readouterr().out
    assert main(["compare-quality", old, bad, *at]) == 1 and "gate fail" in capsys.readouterr().out
    assert main(["compare-quality", old, str(tmp_path / "none"), *at]) == 2
