import corpus_pipeline as pipeline
from sievewright.llm import langid

from test_simhash import check_kept

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = pipeline.identify_language(spark, table, SMALL)
    assert first.columns == list(pipeline.COLUMNS)
    kept = {r.doc_id for r in first.collect()}
    marked = {r.doc_id: r for r in langid.identify(table).collect()}
    assert kept == {d for d, r in marked.items() if r.lang_pred != "und" and r.certainty >= pipeline.MIN_CERTAINTY} and len(kept) > 0.95 * table.count()
    second = pipeline.drop_near_duplicates(spark, first, SMALL)
    groups = {r.doc_id for r in second.collect()}
    check_kept([(r.doc_id, r.text) for r in first.collect()], [(r.doc_id, r.text) for r in second.collect()])
    third = pipeline.mix_sources(spark, second, SMALL)
    assert third.columns == list(pipeline.COLUMNS) and {r.doc_id for r in third.collect()} <= groups
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "mixing", "packing"]


def test_run(spark):
    rows = pipeline.run(spark, SMALL).collect()
    assert len(rows) > 0 and {"doc_id", "start", "length", "sequence_id"} <= set(rows[0].asDict())


def test_odd_rows(spark, docs):
    frame = docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")
    for _, stage in pipeline.STAGES:
        for rows in (frame, frame.limit(0)):
            stage(spark, rows, SMALL).collect()
