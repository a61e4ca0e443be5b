"""Every query with SQL gives DuckDB's rows; the others run."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        elif out[c].dtype == float:
            out[c] = out[c].map(lambda x: "nan" if x != x else f"{x:.9g}")
        else:
            out[c] = out[c].astype(str).replace("<NA>", "nan")
    return sorted(map(tuple, out.values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


OWN = [q for q in entry.catalog.QUERIES]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.catalog.QUERIES[name](spark, SMALL).toPandas()
    if name in entry.catalog.SQL:
        want = duck.execute(entry.catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_source_rows_read_a_table(spark, duck):
    assert entry.catalog.QUERIES["source_rows"](spark, SMALL).count() == duck.execute("SELECT count(*) FROM supplier").fetchone()[0]


@pytest.mark.parametrize("name", ["event_profile", "value_score", "selection_reasons", "key_signal_gate"])
def test_negators_before_emoji_and_chinese_terms(spark, tmp_path, name):
    titles = ("Not " + "😀" * 70 + " an acquisition", "They did not收购 a startup", "An acquisition")
    pd.DataFrame({"doc_id": [4, 14, 24], "text": [f"{t}\nand more" for t in titles], "lang": "en", "source": "web", "n_chars": 9}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert rows(entry.catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(entry.catalog.SQL[name]).df())


@pytest.mark.parametrize("name", ["event_profile", "value_score", "key_signal_gate"])
def test_scores_read_whole_texts(spark, tmp_path, name):
    """Of two documents that differ after 6,000 characters only, the one with signals there scores otherwise."""
    told = "A title\n" + "word " * 1200
    tail = "We introduce a new benchmark. It outperforms the baseline by 40% and sees adoption by 3 million users."
    pd.DataFrame({"doc_id": [4, 4 + 3720], "text": [told, told + tail], "lang": "en", "source": "web", "n_chars": 9}).to_parquet(tmp_path / "documents.parquet")
    got = entry.catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    plain, whole = (r[1:] for r in got.sort_values("id").drop(columns="id").itertuples())
    assert plain != whole
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert rows(got) == rows(con.execute(entry.catalog.SQL[name]).df())


@pytest.mark.parametrize("title, negated", [
    ("They do not see, with no change, " + "x" * 100 + " an acquisition", True), ("Noël acquisition", False), ("No noël " + "é" * 105 + " an acquisition", True), ("No " + "x" * 119 + ",acquisition", False),
    ("No " + "x" * 119 + "acquisition", False), ("No " + "x" * 118 + " acquisition", True), ("Not one. An acquisition", False), ("No, no, no, " + "de " * 38 + "acquisition", True), ("没有" + "的" * 119 + "收购", True), ("没有" + "的" * 121 + "收购", False),
    ("İacquisition", False), ("Noé收购", False),
])
def test_negators_within_another_ones_reach(spark, tmp_path, title, negated):
    pd.DataFrame({"doc_id": [4], "text": [title], "lang": "en", "source": "web", "n_chars": 9}).to_parquet(tmp_path / "documents.parquet")
    got = entry.catalog.QUERIES["event_profile"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert rows(got) == rows(con.execute(entry.catalog.SQL["event_profile"]).df())
    term = not negated and not title.endswith("xacquisition")
    assert (got.types[0] == "market_structure") == term
