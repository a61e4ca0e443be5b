"""Substring removal against brute force and SQL; the index against plain search."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.llm import queries, substrings
from sievewright.llm.fm_index import FmIndex, Wavelet

SMALL = "/root/testdata/sf0.001"


def removed(rows):
    """rows(doc_id, text) -> doc_id, n_words, n_removed, digest, window by window."""
    texts = [(d, (t or "").encode("utf-8", "replace").split()) for d, t in rows]
    first = {}
    for d, words in texts:
        if d is not None:
            for i in range(len(words) - 49):
                window = tuple(words[i : i + 50])
                first[window] = min(d, first.get(window, d))
    out = []
    for d, words in texts:
        gone = set()
        for i in range(len(words) - 49):
            if d is not None and first[tuple(words[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit("x"), "tid": F.lit(1), "n_words": F.lit(2), "marks": F.array(F.lit(1))})
    return sorted(map(tuple, substrings.remove_repeats(docs.repartition(3), **options).collect()), key=str)


def prose(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed):
    """Exact and edited copies, shared passages around the threshold, repeats inside a text."""
    draw = random.Random(seed)
    passages = [prose(draw, n) for n in (48, 49, 50, 51, 60, 120, 300)]
    rows = []
    for d in range(120):
        words = prose(draw, draw.randrange(0, 160))
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(words) + 1)
            words[at:at] = draw.choice(passages)
        if rows and d % 4 == 0:
            words = rows[draw.randrange(len(rows))][1].split()
            for _ in range(draw.randrange(4) if words else 0):
                words[draw.randrange(len(words))] = "edit"
        rows.append((draw.randrange(500), draw.choice([" ", "\n", "\t ", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"limit": 1, "shard": 5}, {"limit": 4, "shard": 40}])
def test_removal(spark, options):
    rows = corpus(len(options))
    want = removed(rows)
    assert run(spark, rows, **options) == want
    assert sum(r[2] > 0 for r in want) > 20


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    same = "word " * 3000
    rows = [(None, passage), (5, passage), (6, "x " + passage + " y"), (6, "z " + passage), (7, None), (8, ""), (9, " \n\t"), (10, same), (11, same), (12, same + "end"), (5, passage), (5, passage), (None, None)]
    rows += [(13, "ß é 日本 " * 40), (14, "ß é 日本 " * 39 + "ß"), (15, "q" * 3_000_000 + " " + passage)]
    assert run(spark, rows) == removed(rows)
    assert run(spark, rows, limit=1, shard=2) == removed(rows)
    assert run(spark, [(1, "a")]) == removed([(1, "a")])
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert substrings.remove_repeats(docs).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.op13_substrings(spark, SMALL)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op13_substrings']})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \t\x0b\x1c\x85aé日x", max_size=60), st.integers(1, 9))
def test_word_hashes_over_pieces(text, piece):
    """Words are ASCII white space's; pieces of any size give the same hashes."""
    octets = text.encode()
    whole, begins = substrings.word_hashes(octets)
    words = octets.split()
    assert len(whole) == len(words) and all(octets[b : b + len(w)] == w for b, w in zip(begins, words))
    assert len(set(zip(whole.tolist(), words))) == len(set(words)) == len(set(whole.tolist()))
    before = substrings.PIECE
    try:
        substrings.PIECE = piece
        again, places = substrings.word_hashes(octets)
    finally:
        substrings.PIECE = before
    assert again.tolist() == whole.tolist() and places.tolist() == begins.tolist()


def test_equal_windows_share_a_mark():
    draw = random.Random(5)
    shared = prose(draw, 50, 30)
    for _ in range(40):
        made = []
        for _ in range(2):
            words = prose(draw, draw.randrange(90), 30) + shared + prose(draw, draw.randrange(90), 30)
            hashes = substrings.word_hashes(" ".join(words).encode())[0]
            made.append(set(substrings.marks(hashes, np.array([0, len(hashes)]))[2].tolist()))
        assert made[0] & made[1]


def test_wavelet_ranks():
    draw = np.random.default_rng(2)
    symbols = draw.integers(0, 37, 1000)
    tree = Wavelet(symbols, 6)
    c, at = draw.integers(0, 37, 500), draw.integers(0, 1001, 500)
    assert tree.ranks(c, at).tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(c, at)]


@pytest.mark.parametrize("alphabet", [1, 2, 4, 40])
def test_matching_statistics(alphabet):
    """Lengths and first suffixes of matches, up to the cap, by plain search; queries with unknown symbols too."""
    draw = np.random.default_rng(alphabet)
    cap = 6
    for _ in range(20):
        text = np.concatenate([np.append(draw.integers(1, alphabet + 1, draw.integers(1, 40)), 0) for _ in range(4)])
        index = FmIndex(text, cap)
        queries_ = draw.integers(0, alphabet + 2, (7, 25))
        for column, low, length in index.matches(queries_):
            for row in range(len(queries_)):
                best = 0
                while best < cap and column + best < 25 and _inside(text, queries_[row, column : column + best + 1]):
                    best += 1
                assert length[row] == best
                if best:
                    at = index.order[low[row]]
                    assert text[at : at + best].tolist() == queries_[row, column : column + best].tolist()
                    assert not low[row] or text[index.order[low[row] - 1] :][:best].tolist() != text[at : at + best].tolist()


def _inside(text, run):
    return (run > 0).all() and any((text[i : i + len(run)] == run).all() for i in range(len(text) - len(run) + 1))
