"""Queries that SQL can't express, against plain Python on the smallest tables."""

import hashlib
import html
import math
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


def result(spark, name):
    return entry.catalog.QUERIES[name](spark, SMALL).collect()


def embedded(text):
    """A text's vector by the recipe's fixed values: BLAKE2b of trigrams, four bytes for the place, a bit for the sign."""
    folded = " ".join(text.casefold().split())
    grams = {folded[i : i + 3] for i in range(max(1, len(folded) - 2))}
    places = defaultdict(int)
    for gram in grams:
        often = sum(folded.startswith(gram, i) for i in range(max(1, len(folded) - 2)) if len(folded[i : i + 3]) == len(gram))
        digest = hashlib.blake2b(gram.encode(), digest_size=8).digest()
        places[int.from_bytes(digest[:4], "big") % 384] += often if digest[4] % 2 else -often
    size = math.hypot(*places.values())
    return [places[i] / size if size else 0.0 for i in range(384)]


def test_text_embeddings(spark, table):
    from sievewright.functions.arrow import hashing_embedder

    for r in result(spark, "text_embeddings"):
        assert r.n == 384 and abs(r.norm - 1) < 1e-6
    frame = spark.createDataFrame([(t,) for t in ("", "a", "ab", "Straße und mehr", None, *[x.text for x in table("benchmark")[:5]])], "text string")
    for r in frame.select("text", hashing_embedder()("text").alias("v")).collect():
        assert r.v is None if r.text is None else max(abs(a - b) for a, b in zip(r.v, embedded(r.text))) < 1e-12


def test_chunk_paragraph(spark, table):
    """Chunks are pieces of the text, at most 900 long; each ends at the last break of its second half, if it has one."""
    from sievewright.functions.arrow import chunk_text

    rows = {str(r.doc_id): r.text for r in table("documents")}
    chunks = defaultdict(list)
    for r in result(spark, "chunk_paragraph"):
        chunks[r.article_id].append(r.position)
    for doc, text in rows.items():
        plain = "\n\n".join(p for p in map(str.strip, text.split("\n\n")) if p)
        made = chunk_text(text)
        assert sorted(chunks[doc]) == list(range(len(made)))
        at = 0
        for k, piece in enumerate(made):
            start = plain.index(piece, max(0, at - 900))
            assert len(piece) <= 900 and start <= at
            window = plain[start : start + 900]
            if k < len(made) - 1 and "\n\n" in window[450:898]:
                assert plain[start + len(piece) :].lstrip(" ").startswith("\n\n") or "\n\n" in piece
            at = start + len(piece)
        assert not made or plain.endswith(made[-1])


def test_claims_citations(spark, table):
    want = []
    for r in table("conversations"):
        if r.role != "assistant":
            continue
        answer = r.text + " First claim [1]. Second claim [9]! Head: Third?"
        parts = [p.strip(" \t-*•") for p in re.split(r"(?<=[。！？!?；;])(?!\s*\[\d+\])\s*|\n+", answer)]
        for i, p in enumerate([p for p in parts if p]):
            cited = [int(x) for x in re.findall(r"\[(\d+)\]", p)]
            want.append((r.conv_id, r.turn, i, bool(cited) or not re.search("[:：]$", p.rstrip(" ")), bool(cited), bool(cited) and all(1 <= x <= 3 for x in cited)))
    assert sorted(map(tuple, result(spark, "claims_citations"))) == sorted(want)


UNREAD = "script style noscript svg nav header footer form"
LINE = "article blockquote br div h1 h2 h3 li p section"


def test_html_readable_text(spark, table):
    """The given pages, whose elements are closed in order, by cutting and splitting the markup."""
    got = {r.page_id: r.text for r in result(spark, "html_readable_text")}
    checked = 0
    for r in table("pages"):
        cut = re.sub("<!--.*?-->|<!doctype[^>]*>", "", r.html, flags=re.S | re.I)
        for name in UNREAD.split():
            inner = re.compile(rf"<{name}(?:\s[^>]*)?>(?:(?!<{name}[\s>]).)*?</{name}\s*>", re.S | re.I)
            while inner.search(cut):
                cut = inner.sub("", cut)
        if re.search(rf"</?(?:{UNREAD.replace(' ', '|')})\b", cut, re.I):
            continue  # left open somewhere
        pieces = re.split(rf"</?(?:{LINE.replace(' ', '|')})(?:[\s/][^>]*)?>", cut, flags=re.I)
        lines = [" ".join(line.split()) for piece in pieces for line in html.unescape(re.sub("<[^>]*>", "", piece)).splitlines()]
        assert got[r.page_id] == "\n".join(line for line in lines if line)[:12_000]
        checked += 1
    assert checked >= 0.8 * len(got)


@pytest.mark.parametrize("page, lines", [
    ("<p>One  two</p>three<br>four", ["One two", "three", "four"]), ("a<span>b</span>c<div>d", ["abc", "d"]), ("<nav>menu<p>x</p></nav><h2>Head &amp; line</h2>", ["Head & line"]),
    ("<header><nav>a</nav>b</header>c", ["c"]), ("<script>if (a<b) x('</p>')</script>y", ["y"]), ("a<svg><p>no</p></svg>b", ["ab"]), ("", []), ("<footer>all", []),
    ("<nav></header>x", []),  # an unread element ends at its own end tag, so what follows a wrong one stays unread
    ("<nav>a</nav></nav>x", ["x"]), ("<ul><li>1<li>2</ul>", ["1", "2"]), ("x\ny", ["x", "y"]),
])
def test_readable_lines(page, lines):
    from sievewright.sources import html as pages

    assert pages.readable_text(page).splitlines() == lines


def test_uncut_readable_text():
    from sievewright.sources import html

    page = "<p>" + "word " * 5000 + "</p>" + "<div>" * 3000 + "end"
    assert html.readable_text(page, None) == " ".join(["word"] * 5000) + "\nend" and len(html.readable_text(page)) == 12_000
    assert len(html.sections(f"<h3 id=a>Title</h3>{'x' * 9000}", "http://e/", longest=None)[0][2]) == 9000


def test_enrichment_priority(spark):
    from sievewright.operators import selection
    from sievewright.plans import catalog

    rows = {r.id: r for r in selection.priority_rows(catalog.scored_articles(spark, SMALL)).select("id", "ord", "source_id", "priority").collect()}
    batches = defaultdict(list)
    for r in result(spark, "enrichment_priority"):
        batches[r.batch].append((r.turn, r.id))
    for placed in batches.values():
        order = [rows[i] for _, i in sorted(placed)]
        used, seen = defaultdict(int), []
        for k, r in enumerate(order):
            left = order[k:]
            free = [x for x in left if not (k > 1 and x.source_id == seen[-1] == seen[-2])] or left
            best = max(x.priority - used[x.source_id] for x in free)
            assert r in free and r.priority - used[r.source_id] == best
            used[r.source_id] += 1
            seen.append(r.source_id)


def test_diversify_feed(spark):
    pages = defaultdict(list)
    for r in result(spark, "diversify_feed"):
        pages[r.page].append((r.shown_at, r.id))
    source = dict((f"doc-{r.ord}", f"s{r.s}") for r in spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id as ord", "xxhash64(doc_id) % 3 as s").collect())
    for placed in pages.values():
        assert [n for n, _ in sorted(placed)] == list(range(1, len(placed) + 1)) and len({i for _, i in placed}) == len(placed)
        shown = [source[i] for _, i in sorted(placed)]
        counts = sorted((shown.count(s) for s in set(shown)), reverse=True)
        triples = sum(a == b == c for a, b, c in zip(shown, shown[1:], shown[2:]))
        if counts[0] <= 2 * (len(shown) - counts[0] + 1):
            assert triples == 0


def test_fetch_addresses():
    from sievewright.sources.external import public_address

    for url in ("http://example.org/", "https://localhost/x", "https://LOCALHOST./", "https://127.0.0.1/", "https://10.1.2.3/", "https://[::1]/", "https://169.254.1.1/", "https://0.0.0.0/", "ftp://x", "https://", "https://[bad", "https://x.localhost/"):
        assert not public_address(url), url
    assert public_address("https://8.8.8.8/") and public_address("https://[2606:4700::1111]/")


def test_index_checks(spark, tmp_path):
    from pyspark.sql import functions as F

    from sievewright.sources import store

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, e array<double>")
    index = store.build_index(rows, lambda c: c, "e")
    store.write_index(index, str(tmp_path / "a"), "s", "m", 2, "v1")
    assert store.load_index(spark, str(tmp_path / "a"), "m", 2, "v1").count() == 2
    for bad in ({"model": "other"}, {"dimensions": 3}, {"chunking": "v2"}):
        with pytest.raises(ValueError):
            store.load_index(spark, str(tmp_path / "a"), **bad)
    with pytest.raises(ValueError):
        store.write_index(index.withColumn("vector", F.when(F.col("id") == 1, F.col("vector"))), str(tmp_path / "b"), "s", "m", 2, "v1")
    with pytest.raises(Exception):
        store.load_index(spark, str(tmp_path / "b"))


def test_package_and_terms(spark, tmp_path):
    from sievewright.sources import store

    (tmp_path / "o.json").write_text('{"content_hash": "a", "title_zh": "t"}\n{"content_hash": "b"}\n')
    assert store.load_overlay(spark, str(tmp_path / "o.json")).count() == 2
    (tmp_path / "p.json").write_text('{"content_hash": "a"}\n{"content_hash": "a"}\n')
    with pytest.raises(ValueError):
        store.load_overlay(spark, str(tmp_path / "p.json"))
    (tmp_path / "t.json").write_text('{"source": "x", "preferred": "y", "aliases": ["z"]}\n{"source": "x"}\n{"source": "u", "preferred": "v"}\n')
    assert [tuple(r) for r in store.load_terms(spark, str(tmp_path / "t.json")).collect()] == [("x", "y", ["z"]), ("u", "v", [])]
    assert store.load_ledger(spark, str(tmp_path / "none")) is None


def test_html_readable_text_is_whole(spark, tmp_path):
    from sievewright.plans import catalog

    words = " ".join(["word"] * 5000)
    spark.createDataFrame([(1, "http://e/", f"<p>{words}</p><p>end</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (row,) = catalog.QUERIES["html_readable_text"](spark, str(tmp_path)).collect()
    assert (row.page_id, row.text, row.size) == (1, f"{words}\nend", 25_003)
