import base64
import hashlib
import struct
import zipfile
import time
import zlib

import numpy as np
import pytest

from sievewright.llm import covertree, html_blocks, html_training, mixing, warc_zip

SMALL = "/root/testdata/sf0.001"

PAGES = [
    (1, "http://a/1", "<article><h1>Head &amp; line</h1><p>One  two&nbsp;three.<p>Four</article>"), (2, None, ""), (3, "http://a/3", None), (None, "http://a/4", "<article><h1>Head</h1><p>Text.</p></article>"),
    (5, "http://a/5", "<article><h1>Head</h1><p>Text.</p></article>"), (4, "http://a/4\n", "<article><h1>Head</h1><p>Text.</p></article>"), (4, "x", "<article><h1>Head</h1><p>Text.</p></article>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "uri": F.lit(1), "same": F.lit(2)})


@pytest.fixture(scope="module")
def model():
    return html_blocks.labeller()


def test_gradients():
    small, data = html_blocks.Labeller(4, 3), html_training.labelled(3, 5)
    p, y = [d[0] for d in data], [d[1] for d in data]
    _, slope = html_training.gradients(small, p, y)
    for k in ("hf", "hb", "xf", "cb", "out", "path", "word"):
        i = np.unravel_index(np.abs(slope[k]).argmax(), slope[k].shape)
        small.p[k][i] += 1e-5
        up, _ = html_training.gradients(small, p, y)
        small.p[k][i] -= 2e-5
        down, _ = html_training.gradients(small, p, y)
        small.p[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - slope[k][i]) < 1e-6


def test_held_out_pages(model):
    data = html_training.labelled(150, 999)
    right = np.concatenate([(s >= 0.5) == (y > 0) for s, (_, y) in zip(model.probabilities([d[0] for d in data]), data)])
    assert right.mean() > 0.99


def test_page_text(spark, pages, model):
    rows = {(r.page_id, r.url): r for r in html_blocks.extract(pages, model).collect()}
    assert rows[1, "http://a/1"].text == "Head & line\nOne two three.\nFour" and rows[2, None].text == "" and rows[3, "http://a/3"].n_chars == 0
    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in html_blocks.extract(table, model).collect():
        assert r.n_chars == len(r.text) > 0 and "track(" not in r.text and "©" not in r.text
    assert html_blocks.extract(pages.limit(0), model).count() == 0


def test_surroundings_are_left_out(model):
    page = (
        "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>A title of this page</h1><p>A first paragraph with several words in it.</p><div class=ad>Buy now</div><p>A second paragraph, also with words.</p></article>"
        "<aside><p>Popular posts</p></aside><section id=comments><div class=comment><p>Great post</p></div></section><form><label>Email</label><button>Go</button></form><footer>&copy; x</footer></body></html>"
    )
    assert html_blocks.main_text([page], model) == ["A title of this page\nA first paragraph with several words in it.\nA second paragraph, also with words."]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><meta charset=utf-8><body><p>One two.</p><p>Three.</p></body></html>", "<html><head><title>t</title><script>x</script><p>One two.</p><p>Three.</p></html>",
        "<head><title>t</title>One two.<p>Three.", "<head><title>t</title><span>One two.</span><p>Three.", "<div><p><svg viewBox='0 0 1 1'/>One two.</p><p>Three.</p></div>",
        "<div><p><math/>One two.</p><p>Three.</p></div>", "<p><svg><title/><style/><path d='M0'/><g>hidden</g></svg>One two.</p><p>Three.</p>", "<p><svg id=a/>hidden</svg>One two.</p><p>Three.</p>",
    ],
)
def test_open_heads_and_self_closed_elements(page):
    assert [b.text for b in html_blocks.leaves(page)] == ["One two.", "Three."]


@pytest.mark.parametrize(
    "page",
    [
        "<p title=don't>One two.</p><p title=won't>Three.</p>", "<!--><p>One two.</p><p>Three.</p>", "<!---><p>One two.<p>Three.", "<!-- a > b <p>no</p> --><p>One two.</p><p>Three.</p>",
        "<p title=\"a>b\">One two.</p><p data-x='</p>'>Three.</p>", "<p title=\"it's\" class = 'x\"y'>One two.</p><p a=1 b=\"'\">Three.", "<p>One two.</p><p a= b=c/>Three.", "<P CLASS=X>One two.</P><br><!doctype html><p>Three.",
        "<p>One <b>two</i>.</p></div></section><p>Three.</p></body>", "<p>One&#32;two.<table><td>Three.</table>", "<p>One\n\n two.</p><![CDATA[ x ]]><p>Three.</p>",
    ],
)
def test_broken_markup(page):
    assert [b.text for b in html_blocks.leaves(page)] == ["One two.", "Three."]


def test_deep_nesting_shares_paths():
    blocks = html_blocks.leaves("<div class=x>a" * 3000)
    assert len(blocks) == 3000 and blocks[-1].path.size == 6000 and blocks[-1].path.seen is blocks[-2].path.seen
    own = html_blocks.leaves("<section id=main-part><p>a")[0].path
    parts = ["section", ".main", ".part", "p"]
    assert sorted(own.buckets()) == sorted({*(zlib.crc32(p.encode()) % html_blocks.PATHS for p in parts), zlib.crc32(b"leaf:.part/p") % html_blocks.PATHS})


@pytest.mark.parametrize("page, texts", [
    ("<svg><path d='x'><p>Main text</p><p>more</p>", ["Main text", "more"]),
    ("<svg width=1/><b>bold</b> text", ["bold text"]),
    ("<p>a<math><mi>x</p><p>b</p>", ["a", "b"]),
    ("<svg><foreignObject><p>in</p><div>too</div></foreignObject><text>t</text></svg><p>out</p>", ["out"]),
    ("<svg><desc><p>in</desc><g></svg>out", ["out"]),
    ("<p>a <svg><title>t</title><g/><text>no</text></svg> b</p>", ["a", "b"]),
    ("<svg><font>x</font><font color=red>y</font>z", ["yz"]),
    ("<svg><svg><math><a>x</a></br>y", ["y"]),
    ("<math><svg><table><tr><td>cell", ["cell"]),
    ("<template><svg><p>still hidden</p></svg></template>shown", ["shown"]),
    ("</svg></math>a</foreignobject>b", ["ab"]),
])
def test_foreign_content_ends(page, texts):
    assert [b.text for b in html_blocks.leaves(page)] == texts


def test_deep_and_unmatched_markup_is_linear():
    began = time.perf_counter()
    for page, n in (("<div>x" * 100_000, 100_000), ("<div>x" * 30_000 + "</section>" * 30_000, 30_000), ("<svg>" * 30_000 + "<g/>" * 30_000 + "<p>x", 1)):
        blocks = html_blocks.leaves(page)
        assert len(blocks) == n and len(html_blocks.Page(blocks).paths) == n
    assert time.perf_counter() - began < 30


def test_main_text_of_generated_pages(model):
    """Whole texts against the generator's marks, on pages that training doesn't see, in whole and broken markup."""
    right, n = 0, 120
    for i in range(n):
        page = html_training.Generator(70_000 + i).page()
        if i % 2:
            page = page.replace("</p>", "").replace("</li>", "").replace("</head>", "").replace("</html>", "")
        want = "\n".join(" ".join(b.text.replace(html_training.MAIN, "").split()) for b in html_blocks.leaves(page) if html_training.MAIN in b.text)
        clean = page.replace(html_training.MAIN, "").replace(html_training.REST, "")
        right += html_blocks.main_text([clean], model) == [want]
    assert right >= 0.9 * n


@pytest.mark.parametrize("url", ["http://x.org/a {b", 'http://x.org/{"a": 1} {', "no url at all", "http://[bad", "", "http://x.org/\u2028 ü"])
def test_odd_urls(tmp_path, url):
    writer = warc_zip.PackageWriter(str(tmp_path / "x.wacz"))
    writer.add("response", url, 1, b"one", None)
    writer.add("response", url, None, b"two", None)
    writer.add("revisit", url, 2, b"one", 1)
    writer.close()
    reader = warc_zip.PackageReader(str(tmp_path / "x.wacz"))
    found = list(reader.records(sorted(reader.index(), key=lambda x: x["offset"])))
    assert [x["url"] for x in reader.index()] == [url] * 3 and [b for _, _, b in found] == [b"one", b"two", b""]
    heads = [h for h, _, _ in found]
    assert len({h["WARC-Record-ID"] for h in heads}) == 3 and heads[2]["WARC-Refers-To"] == heads[0]["WARC-Record-ID"]


def test_archive(spark, pages):
    for table in (spark.read.parquet(f"{SMALL}/pages.parquet"), pages):
        rows = table.collect()
        least = {}
        for r in rows:
            if r.page_id is not None:
                least[r.html or ""] = min(least.get(r.html or "", r.page_id), r.page_id)
        want = []
        for r in rows:
            data, first = (r.html or "").encode(), least.get(r.html or "")
            again = first is not None and r.page_id != first
            want.append((str(r.page_id), r.url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", str(first if again else None)))
        got = [(str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc_zip.archive_pages(table).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc_zip.archive_pages(pages.limit(0)).count() == 0


def test_small_payloads_are_responses(pages):
    got = warc_zip.archive_pages(pages, min_bytes=1).where("payload_bytes = 0").collect()
    assert [r.record_type for r in got] == ["response"] * 2


def test_package_is_a_zip(tmp_path):
    path = str(tmp_path / "x.wacz")
    writer = warc_zip.PackageWriter(path)
    for i in range(5):
        writer.add("response", f"http://e.org/{i}", i, f"<p>{i}</p>".encode(), None)
    writer.close()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc_zip.WARC_MEMBER, warc_zip.INDEX_MEMBER}
    reader = warc_zip.PackageReader(path)
    (one,) = [x for x in reader.index() if x["page_id"] == 3]
    ((head, _, body),) = reader.records([one])
    assert body == b"<p>3</p>" and head["WARC-Target-URI"] == "http://e.org/3"


def test_zip64_directory(tmp_path):
    """The same package with its end record's fields moved to ZIP64 records."""
    path = tmp_path / "x.wacz"
    writer = warc_zip.PackageWriter(str(path))
    writer.add("response", "http://e.org/", 1, b"body", None)
    writer.close()
    data = path.read_bytes()
    end = data.rindex(b"PK\x05\x06")
    count, size, at = struct.unpack_from("<HII", data, end + 10)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    path.write_bytes(data[:end] + wide + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    reader = warc_zip.PackageReader(str(path))
    assert [body for _, _, body in reader.records(reader.index())] == [b"body"]


def slow_links(vectors, ids, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(x, float) / np.abs(x).max() for x in (vectors[i], vectors[j]))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(ids[i], links[i], least.get(find(i)), ids[i] is not None and least.get(find(i)) == ids[i]) for i in range(len(ids))]


@pytest.mark.parametrize("block", [4096, 40])
def test_vectors(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 8))
    vectors = [(base[i % 3] + rng.normal(size=8) * 0.25).tolist() for i in range(90)] + [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [1.0], [2.0], base[0].tolist(), base[0].tolist()]
    vectors += [(base[1] * 1e300).tolist(), (base[1] * 1e-310).tolist(), [1e308, 1e308] + [0.0] * 6, [1e-320] * 8]
    ids = [*range(1, len(vectors)), None]
    frame = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    got = [tuple(r) for r in covertree.near_vectors(frame, block=block).collect()]
    assert sorted(got, key=str) == sorted(slow_links(vectors, ids), key=str)
    assert covertree.near_vectors(frame.limit(0)).count() == 0


def test_cover_tree_covers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(700))
    for n in range(len(tree.centre)):
        own = tree.order[tree.lo[n] : tree.hi[n]]
        assert tree.centre[n] in own and np.linalg.norm(x[own] - x[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-9
        kids = range(tree.child[n], tree.child[n] + tree.children[n])
        assert not tree.children[n] or (tree.centre[n] in tree.centre[kids] and sum(tree.hi[k] - tree.lo[k] for k in kids) == len(own))


def test_allocation():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "z", "4"): 1000}
    got = mixing.allocate(leaves, 200)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "3"): 50, ("b", "z", "4"): 100}
    assert mixing.allocate(leaves, 10**9) == {k: float(v) for k, v in leaves.items()}
    assert sum(mixing.allocate(leaves, 300, {("b",): 3.0}).values()) == 300
    short = mixing.allocate({("a", "x", "1"): 5, ("a", "x", "2"): 5, ("b", "z", "4"): 1000}, 100)
    assert short[("b", "z", "4")] == 90  # the siblings have no more, so the shortage goes up


@pytest.mark.parametrize("epochs", [1, 2])
def test_mixing_is_a_prefix_of_each_leaf(spark, epochs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = table.collect()
    words = {r.doc_id: len([w for w in __import__("re").split(r"[\x20\x09-\x0d]+", r.text) if w]) for r in rows}
    leaf = {r.doc_id: (f"domain{zlib.crc32(r.source.encode()) % mixing.DOMAINS}", r.lang, r.source) for r in rows}
    held = {}
    for d, path in leaf.items():
        held[path] = held.get(path, 0) + words[d]
    budget = mixing.allocate(held, sum(held.values()) * mixing.SHARE, epochs=epochs)
    want = []
    for path, b in budget.items():
        full = min(epochs, int(b // held[path]))
        rest = b - full * held[path] if full < epochs else 0
        order = sorted((hashlib.md5(f"{mixing.SEED}:{full}:{d}".encode()).hexdigest(), d) for d in leaf if leaf[d] == path)
        at = 0
        for _, d in order:
            want += [(d, e) for e in range(full)]
            if at < rest:
                want.append((d, full))
            at += words[d]
    got = [(r.doc_id, r.mix_epoch) for r in mixing.mix(table, epochs=epochs).collect()]
    assert sorted(got) == sorted(want)


def test_leaves_of_unlike_depth_and_nulls():
    assert mixing.allocate({("d", "l", "s"): 10, ("d", "l", "s", "x"): 20}, 24) == {("d", "l", "s"): 10, ("d", "l", "s", "x"): 14}
    assert mixing.allocate({("d", None): 10, ("d", "null"): 10}, 12, {("d", None): 2.0}) == {("d", None): 8, ("d", "null"): 4}


def test_mixing_columns_of_clashing_names(spark):
    rows = [(i, f"t{i} " + "w " * 9, lang, f"s\x01{i % 2}") for i, lang in enumerate((None, "null", "en") * 8)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = plain.selectExpr("*", "1 as mix_tokens", "2 as mix_domain", "3 as mix_epoch", "4 as _leaf", "5 as leaf", "6 as base", "7 as row", "8 as times", "9 as key", "10 as last", "11 as `a.b`")
    weights = {(f"domain{k}", None): 5.0 for k in range(mixing.DOMAINS)}
    one, two = (mixing.mix(f, weights, share=0.5) for f in (plain, clash))
    assert two.columns == ["doc_id", "text", "lang", "source", "_leaf", "leaf", "base", "row", "times", "key", "last", "a.b", "mix_domain", "mix_tokens", "mix_epoch"]
    got = sorted(r.doc_id for r in two.collect())
    assert got == sorted(r.doc_id for r in one.collect()) and {r["leaf"] for r in two.collect()} == {5}
    picked = [sum(rows[i][2] == lang for i in got) for lang in (None, "null", "en")]
    assert picked[0] > picked[1]


def test_mixing_odd_rows(docs, empty):
    got = mixing.mix(docs, share=1.0)
    assert got.columns == [*docs.columns, "mix_domain", "mix_tokens", "mix_epoch"] and {r.doc_id for r in got.collect()} >= {1, 2, 5}
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("epochs", [1, 2])
@pytest.mark.parametrize("named", [True, False])
def test_mixing_repeats_across_the_budget(spark, named, epochs):
    """A doc_id (or a text without one) that holds a third of the leaf, wherever its place is; all its rows share that place."""
    for again in (0, 3):
        rows = [(i if named or i != again else None, f"text {i} " + "w " * 8) for i in range(12) for _ in range(6 if i == again else 1)]
        place = {t: hashlib.md5(t.encode()).hexdigest() if d is None else str(d) for d, t in rows}
        held = {}
        for _, t in rows:
            held[t] = held.get(t, 0) + 10
        for total in (5, 95, 169):
            want, at, goal = [], 0, total + 170 * (epochs - 1)
            for t in sorted(held, key=lambda t: hashlib.md5(f"{mixing.SEED}:{epochs - 1}:{place[t]}".encode()).hexdigest()):
                want += [(t, e) for e in range(epochs - 1 + (at < total)) for _ in range(held[t] // 10)]
                at += held[t]
            frame = spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string")
            assert sorted((r.text, r.mix_epoch) for r in mixing.mix(frame, total=goal, epochs=epochs).collect()) == sorted(want)
