import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from sievewright.llm import simhash
from sievewright.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(prints, ids, radius=3):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "a b c d a b c", "É é\xa0x\x0by z"])
def test_fingerprint(text):
    assert simhash.simhash(text) == slow_print(text)


def test_documents(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = table.collect()
    want = dict(zip([r.doc_id for r in rows], components([slow_print(r.text) for r in rows], [r.doc_id for r in rows])))
    got = simhash.near_duplicates(table, block=16).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert all(int(r.fingerprint, 16) == slow_print(next(x.text for x in rows if x.doc_id == r.doc_id)) for r in got[:20])


def test_odd_rows(docs, empty):
    rows = docs.collect()
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    prints = [slow_print(r.text) for r in rows]
    assert got == sorted((r.doc_id or -1, f"{p:016x}", c or -1) for r, p, c in zip(rows, prints, components(prints, [r.doc_id for r in rows])))
    assert simhash.near_duplicates(empty).count() == 0


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def check_kept(rows, kept):
    """rows, kept: (doc_id, text).  Of each group one row, with the smallest doc_id, nulls last."""
    sets, up = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                up[find(i)] = find(j)
    group = {(d, t): find(i) for i, (d, t) in enumerate(rows)}
    want = {}
    for d, t in rows:
        g = group[d, t]
        want[g] = min(want.get(g, (True, 0)), (d is None, d or 0))
    got = Counter(group[k] for k in kept)
    assert set(got) == set(want) and set(got.values()) <= {1}
    assert all((d is None, d or 0) == want[group[d, t]] for d, t in kept)


def kept(frame, **options):
    return [(r.doc_id, r.text) for r in simhash.keep_one(frame, **options).collect()]


def test_keep_one(spark, docs, empty):
    assert sorted(d or -1 for d, _ in kept(docs)) == [-1, 1, 3, 5, 7, 8]
    assert Counter(map(str, simhash.keep_one(docs).collect())) <= Counter(map(str, docs.collect())) and simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(empty).count() == 0
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_kept([(r.doc_id, r.text) for r in table.collect()], kept(table, block=16))


def test_keep_one_with_repeated_ids(spark):
    """Unlike texts that share a doc_id stay; a copy under another doc_id goes."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black brown")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(kept(frame([(3, b), (5, a), (5, b)]))) == [(3, b), (5, a)]
    assert sorted(kept(frame([(5, a), (5, c)]))) == sorted([(5, a), (5, c)])
    assert kept(frame([(None, a), (None, a), (None, a)])) == [(None, a)]
    assert kept(frame([(None, a), (7, a), (6, a), (6, a)])) == [(6, a)]


def test_keep_one_around_the_threshold(spark):
    """Chains, a common line, short texts and a dense group, with pairs on both sides of 0.8."""
    draw, rows = random.Random(5), []
    line = " ".join(f"line{i}" for i in range(12))
    for base in range(12):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.choice((3, 5, 9, 13, 40, 90)))]
        for _ in range(8):
            again = list(words)
            for _ in range(draw.randrange(4)):
                again[draw.randrange(len(again))] = f"x{draw.randrange(4000)}"
            rows.append(" ".join(again) + f" {line}" * (base % 2))
            words = draw.choice((words, again))
    dense = [f"d{i}" for i in range(60)]
    rows += [" ".join([*dense, f"end{i}"]) for i in range(40)]
    rows = [*enumerate(rows, 1), (None, rows[0]), (7, "another text with a doc_id that another row has"), (None, "no other row has this text of no doc_id"), (None, None), (500, "")]
    check_kept(rows, kept(spark.createDataFrame(rows, "doc_id long, text string"), block=64))


@pytest.mark.parametrize("n", [5, 10, 20, 50, 200, 2000])
def test_similar_sets_lie_within_the_radius(n):
    """Sets of similarity 0.8, one a part of the other or both of one size."""
    rng, far = np.random.default_rng(n), 0
    for _ in range(200):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        part = one[: -(-4 * n // 5)]
        fresh = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = np.unique(np.concatenate([one[: -(-8 * n // 9)], fresh[: n - -(-8 * n // 9)]]))
        for b in (part, other):
            assert simhash.similar_sets(one, np.sort(b), simhash.SIMILAR)
            far = max(far, int(np.bitwise_count(simhash.wide_print(one) ^ simhash.wide_print(b)).sum()))
    assert far <= simhash.WIDE_RADIUS


def test_similar_sets_share_a_band():
    rng = np.random.default_rng(3)
    for n in (5, 9, 45, 900):
        for _ in range(200):
            one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) & simhash._HIGH)
            assert np.intersect1d(simhash.band_keys(one), simhash.band_keys(one[: -(-4 * n // 5)])).size
    assert not len(simhash.band_keys(np.empty(0, np.uint64)))


def test_set_links_compares_no_unlike_texts(spark):
    """Pairs that are looked at grow with likeness, not with the square of the texts."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + (" end" if i % 2 else "")) for i in range(400)]
    rows += [(1000 + i, t + " more") for i, t in rows[:50]]
    base = simhash.scratch(spark, "sets")
    nodes = simhash._with_sets(spark.createDataFrame(rows, "doc_id long, text string"), 5, base).select("node", *(f"p{k}" for k in range(simhash.WIDE)), "uri", "at", "n", "keys")
    assert nodes.selectExpr("node", "explode(keys) key").groupBy("key").count().where("count > 2").isEmpty()
    assert simhash.set_links(nodes).distinct().count() == 50


def test_dense_cluster_links_are_few():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = np.unique([base ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(40) for j in range(i)])
    found, _ = simhash.link_blocks(simhash.Block(near[:, None], near.view(np.int64)), None)
    assert len(found) == len(near) - 1


@pytest.mark.parametrize("radius,width", [(3, 1), (3, 2), (3, 8), (80, 20), (0, 1)])
def test_offsets_reach_all_bands(radius, width):
    offsets = simhash._offsets(radius, width)
    for a in range(24):
        for b in range(24):
            for c in range(24):
                for d in range(0, 24, 3):
                    if abs(a - c) + abs(b - d) <= radius:
                        o = (c // width - a // width, d // width - b // width)
                        assert o in offsets or (-o[0], -o[1]) in offsets


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(3, 2), (2, 3), (9, 9), (1, 3), (None, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).distinct().collect()))
    assert got == {i: 20 for i in range(20, 61)} | {1: 1, 2: 1, 3: 1}


def test_unlike_sets_are_read_once_for_many_pairs(monkeypatch):
    """300 sets, all candidates of each other and nearly none similar: their pairs aren't read one by one."""
    rng = np.random.default_rng(5)
    shared, n = rng.integers(0, 1 << 40, 300, dtype=np.uint64), 300
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 40, 50, dtype=np.uint64)])) for _ in range(n)]
    for i in range(0, n, 30):
        sets[i + 1] = np.unique(np.concatenate([sets[i][:-5], rng.integers(0, 1 << 40, 5, dtype=np.uint64)]))
    reads = []
    monkeypatch.setattr(simhash, "_read_set", lambda uri, at, size: reads.append(at) or sets[at])
    rows = {
        "node": np.arange(n), "root": np.arange(n), "uri": np.array(["x"] * n), "at": np.arange(n), "n": np.array([len(x) for x in sets]),
        "prints": np.zeros((n, simhash.WIDE), np.uint64),
    }
    u, v = simhash.link_unlike(rows, np.arange(n), np.arange(n), simhash.WIDE_RADIUS, simhash.SIMILAR, most=20_000)
    want = {(i, k) for i in range(n) for k in range(i) if simhash.similar_sets(sets[i], sets[k], simhash.SIMILAR)}
    assert {(max(p), min(p)) for p in zip(u.tolist(), v.tolist())} == want and len(want) == 10
    assert len(reads) < 10 * n * 2
