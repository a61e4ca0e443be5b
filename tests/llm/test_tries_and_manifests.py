"""Prefix trie and Merkle manifest against brute force and SQL, and their odd inputs."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sievewright.llm import merkle, prefix_trie, queries, ranges

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tries(rows):
    """Every prefix of every rebuilt conversation as a tuple of turns."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    made = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        made[conv] = tuple(t[3] for t in sorted(own.get(conv - conv % 100, []))[:h] + sorted(turns)[h:])
    nodes = {}
    for conv, turns in made.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(turns[:depth], []).append(conv)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = sorted(c for c in members if made[c] == prefix)
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(children), leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out)


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "n_convs": F.lit(0), "a": F.lit(1), "_row": F.lit(2)})


def test_trie_of_random_conversations(spark):
    draw = random.Random(3)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["", "a", "bé", "cc c"])) for c in [*range(20), *range(100, 112), 205, 207] for t in range(draw.randrange(1, 9))]
    rows += [(300 + c, t, "user", "same") for c in range(1, 30) for t in range(7)]
    got = sorted(tuple(r) for r in prefix_trie.trie(talks(spark, rows)).collect())
    assert got == tries(rows)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "z"), (1, 2, "user", "y"), (1, 2, "user", "y"), (None, 0, "user", "lost"), (0, 0, None, "x"), (0, None, "r", ""), (7, 0, "1", ":a"), (7, 1, "", "1:a")]
    assert sorted((tuple(r) for r in prefix_trie.trie(talks(spark, rows)).collect()), key=str) == sorted(tries(rows), key=str)
    assert prefix_trie.trie(talks(spark, rows).limit(0)).count() == 0


def test_deep_trie_in_few_rounds(spark, monkeypatch):
    """3,000 turns: blocks of sums, and a number of rounds that is logarithmic."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    staged = []
    monkeypatch.setattr(prefix_trie, "stage", lambda df, name: staged.append(name) or ranges.stage(df, name))
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(1500)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(talks(spark, rows)).collect()}
    assert staged.count("trie-sums") == 12
    cut = [zlib.crc32(str(c).encode()) % 6 for c in (1, 2)]  # no conversation 0: the first turns go
    assert len({cut[0], cut[1]}) == 2  # so the two differ from their first turn on
    assert all(got[1, d].n_leaves == 1 and got[1, d].n_children == (d < 3000 - cut[0]) for d in range(1, 3001 - cut[0]))
    assert got[1, 0].n_leaves == 2 and got[1, 0].saved_tokens == 0


def test_trie_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    got = queries.op11_prefix_trie(spark, SMALL)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op11_prefix_trie']})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def manifests(rows):
    """rows(doc_id, source, lang, n_chars, text) -> the manifest, tree by tree."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, r[:4])) + field(text))

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for key in keys:
        by[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {key: levels([leaf(r, r[4]) for r in by[key]]) for key in keys}
    upper = levels([trees[key][-1][0] for key in keys])
    out = []
    for s, key in enumerate(keys):
        for i, r in enumerate(by[key]):
            first, siblings = leaf(r, r[4]), ""
            folded = first
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                folded = leaf(r, "".join(c.lower() if c.isascii() else c for c in r[4]))
            for tree, at in ((trees[key], i), (upper, s)):
                for level in tree[:-1]:
                    low = at // 16 * 16
                    left, right = "".join(level[low:at]), "".join(level[at + 1 : low + 16])
                    siblings += left + right
                    folded = sha(left + folded + right)
                    at //= 16
            out.append((r[0], first, trees[key][-1][0], upper[-1][0], sha(siblings), folded, folded == upper[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"key": F.lit("x"), "hash": F.lit(1), "leaf": F.lit(2), "level": F.lit(3)})


@pytest.mark.parametrize("counts", [(1,), (1, 1), (16, 17, 1), (273, 256, 2, 33), (5000, 4096)])
def test_manifest_of_sizes(spark, counts):
    """Full and short runs, lone leaves, runs across partitions, chunks."""
    rows = [(d * 7 + s, f"src{s}", None, d, f"Text {d} É") for s, n in enumerate(counts) for d in range(n)]
    random.Random(1).shuffle(rows)
    got = merkle.manifest(table(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == manifests(rows)


def test_manifest_of_many_sources(spark):
    rows = [(d, f"s{d % 300}é" if d % 7 else None, "en", None, "A") for d in range(900)]
    assert sorted(map(tuple, merkle.manifest(table(spark, rows)).collect()), key=str) == manifests(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(1, "a", "en", 3, "ABC")] * 40 + [(None, None, None, None, None), (None, "a", "en", 1, "Z"), (2, "", "", 0, ""), (3, "", "", 0, None), (5, "a", "-", 4, "L" * 100_000)]
    got = merkle.manifest(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == manifests(rows)
    assert merkle.manifest(table(spark, rows).limit(0)).count() == 0


def test_range_emits_each_node_once():
    """Ranges that begin and end anywhere give the nodes of the whole tree."""
    leaves = [sha(str(i)) for i in range(700)]
    whole = levels(leaves)
    for cuts in ([0, 700], [0, 5, 6, 290, 512, 700]):
        emit = []
        for low, high in zip(cuts, cuts[1:]):
            stack = merkle.Range("k", 3, emit)
            for i in range(low, high):
                stack.push(i, leaves[i])
            stack.close()
        at = {(level, idx): digest for _, _, level, idx, digest, _ in emit}
        assert len(at) == len(emit) and all(whole[level][idx] == digest for (level, idx), digest in at.items())
        covered = sorted((idx << 4 * level, (idx + 1) << 4 * level) for _, _, level, idx, _, peak in emit if peak)
        assert covered[0][0] == 0 and all(a[1] == b[0] for a, b in zip(covered, covered[1:])) and covered[-1][1] == 700


def test_manifest_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.op12_merkle(spark, SMALL)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op12_merkle']})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)
