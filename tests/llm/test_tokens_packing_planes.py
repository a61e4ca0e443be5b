import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sievewright.llm import packing, planes, tokens

SMALL = "/root/testdata/sf0.001"

PATH = tokens.default_path()
TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_the_library():
    encode, r = tokens.Encoder(PATH), random.Random(1)
    parts = ["a", "B", "bc", " ", "  ", "\n", "\t", ".", ",", "é", "ß", "'", "s", "don't", "1", "²", "_", "́", "日本", "!?", "\x1c", "\x85", "　", "​", "<|endoftext|>", "😀", "\r\n"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert list(encode(text)) == list(ids_of(text)), repr(text)


def check_pieces(rows, texts):
    """texts: doc_id -> texts of that id, in any order."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc_id, own in texts.items():
        lengths = sorted(len(ids_of(t)) for t in own)
        assert sum(p.length for p in pieces[doc_id]) == sum(lengths)
        if len(own) == 1:
            ids, at = ids_of(own[0]), 0
            for p in sorted(pieces[doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == own[0].sequence_tokens <= own[0].tier <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packing_documents(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(table, pool=20_000).collect()
    assert check_pieces(rows, {r.doc_id: [r.text] for r in table.collect()}) <= 1024


def test_packing_odd_rows(docs, empty):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    check_pieces(packing.pack(docs).collect(), texts)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_packer(seed):
    r, lengths = random.Random(seed), []
    packer = packing.Packer(0, pool=r.choice([500, 5000, 100_000]), step=4096)
    for d in range(r.randint(0, 60)):
        lengths.append(r.choice([1, 2, r.randint(1, 300), r.randint(1, 5000), 1024, 512]))
        packer.add(d, np.full(lengths[-1], d, "<u4"))
    packer.flush(True)
    got = defaultdict(list)
    for row in packer.rows():
        got[row[0]].append((row[1], row[2]))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(got[d]):
            assert start == at
            at += length
        assert at == n


def test_tiers_are_powers_of_two():
    with pytest.raises(ValueError):
        packing.Packer(0, tiers=(1000, 500))


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 100, 4097])
def test_planes_round_trip(tmp_path, mode, n):
    rng = np.random.default_rng(n)
    block = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    assert (planes.join_planes(planes.split_planes(block, mode), n, mode) == block).all() if n else True
    sizes = [int(s) for s in rng.integers(1, 50, 9)]
    writer, every = planes.PlaneWriter(str(tmp_path / "x"), mode, chunk=32), []
    for i, s in enumerate(sizes):
        every.append(rng.integers(0, 50_000, s, dtype=np.uint32))
        writer.add(None if i == 0 else i, every[-1])
    writer.close()
    reader, flat = planes.PlaneReader(str(tmp_path / "x")), np.concatenate(every)
    ids, counts = reader.documents()
    assert ids.tolist() == [planes.NO_ID, *range(1, 9)] and counts.tolist() == sizes
    for start, length in ((0, len(flat)), (5, 40), (31, 2), (len(flat) - 1, 1)):
        assert (reader.read(start, length) == flat[start : start + length]).all()


def test_token_files(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    got, at = sorted(planes.token_files(table, file_ids=20_000).collect()), 0
    for r, d in zip(got, sorted(table.collect(), key=lambda d: d.doc_id)):
        ids = ids_of(d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == table.count()


def test_token_files_odd_rows(docs, empty):
    rows = sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text is not None, d.text or ""))
    got, at = sorted(planes.token_files(docs).collect(), key=lambda r: r.start), 0
    assert [r.doc_id for r in got] == [d.doc_id for d in rows]
    for r, d in zip(got, rows):
        assert (r.start, r.n_tokens) == (at, len(ids_of(d.text)))
        at += r.n_tokens
    assert planes.token_files(empty).count() == 0
