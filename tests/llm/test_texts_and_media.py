import hashlib
import io
import re
import zlib

import numpy as np
import pytest

from sievewright.llm import langid, licenses, media

SMALL = "/root/testdata/sf0.001"

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def slow_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), places


def check_licenses(rows, texts):
    for r, text in zip(rows, texts):
        n, places = slow_base(text)
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({label for _, label in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses(spark, docs, empty):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    rows = licenses.scan_licenses(table).collect()
    check_licenses(rows, [texts[r.doc_id] for r in rows])
    check_licenses(licenses.scan_licenses(docs).collect(), [r.text for r in docs.collect()])
    assert len(rows) == len(texts) and licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache Licence, Version 2.0", "apache"), ("Relesed under the MIT Licens", "mit"), ("MIT license MIT license", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("licensed under the gnu genral public license", "gpl"), ("a plain sentence", ""), ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"), ("Licensed under CC BY-NC-ND 4.0", "cc-by,cc-by-nc-nd"), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa"),
    ("Creative Commons Attribution 4.0 Internatonal", "cc-by"), ("CC0 1.0 Universal", "cc0"), ("the GNU Affero General Public License", "agpl"), ("Eclipse Public Licence", "epl"), ("This is free and unencumbered software, released into the public domain.", "unlicense"),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "zlib"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"), ("Redistribution and use in source and binary forms, with or without modifications", "bsd"),
])
def test_fuzzy_notices(text, labels):
    assert licenses.Scanner().scan(text)["labels"] == labels


def test_pigeonhole_finds_what_a_full_search_finds():
    notice, rng = licenses.Notice("released under the mit license", "mit"), np.random.default_rng(2)
    for _ in range(300):
        t = list("released under the mit license")
        for _ in range(rng.integers(0, 5)):
            t[rng.integers(len(t))] = "xyz"[rng.integers(3)]
        words = b" a b " + "".join(t).encode() + b" c d "
        assert bool(notice.find(words)) == bool(notice.match.search(words))


@pytest.mark.parametrize("text,labels,score", [
    ("Released under the ISC license", "isc", 1.0), ("released under the BSD license", "", 0.0), ("Licensed under CC BY-ND 4.0", "cc-by,cc-by-nd", 1.0),
    ("released under the bsd license released under the mit licence", "mit", 1 - 1 / 30), ("licensed under the gnu lesser general public license", "lgpl", 1.0),
])
def test_edits_cannot_change_the_licence(text, labels, score):
    found = licenses.Scanner().scan(text)
    assert found["labels"] == labels and abs(found["score"] - score) < 1e-9


def test_licenses_against_a_full_search():
    """Seeds and windows find what the matcher finds when it searches whole texts for every notice."""
    rng, scanner, found_some = np.random.default_rng(8), licenses.Scanner(), 0
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 6)):
            t = list(licenses.NOTICES[rng.integers(len(licenses.NOTICES))][0])
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = "xyz"[rng.integers(3)]
            parts += ["".join(t), *(["some", "words", "between"] * rng.integers(0, 8))]
        text = " ".join(parts)
        words, _ = licenses.normalise(text)
        want = {label for _, label in slow_base(text)[1]}
        for x in scanner.notices:
            hits = [m for m in x.match.finditer(words, overlapped=True) if x.exact in words[m.start() - 1 : m.end() + 1]]
            if hits:
                assert any(start < hits[0].end() and hits[0].start() < end for start, end, _ in x.find(words))
            assert bool(hits) == bool(x.find(words))
        got = scanner.scan(text)
        every = {x.label for x in scanner.notices if x.find(words)}
        assert want <= set(got["labels"].split(",")) | {""} and set(got["labels"].split(",")) - {""} <= want | every
        folded = words.decode().split()
        for label, first, n, edits in got["spans"]:
            assert 0 <= first and first + n <= len(folded)
            found_some += edits > 0
            if edits == 0:
                assert " ".join(folded[first : first + n]) in [x[0] for x in (*licenses.BASE, *licenses.NOTICES)]
    assert found_some > 10


def test_long_repeats_of_a_phrase():
    found = licenses.Scanner().scan("mit license " * 80_000)
    assert (found["n_base"], found["first_word"], found["last_word"], found["labels"]) == (80_000, 0, 159_998, "mit")


def test_media_documents(spark, docs, empty):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    for frame in (table, docs):
        for form in ("pgm", "bmp"):
            got = sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.text_media(frame, form).collect())
            want = []
            for r in frame.collect():
                data = (r.text or "").encode()
                p = data + b"\0" * (-len(data) % 64 if data else 64)
                want.append((len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
            assert got == sorted(want)
    assert media.text_media(empty).count() == 0


def test_decoders():
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(grey)) == grey).all()
    assert media.decode(b"P1\n# c\n2 2\n0 1\n1 0\n").tolist() == [[255, 0], [0, 255]]
    assert media.decode(b"P4 9 1\n" + bytes([0b10000000, 0])).tolist() == [[0] + [255] * 8]
    assert media.decode(b"P2 2 1 100\n0 50\n").tolist() == [[0, 128]] and media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]] and media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    short_palette = bytearray(media.encode_bmp(grey)[:54] + media.encode_bmp(grey)[54 + 1024 :])
    short_palette[10:14] = (54).to_bytes(4, "little")
    for junk in (b"", b"GIF89a", b"P5 9", b"P5 9 9 255\nxx", b"P5 99999999999 99999999999\n", b"P2 1 1 255 70000", b"P5 1 1 0\nx", b"P5 2 2 100\n\xff\xff\xff\xff", b"P1 2 2 0", b"BM" + b"\0" * 60, bytes(short_palette)):
        with pytest.raises(ValueError):
            media.decode(junk)


def test_no_bytes_end_the_task(spark):
    """Cut and changed files are pictures or nulls, never errors."""
    rng, grey = np.random.default_rng(3), np.arange(35, dtype=np.uint8).reshape(5, 7)
    whole = [media.encode_pgm(grey), media.encode_bmp(grey), b"P2 2 1 100\n0 50\n", b"P4 9 1\n\x80\0", b"P3 1 1 255 1 2 3"]
    data = [None, b""]
    for w in whole:
        for _ in range(80):
            x = bytearray(w[: rng.integers(1, len(w) + 1)])
            x[rng.integers(min(len(x), 60))] = rng.integers(256)
            data.append(bytes(x))
    rows = media.read_media(spark.createDataFrame([(i, 0, d) for i, d in enumerate(data)], "doc_id long, n_bytes long, media binary")).collect()
    assert len(rows) == len(data) and rows[0].feature is None


def test_features_of_stored_texts(spark, docs):
    """media_sha256 and feature against the stored form made again here."""
    by_id = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (None, 1)}
    for r in media.text_media(docs).where("doc_id > 1").collect():
        data = (by_id[r.doc_id] or "").encode()
        samples = np.frombuffer(data + b"\0" * (-len(data) % 64 if data else 64), np.uint8).reshape(-1, 64)
        stored = b"P5\n64 %d\n255\n" % len(samples) + samples.tobytes()
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_bytes == len(stored)
        table = np.zeros((len(samples) + 1, 65))
        table[1:, 1:] = samples.astype(float).cumsum(0).cumsum(1)

        def total(y, x):
            y0, x0 = min(int(y), len(samples) - 1), min(int(x), 63)
            top = table[y0, x0] * (1 - x + x0) + table[y0, x0 + 1] * (x - x0)
            low = table[y0 + 1, x0] * (1 - x + x0) + table[y0 + 1, x0 + 1] * (x - x0)
            return top * (1 - y + y0) + low * (y - y0)

        ys, xs = [len(samples) * i / 8 for i in range(9)], [64 * i / 9 for i in range(10)]
        cells = [[total(b, d) - total(a, d) - total(b, c) + total(a, c) for c, d in zip(xs, xs[1:])] for a, b in zip(ys, ys[1:])]
        area = (len(samples) / 8) * (64 / 9)
        bits = "".join(str(int(round(p / area, 6) > round(q / area, 6))) for row in cells for p, q in zip(row, row[1:]))
        assert r.feature == f"{int(bits, 2):016x}"


def test_area_resize_and_hash():
    block = np.kron(np.array([[10, 20], [30, 40]]), np.ones((4, 4)))
    assert np.allclose(media.area_resize(block, 2, 2), [[10, 20], [30, 40]]) and np.allclose(media.area_resize(block, 1, 1), 25)
    odd = np.random.default_rng(0).integers(0, 255, (7, 5)).astype(float)
    assert np.isclose(media.area_resize(odd, 3, 2).mean(), odd.mean())
    assert media.difference_hash(np.tile(np.arange(9)[::-1] * 20, (8, 1))) == "f" * 16
    assert np.load(io.BytesIO(media.tile(odd))).shape == (media.TILE, media.TILE)


def test_language_accuracy(spark):
    table = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(table, rows=150).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_odd_rows(docs, empty):
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(3, "und"), (4, "und"), (6, "und"), (8, "und")} <= rows and all(p != "und" for d, p in rows if d in (1, 2, 5, 7))
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.where("lang is null"))  .collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.identify(docs, keep=["doc_id", "score"])


@pytest.mark.parametrize("text,letters", [("½ ²", False), ("🄀 𐄇", False), ("𐄇𝒜😀", True), ("① Ⅷ ٣ 12_", False), ("é", True), ("x²", True), ("日本", True), ("", False), (None, False)])
def test_texts_without_letters_are_unknown(text, letters):
    model = langid.train([("the and of", "en"), ("le la des", "fr")])
    (name,), (score,), (sure,) = model.predict([text])
    assert (name != "und") == letters and (score > 0) == letters and sure >= score


def test_sample_windows_are_spread_over_the_text():
    parts = langid.windows_of(" ".join(["start"] * 400 + ["end"] * 400))
    assert len(parts) == langid.TRAIN_WINDOWS and all(len(p) == langid.WINDOW for p in parts)
    assert set(parts[0]) == {"start"} and set(parts[-1]) == {"end"} and langid.windows_of("one two") == [["one", "two"]] and langid.windows_of(None) == []


def test_chain_equals_enumeration():
    rng = np.random.default_rng(1)
    e, move, start = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    total, marginal = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(start[path[0]] + sum(e[t, 0, path[t]] for t in range(4)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t in range(4):
            marginal[t, path[t]] += w
    mask = np.ones((4, 1), bool)
    assert np.allclose(langid.chain(e, mask, move, start)[0][:, 0], marginal / total)
    assert np.allclose(langid.posteriors(e.copy(), mask, move, start)[:, 0], marginal / total)


def test_code_switching():
    en, fr = "the and of with house tree water this", "le la des avec maison arbre eau cette"
    model = langid.train([(" ".join([en] * 20), "en"), (" ".join([fr] * 20), "fr")] * 4)
    labels = [lang for _, lang, _ in langid.label_words(model, f"{en} {fr}")]
    assert labels == ["en"] * 8 + ["fr"] * 8
    _, (score,), (sure,) = model.predict([f"{en} {fr}"])
    assert score < 0.7 and sure > 0.8
