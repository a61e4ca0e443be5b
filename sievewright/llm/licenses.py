"""Fuzzy search for short licence notices in whole texts.

A text is brought to words: A-Z in lower case, every other ASCII character
that is no letter or digit separates, one space between words.  Then

* base phrases are found where their words stand consecutively;
* each notice is split into k + 1 seeds, k being its error bound.  A match
  within k edits leaves one seed intact (pigeonhole), so exact seed hits
  locate all candidates, and the ``regex`` library's bounded-error matching
  verifies each candidate window and reports its span and edits;
* a notice's distinguishing words (a licence's name, a clause's letters) must
  stand in a match as they are, so that edits can't make one licence another.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices in the words of the licences' own texts, their labels and their distinguishing words.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ""),
    ("licensed under the gnu general public license", "gpl", "gnu"),
    ("gnu lesser general public license", "lgpl", "lesser"),
    ("licensed under cc by 4 0", "cc-by", "cc by 4"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("redistribution and use in source and binary forms with or without modification", "bsd", ""),
    ("subject to the terms of the mozilla public license", "mpl", "mozilla"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc by nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", "cc by nc sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd", "cc by nc nd"),
    ("creative commons attribution 4 0 international", "cc-by", "attribution 4"),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa", "attribution sharealike"),
    ("creative commons attribution noderivatives 4 0 international", "cc-by-nd", "attribution noderivatives"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc", "attribution noncommercial 4"),
    ("creative commons attribution noncommercial sharealike 4 0 international", "cc-by-nc-sa", "noncommercial sharealike"),
    ("creative commons attribution noncommercial noderivatives 4 0 international", "cc-by-nc-nd", "noncommercial noderivatives"),
    ("cc0 1 0 universal", "cc0", "cc0"),
    ("released under the isc license", "isc", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ""),
    ("gnu affero general public license", "agpl", "affero"),
    ("eclipse public license", "epl", "eclipse"),
    ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib", ""),
    ("this is free and unencumbered software released into the public domain", "unlicense", ""),
)
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def error_bound(notice: str) -> int:
    """Edits allowed: one for every ten characters, four at most."""
    return min(4, len(notice) // 10)


class Notice:
    """A notice, its seeds with their places in it, and its verifier."""

    def __init__(self, text: str, label: str, exact: str = ""):
        self.label, self.text, self.k = label, text.encode(), error_bound(text)
        self.exact = f" {exact} ".encode() if exact else b" "
        n, parts = len(self.text), self.k + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        self.seeds = [(self.text[i:j], i) for i, j in zip(cuts, cuts[1:])]
        self.match = regex.compile(b"(?e)(?<= )(?:" + regex.escape(self.text, literal_spaces=True) + b"){e<=%d}(?= )" % self.k)

    def find(self, words: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches in a text of words."""
        windows: list[tuple[int, int]] = []
        if self.exact not in words:
            return []
        for seed, place in self.seeds:
            at = words.find(seed)
            while at >= 0:
                windows.append((max(0, at - place - self.k - 1), at - place + len(self.text) + self.k + 1))
                at = words.find(seed, at + 1)
        found: list[tuple[int, int, int]] = []
        windows.sort()
        merged: list[list[int]] = []
        for low, high in windows:
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high])
        for low, high in merged:
            if self.exact in words[max(0, low - 1) : high + 1]:
                # overlapping matches too: one without the exact words may begin in front of one with them
                found += [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.match.finditer(words, low, high, overlapped=True) if self.exact in words[m.start() - 1 : m.end() + 1]]
        return found


def normalise(text: str | None) -> tuple[bytes, int]:
    """The text as words between single spaces, and how many there are."""
    words = utf8(text).translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" ", len(words)


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [(f" {p} ".encode(), label) for p, label in base]
        self.notices = [Notice(*x) for x in notices]

    def scan(self, text: str | None) -> dict:
        """Counts, labels, score and the spans of one whole text.

        A span is (label, first word, words, edits); base places have no
        edits.  ``score`` is the best match's share of unedited characters.
        """
        words, n = normalise(text)
        spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)

        def word_at(places: list[int]) -> list[int]:
            """How many words begin before each byte."""
            return (np.searchsorted(spaces, places) - 1).tolist()

        spans, places, base_labels, best = [], [], set(), 0.0
        for phrase, label in self.base:
            own, at = [], words.find(phrase)
            while at >= 0:
                own.append(at + 1)
                at = words.find(phrase, at + 1)
            if own:
                own = word_at(own)
                places += own
                spans += [(label, at, phrase.count(b" ") - 1, 0) for at in own]
                base_labels.add(label)
                best = 1.0
        labels = set(base_labels)
        matches = sorted((edits, start - end, start, end, x.label, len(x.text)) for x in self.notices for start, end, edits in x.find(words))
        taken: list[tuple[int, int]] = []  # the closest of overlapping matches counts
        fuzzy: list[tuple[str, int, int, int]] = []
        for edits, _, start, end, label, size in matches:
            at = bisect_right(taken, (start, end))
            if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                continue
            taken.insert(at, (start, end))
            fuzzy.append((label, start, end, edits))
            labels.add(label)
            best = max(best, 1.0 - edits / size)
        if fuzzy:
            first, after = word_at([x[1] for x in fuzzy]), word_at([x[2] for x in fuzzy])
            spans += [(label, a, b - a + 1, edits) for (label, _, _, edits), a, b in zip(fuzzy, first, after)]
        return {
            "n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": best, "spans": sorted(spans),
        }


SPANS = "array<struct<label:string,first_word:bigint,n_words:bigint,edits:bigint>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def scan_licenses(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """docs(doc_id, text, ...) -> a row for each row, with counts, labels and spans.

    A null text is empty: no words, no labels (empty strings), score 0, null
    first_word and last_word.  Null and repeated doc_ids pass through.  Other
    columns are ignored; an empty table gives an empty result.
    """
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def run(batches):
        scanner = Scanner(base, notices)
        for batch in slices(batches):
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            columns = {"doc_id": batch.column("doc_id")} | {k: pa.array([x[k] for x in found], t) for k, t in kinds.items()}
            columns["spans"] = pa.array([[dict(zip(("label", "first_word", "n_words", "edits"), s)) for s in x["spans"]] for x in found], span)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
