"""Token ids of whole texts by a public tokenizer file.

Encoding goes through the ``tokenizers`` library.  A plain byte-level BPE file
splits a text into pre-tokens by a fixed pattern, and starts one at each space
that a word follows.  There the ids of a text are those of its space-separated
units.  Arrow tells the units of a slice of texts apart, the pattern cuts the
different ones into pre-tokens, the library's model encodes all of these in
one call, and numpy puts the ids in the texts' order; a bounded memo keeps
units' ids between slices.  A text with white space
other than single spaces and line feeds between words, or with the string of
a special token, is encoded whole, and so are texts of other kinds of file.
Both ways give the same ids.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .common import held_by_worker

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text that are worked on at once.
SLICE = 4 << 20
#: Units that a memo keeps, about 150 bytes each, and the longest of them.
MEMO = 500_000
MEMO_UNIT = 32
#: Stands before a text and, twice, after it; a text that holds it is encoded whole.
MARK = "\0"

#: Latin, Greek and Cyrillic letters, which are letters in any version of Unicode; ASCII digits and marks.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωЀ-ҁҊ-ԯ"
_MARK = r"!-/:-@\[-`{-~"
#: The pattern of byte-level BPE's pre-tokens, for the characters above.
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)|\n| ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+")
_STRANGE = re.compile(rf"[^{_LETTER}0-9{_MARK}]")


def _byte_marks() -> list[tuple[str, str]]:
    """Bytes that byte-level BPE writes as other characters, in order from U+0100 on; MARK becomes a space at last."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(0x100) if b not in shown]
    used = [b for b in hidden if b >= 0x80 or chr(b) in " \n"]
    return [(chr(b), chr(0x100 + hidden.index(b))) for b in used] + [(MARK, " ")]


_BYTE_MARKS = _byte_marks()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Texts -> ids, the end id last, as little-endian unsigned 32-bit arrays."""

    def __init__(self, path: str, end_id: int = END_ID, memo: int = MEMO):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = (
            model.get("type") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space") and split.get("use_regex", True)
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "unk_token", "byte_fallback"))
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.end = np.array([end_id], "<u4").tobytes()
        if self.plain:
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            known = model["vocab"]
            self.width = np.zeros(max(known.values()) + 1, np.int64)
            self.width[list(known.values())] = list(map(len, known))
            self.most, self.memo = memo, {MARK: b"", MARK + MARK: self.end}
            self.feed = self._library("\n")

    def whole(self, text: str | None) -> np.ndarray:
        """The ids of one text by the library's encoding of it as a whole."""
        return np.frombuffer(_packed(self.tokenizer.encode(text or "", add_special_tokens=False).ids) + self.end, "<u4")

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.each(pa.array([text], pa.string())))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column; null is empty."""
        if not self.plain:
            yield from map(self.whole, texts.to_pylist())
            return
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE, "right")))
            yield from self._some(texts.slice(low, high - low))
            low = high

    def _some(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for part in (MARK, *self.special):
            odd |= pc.match_substring(texts, part).to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise(pa.scalar(MARK), pc.replace_substring(texts, "\n", " \n"), pa.scalar(f" {MARK}{MARK}"), "")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        codes, cuts = coded.indices.to_numpy(), split.offsets.to_numpy()
        packed = self._units(coded.dictionary.to_pylist())
        if None in packed:
            strange = np.array([p is None for p in packed])
            odd |= np.logical_or.reduceat(strange[codes], cuts[:-1] - cuts[0])
            packed = [p or b"" for p in packed]
        sizes = np.fromiter(map(len, packed), np.int32, len(packed)) >> 2
        pool = np.frombuffer(b"".join(packed), "<u4")
        n = sizes[codes]
        ends = np.cumsum(n, dtype=np.int32)
        ids = pool[np.arange(ends[-1], dtype=np.int32) + np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[codes] - (ends - n), n)]
        at = np.concatenate([[0], ends])[cuts - cuts[0]].tolist()
        for i, whole in enumerate(odd.tolist()):
            yield self.whole(texts[i].as_py()) if whole else ids[at[i] : at[i + 1]].copy()

    def _units(self, units: list[str]) -> list[bytes | None]:
        """The ids of all units; None where a unit's text has to be encoded whole."""
        packed = list(map(self.memo.get, units))
        fresh, bodies = [], []
        for i in [i for i, p in enumerate(packed) if p is None]:
            unit = units[i]
            lead, body = ("", unit[1:]) if unit[:1] == MARK else ("\n", unit[1:]) if unit[:1] == "\n" else (" ", unit)
            if body and not _STRANGE.search(body):
                fresh.append(i)
                bodies.append(lead + body)
            elif body and body.split() == [body]:
                packed[i] = self.feed + self._library(body) if lead == "\n" else self._library(lead + body)
        if bodies:
            every = self._pieces(bodies)
            sizes = np.array([len(x) if x.isascii() else len(x.encode()) for x in bodies], np.int64)
            ends = (4 * np.searchsorted(np.cumsum(self.width[every]), np.cumsum(sizes), "right")).tolist()
            octets = every.tobytes()
            if len(self.memo) > self.most:
                self.memo = {MARK: b"", MARK + MARK: self.end}
            for i, low, high in zip(fresh, [0, *ends], ends):
                packed[i] = octets[low:high]
                if len(units[i]) <= MEMO_UNIT:
                    self.memo[units[i]] = packed[i]
        return packed

    def _library(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pieces(self, bodies: list[str]) -> np.ndarray:
        """Ids of the pre-tokens of all bodies, in order."""
        shown = MARK.join(_PIECE.findall(MARK.join(bodies))).encode().decode("latin-1")
        for plain, mark in _BYTE_MARKS:
            shown = shown.replace(plain, mark)
        return np.array(self.pieces.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")


@held_by_worker
@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int = END_ID, memo: int = MEMO) -> Encoder:
    """The worker's encoder of a file; it lives as long as the worker."""
    return Encoder(path, end_id, memo)
