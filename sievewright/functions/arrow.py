"""Functions that no built-in expression has: Arrow-batched UDFs."""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import itertools
import json
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_slices(one, texts: pa.Array, kind: pa.DataType, rows: int = 128) -> pa.Array:
    """``one`` of each text; ``rows`` of a batch are Python objects at once, the rest stays in Arrow's buffers."""
    parts = (texts.slice(low, rows).to_pylist() for low in range(0, len(texts), rows))
    return pa.concat_arrays([pa.array([], kind), *(pa.array([None if t is None else one(t) for t in part], kind) for part in parts)])


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding."""
    return text.str.casefold()


@F.pandas_udf(T.DoubleType())
def matcher_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block similarity of two texts; the order of arguments matters."""
    return pd.Series([0.0 if a is None or b is None else SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in zip(left, right)], dtype=float)


def matched(a: str, b: str, small: int = 1 << 16) -> int:
    """Characters in SequenceMatcher's matching blocks (without junk), in less than quadratic time for long texts.

    The longest common run (earliest in a, then in b) is found by halving over
    hashes of all runs of a length; runs found are compared as text, and what
    lies to their left and right follows.  Pieces of ``small`` pairs of
    characters go to SequenceMatcher.
    """
    def sums(t: str) -> np.ndarray:
        out = np.zeros(len(t) + 1, dtype=np.uint64)
        np.cumsum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) * powers[: len(t)], out=out[1:])
        return out

    def runs(h: np.ndarray, low: int, high: int, n: int) -> np.ndarray:
        """Hashes of the runs of n characters in [low, high), shifted to the same power."""
        return (h[low + n : high + 1] - h[low : high + 1 - n]) * powers[longest - np.arange(low, high + 1 - n)]

    if len(a) * len(b) <= small:
        return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    longest = max(len(a), len(b))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(longest, 0x9E3779B97F4A7C15, dtype=np.uint64)])
    x, y, found, todo = sums(a), sums(b), 0, [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        low, high = 0, min(k - i, m - j)
        while low < high and (k - i) * (m - j) > small:
            n = (low + high + 1) // 2
            low, high = (n, high) if np.isin(runs(x, i, k, n), runs(y, j, m, n)).any() else (low, n - 1)
        if (k - i) * (m - j) > small:
            if not low:
                continue
            ours, theirs = runs(x, i, k, low), runs(y, j, m, low)
            one = int(np.argmax(np.isin(ours, theirs)))
            two = int(np.argmax(theirs == ours[one]))
            one, two = one + i, two + j
            if a[one : one + low] == b[two : two + low]:
                found += low
                todo += [(i, one, j, two), (one + low, k, two + low, m)]
                continue
        found += sum(z.size for z in SequenceMatcher(None, a[i:k], b[j:m], autojunk=False).get_matching_blocks())
    return found


def reads_alike(threshold: float, containment: float, bounds_only: bool = False):
    """(later, earlier) -> do they share enough trigrams and match by ``threshold``.

    Cheap upper bounds come first (see operators.dedup.similar_pairs for the
    one on q-grams); texts under three characters need no trigram.  With
    ``bounds_only`` these decide alone, and may let unlike texts pass.
    """

    q = next(k for k in (5, 4, 3, 2, 1) if k == 1 or threshold / 2 - (k - 1) * (1 - threshold) > 0.1)

    def grams(t: str) -> tuple[frozenset[str], Counter]:
        """Its trigrams, and its q-grams with their counts."""
        return frozenset(t[i : i + 3] for i in range(max(1, len(t) - 2))), Counter(t[i : i + q] for i in range(len(t) - q + 1))

    def one(a: str, b: str, known) -> bool:
        (x, many_x), (y, many_y) = known(a), known(b)
        if len(a) >= 3 and len(b) >= 3 and len(x & y) / max(1, min(len(x), len(y))) < containment:
            return False
        whole = len(a) + len(b)
        least = threshold * whole / 2 - ((q - 1) * ((1 - threshold) * whole + 1) if q > 1 else 0)
        if least > 0 and sum(min(n, many_y[g]) for g, n in many_x.items() if g in many_y) < least - 1e-9:
            return False
        if bounds_only:
            return True
        m = SequenceMatcher(None, a, b, autojunk=False)
        return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and 2.0 * matched(a, b) / whole >= threshold

    @F.pandas_udf(T.BooleanType())
    def alike(later: pd.Series, earlier: pd.Series) -> pd.Series:
        known = functools.lru_cache(maxsize=4096)(grams)
        return pd.Series([one(a, b, known) for a, b in zip(later, earlier)], dtype=bool)

    return alike


@functools.lru_cache(maxsize=100_000)
def _slot(gram: str, dimensions: int) -> int:
    """A trigram's dimension, or -1 minus it for a negative sign."""
    digest = hashlib.blake2b(gram.encode("utf-8", "replace"), digest_size=8).digest()
    slot = int.from_bytes(digest[:4], "big") % dimensions
    return slot if digest[4] & 1 else -1 - slot


def hashing_embedder(dimensions: int = 384):
    """text -> unit vector of signed, hashed character trigram counts.

    Fixed values: trigrams of the case-folded text with single spaces; of a
    trigram's BLAKE2b digest of eight bytes, the first four (big-endian) give
    the dimension and the last bit of the fifth the sign.
    """

    def one(text: str) -> np.ndarray:
        plain = " ".join(text.casefold().split())
        grams = map("".join, zip(plain, plain[1:], plain[2:])) if len(plain) > 2 else [plain]
        slots = np.array([_slot(g, dimensions) for g in grams])
        vector = np.bincount(slots[slots >= 0], minlength=dimensions) - np.bincount(-1 - slots[slots < 0], minlength=dimensions)
        return vector / (np.sqrt((vector * vector).sum()) or 1.0)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(text: pa.Array) -> pa.Array:
        return by_slices(one, text, pa.list_(pa.float64()))

    return embed


def keyed_fingerprint(secret: str, digits: int = 32):
    """text -> hexadecimal digits of its HMAC-SHA-256 under a secret."""

    @F.pandas_udf(T.StringType())
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest()[:digits])

    return sign


#: Keys whose values never reach a log.
SECRET_KEYS = ("authorization", "cookie", "token", "secret", "password", "apikey", "api_key", "question", "prompt")


@F.pandas_udf(T.StringType())
def redact_json(text: pd.Series) -> pd.Series:
    """JSON with the values of secret keys masked, at any depth; junk is null."""

    def mask(value):
        if isinstance(value, dict):
            return {k: "[redacted]" if any(s in k.lower() for s in SECRET_KEYS) else mask(v) for k, v in value.items()}
        return [mask(v) for v in value] if isinstance(value, list) else value

    def one(t):
        try:
            return None if t is None else json.dumps(mask(json.loads(t)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return text.map(one)


@F.arrow_udf(T.ArrayType(T.StringType()))
def split_paragraphs(text: pa.Array) -> pa.Array:
    """Chunks of 900 characters at most, 120 shared, ended at paragraph breaks."""
    return by_slices(chunk_text, text, pa.list_(pa.string()))


def chunk_text(text: str, longest: int = 900, shared: int = 120) -> list[str]:
    """Pieces of ``longest`` characters at most; neighbours share ``shared``.

    A piece ends at the last paragraph break of its second half, if it has
    one, and the text's last piece at its end.
    """
    if longest < 200 or not 0 <= shared < longest:
        raise ValueError("chunks: at least 200 characters, and a smaller overlap")
    paragraphs = [p for p in map(str.strip, text.split("\n\n")) if p]
    whole = "\n\n".join(paragraphs)
    breaks = list(itertools.accumulate((len(p) + 2 for p in paragraphs), initial=-2))[1:-1]  # where each paragraph but the last ends

    def spans():
        start = 0
        while start + longest < len(whole):
            fitting = bisect.bisect_right(breaks, start + longest - 2)
            end = breaks[fitting - 1] if fitting and breaks[fitting - 1] >= start + longest // 2 else start + longest
            yield start, end
            start = max(start + 1, end - shared)
        if start < len(whole):
            yield start, len(whole)

    return [piece for a, b in spans() if (piece := whole[a:b].strip())]
