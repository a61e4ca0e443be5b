"""Removal of word windows that an earlier document has, by FM-index shards.

1. Every text is read once for its words (64-bit hashes) and its marks: of
   each ``WINDOW`` words, the run of ``SEED`` words with the smallest hash.
   Equal windows have equal marks, so two documents share a window only if
   they share a mark.  A mark carries a digest of its region: all windows
   that contain the marked run.
2. Marks are summed up (partial aggregation): those of one document only are
   dropped.  Where a whole region stands in an earlier document, all of it
   goes; no text is needed for that, however many copies there are.
3. Marks that stand in different regions need their words.  Each distinct
   region is written once, in the shard of its mark, and every shard builds a
   compressed FM-index of its regions (``fm_index``).  The regions then run
   through it by backward search over the wavelet tree; where the matching
   statistic reaches ``WINDOW``, the suffixes that match name the first
   document.
4. A mark with more than ``LIMIT`` distinct regions would overfill a shard.
   Its regions' windows are summed up by their digests instead, which is exact
   at any number.
5. A document's intervals are put together and its kept words are hashed.

Words count as equal by 64-bit hashes, regions by two of them.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, stage, utf8
from .fm_index import FmIndex

WINDOW = 50
#: Words of a marked run.  Of a window's WINDOW - SEED + 1 runs one is marked.
SEED = 12
#: Distinct regions of one mark that a shard takes.
LIMIT = 4096
#: Regions of a shard, about.
SHARD = 8192
#: Bytes of text read at once.
PIECE = 1 << 20

_WHITE = b"\t\n\x0b\x0c\r "
_U64 = (1 << 64) - 1
_draw = np.random.default_rng(13)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.isin(np.arange(256), list(_WHITE))
_BASE = int(_draw.integers(1 << 62, 1 << 63)) | 3
_MIX = _draw.integers(1 << 62, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return tuple(out)


def _mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX[salt]
    return values ^ (values >> np.uint64(29))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text, in order: 64-bit hashes and where they begin.

    A word's hash is a sum of its bytes' values times powers of a base, so a
    piece of text is hashed by one running sum, and a word that crosses pieces
    by adding its parts.
    """
    hashes, begins = [], []
    rest, rest_length, open_ = 0, 0, False
    up, down = _powers(PIECE)
    for at in range(0, len(text), PIECE):
        octets = np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at)
        inside = ~_IS_WHITE[octets]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        low, high = edges[::2], edges[1::2]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[octets] * up[: len(octets)] * inside)))
        made = (total[high] - total[low]) * down[low]
        if open_:
            if len(low) and low[0] == 0:  # goes on
                made[0] = (rest + int(made[0]) * pow(_BASE, rest_length, 1 << 64)) & _U64
                length = rest_length + int(high[0])
            else:
                hashes.append(np.array([rest], np.uint64))
                length = 0
        else:
            length = 0
            if len(low) and low[0] == 0:
                length = int(high[0])
        begins.append(low[1:] + at if open_ and len(low) and low[0] == 0 else low + at)
        open_ = bool(len(high)) and high[-1] == len(octets)
        if open_:
            rest = int(made[-1])
            rest_length = length if len(high) == 1 and low[0] == 0 else int(high[-1] - low[-1])
            made = made[:-1]
        hashes.append(made)
    if open_:
        hashes.append(np.array([rest], np.uint64))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _mixed(np.concatenate(hashes)), np.concatenate(begins).astype(np.int64)


def marks(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' words, one after another; text i has words[bounds[i]:bounds[i + 1]] -> (text, place, mark, region) of each mark."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    n = len(words)
    if n < WINDOW:
        return none
    runs = {1: words}
    size = 1
    while size * 2 <= SEED:
        runs[size * 2] = _mixed(runs[size][:-size] * _MIX[1] + runs[size][size:], 2)
        size *= 2
    seeds, done = runs[size], size
    while done < SEED:
        more = 1 << ((SEED - done).bit_length() - 1)
        seeds = _mixed(seeds[: n - done - more + 1] * _MIX[3] + runs[more][done : n - more + 1], 4)
        done += more
    span = WINDOW - SEED + 1
    least, best = seeds, np.arange(len(seeds))
    size = 1
    while size < span:
        step = min(size, span - size)
        a, b = slice(0, len(least) - step), slice(step, len(least))
        right = least[b] < least[a]
        least, best = np.where(right, least[b], least[a]), np.where(right, best[b], best[a])
        size += step
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(of[: len(best)] == of[WINDOW - 1 : WINDOW - 1 + len(best)])
    if not len(whole):
        return none
    place = np.unique(best[whole])
    text = of[place]
    low, high = np.maximum(bounds[text], place - (span - 1)), np.minimum(bounds[text + 1], place + WINDOW)
    size = 1 << max(16, n.bit_length())
    up, down = _powers(size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n])))
    region = _mixed((total[high] - total[low]) * down[low], 5)
    region = _mixed(region ^ (((high - low) << 8) | (place - low)).astype(np.uint64) * _MIX[6], 7)
    return text, place - bounds[text], seeds[place], region


def region_of(place: int | np.ndarray, n: int | np.ndarray) -> tuple:
    """The words [low, high) of all windows that contain the run at ``place``, in a text of n words."""
    return np.maximum(0, place - (WINDOW - SEED)), np.minimum(n, place + WINDOW)


def _spaced(text: bytes) -> bytes:
    """The words of a text, joined by one space."""
    if len(text) < PIECE:
        return b" ".join(text.split())
    text = text.translate(bytes.maketrans(_WHITE, b" " * len(_WHITE)))
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.strip(b" ")


_SKETCH = "doc_id long, tid long, n_words long, all_sha256 string, marks array<struct<mark:long,region:long,place:int>>"


def _sketch(batches):
    """(doc_id, tid, text) -> word count, digest of all words, marks."""
    release()
    for batch in slices(batches, 256, 2 << 20):
        texts = [utf8(t) for t in batch.column("text").to_pylist()]
        words = [word_hashes(t)[0] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        text, place, mark, region = marks(np.concatenate(words) if words else np.empty(0, np.uint64), bounds)
        counts = np.bincount(text, minlength=len(texts))
        found = pa.StructArray.from_arrays([pa.array(mark.view(np.int64)), pa.array(region.view(np.int64)), pa.array(place.astype(np.int32))], ["mark", "region", "place"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), found)
        shas = [hashlib.sha256(_spaced(t)).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(sizes), pa.array(shas), lists], ["doc_id", "tid", "n_words", "all_sha256", "marks"])
    release()


_WORDS = "mark long, region long, first_doc long, words binary"


def _region_words(batches):
    """(doc_id, text, asks) -> the words of each asked region."""
    release()
    for batch in slices(batches, 64, 2 << 20):
        out = []
        for doc_id, text, asks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asks"))):
            words, _ = word_hashes(utf8(text))
            for ask in asks:
                low, high = region_of(ask["place"], len(words))
                out.append((ask["mark"], ask["region"], doc_id, words[low:high].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["mark", "region", "first_doc", "words"])
    release()


_SPANS = "array<struct<low:int,high:int>>"
_FOUND = f"mark long, region long, spans {_SPANS}"


def search_shard(shard: pa.Table) -> pa.Table:
    """Regions (mark, region, first_doc, words) -> (mark, region, spans): what an earlier document's region has of each, from the region's begin."""
    docs = shard.column("first_doc").to_numpy()
    words = [np.frombuffer(w, np.uint64) for w in shard.column("words").to_pylist()]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + 1)
    _, symbols = np.unique(np.concatenate(words), return_inverse=True)
    kept = np.ones(ends[-1], bool)
    kept[ends - 1] = False
    text = np.zeros(ends[-1], np.int64)
    text[kept] = symbols.reshape(-1) + 1
    index = FmIndex(text, WINDOW)
    of = np.repeat(docs, sizes + 1)[index.order]
    groups = np.flatnonzero(index.lcp[:-1] < WINDOW)
    first = np.repeat(np.minimum.reduceat(of, groups), np.diff(np.append(groups, len(of))))
    width = int(sizes.max())
    queries = np.zeros((len(words), width), np.int64)
    queries[np.arange(width) < sizes[:, None]] = text[kept]
    hits = np.zeros((len(words), width + 1), bool)
    for column, low, length in index.matches(queries):
        full = np.flatnonzero(length == WINDOW)
        hits[full, column] = first[low[full]] < docs[full]
    edges = np.diff(hits.astype(np.int8), axis=1, prepend=0)
    row, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1] + WINDOW - 1
    found, counts = np.unique(row, return_counts=True)
    spans = pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["low", "high"])
    chosen = shard.select(["mark", "region"]).take(pa.array(found))
    return pa.table([*chosen.columns, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), spans)], ["mark", "region", "spans"])


def _windows(batches):
    """Region words -> (mark, region, first_doc, low, one, two): each window's place and digests."""
    up = _powers(1 << 16)[0][:WINDOW]
    for batch in slices(batches, 512):
        for mark, region, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("mark", "region", "first_doc", "words"))):
            words = np.frombuffer(raw, np.uint64)
            if len(words) < WINDOW:
                continue
            views = np.lib.stride_tricks.sliding_window_view(words, WINDOW)
            one, two = (_mixed((view * up).sum(axis=1, dtype=np.uint64), 3).view(np.int64) for view in (views, _mixed(views, 6)))
            n = len(one)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, mark)), pa.array(np.full(n, region)), pa.array(np.full(n, doc)), pa.array(np.arange(n, dtype=np.int32)), pa.array(one), pa.array(two)], ["mark", "region", "first_doc", "low", "one", "two"]
            )


def _kept(batches):
    """(doc_id, tid, text, sure, found) -> n_removed and the digest of the words that stay."""
    release()
    for batch in slices(batches, 64, 2 << 20):
        removed, digests = [], []
        for text, sure, found in zip(*(batch.column(c).to_pylist() for c in ("text", "sure", "found"))):
            octets = utf8(text)
            words, begins = word_hashes(octets)
            change = np.zeros(len(words) + 1, np.int64)
            for spans in (sure, found):
                if spans:
                    np.add.at(change, [s["low"] for s in spans], 1)
                    np.add.at(change, [s["high"] for s in spans], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            running = hashlib.sha256()
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=1, append=1))
            for i, (low, high) in enumerate(zip(edges[::2].tolist(), edges[1::2].tolist())):
                end = begins[high] if high < len(words) else len(octets)
                running.update((b" " if i else b"") + _spaced(octets[begins[low] : end]))
            digests.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(removed, pa.int64()), pa.array(digests)], ["doc_id", "tid", "n_removed", "kept_sha256"])
    release()


def _span(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def remove_repeats(docs: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256), one row for each row.

    A word goes if a window of WINDOW words covers it whose words also begin
    somewhere in a document with a smaller doc_id.  Null and wordless texts
    have no words; texts of fewer than WINDOW words lose none.  Rows with one
    doc_id don't affect each other, and rows without doc_id neither lose words
    nor take them from others.  Repeated rows get the same result each.  An
    empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    sketch = stage(rows.select("doc_id", "tid", "text").mapInArrow(_sketch, _SKETCH), "substrings-sketch")
    each = sketch.where("doc_id IS NOT NULL").select("doc_id", "tid", "n_words", F.inline("marks"))
    shared = each.groupBy("mark").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), (F.min("region") < F.max("region")).alias("mixed")).where("_low < _high").select("mark", "mixed")
    each = stage(each.join(shared, "mark"), "substrings-shared")

    first = F.min(F.struct("doc_id", "tid", "place")).alias("first")
    regions = each.groupBy("mark", "region").agg(first, F.first("mixed").alias("mixed")).select("mark", "region", F.col("first.doc_id").alias("first_doc"), F.col("first.tid").alias("first_tid"), F.col("first.place").alias("first_place"), "mixed")
    regions = stage(regions, "substrings-regions")
    counts = regions.where("mixed").groupBy("mark").agg(F.count("*").alias("n"))
    crowded = stage(counts.where(F.col("n") > limit).select("mark", F.lit(True).alias("crowded")), "substrings-crowded")
    any_crowded = bool(crowded.head(1))

    low, high = F.greatest(F.lit(0), F.col("place") - (WINDOW - SEED)), F.least(F.col("n_words"), F.col("place") + WINDOW)
    here = each.join(regions.select("mark", "region", "first_doc"), ["mark", "region"])
    no_span, no_ask = F.lit(None).cast("struct<low:int,high:int>"), F.lit(None).cast("struct<mark:long,region:long,place:int>")
    sure = here.where("doc_id > first_doc").select("doc_id", "tid", _span(low, high).alias("span"), no_ask.alias("ask"))
    asks = regions.where("mixed").select(F.col("first_doc").alias("doc_id"), F.col("first_tid").alias("tid"), no_span.alias("span"), F.struct("mark", "region", F.col("first_place").alias("place")).alias("ask"))
    wanted = sure.unionByName(asks).groupBy("doc_id", "tid").agg(F.collect_set("span").alias("sure"), F.collect_set("ask").alias("asks"))
    involved = stage(rows.join(wanted, ["doc_id", "tid"]), "substrings-texts")
    if involved.groupBy("doc_id", "tid").count().where("count > 1").head(1):
        involved = stage(involved.dropDuplicates(["doc_id", "tid"]), "substrings-texts")

    spread = involved.where(F.size("asks") > 0).select("doc_id", "text", "asks").mapInArrow(_region_words, _WORDS)
    n_shards = max(1, -(-regions.where("mixed").count() // shard))
    if any_crowded:
        spread = stage(spread.join(crowded, "mark", "left"), "substrings-words")
        quiet = spread.where("crowded IS NULL").drop("crowded")
    else:
        quiet = spread
    # distinct regions of one mark stay together
    found = quiet.groupBy(F.pmod(F.xxhash64("mark"), F.lit(n_shards)).alias("shard")).applyInArrow(_searched, _FOUND)
    if any_crowded:
        windows = spread.where("crowded").select("mark", "region", "first_doc", "words").mapInArrow(_windows, "mark long, region long, first_doc long, low int, one long, two long")
        earliest = windows.groupBy("mark", "one", "two").agg(F.min("first_doc").alias("earliest"))
        late = windows.join(earliest, ["mark", "one", "two"]).where("first_doc > earliest")
        # a region has WINDOW - SEED + 1 windows at most
        found = found.unionByName(late.groupBy("mark", "region").agg(F.collect_list(_span(F.col("low"), F.col("low") + WINDOW)).alias("spans")))
    found = stage(found, "substrings-found")

    own = here.where("doc_id = first_doc AND mixed").join(found, ["mark", "region"]).select("doc_id", "tid", F.transform("spans", lambda s: _span(low + s["low"], low + s["high"])).alias("spans"))
    own = own.groupBy("doc_id", "tid").agg(F.flatten(F.collect_set("spans")).alias("found"))
    ready = involved.join(own, ["doc_id", "tid"], "left").select("doc_id", "tid", "text", "sure", "found")
    outcome = stage(ready.mapInArrow(_kept, "doc_id long, tid long, n_removed long, kept_sha256 string"), "substrings-outcome")
    return sketch.select("doc_id", "tid", "n_words", "all_sha256").join(outcome, ["doc_id", "tid"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")
    )


def _searched(shard: pa.Table) -> pa.Table:
    return search_shard(shard.select(["mark", "region", "first_doc", "words"]))
