"""Language identification of code-switched text by a linear-chain CRF.

Every word of a text is a position of the chain, its language the label.  The
features of a word are hashed character n-grams of the word between boundary
marks (those that hold a mark are its affixes) and the word itself (the
lexicon); transitions between neighbouring words' languages are learned too.
Training maximises the chain's conditional likelihood by AdaGrad on windows
of labelled texts, some spliced from two languages, so that switches are seen
as well as runs.  Labels of words come from forward-backward over whole texts;
a text's language is the one with the largest mean marginal.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

UNKNOWN = "und"
#: Bounds of the training sample: rows of a language, windows of a row, words of a window.
TRAIN_ROWS = 400
TRAIN_WINDOWS = 6
WINDOW = 32
TABLE = 1 << 16
ORDERS = (1, 2, 3, 4)
PASSES = 6
SPLICED = 0.3
CELLS = 1 << 17
CHUNK = 300
SEED = 7

#: Characters that \\w takes and that are neither letters nor decimal digits: superscripts, fractions, Roman and circled numbers.
_NUMBERS = [c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
#: Those above U+FFFF aren't in the class, which would make it slow for every text; they are blanked out where a text has such characters.
_WORD = re.compile(rf"[^\W\d_{''.join(c for c in _NUMBERS if ord(c) < 0x10000)}]+")
_HIGH = re.compile("[\U00010000-\U0010ffff]")
_BLANK = str.maketrans(dict.fromkeys((c for c in _NUMBERS if ord(c) >= 0x10000), " "))
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low.translate(_BLANK) if _HIGH.search(low) else low)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and where each word's features begin.

    TABLE is the index of no feature, which has no weight.
    """
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    marks = codes == ord("^")
    word = np.cumsum(marks) - 1
    starts = np.flatnonzero(marks)
    n, columns = len(codes), []
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for order in range(1, max(ORDERS) + 1):
            k = n - order + 1
            if k <= 0:
                break
            mixed = mixed[:k] * _P + codes[order - 1 :] + np.uint64(order)
            if order in ORDERS:
                column = np.full(n, TABLE, np.int64)
                inside = word[:k] == word[order - 1 :]
                column[:k][inside] = ((mixed * _P) >> np.uint64(64 - 16))[inside].astype(np.int64)
                columns.append(column)
        place = (np.arange(n) - starts[word]).astype(np.uint64)
        whole = np.add.reduceat(codes * (place * place + np.uint64(31) * place + np.uint64(7)) * _P, starts)
        lexicon = np.full(n, TABLE, np.int64)
        lexicon[starts] = ((whole * _P) >> np.uint64(64 - 16)).astype(np.int64)
    columns.append(lexicon)
    return np.stack(columns, 1).ravel(), starts * len(columns)


def chain(emission: np.ndarray, mask: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over B chains at once.

    emission: (T, B, L) scores; mask: (T, B), false after a chain's end.
    Returns marginals (T, B, L) and the expected transition counts (L, L).
    """
    steps, batch, size = emission.shape
    scale = np.exp(emission - emission.max(2, keepdims=True))
    move, back = np.exp(transition), np.exp(transition).T
    alpha = np.empty_like(scale)
    state = np.exp(start)[None] * scale[0]
    alpha[0] = state = state / state.sum(1, keepdims=True)
    for t in range(1, steps):
        ahead = (state @ move) * scale[t]
        state = np.where(mask[t][:, None], ahead / ahead.sum(1, keepdims=True), state)
        alpha[t] = state
    marginal = np.empty_like(scale)
    pairs = np.zeros((size, size))
    beta = np.ones((batch, size))
    for t in range(steps - 1, -1, -1):
        both = alpha[t] * beta
        marginal[t] = both / both.sum(1, keepdims=True)
        if t:
            inner = scale[t] * beta
            joint = alpha[t - 1][:, :, None] * move[None] * inner[:, None, :]
            pairs += (joint * (mask[t] / joint.sum((1, 2)))[:, None, None]).sum(0)
            behind = inner @ back
            beta = np.where(mask[t][:, None], behind / behind.sum(1, keepdims=True), beta)
    return marginal * mask[:, :, None], pairs


def posteriors(emission: np.ndarray, mask: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals as in :func:`chain`, without transition counts; overwrites emission."""
    steps = len(emission)
    emission -= emission.max(2, keepdims=True)
    scale = np.exp(emission, out=emission)
    move, back = np.exp(transition).astype(scale.dtype), np.exp(transition).T.astype(scale.dtype)
    alpha = np.zeros_like(scale)
    state = np.exp(start).astype(scale.dtype)[None] * scale[0]
    state /= state.sum(1, keepdims=True)
    alpha[0] = state
    live = mask.sum(1)  # chains are ordered by length, longest first
    for t in range(1, steps):
        n = live[t]
        ahead = (state[:n] @ move) * scale[t, :n]
        ahead /= ahead.sum(1, keepdims=True)
        state = alpha[t, :n] = ahead
    beta = np.ones_like(scale[0])
    for t in range(steps - 1, 0, -1):
        n = live[t]
        inner = scale[t, :n] * beta[:n]
        alpha[t, :n] *= beta[:n]
        behind = inner @ back
        beta[:n] = behind / behind.sum(1, keepdims=True)
    alpha[0] *= beta
    alpha /= np.maximum(alpha.sum(2, keepdims=True), 1e-30)
    return alpha * mask[:, :, None]


class Model:
    """Weights of a trained chain; ``languages`` are its labels in order."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.languages, self.weights, self.transition, self.start = languages, weights, transition, start

    def score_words(self, words: list[str]) -> np.ndarray:
        index, starts = features(words)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.weights[k][index], starts)
        return out

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """(words, L) marginals of each text's words; texts of no words give none."""
        out: list[np.ndarray] = [np.zeros((0, len(self.languages)), np.float32)] * len(texts)
        for rows, table in self._batches(texts):
            for b, i in enumerate(rows):
                out[i] = table[: len(texts[i]), b]
        return out

    def means(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, L) mean marginals, and the mean of each word's best marginal; zeros for texts of no words."""
        out, sure = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for rows, table in self._batches(texts):
            sizes = np.array([len(texts[i]) for i in rows])
            out[rows] = table.sum(0, dtype=np.float64) / sizes[:, None]
            sure[rows] = table.max(2).sum(0, dtype=np.float64) / sizes
        return out, sure

    def _batches(self, texts: list[list[str]]):
        place: dict[str, int] = {}
        coded = [np.array([place.setdefault(w, len(place)) for w in words], np.int32) for words in texts]
        if not place:
            return
        table, known = self._emissions(list(place)), sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(known):
            steps = len(texts[known[at]])
            rows = known[at : at + max(1, CELLS // steps)]
            at += len(rows)
            grid = np.full((len(rows), steps), len(table) - 1, np.int32)
            for b, i in enumerate(rows):
                grid[b, : len(coded[i])] = coded[i]
            mask = np.arange(steps)[:, None] < np.array([len(coded[i]) for i in rows])[None]
            yield rows, posteriors(table[grid.T], mask, self.transition, self.start)

    def _emissions(self, words: list[str]) -> np.ndarray:
        parts = [self.score_words(words[i : i + 8_000]) for i in range(0, len(words), 8_000)]
        return np.concatenate([*parts, np.zeros((1, len(self.languages)), np.float32)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Each text's language, its mean marginal, and how sure its words' labels are."""
        words = [words_of(t) for t in texts]
        means, sure = self.means(words)
        best = means.argmax(1) if len(self.languages) else np.zeros(len(texts), int)
        names = [self.languages[k] if w and self.languages else UNKNOWN for k, w in zip(best, words)]
        known = [n != UNKNOWN for n in names]
        return names, [float(min(1.0, m[k])) if n else 0.0 for m, k, n in zip(means, best, known)], [float(min(1.0, s)) if n else 0.0 for s, n in zip(sure, known)]


def windows_of(text: str | None) -> list[list[str]]:
    """Up to TRAIN_WINDOWS windows of WINDOW words, spread evenly over the text."""
    words = words_of(text)
    count = min(TRAIN_WINDOWS, -(-len(words) // WINDOW))
    return [words[low : low + WINDOW] for low in np.linspace(0, max(0, len(words) - WINDOW), count).astype(int)]


def train(rows: list[tuple[str, str]], seed: int = SEED) -> Model:
    """rows: (text, language), a bounded sample.  Deterministic."""
    return train_windows([(windows_of(text), lang) for text, lang in rows], seed)


def train_windows(rows: list[tuple[list[list[str]], str]], seed: int = SEED) -> Model:
    """rows: (windows of words, language).  Deterministic."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    windows = [(part, np.full(len(part), languages.index(lang))) for parts, lang in rows for part in parts]
    for i in np.flatnonzero(rng.random(len(windows)) < SPLICED) if windows else []:
        other, cut = windows[rng.integers(len(windows))], int(rng.integers(1, WINDOW))
        windows[i] = (windows[i][0][:cut] + other[0][cut:], np.concatenate([windows[i][1][:cut], other[1][cut:]]))
    size = len(languages)
    weights, transition, start = np.zeros((size, TABLE + 1)), np.zeros((size, size)), np.zeros(size)
    sums = [np.full_like(weights, 1e-2), np.full_like(transition, 1e-2), np.full_like(start, 1e-2)]
    for _ in range(PASSES if windows else 0):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), 128):
            batch = [windows[i] for i in order[low : low + 128]]
            flat = [w for words, _ in batch for w in words]
            index, starts = features(flat)
            emission = np.stack([np.add.reduceat(weights[k][index], starts) for k in range(size)], 1)
            sizes = np.array([len(w) for w, _ in batch])
            steps = int(sizes.max())
            mask = np.arange(steps)[:, None] < sizes[None]
            at_t = np.concatenate([np.arange(n) for n in sizes])
            at_b = np.repeat(np.arange(len(batch)), sizes)
            grid = np.zeros((steps, len(batch), size))
            grid[at_t, at_b] = emission
            truth = np.concatenate([y for _, y in batch])
            marginal, pairs = chain(grid, mask, transition, start)
            error = marginal[at_t, at_b]
            error[np.arange(len(truth)), truth] -= 1
            each = np.diff(np.append(starts, len(index)))
            slopes = [np.stack([np.bincount(index, np.repeat(error[:, k], each), TABLE + 1) for k in range(size)]), pairs, marginal[0].sum(0)]
            follow = (at_t[1:] > 0) & (at_b[1:] == at_b[:-1])
            np.subtract.at(slopes[1], (truth[:-1][follow], truth[1:][follow]), 1)
            np.subtract.at(slopes[2], truth[at_t == 0], 1)
            slopes[0][:, TABLE] = 0
            for value, total, slope in zip((weights, transition, start), sums, slopes):
                slope /= len(batch)
                total += slope * slope
                value -= 0.1 * slope / np.sqrt(total)
    return Model(languages, weights.astype(np.float32), transition, start)


def held_out(docs: DataFrame, doc_id: str = "doc_id"):
    """True where crc32 of the id as text is 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on about ``rows`` texts of each language, chosen by hash.

    Only rows that are not held out and have a text and a lang are used.  The
    sample's expected size is ``rows`` times the number of languages,
    whatever the table's size; of each text TRAIN_WINDOWS windows go to the
    driver.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(docs)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < F.try_element_at(share, "lang") * (1 << 30)

    def cut(batches):
        for batch in batches:
            parts = [windows_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(parts, pa.list_(pa.list_(pa.string())))], ["lang", "doc_id", "parts"])

    rows = usable.where(drawn).select("lang", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.mapInArrow(cut, "lang string, doc_id string, parts array<array<string>>").collect()
    return train_windows([(r.parts, r.lang) for r in sorted(sample, key=lambda r: (r.doc_id, r.parts))])


def identify(docs: DataFrame, model: Model | None = None, rows: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> (doc_id, held_out, lang_pred, score, certainty).

    One row for each row.  ``score`` is the mean marginal of the predicted
    language over the text's words, ``certainty`` the mean of each word's best
    marginal, which is high for a text that mixes known languages too.  A text that is null or has no letter is
    ``und`` with score 0, and so is every text if no labelled row exists.
    lang, source and doc_id play no part in a prediction.  With ``keep``,
    those columns of ``docs`` replace doc_id in the result; names that the
    result has itself (held_out, lang_pred, score, certainty) can't be kept and raise
    ValueError.  Other columns of ``docs`` are ignored, whatever their names;
    an empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    if {"held_out", "lang_pred", "score", "certainty"} & set(keep):
        raise ValueError("the result has columns of its own of these names")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, rows))
    own = [F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in keep]
    extra = [] if "text" in keep else [F.col("text").cast("string").alias("text")]
    source = docs.select(*own, *extra, held_out(docs).alias("held_out"))
    kept = [c for c in source.columns if c != "text" or not extra]
    schema = source.select(kept).schema.add("lang_pred", "string").add("score", "double").add("certainty", "double")

    def run(batches):
        release()
        model = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                names, scores, sure = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())], [*kept, "lang_pred", "score", "certainty"])

    return source.mapInArrow(run, schema)


def label_words(model: Model, text: str | None) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of each word of a text."""
    words = words_of(text)
    (table,) = model.marginals([words])
    return [(w, model.languages[int(p.argmax())], float(p.max())) for w, p in zip(words, table)]
