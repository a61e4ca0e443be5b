"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf sequence: blocks of text between block-level
tags, each with the path of open elements (tags, class and id words).  A
bidirectional LSTM in numpy reads one vector a block (hashed path parts,
hashed words and a few shape features) and labels every block as main text or
not, seeing the whole page in both directions.  Main blocks, white space made
single, are joined by line feeds.

The labeller is trained here, on pages of a seeded generator
(:mod:`sievewright.llm.html_training`), the first time a process needs it.
"""

from __future__ import annotations

import collections
import functools
import html as html_lib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by_worker, release, slices

#: Elements that start and end blocks, by the HTML standard's rendering rules, and br.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe input label legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td textarea tfoot th thead tr ul video audio canvas".split()
)
#: Elements whose content is never shown as text.
HIDDEN_TAGS = frozenset("script style template noscript svg math object iframe head title canvas audio video".split())
#: Elements whose content is not markup.
RAW_TAGS = frozenset("script style textarea title iframe noscript xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag of the key ends an open element of the values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
#: Elements that can stand in a head; any other ends it, as text does.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements in which, and in whose content, a tag can close itself.
FOREIGN_TAGS = frozenset("svg math".split())
#: Elements of foreign content whose own content is HTML.
ISLANDS = frozenset("foreignobject desc annotation-xml".split())
#: Tags that end foreign content, by the HTML standard's parsing rules.
BREAKOUT_TAGS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
_FONT = re.compile(r"(?:^|[\s\"'/])(?:color|face|size)(?=[\s=/]|\Z)", re.I)
PATHS, WORDS, SHAPES = 1024, 2048, 8
WORD_SCALE = 3.0

#: A comment (closed at once by > or ->), a tag with its attributes (quotes count only at the start of a value), or a declaration.
_TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]++)?+)*+)>?|[!?/][^>]*>?)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNQUOTED_END = re.compile(r"=\s*[^\s\"']*\Z")
_PART = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW_TAGS}


class Path:
    """The open elements' parts: an element's own (tag, then class, id and role words) and the path above it.

    What a path knows of its ancestors is handed down, never walked: ``seen``
    is shared with the path above unless an own part is new to it.
    """

    __slots__ = ("last", "seen", "size")

    def __init__(self, above: Path | None, own: tuple[str, ...]):
        self.size = len(own) + (above.size if above else 0)
        self.last = ((above.last if above else ()) + own)[-2:]
        seen = above.seen if above else {}
        new = [b for b in map(_part_bucket, own) if b not in seen]
        self.seen = {**seen, **dict.fromkeys(new)} if new else seen

    def buckets(self) -> list[int]:
        """Hashed parts, each once, and the last two together."""
        return list(dict.fromkeys([*self.seen, zlib.crc32(b"leaf:" + "/".join(self.last).encode("utf-8", "replace")) % PATHS]))


class Leaf:
    """A block's text, its path and how many of its characters are links."""

    __slots__ = ("link", "path", "text")

    def __init__(self, text: str, path: Path, link: int):
        self.text, self.path, self.link = text, path, link


def leaves(html: str | None) -> list[Leaf]:
    """The leaf sequence of a page; blocks without text are left out.

    An open svg or math ends at the tags that end foreign content in the HTML
    standard, and at ``</p>`` and ``</br>``, unless an element of it with HTML
    content (foreignObject, desc, annotation-xml) is open.  The standard's
    text points of math (mi and the like) hold nothing back here, so a page
    that leaves one open loses no text after it.
    """
    out: list[Leaf] = []
    top = Path(None, ())
    stack: list[tuple[str, Path]] = []
    count: collections.Counter[str] = collections.Counter()  # open elements of each tag
    marks: list[int] = []  # places of open svg, math and islands
    held: list[str] = []
    at, hidden, linked, link = 0, 0, False, 0
    html = html or ""

    def flush() -> None:
        nonlocal link
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Leaf(text, stack[-1][1] if stack else top, link))
            held.clear()
        link = 0

    def pop() -> None:
        nonlocal hidden
        tag = stack.pop()[0]
        count[tag] -= 1
        hidden -= tag in HIDDEN_TAGS
        if marks and marks[-1] == len(stack):
            marks.pop()

    def foreign() -> bool:
        return bool(marks) and stack[marks[-1]][0] in FOREIGN_TAGS

    def leave_foreign() -> None:
        flush()
        while foreign():
            pop()

    def keep(raw: str) -> None:
        nonlocal link
        if stack and stack[-1][0] == "head" and raw.strip():
            pop()
        if raw and not hidden:
            text = html_lib.unescape(raw) if "&" in raw else raw
            held.append(text)
            if linked:
                link += len(text.strip())

    while True:
        found = _TAG.search(html, at)
        if not found:
            keep(html[at:])
            break
        keep(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "a":
                linked = False
            if tag in ("p", "br") and foreign():
                leave_foreign()
            if tag in BLOCK_TAGS or tag in HIDDEN_TAGS or (marks and tag in ISLANDS):
                flush()
                while count[tag]:
                    if stack[-1][0] == tag:
                        pop()
                        break
                    pop()
            continue
        if marks and foreign() and (tag in BREAKOUT_TAGS or tag == "font" and _FONT.search(found[3])):
            leave_foreign()
        if stack and stack[-1][0] == "head" and tag not in HEAD_TAGS:
            pop()
        if tag == "a":
            linked = True
        if tag not in BLOCK_TAGS and tag not in HIDDEN_TAGS and not (marks and tag in ISLANDS):
            continue
        flush()
        if tag in VOID_TAGS:
            continue
        if found[3].endswith("/") and not _UNQUOTED_END.search(found[3]) and (tag in FOREIGN_TAGS or marks):
            continue
        ends = CLOSES.get(tag, ())
        while stack and (stack[-1][0] in ends or stack[-1][0] == "p"):
            pop()
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(html, at)
            body, at = (html[at : end.start()], end.end()) if end else (html[at:], len(html))
            if tag == "textarea":
                keep(body)
                flush()
            continue
        named = [p.lower() for m in _NAMED.findall(found[3]) for p in _PART.findall("".join(m))] if "=" in found[3] else []
        stack.append((tag, Path(stack[-1][1] if stack else None, (tag, *(f".{p}" for p in named)))))
        count[tag] += 1
        hidden += tag in HIDDEN_TAGS
        if tag in FOREIGN_TAGS or tag in ISLANDS:
            marks.append(len(stack) - 1)
    flush()
    return out


@held_by_worker
@functools.lru_cache(maxsize=100_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORDS


@held_by_worker
@functools.lru_cache(maxsize=10_000)
def _part_bucket(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "replace")) % PATHS


class Page:
    """A page's features: path and word buckets of each block, and shapes."""

    def __init__(self, blocks: list[Leaf]):
        known: dict[int, list[int]] = {}
        self.paths = [known[id(b.path)] if id(b.path) in known else known.setdefault(id(b.path), b.path.buckets()) for b in blocks]
        self.words = [[_bucket(w) for w in b.text.lower().split()] for b in blocks]
        n = len(blocks)
        self.shapes = np.zeros((n, SHAPES), np.float32)
        for i, b in enumerate(blocks):
            size, words = len(b.text), len(self.words[i])
            self.shapes[i] = (
                min(1.0, size / 400), min(1.0, words / 60), min(1.0, b.link / size), b.text[-1] in ".!?:;\"'”…",
                b.path.size / 16, i / n, _DIGIT.search(b.text) is not None, 1.0,
            )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs (forwards and backwards) and a logistic output."""

    def __init__(self, size: int = 16, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        width = 2 * size + SHAPES
        self.size, self.hidden = size, hidden
        self.p = {"path": rng.normal(0, 0.1, (PATHS, size)), "word": rng.normal(0, 0.02, (WORDS, size)), "out": rng.normal(0, 0.2, 2 * hidden), "bias": np.zeros(1)}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.2, (width, 4 * hidden)), f"h{d}": rng.normal(0, 0.2, (hidden, 4 * hidden)), f"c{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}

    def inputs(self, pages: list[Page]) -> tuple[np.ndarray, tuple]:
        """(blocks, width) vectors of all pages' blocks in order."""
        paths = np.array([p for page in pages for block in page.paths for p in block], np.int64)
        path_n = np.array([len(b) for page in pages for b in page.paths], np.int64)
        words = np.array([w for page in pages for block in page.words for w in block], np.int64)
        word_n = np.array([len(b) for page in pages for b in page.words], np.int64)
        x = np.concatenate([
            np.add.reduceat(self.p["path"][paths], np.cumsum(path_n) - path_n),
            np.add.reduceat(self.p["word"][words], np.cumsum(word_n) - word_n) * (WORD_SCALE / word_n)[:, None],
            np.concatenate([page.shapes for page in pages]),
        ], 1)
        return x, (paths, path_n, words, word_n)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """(T, B, hidden) states of one direction; mask (T, B) is false beyond a page's end."""
        steps, batch = mask.shape
        n, weights = self.hidden, self.p[f"h{d}"]
        gates = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
        out = np.zeros((steps, batch, n), x.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ weights
            ifo, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
            fresh = f * c + i * g
            squashed = np.tanh(fresh)
            live = mask[t][:, None]
            if trace is not None:
                trace.append((t, i, f, o, g, c, squashed, h))
            c, h = np.where(live, fresh, c), np.where(live, o * squashed, h)
            out[t] = h
        return out

    def probabilities(self, pages: list[Page], cells: int = 16_384) -> list[np.ndarray]:
        """Of each page, each block's probability of being main text."""
        out = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i].paths), key=lambda i: len(pages[i].paths))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(pages[order[stop]].paths) * (stop + 1 - at) <= cells:
                stop += 1
            some, at = order[at:stop], stop
            vectors, _ = self.inputs([pages[i] for i in some])
            sizes = np.array([len(pages[i].paths) for i in some])
            where_t, where_b = np.concatenate([np.arange(n) for n in sizes]), np.repeat(np.arange(len(some)), sizes)
            x = np.zeros((sizes.max(), len(some), vectors.shape[1]), np.float32)
            x[where_t, where_b] = vectors
            mask = np.arange(sizes.max())[:, None] < sizes[None]
            both = np.concatenate([self.run(x, mask, "f"), self.run(x, mask, "b")], 2)
            score = _sigmoid(both @ self.p["out"] + self.p["bias"])
            for b, i in enumerate(some):
                out[i] = score[: sizes[b], b]
        return out

    def compact(self) -> Labeller:
        """Single-precision weights for labelling."""
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self


@functools.lru_cache(maxsize=1)
def labeller() -> Labeller:
    from .html_training import train

    return train()


def main_text(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page; empty if none."""
    blocks = [leaves(h) for h in pages]
    scores = model.probabilities([Page(b) for b in blocks])
    return ["\n".join(b.text for b, p in zip(page, own) if p >= 0.5) for page, own in zip(blocks, scores)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars), a row for each row.

    A null or empty html, and a page without main text, give an empty text.
    Null and repeated page_ids and null urls pass through; other columns are
    ignored; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or labeller())

    def run(batches):
        release()
        for batch in slices(batches):
            texts = main_text(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
