"""Labelled pages by a seeded generator, and the block labeller's training.

Every text run of a generated page begins with a private-use character that
tells whether it is main text; the labels are read back from the parsed
blocks, so they agree with the parser whatever the markup.  Pages vary in
layout, element and class names, and in broken markup.
"""

from __future__ import annotations

import random

import numpy as np

from .html_blocks import WORD_SCALE, Labeller, Leaf, Page, leaves

MAIN, REST = "", ""
PAGES = 1500
PASSES = 8

#: Words of page furniture, and names that mark it.
FURNITURE = {
    "nav": ("home about contact news menu sports archive login search", ("nav", "navbar", "menu", "navigation", "breadcrumb", "topnav")),
    "ad": ("advertisement sponsored buy now offer sale click here deal", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")),
    "side": ("popular posts recent trending tags related stories archive", ("sidebar", "side", "widget", "secondary", "related", "recommended")),
    "notice": ("we use cookies accept privacy policy consent notice alert", ("cookie", "notice", "consent", "alert", "gdpr", "popup", "modal")),
    "form": ("subscribe newsletter email name submit search sign up password", ("form", "subscribe", "newsletter", "signup", "searchbox")),
    "comments": ("reply comment says great post thanks for sharing anonymous", ("comments", "comment", "respond", "replies", "disqus", "commentlist")),
    "share": ("share tweet facebook email print follow us like this", ("share", "social", "sharing", "toolbar")),
    "footer": ("copyright all rights reserved terms privacy contact imprint ©", ("footer", "colophon", "copyright", "bottom")),
    "header": ("site logo tagline welcome log in register", ("header", "masthead", "topbar", "branding")),
}
CONTENT_NAMES = ("content", "post", "entry", "article", "body", "story", "text", "main", "page")
PARTS = "an the er on re st en ed le la de ou que ment sch ein ung keit ción os ar ado mi é è ü ä ß ñ tion ing ly th".split()


class Generator:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(PARTS) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.1:
            words = [w + self.r.choice(("###", "$$$", "&amp;&amp;", "%%%", "!!")) for w in words]
        if self.r.random() < 0.05:
            words = [w.upper() for w in words]
        return " ".join(words).capitalize() + self.r.choice((".", ".", ".", "", "!", "?"))

    def prose(self) -> str:
        kind = self.r.random()
        if kind < 0.15:
            return self.sentence(1, 3)
        if kind < 0.18:
            return " ".join([self.sentence(1, 8)] * self.r.randint(2, 40))
        return " ".join(self.sentence(3, 14) for _ in range(self.r.randint(1, 2 if kind < 0.5 else 7)))

    def named(self, names) -> str:
        if self.r.random() < 0.25:
            return ""
        name = self.r.choice(names) + self.r.choice(("", "", "", "-1", "-box", " wide", "-area"))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def phrase(self, kind: str) -> str:
        """Text of page furniture; as often as not it reads like prose."""
        if self.r.random() < 0.5:
            return self.sentence(2, 16)
        words = FURNITURE[kind][0].split()
        return " ".join(self.r.sample(words, self.r.randint(1, min(6, len(words))))).capitalize()

    def furniture(self, kind: str) -> str:
        r, names = self.r, FURNITURE[kind][1]
        text = lambda: REST + self.phrase(kind)
        if kind == "nav":
            items = "".join(f'<li><a href="/{i}">{REST}{self.word() if r.random() < 0.7 else self.phrase(kind)}</a>' + ("</li>" if r.random() < 0.8 else "") for i in range(r.randint(2, 9)))
            if r.random() < 0.5:
                return f"<nav{self.named(names) if r.random() < 0.4 else ''}><ul>{items}</ul></nav>"
            return f'<div class="{r.choice(names)}"><ul>{items}</ul></div>'
        if kind == "footer":
            inner = REST + f"&copy; {self.word()}.example &middot; {self.phrase(kind)}" if r.random() < 0.6 else f"<p>{text()}</p><p>{text()}</p>"
            return f"<footer{self.named(names) if r.random() < 0.4 else ''}>{inner}</footer>" if r.random() < 0.7 else f'<div class="{r.choice(names)}">{inner}</div>'
        if kind == "header":
            return f"<header{self.named(names)}><div>{text()}</div><p>{text()}</p></header>" if r.random() < 0.6 else f'<div class="{r.choice(names)}">{text()}</div>'
        if kind == "form":
            return f'<form{self.named(names)}><label>{text()}</label><input name="q"><button>{REST}{self.word()}</button>' + (f"<p>{text()}</p>" if r.random() < 0.5 else "") + "</form>"
        if kind == "comments":
            items = "".join(r.choice((f'<li class="comment"><p>{REST}{self.prose()}</p></li>', f'<div class="comment"><div>{REST}{self.word()}</div><p>{REST}{self.prose()}</p></div>')) for _ in range(r.randint(1, 6)))
            box = r.choice(("section", "div", "ol"))
            return f'<{box} {r.choice(("class", "id"))}="{r.choice(names)}"><h3>{text()}</h3>{items}</{box}>'
        if kind == "side":
            box = r.choice(("aside", "aside", "div"))
            inner = f"<h3>{text()}</h3>" + "".join(f"<p>{text()}</p>" if r.random() < 0.5 else f'<ul><li><a href="/x">{text()}</a></li></ul>' for _ in range(r.randint(1, 4)))
            return f"<aside{self.named(names)}>{inner}</aside>" if box == "aside" else f'<div class="{r.choice(names)}">{inner}</div>'
        inner = text() if r.random() < 0.6 else f"<p>{text()}</p>"
        return f'<{(box := r.choice(("div", "div", "section")))} {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-box", "-1"))}">{inner}</{box}>'

    def article(self) -> str:
        r, out = self.r, []
        title = MAIN + self.sentence(1, 12)
        if r.random() < 0.9:
            out.append(f"<h1>{title}</h1>" if r.random() < 0.8 else f"<h2>{title}</h2>")
        for _ in range(r.randint(1, 16)):
            kind, text = r.random(), MAIN + self.prose()
            if kind < 0.55:
                out.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.7:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.76:
                out.append(f"<h{r.randint(2, 4)}>{MAIN}{self.sentence(1, 8)}</h{2}>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{MAIN}{self.sentence(1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.89:
                out.append(f"<pre>{text}</pre>" if r.random() < 0.5 else f"<figure><img src=x><figcaption>{text}</figcaption></figure>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{MAIN}{self.word()}</td><td>{MAIN}{self.word()}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                out.append(f'<div>{text} <a href="/y">{self.word()}</a> {self.word()}</div>')
            else:
                out.append(self.furniture(r.choice(("ad", "side", "share", "form", "notice"))))
        inner = "".join(out)
        kind = r.random()
        if kind < 0.55:
            return f"<article{self.named(CONTENT_NAMES) if r.random() < 0.3 else ''}>{inner}" + (self.furniture(r.choice(("share", "comments", "footer"))) if r.random() < 0.15 else "") + "</article>"
        if kind < 0.7:
            return f"<main{self.named(CONTENT_NAMES)}>{inner}</main>"
        return f'<div {r.choice(("class", "id"))}="{r.choice(CONTENT_NAMES)}{r.choice(("", "-content", "-body", ""))}">{inner}</div>'

    def page(self) -> str:
        r = self.r
        if r.random() < 0.3:
            before, after = ["nav", "ad"], ["footer"]
        else:
            before = [k for k in ("header", "nav", "notice", "ad", "form", "side", "share") if r.random() < 0.4]
            after = [k for k in ("share", "comments", "side", "form", "ad", "notice", "nav", "footer") if r.random() < 0.4]
            r.shuffle(before)
        top = "".join(map(self.furniture, before))
        middle = "<!-- x -->" + self.article()
        bottom = "".join(map(self.furniture, after))
        if r.random() < 0.3:
            top, bottom = top + '<div class="wrapper">', "</div>" + bottom
        if r.random() < 0.2:
            top, bottom = top + "<main>", "</main>" + bottom
        head = f"<!DOCTYPE html><html><head><title>{self.sentence(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        return head + top + middle + bottom + ("</body></html>" if r.random() < 0.8 else "")


def labelled(count: int, seed: int) -> list[tuple[Page, np.ndarray]]:
    out, gen = [], Generator(seed)
    while len(out) < count:
        blocks = leaves(gen.page())
        truth = np.array([b.text.startswith(MAIN) for b in blocks], float)
        clean = [Leaf(b.text.replace(MAIN, "").replace(REST, "") or "-", b.path, b.link) for b in blocks]
        if clean:
            out.append((Page(clean), truth))
    return out


def gradients(model: Labeller, pages: list[Page], truth: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of a batch, and its slope by each weight (through time)."""
    p, n = model.p, model.hidden
    vectors, (paths, path_n, words, word_n) = model.inputs(pages)
    sizes = np.array([len(q.paths) for q in pages])
    at_t, at_b = np.concatenate([np.arange(k) for k in sizes]), np.repeat(np.arange(len(pages)), sizes)
    x = np.zeros((sizes.max(), len(pages), vectors.shape[1]))
    x[at_t, at_b] = vectors
    mask = np.arange(sizes.max())[:, None] < sizes[None]
    traces: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([model.run(x, mask, d, traces[d]) for d in "fb"], 2)
    y = np.zeros(mask.shape)
    y[at_t, at_b] = np.concatenate(truth)
    score = 1 / (1 + np.exp(-(both @ p["out"] + p["bias"])))
    total = mask.sum()
    loss = -(np.where(y > 0, np.log(score + 1e-12), np.log(1 - score + 1e-12)) * mask).sum() / total
    error = (score - y) * mask / total
    slope = {"out": np.einsum("tb,tbh->h", error, both), "bias": np.array([error.sum()])}
    above = error[:, :, None] * p["out"]
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        dh, dc = np.zeros((len(pages), n)), np.zeros((len(pages), n))
        dz_all, dw = np.zeros((*mask.shape, 4 * n)), np.zeros_like(p[f"h{d}"])
        for t, i, f, o, g, c_old, squashed, h_old in reversed(traces[d]):
            live = mask[t][:, None]
            total_h = dh + above[t, :, k * n : (k + 1) * n]
            inner = np.where(live, dc + total_h * o * (1 - squashed**2), 0)
            dz = np.concatenate([inner * g * i * (1 - i), inner * c_old * f * (1 - f), np.where(live, total_h * squashed, 0) * o * (1 - o), inner * i * (1 - g**2)], 1)
            dz_all[t] = dz
            dw += h_old.T @ dz
            dh = np.where(live, dz @ p[f"h{d}"].T, dh)
            dc = np.where(live, inner * f, dc)
        flat = dz_all.reshape(-1, 4 * n)
        slope |= {f"h{d}": dw, f"x{d}": x.reshape(len(flat), -1).T @ flat, f"c{d}": flat.sum(0)}
        dx += dz_all @ p[f"x{d}"].T
    each = dx[at_t, at_b]
    size = model.size
    slope["path"], slope["word"] = np.zeros_like(p["path"]), np.zeros_like(p["word"])
    np.add.at(slope["path"], paths, np.repeat(each[:, :size], path_n, 0))
    np.add.at(slope["word"], words, np.repeat(each[:, size : 2 * size] * (WORD_SCALE / word_n)[:, None], word_n, 0))
    return float(loss), slope


def train(pages: int = PAGES, passes: int = PASSES, seed: int = 11, batch: int = 24) -> Labeller:
    """A labeller trained by Adam on generated pages.  Deterministic."""
    model, data = Labeller(), labelled(pages, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(passes):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][1]) // 12)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            step += 1
            _, slope = gradients(model, [data[i][0] for i in groups[g]], [data[i][1] for i in groups[g]])
            for k, s in slope.items():
                first[k] = 0.9 * first[k] + 0.1 * s
                second[k] = 0.99 * second[k] + 0.01 * s * s
                model.p[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model.compact()
