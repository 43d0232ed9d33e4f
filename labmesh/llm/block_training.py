"""Fit the block labeller on generated pages.

    python -m labmesh.llm.block_training

writes `block_weights.npz`. Pages are drawn from a grammar of usual layouts: an
article inside some of the containers that sites use, between menus, headers,
sidebars, notices, adverts, forms, comments and footers. An article has paragraphs,
heads of all ranks, lists, definitions, tables, code, figures and quotations, and
sometimes more than a thousand of them. Words are invented or common ones; what
stands around the article also holds the usual phrases of its kind, so that the
labeller learns from structure, sizes and wording. Gradients run back through both
directions in numpy; Adam updates the weights.
"""

from __future__ import annotations

import os
import random

import numpy as np

from labmesh.llm.html_blocks import INPUTS, Block, blocks, features, label_pages

HIDDEN = 32
PAGES = 5000
EPOCHS = 10
# Halved after every third epoch.
RATE = 0.004

_SYLLABLES = "ba de ki lo mu na pe ri so tu va wo en th er an st on ti é ü ñ ch".split()

MAIN = (
    "<article>", "<main>", '<article class="post">', '<div class="content">',
    '<div id="content">', '<div class="article-body">', '<div class="entry-content">',
    '<div class="post-content">', '<section class="story">', '<div class="main">',
    '<div role="main">', '<main id="main"><article class="entry">', '<div class="text">', "", "",
)
# Layouts around the container: wiki, blog, forum, news and shop software, and tables.
LAYOUTS = (
    '<div id="mw-content-text">', '<div id="bodyContent">', '<div id="content"><div class="mw-parser-output">',
    '<div id="mw-content-text"><div class="mw-parser-output">', '<div class="wiki-page">', '<div class="wikitext">',
    '<div class="hentry">', '<div class="blog-post">', '<div class="single-post"><div class="entry">',
    '<div class="post-outer">', '<div class="blog"><div class="post">', '<div class="entry-body">',
    '<div class="story-body">', '<div class="article__body">', '<div class="news-text">', '<section class="news">',
    '<div class="field-item">', '<div class="node">', '<div class="topic"><div class="message">',
    '<div class="post-message">', '<div class="product-description">', '<div class="markdown">', '<div class="prose">',
    '<div class="page-content">', '<div id="article">', '<div id="story">', '<div itemprop="articleBody">',
    '<center>', '<div align="left">', '<blockquote>', '<font size="2">',
)
# Never drawn for fitting: `accuracy` of unseen layouts is measured on these.
UNSEEN = (
    '<div id="doc"><div class="bd">', '<div class="post-body">', "<div><div><div>", '<div class="td-post-content">', '<div id="primary"><div class="inside">',
    '<div class="c-richtext">', '<div id="readme"><div class="file">', '<td class="maincell">',
)
MENU = (
    "Home", "About", "About us", "Contact", "Contact: webmaster", "News", "Blog", "Login", "Sign in", "Help", "FAQ",
    "Products", "Services", "Archive", "Categories", "Search", "Sitemap", "Next", "Previous", "Back to top", "Forum",
)
OUTSIDE = {
    "menu": ("<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navbar">',
             '<nav class="breadcrumb">', '<div class="navigation">', '<div class="tags">'),
    "header": ("<header>", '<div class="header">', '<div id="masthead">', '<div class="banner">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">'),
    "side": ("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="related">',
             '<aside class="widget">', '<div class="promo">', '<div class="popular">'),
    "notice": ('<div class="cookie-notice">', '<div id="consent">', '<div class="newsletter">',
               '<div class="alert">', '<div class="subscribe">', '<div class="paywall">',
               '<div class="disclaimer">', '<div class="share">', '<div class="social">', '<div class="share">',
               '<div class="sharing">', '<ul class="share-buttons">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">',
               '<div class="sponsored">', '<div id="ad1">', '<aside class="advertisement">',
               '<div class="ad-slot">'),
    "form": ("<form>", '<form class="search">', '<div class="login"><form>', '<form id="signup">'),
    "comments": ('<div class="comments">', '<section id="comments">', '<div class="comment">',
                 '<ol class="comment-list">', '<div class="replies">', '<section class="discussion">'),
}

# Common words, in articles and around them; some of them are usual in notices too.
COMMON = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an "
    "they which one you were all her she there would their we him been has when who will no more if out so "
    "said what up its about into than them can only other new some could time these two may then do first "
    "any my now such like our over man me even most made after also did many before must through years "
    "where much your way well down should because each just those people how too little state good very "
    "make world still own see men work long here get both between life being under never day same another "
    "know while last might us great old year off come since against go came right used take three use "
    "share free order today read next site experience offer sign comment report posted access"
).split()
PHRASES = {
    "notice": ("We use cookies to improve your experience on our website.", "Accept all cookies",
               "By continuing to use this site you accept our cookie policy.", "Cookie settings",
               "Subscribe to our newsletter", "Sign up for our email newsletter.", "Share this on Facebook",
               "Share on Twitter", "Follow us on Instagram", "Subscribe now for unlimited access.",
               "Log in to continue reading.", "Please disable your ad blocker.",
               "Share this on Facebook Twitter", "Share Tweet Pin Email", "Facebook Twitter LinkedIn"),
    "advert": ("Advertisement", "Sponsored content", "Buy now and save 20%!", "Sponsored advert",
               "Limited time offer: free shipping", "Click here for the best deals.", "Sale ends soon, shop now!",
               "Promoted: get your free quote today", "Advertisement - continue below"),
    "comments": ("Reply", "Log in to comment", "Posted by anna 3 days ago", "Thanks for sharing, great post!",
                 "I agree with the comment above.", "3 comments", "Report this comment", "Leave a reply"),
    "side": ("Related articles", "Most popular", "Read next", "You may also like", "Recent posts"),
    "footer": ("All rights reserved.", "Terms of use", "Privacy policy", "Contact us", "Powered by",
               "Contact: webmaster", "Last updated 3 days ago", "Contact: editor"),
}
# Without a class only the wording tells these from an article's paragraphs.
PLAIN = ("<div>", "<p>")


def _closed(opening: str) -> str:
    names = [tag.split()[0].strip("<>") for tag in opening.replace(">", ">|").split("|") if tag]
    return "".join(f"</{name}>" for name in reversed(names))


class Grammar:
    """Pages and, for every block of them, whether it is main text."""

    def __init__(self, seed: int, layout: str | None = None):
        self.r = random.Random(seed)
        self.layout = layout

    def words(self, low: int, high: int) -> str:
        r = self.r
        n = r.randint(low, high)
        style = r.random()
        common = r.choice((0, 0, 0.5, 0.8, 0.95))
        out = [
            r.choice(COMMON)
            if r.random() < common
            else "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            for _ in range(n)
        ]
        if style < 0.08:
            out = [w + r.choice(("***", "%%%", "$$$", "&amp;&amp;&amp;", "!!")) for w in out]
        elif style < 0.12:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.16:
            return " | ".join(out)
        elif style < 0.22:
            # Spam, and what broken software writes: few words again and again.
            out = (out[: r.choice((1, 1, 2, 5))] * n)[:n]
        end = "." if r.random() < 0.8 else ""
        return " ".join(out).capitalize() + end

    def links(self, low: int, high: int) -> str:
        r = self.r
        usual = r.random() < 0.5
        items = [
            f'<a href="/x">{r.choice(MENU) if usual and r.random() < 0.7 else self.words(1, 3)}</a>'
            for _ in range(r.randint(low, high))
        ]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items)

    def phrased(self, kind: str, low: int, high: int) -> str:
        """Words of what stands around an article, most of them with a usual phrase."""
        r = self.r
        if r.random() < 0.4:
            return self.words(low, high)
        phrases = " ".join(r.sample(PHRASES[kind], r.choice((1, 1, 1, 2))))
        return phrases if r.random() < 0.6 else f"{self.words(low, high)} {phrases}"

    def plain(self, kind: str) -> str:
        """Usual phrases in an element without a class."""
        r = self.r
        opening = r.choice(PLAIN)
        return opening + " ".join(r.sample(PHRASES[kind], r.choice((1, 2)))) + _closed(opening)

    def outside(self, kind: str) -> str:
        r = self.r
        if kind in ("notice", "advert") and r.random() < 0.1:
            return self.plain(kind)
        opening = r.choice(OUTSIDE[kind])
        if kind in ("menu", "form") and r.random() < 0.25:
            # Links tell a menu, and fields a form, whatever is around them.
            opening = r.choice((self.invented(), "<div>", "<div><div>", "<td>")) if kind == "menu" else "<div><form>"
        elif r.random() < 0.2:
            opening = self.invented() + opening
        if kind == "menu":
            inner = self.links(2, 9)
        elif kind == "header":
            inner = r.choice((f"<h1>{self.words(1, 4)}</h1>", self.links(1, 5), self.words(2, 8)))
        elif kind == "footer":
            inner = r.choice(("&copy; ", "")) + self.phrased(kind, 2, 14)
            inner += self.links(1, 6) if r.random() < 0.4 else ""
        elif kind == "side":
            head = r.choice(("h2", "h3", "h3", "h4"))
            inner = f"<{head}>{self.phrased(kind, 1, 4)}</{head}>" + r.choice(
                (self.links(2, 8), f"<p>{self.words(5, 40)}</p>")
            )
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input type=text><p>{self.words(1, 12)}</p>"
        elif kind == "comments":
            inner = "".join(
                f"<p>{self.phrased(kind, 3, 60)}</p>"
                if r.random() < 0.6
                else f"<div>{self.phrased(kind, 2, 30)}</div>"
                for _ in range(r.randint(1, 6))
            )
        else:
            inner = self.phrased(kind, 3, r.choice((20, 20, 80)))
            inner = f"<p>{inner}</p>" if r.random() < 0.4 else inner
        return opening + inner + _closed(opening)

    def invented(self) -> str:
        """An element with a name that no other page has."""
        r = self.r
        name = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4)))
        kind = r.choice(("class", "class", "id"))
        return f'<{r.choice(("div", "div", "div", "section"))} {kind}="{name}{r.choice(("", "-x", "_1", "2"))}">'

    def wrapper(self) -> str:
        """Elements that say nothing: plain ones and such with unknown names."""
        return "".join(self.r.choice(("<div>", "<div>", self.invented())) for _ in range(self.r.choice((0, 0, 0, 1, 1, 2, 3, 4))))

    def container(self) -> str:
        """What an article stands in."""
        r = self.r
        pick = r.random()
        if pick < 0.3:
            return "<article>"
        if pick < 0.5:
            return r.choice(MAIN)
        if pick < 0.7:
            return r.choice(LAYOUTS)
        if pick < 0.8:
            return self.invented()
        return "<div>" * r.choice((0, 0, 1, 2, 3, 4))

    def article(self) -> str:
        r = self.r
        opening = self.layout if self.layout is not None else self.wrapper() + self.container() + self.wrapper()
        out = [opening]
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(1, 10)}</h1>")
        many = int(min(r.paretovariate(1.1), 60)) + r.randint(0, 6)
        # Few pages are long, but those are very long.
        if r.random() < 0.02:
            many = r.randint(100, 1200)
        for _ in range(many):
            out.append(self.part())
            if r.random() < min(0.05, 3 / many):
                out.append("\x01" + self.outside(r.choice(("advert", "notice", "side"))) + "\x02")
        return "".join(out) + _closed(opening)

    def part(self) -> str:
        """One part of an article."""
        r = self.r
        pick = r.random()
        if pick < 0.5:
            low, high = r.choice(((1, 3), (2, 8), (5, 40), (30, 120), (100, 400)))
            return f"<p>{self.words(low, high)}</p>"
        if pick < 0.62:
            return f"<p><b>{self.words(2, 60)}<br>"
        if pick < 0.72:
            head = r.choice(("h2", "h2", "h3", "h3", "h4", "h5", "h6"))
            return f"<{head}>{self.words(1, 8)}</{head}>"
        if pick < 0.79:
            kind = r.choice(("ul", "ol"))
            rows = "".join(f"<li>{self.words(1, 20)}</li>" for _ in range(r.randint(1, 6)))
            return f"<{kind}>{rows}</{kind}>"
        if pick < 0.83:
            return f"<blockquote><p>{self.words(5, 40)}</p></blockquote>"
        if pick < 0.87:
            return f"<div>{self.words(5, 80)}</div>"
        if pick < 0.91:
            wide, body = r.randint(1, 4), r.choice(("", "<tbody>"))
            head = "".join(f"<th>{self.words(1, 3)}</th>" for _ in range(wide))
            cells = "".join(
                "<tr>" + "".join(f"<td>{self.words(1, 6)}</td>" for _ in range(wide)) + "</tr>"
                for _ in range(r.randint(1, 5))
            )
            head = f"<thead><tr>{head}</tr></thead>" if r.random() < 0.5 else f"<tr>{head}</tr>"
            return f"<table>{head}{body}{cells}{_closed(body) if body else ''}</table>"
        if pick < 0.94:
            code = self.words(2, 60)
            return f"<pre>{code}</pre>" if r.random() < 0.5 else f"<pre><code>{code}</code></pre>"
        if pick < 0.97:
            rows = "".join(
                f"<dt>{self.words(1, 4)}</dt><dd>{self.words(2, 30)}</dd>" for _ in range(r.randint(1, 5))
            )
            return f"<dl>{rows}</dl>"
        return f'<figure><img src="/x.png"><figcaption>{self.words(2, 25)}</figcaption></figure>'

    def page(self) -> tuple[str, list[bool]]:
        """Characters 1 and 2 enclose what is not main text, so that blocks can be told apart."""
        r = self.r
        before = [k for k in ("menu", "header", "notice", "advert", "menu", "form") if r.random() < 0.4]
        after = [k for k in ("comments", "side", "advert", "form", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        head = "".join(f"\x01{self.outside(k)}\x02" for k in before)
        body = self.article() if r.random() < 0.96 else ""
        tail = "".join(f"\x01{self.outside(k)}\x02" for k in after)
        if r.random() < 0.1:
            # A table as a frame: menus in one cell, the article in the next, a line below.
            side = f'\x01{self.links(2, 8)}\x02' if r.random() < 0.8 else ""
            last = f"<tr><td>\x01{self.phrased('footer', 1, 6)}\x02</td></tr>" if r.random() < 0.6 else ""
            named = r.choice(("", "", ' class="left"', ' width="150"', ' valign="top"'))
            marked = f"{head}<table><tr><td{named}>{side}</td><td>{body}</td></tr>{last}</table>{tail}"
        else:
            wrap = self.wrapper()
            marked = f"{head}{wrap}{body}{_closed(wrap)}{tail}" if r.random() < 0.7 else f"{wrap}{head}{body}{tail}{_closed(wrap)}"
        if r.random() < 0.3:
            marked = f'<div class="{r.choice(("wrap", "page", "container", "site"))}">{marked}</div>'
        head = f"<html><head><title>{self.words(1, 8)}</title><script>var t='</p>';</script></head>"
        page = f"<!DOCTYPE html>{head}<body>{marked}" + ("</body></html>" if r.random() < 0.9 else "")
        return page, _truth(page)


def _truth(page: str) -> list[bool]:
    """Whether the blocks of a marked page are main text: those outside the marks."""
    inside, out = False, []
    tagged = page.replace("\x01", "<mk1 x>").replace("\x02", "</mk1>")
    for block in blocks(tagged):
        inside = "mk1" in block.path
        out.append(not inside)
    return out


def unmarked(page: str) -> str:
    return page.replace("\x01", "").replace("\x02", "")


def generate(n: int, seed: int, layout: str | None = None) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages as blocks, and whether each is main text; `layout` is what all articles stand in."""
    grammar = Grammar(seed, layout)
    pages, ys = [], []
    while len(pages) < n:
        page, truth = grammar.page()
        cut = blocks(unmarked(page))
        if cut and len(cut) == len(truth):
            pages.append(cut)
            ys.append(np.array(truth, np.float32))
    return pages, ys


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _forward(x, w, u, mask):
    pages, steps, _ = x.shape
    n = u.shape[0]
    h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    gates, kept = x @ w, []
    out = np.empty((pages, steps, n), np.float32)
    for t in range(steps):
        z = gates[:, t] + h @ u
        i, f, o = (_sigmoid(z[:, k * n : (k + 1) * n]) for k in range(3))
        g = np.tanh(z[:, 3 * n :])
        m = mask[:, t, None]
        new = np.where(m, f * c + i * g, c)
        tan = np.tanh(new)
        kept.append((h, c, i, f, o, g, tan, m))
        h, c = np.where(m, o * tan, h), new
        out[:, t] = h
    return out, kept


def _backward(x, w, u, kept, d_out):
    n = u.shape[0]
    d_u = np.zeros_like(u)
    d_gates = np.zeros((*x.shape[:2], 4 * n), np.float32)
    d_h = np.zeros((len(x), n), np.float32)
    d_c = np.zeros_like(d_h)
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, g, tan, m = kept[t]
        d_h = d_h + d_out[:, t]
        d_new = np.where(m, d_c + d_h * o * (1 - tan**2), 0)
        d_o = np.where(m, d_h * tan, 0)
        z = np.concatenate(
            [d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_o * o * (1 - o), d_new * i * (1 - g**2)],
            axis=1,
        )
        d_gates[:, t] = z
        d_u += h.T @ z
        d_h = z @ u.T + np.where(m, 0, d_h)
        d_c = np.where(m, d_new * f, d_c)
    flat = x.reshape(-1, x.shape[2])
    return flat.T @ d_gates.reshape(-1, 4 * n), d_u


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = 0.15

    def drawn(*shape):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    weights = {
        "wf": drawn(INPUTS, 4 * HIDDEN), "uf": drawn(HIDDEN, 4 * HIDDEN),
        "wb": drawn(INPUTS, 4 * HIDDEN), "ub": drawn(HIDDEN, 4 * HIDDEN),
        "v": drawn(2 * HIDDEN), "b": np.zeros(1, np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    cut, ys = generate(pages, seed)
    xs = [features(page) for page in cut]
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(xs)), key=lambda k: len(xs[k]))
        groups = [order[k : k + 32] for k in range(0, len(order), 32)]
        rng.shuffle(groups)
        rate = RATE * 0.5 ** (epoch // 3)
        for group in groups:
            steps = max(len(xs[k]) for k in group)
            x = np.zeros((len(group), steps, INPUTS), np.float32)
            y = np.zeros((len(group), steps), np.float32)
            mask = np.zeros((len(group), steps), bool)
            for row, k in enumerate(group):
                n = len(xs[k])
                x[row, :n], y[row, :n], mask[row, :n] = xs[k], ys[k], True
            forward, kept_f = _forward(x, weights["wf"], weights["uf"], mask)
            back_x, back_m = x[:, ::-1], mask[:, ::-1]
            backward, kept_b = _forward(back_x, weights["wb"], weights["ub"], back_m)
            both = np.concatenate([forward, backward[:, ::-1]], axis=2)
            p = _sigmoid(both @ weights["v"] + weights["b"])
            error = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
            d_both = error[:, :, None] * weights["v"]
            grads = {"v": np.einsum("pt,pth->h", error, both), "b": error.sum(keepdims=True)[0]}
            grads["wf"], grads["uf"] = _backward(x, weights["wf"], weights["uf"], kept_f, d_both[:, :, :HIDDEN])
            grads["wb"], grads["ub"] = _backward(
                back_x, weights["wb"], weights["ub"], kept_b, d_both[:, ::-1, HIDDEN:]
            )
            step += 1
            for k, g in grads.items():
                g = np.clip(g.reshape(weights[k].shape), -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                weights[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return weights


def accuracy(
    weights: dict[str, np.ndarray], pages: int = 400, seed: int = 99, layout: str | None = None
) -> float:
    """Share of blocks labelled right on pages drawn with another seed, or in a layout of their own."""
    cut, ys = generate(pages, seed, layout)
    right = [((p >= 0.5) == (y > 0.5)) for p, y in zip(label_pages(cut, weights), ys)]
    return float(np.concatenate(right).mean())


if __name__ == "__main__":
    fitted = train()
    np.savez_compressed(
        os.path.join(os.path.dirname(__file__), "block_weights.npz"),
        **{k: v.astype(np.float16) for k, v in fitted.items()},
    )
    print("held-out accuracy", accuracy(fitted))
    for unseen in UNSEEN:
        print("unseen layout", unseen, accuracy(fitted, 100, layout=unseen))
