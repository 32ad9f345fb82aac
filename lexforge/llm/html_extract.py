"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags, with
the open elements above them. Each block has features of its ancestors (tags, and
the words of their class, id and role; those of the innermost marked element apart), of its own tag and text (length, link
share, punctuation) and of its place. The field's two labels are main text or not;
it is trained by its conditional likelihood on labelled pages made by a rule below,
and decoded by Viterbi.

White space inside a block, as Python's ``str.split`` knows it, becomes one space;
blocks are joined by a blank line in page order. Null and empty pages, and pages
without main blocks, give the empty text. Repeated rows are read alike and stay; an
empty table gives an empty one. Unclosed tags, quotes and comments end with the page.
Time and memory are linear in the page, however long or deep. Formulas belong to the
block around them; what noscript and object hold is read like any other element's.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label".split())
#: Elements of formulas: their text is part of the block around them.
FORMULA = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mfenced menclose mpadded semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Thrown away with all they hold.
RAW = frozenset("script style template textarea title iframe svg select annotation annotation-xml".split())
#: Those of RAW that may hold elements of their own name or close themselves.
NESTING = frozenset(("svg", "template"))
SELF_CLOSING = frozenset(("svg", "annotation", "annotation-xml"))
#: A start tag ends an open element of these without an end tag, up to the container.
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CONTAINERS = frozenset("ul ol dl table tbody div section article main aside nav header footer form blockquote body html figure".split())
P_ENDS = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: The sets of names that IMPLIED looks for.
ENDED = (("p",), ("li",), ("dt", "dd"), ("tr", "td", "th"), ("td", "th"))
NAME = re.compile(r"[A-Za-z][^\s/>]*")
QUOTED = re.compile(r"=\s*([\"'])")
HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.!?…:;][\"'”’»)]*$")
NOTHING: frozenset[str] = frozenset()
#: Stands for hints none of which matters.
UNKNOWN = frozenset("?")


@dataclass
class Block:
    tag: str
    within: frozenset[str]  # the tags above
    hints: frozenset[str]
    near: frozenset[str]  # hints of the innermost element that has any
    text: str
    linked: int = 0


class Node:
    """An open element, with what its blocks need to know of those above: shared with the parent's where it adds nothing."""

    __slots__ = ("tag", "within", "hints", "near", "ended")

    def __init__(self, tag: str, own: frozenset[str], above: Node | None, place: int, known: frozenset[str] | None) -> None:
        """``known``: the only names that matter to the reader; so the sets are bounded, however deep the page is."""
        self.tag = tag
        within, hints, near, ended = (above.within, above.hints, above.near, above.ended) if above else (NOTHING, NOTHING, NOTHING, (-1,) * len(ENDED))
        if known is not None:
            self.within = within if tag in within or tag not in known else within | {tag}
            kept = own & known
        else:
            self.within = within if tag in within else within | {tag}
            kept = own
        self.hints = hints if kept <= hints else hints | kept
        self.near = (kept or UNKNOWN) if own else near
        # for each set of ENDED, the place of the innermost open element of it that no container hides
        self.ended = tuple(place if tag in names else -1 if tag in CONTAINERS else k for names, k in zip(ENDED, ended, strict=True)) if tag in PLACED else ended


PLACED = CONTAINERS.union(*ENDED)


def tag_end(page: str, at: int) -> int:
    """The place after the > that ends the tag at ``at``; quoted values may hold >."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        quote = QUOTED.search(page, at, end)
        if not quote:
            return end + 1
        close = page.find(quote[1], quote.end())
        if close < 0:
            return end + 1
        at = close + 1


def raw_end(page: str, tag: str, at: int) -> int:
    """The place after the end tag of an element of RAW whose content begins at ``at``; elements of its name within count, where they may be."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?![\w-])", re.IGNORECASE).finditer(page, at):
        if m[1]:
            depth -= 1
            if not depth:
                return tag_end(page, m.end())
        elif tag in NESTING and page[tag_end(page, m.end()) - 2] != "/":
            depth += 1
    return len(page)


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order, in time linear in the page; with ``known``, of tags and hints only those in it."""
    out: list[Block] = []
    stack: list[Node] = []
    open_: dict[str, int] = {}
    texts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            top = stack[-1] if stack else ROOT
            out.append(Block(top.tag, top.within, top.hints, top.near, text, min(linked, len(text))))
        texts.clear()
        linked = 0

    def cut(place: int) -> None:
        """Elements from ``place`` on are closed."""
        while len(stack) > place:
            open_[stack.pop().tag] -= 1

    def close(name: str) -> None:
        if open_.get(name):
            while stack[-1].tag != name:
                open_[stack.pop().tag] -= 1
            cut(len(stack) - 1)

    def implied(names: tuple[str, ...]) -> None:
        place = stack[-1].ended[ENDED.index(names)] if stack else -1
        if place >= 0:
            cut(place)

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at:
            texts.append(page[at:lt])
            linked += (lt - at) if in_link else 0
        if lt == len(page):
            break
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if after in ("!", "?"):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        ending = after == "/"
        name = NAME.match(page, lt + 1 + ending)
        if not name:
            texts.append("<")
            at = lt + 1
            continue
        tag, at = name[0].lower(), tag_end(page, name.end())
        if tag in RAW and not ending:
            if not (tag in SELF_CLOSING and page[at - 2] == "/"):
                at = raw_end(page, tag, at)
            continue
        if tag == "a":
            in_link = 0 if ending else 1
        if tag in INLINE or tag in FORMULA:
            if tag == "br":
                texts.append(" ")
            continue
        flush()
        in_link = 0
        if ending:
            close(tag)
            continue
        if tag in P_ENDS:
            implied(("p",))
        if tag in IMPLIED:
            implied(IMPLIED[tag])
        if tag not in VOID:
            words = " ".join(next(v for v in m.groups() if v is not None) for m in HINT.finditer(page, name.end(), at)).lower()
            stack.append(Node(tag, frozenset(PART.findall(words)), stack[-1] if stack else None, len(stack), known))
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out


ROOT = Node("", NOTHING, None, 0, NOTHING)


def bucket(n: int) -> int:
    return min(int(n).bit_length(), 9)


def features(page: list[Block]) -> list[list[str]]:
    has_article = any("article" in b.within or "main" in b.within for b in page)
    out = []
    for k, b in enumerate(page):
        share = b.linked / max(len(b.text), 1)
        own = [f"tag={b.tag}", f"len={bucket(len(b.text))}", f"link={min(4, int(share * 4 + 0.01))}", "ends" if PUNCTUATION.search(b.text) else "open", f"words={bucket(b.text.count(' '))}"]
        own += [f"in={t}" for t in b.within]
        own += [f"hint={h}" for h in b.hints]
        own += [f"near={h}" for h in b.near] or ["near="]
        if "©" in b.text:
            own.append("copyright")
        if has_article:
            own.append("inside" if "article" in b.within or "main" in b.within else "outside")
        own.append("first" if k == 0 else "last" if k == len(page) - 1 else "middle")
        out.append(own)
    return out


class Field:
    """Two labels; weights of features by label, and of neighbouring labels."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 2))
        self.steps = np.zeros((2, 2))

    def names(self) -> frozenset[str]:
        """Tags and hints that any feature has."""
        return frozenset(f.partition("=")[2] for f in self.index if f.startswith(("in=", "hint=", "near="))) | {"article", "main"}

    def scores(self, page: list[list[str]]) -> np.ndarray:
        index, weights = self.index, self.weights
        out = np.zeros((len(page), 2))
        for k, own in enumerate(page):
            at = [index[f] for f in own if f in index]
            if at:
                out[k] = weights[at].sum(axis=0)
        return out

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        if not page:
            return []
        z = self.scores(page)
        best, back = z[0], []
        for row in z[1:]:
            through = best[:, None] + self.steps
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, seed: int = 3) -> Field:
        """Stochastic gradient ascent of the conditional log-likelihood, by forward and backward sums."""
        for own, _ in pages:
            for block in own:
                for f in block:
                    self.index.setdefault(f, len(self.index))
        self.weights = np.zeros((len(self.index), 2))
        order = random.Random(seed)
        pages = list(pages)
        for epoch in range(epochs):
            order.shuffle(pages)
            lr = rate / (1 + epoch / 4)
            for own, labels in pages:
                if not own:
                    continue
                z, n = self.scores(own), len(own)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                t = np.exp(self.steps)
                ahead, behind = np.zeros((n, 2)), np.ones((n, 2))
                ahead[0] = e[0] / e[0].sum()
                for k in range(1, n):
                    ahead[k] = (ahead[k - 1] @ t) * e[k]
                    ahead[k] /= ahead[k].sum()
                for k in range(n - 2, -1, -1):
                    behind[k] = t @ (e[k + 1] * behind[k + 1])
                    behind[k] /= behind[k].sum()
                p = ahead * behind
                p /= p.sum(axis=1, keepdims=True)
                step = np.zeros((2, 2))
                for k in range(1, n):
                    pair = ahead[k - 1][:, None] * t * (e[k] * behind[k])[None, :]
                    step -= pair / pair.sum()
                    step[labels[k - 1], labels[k]] += 1
                self.steps += lr * step / n
                self.weights *= 1 - lr * decay
                for k, block in enumerate(own):
                    g = -p[k]
                    g[labels[k]] += 1
                    self.weights[[self.index[f] for f in block]] += lr * g
        return self


# Labelled training pages, made by a rule: layouts, wrappers and furniture are drawn at random.

MAIN_WRAPPERS = ("<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post">', '<section class="article-body">', '<div class="entry-content">', '<main><article>', '<div class="story">', '<div class="text">')
FURNITURE = ("nav", "menu", "header", "footer", "sidebar", "notice", "ad", "form", "comments", "related", "breadcrumb", "share")
NAMES = {
    "nav": ("nav", "navbar", "navigation", "topnav"), "menu": ("menu", "main-menu", "nav-menu"), "header": ("header", "site-header", "masthead", "top-bar", "banner"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal"), "sidebar": ("sidebar", "side", "widget", "aside", "rail"),
    "notice": ("notice", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "message", "popup", "modal", "disclaimer"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor"),
    "form": ("form", "newsletter", "subscribe", "signup", "search-form", "login", "contact-form"), "comments": ("comments", "comment-list", "comment", "replies", "discussion", "reader-comments", "responses", "disqus"),
    "related": ("related", "recommended", "more-stories", "teaser", "read-more"), "breadcrumb": ("breadcrumb", "breadcrumbs", "crumbs"), "share": ("share", "social", "share-buttons", "follow"),
}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("abdefgilmnorstuv") + r.choice("aeiouäé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(2, 18).capitalize() + self.r.choice(".....?!;")

    def paragraph(self) -> str:
        r = self.r
        if r.random() < 0.12:
            return self.words(1, 6).capitalize() + r.choice([".", ".", "", "!"])
        text = " ".join(self.sentence() for _ in range(r.randint(1, 9)))
        if r.random() < 0.2:
            first, _, rest = text.partition(" ")
            text = f'<a href="/x">{first}</a> {rest}'
        return f"<b>{text}</b>" if r.random() < 0.06 else f"<em>{text[:4]}</em>{text[4:]}" if r.random() < 0.05 and "<" not in text else text

    def links(self, n: int) -> str:
        item = lambda: f'<a href="/{self.words(1, 1)}">{self.words(1, 3).capitalize()}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if self.r.random() < 0.8 else " ".join(item() for _ in range(n))

    def furniture(self, kind: str) -> str:
        r = self.r
        name = r.choice(NAMES[kind])
        mark = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} x{r.randint(1, 9)}"'])
        natural = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        bare = natural in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        tag = natural if bare or r.random() < 0.4 else r.choice(["div", "section", "aside"] if kind in ("sidebar", "ad", "related") else ["div", "div", "section"])
        open_ = f"<{tag}{'' if bare else mark}>"
        if kind in ("nav", "menu", "breadcrumb"):
            body = self.links(r.randint(2, 9))
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(1, 4).title()}</h1>", f"<div>{self.words(1, 5).title()}</div>", f"<p>{self.sentence()}</p>", f'<a href="/">{self.words(1, 3)}</a>' + self.links(3)])
        elif kind == "footer":
            body = r.choice([f"&copy; {self.words(1, 2)} &middot; {self.sentence()}", f"<p>&copy; 20{r.randint(10, 26)} {self.words(1, 4)}</p>", self.links(4), f"<p>{self.sentence()} {self.sentence()}</p>"])
        elif kind == "form":
            body = f"<p>{self.words(2, 8)}</p><label>{self.words(1, 2)}</label><input name='q'><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            body = r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(r.choice(["<div class='comment'><p>%s</p></div>", "<p>%s</p>", "<li>%s</li>", "<div>%s</div>"]) % " ".join(self.sentence() for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6)))
        elif kind in ("sidebar", "related"):
            body = f"<h3>{self.words(1, 4)}</h3>" + (self.links(r.randint(2, 6)) if r.random() < 0.5 else f"<p>{self.sentence()} {self.sentence()}</p>")
        elif kind == "share":
            body = self.links(3)
        else:
            body = r.choice(["%s", "<p>%s</p>", "<div>%s</div>"]) % " ".join(self.sentence() for _ in range(r.randint(1, 4)))
        return f"{open_}{body}</{tag}>"

    def page(self) -> tuple[str, list[str]]:
        """A page and its main blocks' texts, each marked in the page by an attribute-free wrapper."""
        r = self.r
        wrap = r.choice(MAIN_WRAPPERS if r.random() < 0.6 else MAIN_WRAPPERS[:2])
        names = re.findall(r"<(\w+)", wrap)
        body: list[tuple[str, bool]] = []
        if r.random() < 0.85:
            body.append((f"<h1>{self.words(1, 12).capitalize()}{r.choice(['.', ''])}</h1>", True))
        for _ in range(r.randint(1, 12)):
            u = r.random()
            if u < 0.08:
                body.append((f"<h{r.randint(2, 4)}>{self.words(1, 6).capitalize()}</h2>", True))
            elif u < 0.13:
                body.append(("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(1, 4))) + "</ul>", True))
            elif u < 0.17:
                body.append((f"<blockquote>{self.paragraph()}</blockquote>", True))
            elif u < 0.19:
                body.append((f"<pre>{self.words(2, 9)}</pre>", True))
            elif u < 0.21:
                body.append((f"<table><tr><td>{self.words(1, 3)}<td>{self.words(1, 3)}</table>", True))
            elif u < 0.4:
                body.append((self.furniture(r.choice(["ad", "ad", "related", "share", "notice", "form", "sidebar", "nav", "header", "footer"])), False))
            else:
                body.append((f"<p>{self.paragraph()}" + ("</p>" if r.random() < 0.85 else "<br>"), True))
        if r.random() < 0.25:
            body.append((self.furniture("comments"), False))
        before = [(self.furniture(k), False) for k in r.sample(["nav", "menu", "header", "ad", "notice", "breadcrumb", "sidebar", "form"], r.randint(1, 4))]
        after = [(self.furniture(k), False) for k in r.sample(["footer", "comments", "related", "ad", "sidebar", "form", "notice", "share", "nav"], r.randint(1, 4))]
        return [("<html><head><title>x</title></head><body>", False), *before, (wrap, False), *body, ("".join(f"</{n}>" for n in reversed(names)), False), *after, ("</body></html>", False)]


def labelled_page(parts: list[tuple[str, bool]]) -> tuple[list[list[str]], list[int]]:
    """Features and labels: a block is main if it begins within a main part, told by counting blocks part by part."""
    page, labels, before = "", [], 0
    for text, main in parts:
        page += text
        now = len(blocks(page))
        labels += [int(main)] * (now - before)
        before = now
    found = blocks(page)
    return features(found), labels[: len(found)]


@lru_cache(1)
def model(pages: int = 600, seed: int = 11) -> Field:
    maker = Maker(seed)
    return Field().train([labelled_page(maker.page()) for _ in range(pages)])


def main_text(page: str, crf: Field, known: frozenset[str] | None = None) -> str:
    found = blocks(page, known)
    return "\n\n".join(b.text for b, keep in zip(found, crf.decode(features(found)), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """A row for every page: id, ``keep`` columns, text, n_chars."""
    crf = model()
    known = crf.names()
    kinds = dict(pages.dtypes)
    columns = [id_col, *keep, html_col]

    def make():
        def rows(*given):
            texts = [main_text(h or "", crf, known) for h in given[-1]]
            return [*given[:-1], texts, [len(t) for t in texts]]

        return rows

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns[:-1]) + ", text string, n_chars long"
    return per_row(pages, [F.col(c) for c in columns], schema, make)
