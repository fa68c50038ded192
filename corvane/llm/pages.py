"""Labelled web pages made from templates, to train the extraction model on.

Each page is a tree of (tag, attributes, children or text, label); it is written as HTML with the usual sloppiness
(unclosed p, b and li, references, missing end tags). Words are random letters of several scripts, so only structure
can be learned. Everything comes from one seed.
"""

from __future__ import annotations

import html
import random

# Usual names for parts of pages.
MAIN = ["article", "post", "entry", "content", "main", "story", "body", "text", "article-body", "post-content", "entry-content", "main-content"]
SIDE = ["sidebar", "side", "aside", "widget", "related", "recommended", "more", "popular", "trending", "tags", "share", "social", "toolbar", "breadcrumbs", "pagination", "author-box"]
NOTICE = ["cookie", "cookie-notice", "consent", "banner", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "paywall"]
ADS = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "adsbox", "sponsor"]
TALK = ["comments", "comment", "comment-list", "responses", "discussion", "replies", "disqus", "reader-comments"]
HEAD = ["header", "site-header", "masthead", "top", "topbar", "logo", "brand"]
FOOT = ["footer", "site-footer", "bottom", "copyright", "legal", "credits", "colophon"]
MENU = ["nav", "menu", "navbar", "navigation", "main-menu", "links", "submenu"]
LETTERS = ["abcdefghilmnoprstu", "aeinrstlduüöß", "aeioulrstné", "aeosnrlñóí", "абвгдеиклмнорст"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = self.r.choice(LETTERS)

    def words(self, a: int, b: int) -> str:
        r = self.r
        n = r.randint(a, b)
        out = ["".join(r.choice(self.letters) for _ in range(r.randint(1, 9))) for _ in range(n)]
        if r.random() < 0.7 and n > 3:
            for i in range(r.randint(5, 12), n, r.randint(6, 14)):
                out[i - 1] += r.choice([".", ",", ".", "!", "?"])
        if r.random() < 0.1:
            out = [w + r.choice(["***", "%%%", "&&&", "!!"]) for w in out]
        if r.random() < 0.05:
            out = [w.upper() for w in out]
        return " ".join(out).capitalize()

    def attrs(self, names: list[str], often: float = 0.8) -> dict[str, str]:
        r = self.r
        if r.random() > often:
            return {}
        name = r.choice(names)
        if r.random() < 0.2:
            name = r.choice([f"js-{name}", f"{name}-wrap", f"{name}_box", f"{name}{r.randint(1, 9)}", f"main-{name}"])
        return {r.choice(["class", "class", "id"]): name}

    def links(self, a: int, b: int, label: int = 0) -> tuple:
        items = [("li", {}, [("a", {"href": "/" + self.words(1, 1)}, self.words(1, 3), label)], label) for _ in range(self.r.randint(a, b))]
        return ("ul", {}, items, label)

    def paragraphs(self, a: int, b: int, label: int = 1) -> list[tuple]:
        r, out = self.r, []
        for _ in range(r.randint(a, b)):
            x = r.random()
            if x < 0.72:
                out.append(("p", {}, self.words(*r.choice([(1, 6), (8, 40), (30, 120)])), label))
            elif x < 0.80:
                out.append((r.choice(["h2", "h3"]), {}, self.words(2, 9), label))
            elif x < 0.86:
                out.append(("p", {}, [("b", {}, self.words(2, 14), label)], label))
            elif x < 0.90:
                out.append(("blockquote", {}, [("p", {}, self.words(6, 30), label)], label))
            elif x < 0.94:
                out.append((r.choice(["ul", "ol"]), {}, [("li", {}, self.words(3, 20), label) for _ in range(r.randint(2, 6))], label))
            elif x < 0.96:
                out.append(("pre", {}, self.words(4, 20), label))
            elif x < 0.98:
                out.append(("figure", {}, [("img", {"src": "x"}, "", label), ("figcaption", {}, self.words(3, 12), label)], label))
            else:
                out.append(("table", {}, [("tr", {}, [("td", {}, self.words(1, 4), label) for _ in range(3)], label) for _ in range(3)], label))
        return out

    def boilerplate(self) -> tuple:
        r, k = self.r, self.r.randint(0, 8)
        if k == 0:
            return ("nav", self.attrs(MENU, 0.4), [self.links(3, 9)], 0)
        if k == 1:
            return ("div", self.attrs(MENU), [self.links(3, 9)], 0)
        if k == 2:
            return ("div", self.attrs(ADS, 1.0), r.choice([self.words(3, 30), [("p", {}, self.words(4, 20), 0)]]), 0)
        if k == 3:
            return (r.choice(["aside", "div", "section"]), self.attrs(SIDE, 0.9), [("h3", {}, self.words(1, 3), 0), r.choice([self.links(2, 6), ("p", {}, self.words(5, 25), 0)])], 0)
        if k == 4:
            return ("div", self.attrs(NOTICE, 1.0), [("p", {}, self.words(6, 30), 0), ("button", {}, self.words(1, 2), 0)], 0)
        if k == 5:
            fields = [("label", {}, self.words(1, 3), 0), ("input", {"type": "text"}, "", 0), ("select", {}, [("option", {}, self.words(1, 2), 0) for _ in range(3)], 0), ("textarea", {}, self.words(1, 5), 0), ("button", {}, self.words(1, 2), 0)]
            return ("form", self.attrs(NOTICE + ["search", "login"], 0.5), fields, 0)
        if k == 6:
            one = lambda: (r.choice(["div", "li", "article"]), self.attrs(TALK, 0.9), [("p", {}, self.words(3, 40), 0)] * r.randint(1, 2), 0)
            return (r.choice(["section", "div", "ol"]), self.attrs(TALK, 1.0), [("h3", {}, self.words(1, 3), 0), *[one() for _ in range(r.randint(1, 6))]], 0)
        if k == 7:
            return (r.choice(["header", "div"]), self.attrs(HEAD, 0.95), [("div", {}, self.words(1, 4), 0), self.links(1, 4)], 0)
        return (r.choice(["footer", "div"]), self.attrs(FOOT, 0.95), r.choice([[("p", {}, self.words(3, 15), 0)], self.words(4, 15)]), 0)

    def page(self) -> tuple:
        r = self.r
        body = [("h1", {}, self.words(3, 12), 1)] if r.random() < 0.85 else []
        if r.random() < 0.3:
            body.append(("p", {"class": r.choice(["lead", "intro", "summary"])}, self.words(8, 30), 1))
        body += self.paragraphs(1, 14)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body.insert(r.randint(1, len(body)), self.boilerplate())
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        main: tuple = (tag, self.attrs(MAIN, 0.4 if tag in ("article", "main") else 1.0), body, 1)
        if r.random() < 0.3:
            main = (r.choice(["main", "div"]), self.attrs(MAIN + ["container", "wrapper", "page"], 0.9), [main, *[self.boilerplate() for _ in range(r.choice([0, 1, 2]))]], 1)
        first = [("nav", self.attrs(MENU, 0.3), [self.links(2, 9)], 0)] if r.random() < 0.5 else []
        before, after = [self.boilerplate() for _ in range(r.randint(0, 4))], [self.boilerplate() for _ in range(r.randint(0, 4))]
        last = [("footer", self.attrs(FOOT, 0.3), self.words(3, 14), 0)] if r.random() < 0.7 else []
        head = ("head", {}, [("title", {}, self.words(3, 12), 0), ("style", {}, "p{margin:0}", 0), ("script", {}, 'var t="</p>";', 0)], 0)
        if r.random() < 0.12:
            # An old layout: parts of the page are cells of a table.
            _, names, inside, _ = main
            cells = [("td", a, x, 0) for _, a, x, _ in [self.boilerplate() for _ in range(r.randint(1, 3))]]
            cells.insert(r.randint(0, len(cells)), ("td", names or self.attrs(MAIN, 0.8), inside, 1))
            main = ("table", {}, [("tr", {}, cells, 1)], 1)
        return ("html", {}, [head, ("body", {}, [*first, *before, main, *after, *last], 1)], 1)


def write(node: tuple, r: random.Random, marks: bool = True) -> str:
    """HTML of a node; with marks, each element says its label in an attribute."""
    tag, attrs, inside, label = node
    shown = "".join(f' {k}="{v}"' for k, v in attrs.items()) + f' data-label="{label}"' * marks
    if isinstance(inside, str):
        inner = inside if tag in ("script", "style") else html.escape(inside, quote=False)
    else:
        inner = "".join(write(x, r, marks) + ("\n" if r.random() < 0.2 else "") for x in inside)
    if tag in ("img", "input"):
        return f"<{tag}{shown}>"
    if tag in ("p", "li", "b") and r.random() < 0.08:
        return f"<{tag}{shown}>{inner}"
    return f"<{tag}{shown}>{inner}</{tag}>"


def labelled(n: int, seed: int = 17) -> list[str]:
    out = []
    for k in range(n):
        m = Maker(seed * 100_003 + k)
        out.append("<!DOCTYPE html>" + write(m.page(), m.r))
    return out
