"""Main text of web pages by a tree-structured graphical model.

A page becomes the tree of its block elements. Each node is content or not; a node's potentials come from its tag, class, id
and role words and their beginnings, the length, link density, line breaks and closing punctuation of its text, length and link
density of all it contains and brothers of its kind, an edge's from the pair of states. Sum-product messages
passed upward and downward give every node's exact marginal. Weights are trained on labelled pages by the gradient of the
exact log-likelihood, which needs those same marginals; labelled_pages() makes the pages from labelled building blocks.

Tags, attributes and comments are read by the states of the HTML standard, each place of a page once; a tag or attribute that
the page breaks off swallows the rest, as in browsers. Fallback text of videos, sound and drawings is not shown.

Defined results: a null or empty page gives an empty text; unclosed, crossed and unknown tags are taken as browsers take them
as far as blocks go; a page without any block is judged as one block, so running text without tags is kept; character references are decoded; each block's white space collapses and blocks join by one space; nulls
in other columns pass through; an empty table gives no rows. Pages are read whole and nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.llm.common import Store, table

#: White space and names as the HTML standard has them. Patterns never give back what they took, so each place is read once.
_SP = r"[ \t\n\f\r]"
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)(>)?")
_NEXT_ATTRIBUTE = re.compile(rf"""[ \t\n\f\r/]*+(?:(>)|(=?[^ \t\n\f\r/>=]*+)(?:{_SP}*+={_SP}*+(?:"([^"]*+)"?|'([^']*+)'?|(?=>)|([^ \t\n\f\r>]++)))?+)""")
_COMMENT_END = re.compile(r"--!?>")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose text is never shown, or belongs to a form field.
_SILENT = {"script", "style", "template", "noscript", "title", "textarea", "select", "svg", "iframe", "object", "option", "video", "audio", "canvas"}
#: Elements whose content has no tags but their own end tag.
_RAW = {k: re.compile(rf"</{k}(?=[\s/>])", re.I) for k in ("script", "style", "noscript", "title", "textarea", "iframe")}
_BLOCK = set(
    "html head body nav header footer aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend button details summary dialog address hgroup menu center noframes".split()
)
_ENDS_P = _BLOCK - {"html", "head", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "button", "legend", "summary"}
#: Tags that end a drawing or a list of options which was not closed, as browsers take them.
_BREAKS = set("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head li menu ol p pre table ul article main section header footer nav aside".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


#: Elements that hold blocks as a rule.
_HOLDERS = {"root", "html", "body", "div", "section", "td", "center"}


class Node:
    """own and linked: words of its text, and those of them in links; below and below_linked: with all that it contains.

    twins: brothers of its tag and marks; breaks: places where a line of its text ends.
    """

    __slots__ = ("tag", "marks", "parent", "own", "linked", "last", "below", "below_linked", "twins", "breaks")

    def __init__(self, tag: str, marks: tuple[str, ...], parent: int):
        self.tag, self.marks, self.parent, self.own, self.linked, self.last = tag, marks, parent, 0, 0, ""
        self.below = self.below_linked = self.twins = self.breaks = 0


class _Pages:
    """Reads a page's tokens: (end, name, closing, names and values that mark it, closes itself, text); name is None for text, '' for what shows nothing."""

    def __init__(self, page: str):
        self.page, self.sections = page, True

    def token(self, at: int) -> tuple[int, str | None, bool, list[str], bool, str]:
        page, nothing = self.page, ("", False, [], False, "")
        m = _PLAIN.match(page, at)
        if m:
            return (m.end(), m[2].lower(), bool(m[1]), [], False, "") if m[3] else self.tag(m.end(), m[2].lower(), bool(m[1]))
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            return end, None, False, [], False, page[at:end]
        after = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                return page.index(">", at + 4) + 1, *nothing
            m = _COMMENT_END.search(page, at + 4)
            return m.end() if m else len(page), *nothing
        if self.sections and page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            if end >= 0:
                return end + 3, *nothing
            self.sections = False  # none follows
        if after in ("!", "?") or after == "/" and at + 2 < len(page):  # a declaration, or a comment by mistake
            end = page.find(">", at)
            return end + 1 or len(page), *nothing
        return at + 1, None, False, [], False, "<"

    def tag(self, at: int, name: str, closing: bool) -> tuple[int, str, bool, list[str], bool, str]:
        """From the end of its name; a tag that the page breaks off shows nothing, nor does what it swallowed."""
        marks: list[str] = []
        while at < len(self.page):
            m = _NEXT_ATTRIBUTE.match(self.page, at)
            at = m.end()
            if m[1]:
                return at, name, closing, marks, self.page[at - 2] == "/" and m.start(1) > m.start(), ""
            if at < len(self.page) and len(m[2]) <= 5 and m[2].lower() in ("class", "id", "role"):
                marks.append(m[3] or m[4] or m[5] or "")
        return at, "", False, [], False, ""


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in document order (node 0 is the root), and the runs of text as (node, text)."""
    nodes, runs, held = [Node("root", (), -1)], [], []
    stack, links, silent, at = [0], 0, "", 0
    inside: Counter[str] = Counter()  # blocks open in what is silent
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
    reader = _Pages(page)

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                n = nodes[stack[-1]]
                n.own += text.count(" ") + 1
                n.last = text[-1]
                runs.append((stack[-1], text))

    def top(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(place: int) -> None:
        while len(stack) > place:
            places[nodes[stack.pop()].tag].pop()

    while at < len(page):
        at, name, closing, values, alone, text = reader.token(at)
        if name is None:
            if silent:
                continue
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if links:
                nodes[stack[-1]].linked += len(text.split())
            continue
        if not name:
            continue
        if name in _RAW and not closing and silent != "svg" and not alone:
            end = _RAW[name].search(page, at)
            at = end.start() if end else len(page)
        if silent and name != silent and silent not in _RAW:  # its end tag may be left out
            if closing and inside[name]:
                inside[name] -= 1
            elif closing and (silent == "option" and name in ("datalist", "select", "optgroup") or places.get(name)):
                silent = ""
            elif not closing and silent in ("svg", "select") and name in _BREAKS and not inside.total():
                silent = ""
            elif not closing and (name in _BLOCK or name == "foreignobject"):
                inside[name] += 1
        if silent:
            if closing and name == silent:
                silent = ""
            continue
        if closing:
            if name in _BLOCK:
                flush()
                if places.get(name):
                    cut(places[name][-1])
                    links = 0
            elif name == "a":
                links = max(0, links - 1)
            continue
        if name in _SILENT:
            if not alone:
                silent = name
                inside.clear()
        elif name in ("br", "hr"):
            flush()
            nodes[stack[-1]].breaks += 1
        elif name == "a":
            links += 1
        elif name in _BLOCK:
            flush()
            if name in _ENDS_P and nodes[stack[-1]].tag == "p":
                cut(len(stack) - 1)
            if name in _CLOSES:
                ends, stops = _CLOSES[name]
                if top(ends) > top(stops):
                    cut(top(ends))
            marks = tuple(sorted({w.lower() for v in values for w in _PART.findall(v)})) if values else ()
            places.setdefault(name, []).append(len(stack))
            nodes.append(Node(name, marks, stack[-1]))
            stack.append(len(nodes) - 1)
            links = 0
    flush()
    like = Counter((n.parent, n.tag, n.marks) for n in nodes)
    for n in reversed(nodes):
        n.twins = like[n.parent, n.tag, n.marks]
        n.below += n.own
        n.below_linked += n.linked
        if n.parent >= 0:
            nodes[n.parent].below += n.below
            nodes[n.parent].below_linked += n.below_linked
    return nodes, runs


def features(n: Node) -> tuple[str, ...]:
    words = n.own
    size = "none" if not words else "few" if words < 5 else "some" if words < 15 else "many"
    out = ["bias", "t:" + n.tag, "n:" + size, *("m:" + m for m in n.marks), *{"b:" + m[:5] for m in n.marks if len(m) > 5}]
    if words >= 5 and n.tag in _HOLDERS:  # text that no paragraph holds
        out.append(f"s:{n.tag} {size}" + (" lines" if n.breaks else ""))
    if not n.marks and n.tag in ("article", "main"):
        out.append("u:" + n.tag)
    if words < 5 and n.tag in ("root", "html", "body"):
        out.append("s:page bare")
    if n.marks and n.twins > 2:
        out.append("twins")
    if n.below > words and n.below >= 40 and n.below_linked < 0.1 * n.below and n.tag not in ("root", "html", "body"):  # these hold the whole page
        out.append("holds text")
    if words:
        share = n.linked / words
        out.append("l:" + ("none" if share < 0.1 else "part" if share < 0.6 else "all"))
        if n.last in ".!?\"'”»…:;":
            out.append("ends")
    return tuple(out)


class Model:
    """weights: what a feature adds to the log-potential of content; edge[a][b]: log-potential of parent state a, child state b."""

    def __init__(self, weights: dict[str, float], edge: list[list[float]]):
        self.weights, self.edge, self.known = weights, edge, {}

    def potential(self, f: tuple[str, ...]) -> float:
        v = self.known.get(f)
        if v is None:
            if len(self.known) > 100_000:
                self.known.clear()
            v = self.known[f] = sum(self.weights.get(x, 0.0) for x in f)
        return v

    def marginals(self, nodes: list[Node], pairs: bool = False) -> list[float] | tuple[list[float], np.ndarray]:
        """P(content) of every node by sum-product; nodes stand in document order, so children follow their parents."""
        return self.passed([self.potential(features(x)) for x in nodes], [x.parent for x in nodes], pairs)

    def passed(self, potentials: list[float], parents: list[int], pairs: bool = False) -> list[float] | tuple[list[float], np.ndarray]:
        """The two passes over the tree."""
        e = [[exp(x) for x in row] for row in self.edge]
        (e00, e01), (e10, e11) = e
        n = len(parents)
        local = [1 / (1 + exp(-max(-30.0, min(30.0, x)))) for x in potentials]
        up0, up1 = [1 - x for x in local], local[:]
        m0, m1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            a, b, p = up0[i], up1[i], parents[i]
            x, y = e00 * a + e01 * b, e10 * a + e11 * b
            s = x + y
            m0[i], m1[i] = x / s, y / s
            a, b = up0[p] * m0[i], up1[p] * m1[i]
            s = a + b
            up0[p], up1[p] = a / s, b / s
        out, joint = [0.0] * n, np.zeros((2, 2))
        out[0] = up1[0]
        for i in range(1, n):
            p1 = out[parents[i]]
            q0, q1 = (1 - p1) / m0[i], p1 / m1[i]  # the parent without this child's message
            j00, j01, j10, j11 = q0 * e00 * up0[i], q0 * e01 * up1[i], q1 * e10 * up0[i], q1 * e11 * up1[i]
            s = j00 + j01 + j10 + j11
            out[i] = (j01 + j11) / s
            if pairs:
                joint += np.array([[j00, j01], [j10, j11]]) / s
        return (out, joint) if pairs else out


def extract(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes, runs = parse(page)
    p = model.marginals(nodes)
    return " ".join(text for i, text in runs if p[i] > 0.5)


_GOOD, _BAD = "\x01", "\x02"


def labelled_pages(count: int = 320, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages built from labelled parts: (html, label of each block node in document order, the root included)."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    maybe = lambda p: rng.random() < p
    words = lambda lo, hi: " ".join("".join(pick(*"bcdfglmnprst") + pick(*"aeiou") for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(lo, hi)))
    line = lambda lo, hi: words(lo, hi).capitalize() + pick(".", ".", ".", "!", "?", ":")

    def el(tag: str, good: int, inner: str, cls: str = "", attr: str = "class") -> str:
        return f"<{tag}{_GOOD if good else _BAD}" + (f' {attr}="{cls}"' if cls else "") + f">{inner}</{tag}>"

    link = lambda: f'<a href="/x">{words(1, 4)}</a>'
    plain = lambda: el("p", 1, pick(words(1, 40), " ".join([words(1, 2)] * rng.integers(2, 30)), line(1, 6)))
    para = lambda: plain() if maybe(0.2) else el("p", 1, pick("", "<b>", "<em>") + " ".join(line(4, 16) for _ in range(rng.integers(1, 6))) + (f" {link()} {words(3, 9)}." if maybe(0.3) else ""))

    lines = lambda: pick("<br>", "<br><br>", "<br/>\n").join(" ".join(line(5, 18) for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(2, 6)))

    def article() -> str:
        parts = [el(pick("h1", "h2"), 1, words(3, 14))] if maybe(0.85) else []
        for _ in range(rng.integers(1, 9)):
            kind = rng.integers(10)
            if kind < 6:
                parts.append(para())
            elif kind == 6:
                parts.append(el(pick("h2", "h3", "h4"), 1, words(2, 7)))
            elif kind == 7:
                parts.append(el(pick("ul", "ol"), 1, "".join(el("li", 1, line(2, 14)) for _ in range(rng.integers(2, 6)))))
            elif kind == 8:
                parts.append(pick(el("blockquote", 1, para()), el("pre", 1, words(4, 20)), el("blockquote", 1, line(5, 20)), el("figure", 1, el("figcaption", 1, line(3, 10)))))
            else:
                parts.append(el("table", 1, "".join(el("tr", 1, "".join(el("td", 1, words(1, 4)) for _ in range(3))) for _ in range(rng.integers(2, 4)))))
        if maybe(0.12):  # verse, lists of names: short lines without a full stop
            parts += [el("p", 1, words(1, 4) + pick("", "", ",", ".")) for _ in range(rng.integers(8, 40))]
        if maybe(0.25):
            parts.insert(rng.integers(min(1, len(parts)), len(parts) + 1), advert())
        if maybe(0.2):
            parts.append(share())
        if maybe(0.35):
            parts.append(pick(comments, comments, comments, side, form, notice)())
        inner = "".join(parts)
        shape = rng.integers(8)
        if shape == 7:  # no paragraphs: lines in one block
            head = el("h1", 1, words(3, 9)) if maybe(0.4) else ""
            return el(pick("div", "div", "td", "section"), 1, head + lines(), pick("", words(1, 2), "text", "post"), pick("class", "id"))
        if shape < 3:
            return el("article", 1, inner, pick("", "", "post", "entry", "story"))
        if shape == 3:
            return el("main", 1, pick(inner, el("article", 1, inner), el("section", 1, inner)), pick("", "main", "content"), "id")
        if shape == 4:
            return el("div", 1, inner, pick("content", "post-content", "entry-content", "article-body", "story text", "main-content", "post body"), pick("class", "id"))
        if shape == 5:  # a name that tells nothing, or none
            return el("div", 1, inner, pick("", words(1, 2)), pick("class", "id"))
        return el("article", 1, el("div", 1, inner, pick("body", "article-body", "text", "content")))

    menu = lambda: el("ul", 0, "".join(el("li", 0, link()) for _ in range(rng.integers(2, 9))), pick("", "menu", "nav-list", "links"))
    nav = lambda: pick(el("nav", 0, menu()), el("nav", 0, " ".join(link() for _ in range(5))), el("div", 0, menu(), pick("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav"), pick("class", "id")))
    advert = lambda: el(pick("div", "div", "aside", "section"), 0, pick(line(3, 18), el("p", 0, line(3, 18)), link()), pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor", "anzeige", "werbung", "publicite", "publicidad"), pick("class", "id"))
    share = lambda: el("div", 0, pick(menu(), " ".join(link() for _ in range(3))), pick("share", "social", "related", "tags", "meta", "pagination", "author"))
    notice = lambda: el(pick("div", "section", "aside"), 0, pick(line(5, 25), el("p", 0, line(5, 25))) + (el("button", 0, words(1, 2)) if maybe(0.5) else ""), pick("cookie", "cookie-notice", "notice", "consent", "gdpr", "banner", "alert", "popup", "modal", "newsletter", "subscribe", "hinweis", "avis", "aviso"), pick("class", "id"))
    form = lambda: el("form", 0, pick(words(1, 4), el("p", 0, line(2, 10)), f"<label>{words(1, 4)}</label>") + '<input type="text">' + el("button", 0, words(1, 2)), pick("", "search", "login", "signup"))
    footer = lambda: pick(el("footer", 0, line(3, 18)), el("footer", 0, words(1, 4)), el("footer", 0, words(1, 3)), el("footer", 0, el("p", 0, line(3, 14)) + menu()), el("div", 0, pick(line(3, 16), el("p", 0, line(3, 16)), menu()), pick("footer", "site-footer", "copyright", "bottom", "fusszeile", "pied-de-page"), pick("class", "id")))
    header = lambda: pick(el("header", 0, words(1, 6)), el("header", 0, el(pick("div", "p", "h2"), 0, words(1, 6)) + nav()), el("div", 0, el("p", 0, words(1, 6)), pick("header", "site-header", "masthead", "logo", "top"), pick("class", "id")))
    side = lambda: pick(el("aside", 0, el("h3", 0, words(1, 4)) + pick(menu(), el("p", 0, line(4, 25)))), el("div", 0, el("h3", 0, words(1, 4)) + pick(menu(), el("p", 0, line(4, 25)), el("div", 0, line(4, 12))), pick("sidebar", "widget", "side", "related", "sidebar-widget", "recommended", "trending", "popular", "seitenleiste", "barra-lateral", "colonne-laterale"), pick("class", "id")))

    def comments() -> str:
        said = lambda: el("p", 0, line(4, 30)) + (el("p", 0, line(3, 20)) if maybe(0.4) else "")
        one = lambda: el("div", 0, said()) if maybe(0.08) else el(pick("div", "li", "article"), 0, said(), pick("comment", "comment-body", "reply", "comment", "kommentar", "commentaire", "comentario", "post-reply"))
        return el(pick("section", "div", "ol"), 0, el(pick("h2", "h3", "h3", "h4"), 0, words(1, 3)) + "".join(one() for _ in range(rng.integers(1, 5))), pick("comments", "comments", "comment-list", "user-comments", "responses", "discussion", "disqus", "replies", "kommentare", "kommentarbereich", "commentaires", "comentarios", "commenti", "discussion-thread", "reader-opinions", "leserbriefe", "thread"), pick("class", "id"))

    out = []
    for _ in range(count):
        before = [f() for f in (header, nav, notice, advert, form) if maybe(0.5)]
        after = [f() for f in (side, advert, share, comments, form, notice) if maybe(0.4)] + ([footer()] if maybe(0.85) else [])
        if maybe(0.15):  # hardly anything but the article
            before, after = before[:1], [pick(footer, comments, share)()]
        core = article()
        if maybe(0.3):
            core = el("div", 1, core, pick("container", "wrapper", "page", "layout", "row", "site"), pick("class", "id"))
        if maybe(0.15):
            before.append(side())
        whole = "".join(before) + core + "".join(after) + (words(1, 3) if maybe(0.08) else "")  # a stray word
        page = whole if maybe(0.25) else el("html", 0, el("head", 0, f"<title>{words(2, 8)}</title>") + el("body", 0, whole))  # tags that may be left out
        labels = [0, *(int(m == _GOOD) for m in re.findall(f"[{_GOOD}{_BAD}]", page))]
        out.append((re.sub(f"[{_GOOD}{_BAD}]", "", page), labels))
    for _ in range(count // 20):  # text that no element holds, or the body alone
        out.append((lines() if maybe(0.5) else line(5, 30) + " " + line(5, 30), [1]))
        out.append((f"<html><head><title>{words(2, 5)}</title></head><body>{lines()}</body></html>", [0, 0, 0, 1]))
        out.append((f"<article><p>{line(4, 16)}</p></article>", [0, 1, 1]))
    for page in _WRITTEN:
        labels = [0, *(int(m == "+") for m in re.findall(r"<\w+([+-])", page))]
        out += [(re.sub(r"(<\w+)[+-]", r"\1", page), labels)] * 3
    return out


#: Pages written by hand to train on; + and - after a block's name tell whether it is content.
_WRITTEN = (
    "<html-><body-><div- class=oben><a href=1>Start</a> | <a href=2>Archiv</a> | <a href=3>Kontakt</a></div><div+ class=k1><h1+>Der Markt am Morgen</h1><p+>Um sechs Uhr stehen die ersten Wagen auf dem Platz, und es riecht nach Brot.</p><p+>Wer spät kommt, findet nur noch Rüben. Das war schon immer so.</p></div><div- class=kommentare><h3->2 Kommentare</h3><div- class=kommentar><p->Schöner Text, danke!</p></div><div- class=kommentar><p->Früher war der Markt größer, da gab es auch Fisch.</p></div></div><div- class=unten>Impressum und Datenschutz</div></body></html>",
    "<html-><body-><table-><tr-><td-><a href=1>Accueil</a><br><a href=2>Photos</a></td><td+>Le vieux pont a été fermé hier soir.<br>Les travaux dureront trois mois, selon la mairie.<br>Un bac relie les deux rives en attendant.</td></tr></table><div->Mentions légales</div></body></html>",
    "<html-><body-><header-><nav-><a href=1>Home</a> <a href=2>About</a></nav></header><main+><div+><h2+>How we count birds</h2>We stand on the hill at dawn and write down what we see.<br><br>Some mornings there is nothing but fog, and we drink tea.</div><div- class=discussion-thread><h4->Discussion</h4><div-><p->I have counted forty geese here in one hour.</p></div><div-><p->Which binoculars do you use for that?</p></div></div></main></body></html>",
    "<html-><body-><div+ id=x7>La cosecha empezó tarde este año por las lluvias.<br>Los olivos más viejos dan menos, pero su aceite es mejor.</div><div- id=x8><a href=1>Anterior</a> <a href=2>Siguiente</a></div></body></html>",
    "<div+ class=q>It snowed for nine days, and nobody could reach the village by road.<br>On the tenth day a man came over the pass on skis with the mail.</div>",
)


def fit(pages: list[tuple[str, list[int]]], epochs: int = 25, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Gradient ascent on the exact log-likelihood, page by page; expected counts are the marginals of nodes and edges."""
    numbers: dict[str, int] = {}
    trees = []
    for page, labels in pages:
        nodes = parse(page)[0]
        if len(nodes) != len(labels):
            raise ValueError("labels don't fit the page's blocks")
        own = [[numbers.setdefault(f, len(numbers)) for f in features(n)] for n in nodes]
        used, place = np.unique(np.concatenate(own), return_inverse=True)
        found = np.zeros((2, 2))
        for n, t in zip(nodes[1:], labels[1:], strict=True):
            found[labels[n.parent], t] += 1
        trees.append(([n.parent for n in nodes], np.array(labels), used, place, np.array([len(x) for x in own]), found))
    weights, seen = np.zeros(len(numbers)), np.full(len(numbers), 1e-6)
    edge, edge_seen = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    model, rng = Model({}, []), np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(trees)):
            parents, y, used, place, count, found = trees[k]
            model.edge = edge.tolist()
            potentials = np.add.reduceat(weights[used][place], np.cumsum(count) - count)
            p, joint = model.passed(potentials.tolist(), parents, pairs=True)
            g = np.bincount(place, np.repeat(y - p, count)) - decay * weights[used]
            seen[used] += g * g  # steps shrink with a weight's summed squared gradients
            weights[used] += rate * g / np.sqrt(seen[used])
            g = found - joint - decay * edge
            edge_seen += g * g
            edge += rate * g / np.sqrt(edge_seen)
    return Model(dict(zip(numbers, weights.tolist(), strict=True)), edge.tolist())


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit(labelled_pages())


def extract_text(pages: DataFrame, store: Store, model: Model | None = None) -> DataFrame:
    """pages with a column text, or text replaced if there is one."""
    model = model or trained()
    model.known.clear()
    names = [c for c in pages.columns if c != "text"]
    at = pages.columns.index("html")
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x, model) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(pages_columns.index(c)) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    pages_columns = pages.columns
    return pages.mapInArrow(run, schema)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract_text(pages, Store(spark, "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
