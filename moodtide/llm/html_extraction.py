"""op9: main text of web pages by a tree-structured graphical model over their elements.

A page becomes a tree of elements; ``script``, ``style``, ``template``, ``textarea``, ``select`` and the head's ``title`` are left out. Each element has a hidden label
(content or not), a likelihood of its observed traits (kind of tag, hints in class, id and role, share of linked text,
amount of text) and a potential with its parent's label that depends on its kind. Sum-product messages go up and down the
tree once each, which gives exact marginals. The text that stands directly in an element is kept if its marginal
is at least a half.

Potentials are smoothed counts over labelled pages: elements that carry ``data-y="0"`` or ``"1"``, inherited by
what they hold. ``labelled_pages`` writes such pages by rule, in many layouts; own ones may be given.

Character references are decoded; white space of a block becomes one space; blocks are joined in page order by one space.
Null and empty html give an empty text; unclosed elements end where HTML ends them; an unclosed comment, script or style, and a tag
without its ``>``, run to the end; of other left-out elements without a closing tag only the tag is skipped. Labels are read in training
pages only. Time is linear in the page, whatever it holds.
Nothing is cut or dropped but by label. Repeated pages are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common

#: Element kinds of HTML.
RAW = {"script", "style", "template", "textarea", "title", "select"}
RUNS_ON = {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Embedded content, formulas and drawings: their text is part of the text around them.
INLINE |= set("audio canvas iframe math noscript object svg video".split())
INLINE |= set("annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE |= set("circle clippath defs desc ellipse filter foreignobject g image line lineargradient marker mask metadata path pattern polygon polyline radialgradient rect stop switch symbol text textpath tspan use view".split())
KINDS = {
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "article": "article main", "section": "section", "div": "div center", "paragraph": "p",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol li dl dt dd", "table": "table tbody thead tfoot tr td th caption", "form": "form button fieldset legend label input option dialog",
    "quote": "blockquote pre figure figcaption details summary address", "root": "html body", "inline": " ".join(INLINE),
}
KIND_OF = {t: i for i, (_, tags) in enumerate(KINDS.items()) for t in tags.split()}
OTHER = len(KINDS)
#: Words in class, id and role that tell what an element is for.
HINTS = (
    ("comment", r"comment|disqus|respond|repl(?:y|ies)|discussion|feedback|review"),
    ("chrome", r"nav|menu|breadcrumb|crumbs|header|masthead|topbar|banner|footer|copyright|colophon|site-?info|legal|pagination|pager|toolbar|logo|skip"),
    ("side", r"sidebar|side-?col|widget|related|recommend|more-?from|popular|trending|teaser|tags|rail"),
    ("ad", r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|dfp|taboola|outbrain"),
    ("notice", r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri|signup|sign-?up|paywall|disclaimer|toast"),
    ("social", r"share|social|follow|like-?box|byline|author-?box"),
    ("form", r"form|search|login|sign-?in|register"),
    ("content", r"article|content|post|entry|main|story|text|body|prose|page"),
)
_HINT = [re.compile(p) for _, p in HINTS]
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s/>=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_CLOSED_BY = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in sorted(RAW)}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements that the start of another ends, and those within which it does.
_CLOSES_LIKE = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
LENGTHS, SHARES = (1, 25, 80, 250, 1000), (0.01, 0.35, 0.7)
N_HINTS, N_LENGTHS, N_SHARES = len(HINTS) + 2, len(LENGTHS) + 1, len(SHARES) + 2


class _Open:
    """The open elements: a stack that knows where each tag, and the last block, stands."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def cut(self, size: int) -> None:
        """Closes the elements above the first size ones."""
        while len(self.stack) > size:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tags: str) -> int:
        """The place of the innermost open element of some tags, the page's root apart; 0 if there is none."""
        return max((self.places[t][-1] for t in tags.split() if self.places.get(t)), default=0)

    def end(self, tag: str) -> None:
        """A closing tag; one of an inline element closes nothing beyond the innermost block."""
        at = self.last(tag)
        if at and (tag not in INLINE or at > self.blocks[-1]):
            self.cut(at)

    def start_block(self, tag: str) -> None:
        """Closes what the start of a block ends."""
        self.cut(self.blocks[-1] + 1)  # formatting elements don't hold blocks together
        if tag in _CLOSES_LIKE:
            likes, within = _CLOSES_LIKE[tag]
            if (at := self.last(likes)) > self.last(within):
                self.cut(at)
        elif self.stack[-1][0] == "p":
            self.cut(len(self.stack) - 1)


class Tree:
    """Elements of a page in page order: parents, kinds, hints, amounts of text, and the text between; labels of training pages."""

    def __init__(self, html: str, labelled: bool = False):
        self.parent, self.kind, self.hint, self.own, self.linked, self.label = [-1], [KIND_OF["html"]], [0], [0], [0], [None]
        self.pieces: list[tuple[int, str]] = []  # (-1, "") is a border between blocks
        self.html, self.links, self.labelled = html, False, labelled
        self.open, self.missing = _Open(), set()
        self.open.push("html", 0)
        at, text_from, end = 0, 0, len(html)
        while at < end:
            stop = html.find("<", at)
            after = html[stop + 1 : stop + 2] if stop >= 0 else ""
            if stop >= 0 and not (after in ("!", "?") and after or after.isascii() and after.isalpha() or after == "/" and html[stop + 2 : stop + 3].isalpha()):
                at = stop + 1  # a character like others
                continue
            self._text(text_from, stop if stop >= 0 else end)
            if stop < 0:
                return
            at = text_from = self._mark_up(stop, after)
        self._text(text_from, end)

    def _text(self, start: int, stop: int) -> None:
        if stop <= start:
            return
        text = html_lib.unescape(self.html[start:stop])
        node = self.open.stack[-1][1]
        size = len(text) if "  " not in text and "\n" not in text else len(" ".join(text.split()))
        self.own[node] += size
        self.linked[node] += size * self.links
        self.pieces.append((node, text))

    def _find(self, what: str, at: int) -> int:
        """The place behind the next of what; the end of the page if there is none."""
        found = self.html.find(what, at)
        return found + len(what) if found >= 0 else len(self.html)

    def _mark_up(self, at: int, after: str) -> int:
        """Reads the tag, comment or declaration at a place, and tells where it ends."""
        if after in "!?":
            return self._find("-->", at + 4) if self.html.startswith("<!--", at) else self._find(">", at)
        name = _NAME.match(self.html, at + 1 + (after == "/"))
        tag = name[0].lower()
        if after == "/":
            to = self._find(">", name.end())
            if tag == "a":
                self.links = False
            if tag not in INLINE:
                self.pieces.append((-1, ""))
                self.links = False
            self.open.end(tag)
            return to
        to, attrs = self._attributes(name.end())
        closed = self.html.endswith("/>", at, to) and self.html[to - 3 : to - 2] != "="
        if tag in RAW:
            return to if closed else self._raw(tag, to)
        if tag in VOID or tag in INLINE and closed:
            if tag in ("br", "hr"):
                self.pieces.append((-1, ""))
            return to
        hint, label = self._hint(attrs) if attrs else (0, None)
        inline = tag in INLINE
        if tag == "a":
            self.links = True
        if inline and not hint and label is None:
            return to
        if not inline:
            self.links = False
            self.pieces.append((-1, ""))
            self.open.start_block(tag)
            if tag in ("html", "body") and len(self.open.stack) == 1:
                return to
        parent = self.open.stack[-1][1]
        self.parent.append(parent), self.kind.append(KIND_OF.get(tag, OTHER)), self.hint.append(hint), self.own.append(0), self.linked.append(0)
        self.label.append(self.label[parent] if label is None else label)
        self.open.push(tag, len(self.parent) - 1)
        return to

    def _attributes(self, at: int) -> tuple[int, list[tuple[str, str]]]:
        """Where a tag ends, and its attributes."""
        out, end = [], len(self.html)
        while at < end:
            m = _ATTR.match(self.html, at)
            if m:
                out.append((m[1].lower(), (m[2] or m[3] or m[4] or "").lower()))
                at = m.end()
            elif self.html[at] == ">":
                return at + 1, out
            else:
                at += 1
        return end, out

    def _raw(self, tag: str, at: int) -> int:
        """Where a left-out element that begins before a place ends."""
        close = None if tag in self.missing else _CLOSED_BY[tag].search(self.html, at)
        if close:
            return self._find(">", close.start())
        self.missing.add(tag)
        return len(self.html) if tag in RUNS_ON else at

    def _hint(self, attrs: list[tuple[str, str]]) -> tuple[int, int | None]:
        found, label, words = 0, None, []
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                words.append(value)
            elif name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value == "true" or name == "hidden":
                found = N_HINTS - 1
            elif self.labelled and name == "data-y" and value in ("0", "1"):
                label = int(value)
        if words and not found:
            joined = " ".join(words)
            found = next((i for i, p in enumerate(_HINT, 1) if p.search(joined)), 0)
        return found, label

    def traits(self) -> tuple[list[int], list[int]]:
        """Classes of the amount of text under each element, and of its linked share."""
        n = len(self.parent)
        size, linked = self.own[:], self.linked[:]
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        amount = [sum(s >= k for k in LENGTHS) for s in size]
        share = [0 if not s else 1 + sum(x >= k * s for k in SHARES) for s, x in zip(size, linked, strict=True)]
        return amount, share


def fit(pages: list[str]) -> dict:
    """Log potentials of labelled pages; elements without a label teach nothing."""
    edge, obs = np.ones((OTHER + 1, 2, 2)), [np.ones((2, n)) for n in (OTHER + 1, N_HINTS, N_LENGTHS, N_SHARES)]
    root = np.ones(2)
    for page in pages:
        t = Tree(page, labelled=True)
        amount, share = t.traits()
        y = t.label[:]
        size = [t.own[i] * (y[i] is not None) for i in range(len(y))]
        good = [t.own[i] * (y[i] == 1) for i in range(len(y))]
        for i in range(len(y) - 1, 0, -1):
            size[t.parent[i]] += size[i]
            good[t.parent[i]] += good[i]
        for i in range(len(y)):  # what has no label of its own goes with most of its text
            if y[i] is None:
                y[i] = int(2 * good[i] > size[i])
        root[y[0]] += 1
        for i in range(len(y)):
            for table, v in zip(obs, (t.kind[i], t.hint[i], amount[i], share[i]), strict=True):
                table[y[i], v] += 1
            if i:
                edge[t.kind[i], y[t.parent[i]], y[i]] += 1
    return {"root": np.log(root / root.sum()).tolist(), "edge": np.log(edge / edge.sum(2, keepdims=True)).tolist(), "obs": [np.log(o / o.sum(1, keepdims=True)).tolist() for o in obs]}


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(t: Tree, model: dict) -> list[float]:
    """Probability of the label content of each element, by one upward and one downward pass of messages."""
    amount, share = t.traits()
    kinds, hints, lengths, shares = model["obs"]
    edge, n = model["edge"], len(t.parent)
    up0 = [kinds[0][k] + hints[0][h] + lengths[0][a] + shares[0][s] for k, h, a, s in zip(t.kind, t.hint, amount, share, strict=True)]
    up1 = [kinds[1][k] + hints[1][h] + lengths[1][a] + shares[1][s] for k, h, a, s in zip(t.kind, t.hint, amount, share, strict=True)]
    to0, to1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        (e00, e01), (e10, e11) = edge[t.kind[i]]
        to0[i], to1[i] = _log_add(e00 + up0[i], e01 + up1[i]), _log_add(e10 + up0[i], e11 + up1[i])
        up0[t.parent[i]] += to0[i]
        up1[t.parent[i]] += to1[i]
    down0, down1 = [model["root"][0]] + [0.0] * (n - 1), [model["root"][1]] + [0.0] * (n - 1)
    for i in range(1, n):
        p = t.parent[i]
        (e00, e01), (e10, e11) = edge[t.kind[i]]
        b0, b1 = down0[p] + up0[p] - to0[i], down1[p] + up1[p] - to1[i]
        down0[i], down1[i] = _log_add(b0 + e00, b1 + e10), _log_add(b0 + e01, b1 + e11)
    return [1 / (1 + math.exp(min(700.0, max(-700.0, down0[i] + up0[i] - down1[i] - up1[i])))) for i in range(n)]


def extract(html: str | None, model: dict) -> str:
    if not html:
        return ""
    t = Tree(html)
    keep = [p >= 0.5 for p in marginals(t, model)]
    return " ".join("".join(" " if node < 0 else text if keep[node] else "" for node, text in t.pieces).split())


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Pages in many layouts, whose elements are labelled by what the rule that wrote them meant them for."""
    r = random.Random(seed)
    syllables = "an be co de er fo ga hi in ja ka lo mi no or pa qui re sa ti un ve wa xo ye zu".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))).capitalize() + r.choice([".", ".", "", "!"])

    def attr(*names: str, chance: float = 0.75) -> str:
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if names and r.random() < chance else r.choice(["", "", f' class="{r.choice(["c1", "x9", "row", "col-8", "wrap", "inner", "box"])}"'])

    def element(tag: str, inside: str, attrs: str = "", y: int | None = None) -> str:
        return f"<{tag}{attrs}" + (f' data-y="{y}"' if y is not None else "") + f">{inside}" + ("" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>")

    def link() -> str:
        return f'<a href="/{r.randint(1, 99)}">{words(1, 4)}</a>'

    def links() -> str:
        some = [link() for _ in range(r.randint(2, 9))]
        return element("ul", "".join(element("li", x) for x in some)) if r.random() < 0.7 else " | ".join(some)

    def short() -> str:
        return words(1, 25) if r.random() < 0.5 else element("p", words(1, 30))

    def menu() -> str:
        return element(*r.choice([("nav", links(), ""), ("nav", links(), attr("main-nav", "menu")), ("div", links(), attr("menu", "nav", "navbar", "breadcrumbs", chance=0.9)), ("div", links(), ' role="navigation"')]), 0)

    def advert() -> str:
        return element(r.choice(["div", "div", "aside", "section"]), r.choice([words(2, 40), element("p", words(2, 40)), link(), element("a", words(2, 12), ' href="x"')]), attr("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", chance=0.97), 0)

    def notice() -> str:
        return element(r.choice(["div", "div", "section", "aside", "p"]), r.choice([words(4, 40), element("p", words(4, 40)) + "<button>" + words(1, 2) + "</button>"]), attr("cookie-banner", "consent", "notice", "alert", "popup", "newsletter", "gdpr", "subscribe-box", "modal", chance=0.97), 0)

    def form() -> str:
        return element("form", r.choice(["", words(1, 5)]) + r.choice([element("label", words(1, 3)) + "<input>", element("p", words(2, 15)) + "<input><button>" + words(1, 2) + "</button>"]), attr("search", "login", "signup", chance=0.5), 0)

    def comments() -> str:
        each = [element(r.choice(["div", "li", "article"]), r.choice(["", element("h4", words(1, 2)), element("span", words(1, 2), ' class="author"')]) + "".join(element("p", words(3, 60)) for _ in range(r.randint(1, 2))), attr("comment", "reply", "comment-body", chance=0.8)) for _ in range(r.randint(1, 6))]
        return element(r.choice(["section", "div", "div", "ol", "aside"]), r.choice(["", element("h3", words(1, 3))]) + "".join(each) + r.choice(["", form()]), attr("comments", "comment-list", "disqus_thread", "responses", "discussion", chance=0.99), 0)

    def side() -> str:
        inside = r.choice([links(), element("h3", words(1, 4)) + links(), short(), element("h4", words(1, 4)) + short()])
        if r.random() < 0.5:
            return element("aside", inside, attr("sidebar", "widget", "related", chance=0.5), 0)
        return element("div", inside, attr("sidebar", "widget", "related-posts", "recommended", "side-col", chance=0.97), 0)

    def head() -> str:
        return element(r.choice(["header", "header", "div"]), r.choice([link(), element("h2", words(1, 4)), element("p", words(1, 10)), words(1, 5)]) + r.choice(["", menu()]), attr("header", "masthead", "site-header", "topbar", chance=0.97), 0)

    def foot() -> str:
        return element(r.choice(["footer", "footer", "div"]), r.choice(["&copy; " + words(1, 20), element("p", "&copy; " + words(1, 20)) + links(), links(), words(4, 30)]), attr("footer", "site-footer", "copyright", "colophon", chance=0.97), 0)

    def share() -> str:
        return element(r.choice(["div", "ul"]), " ".join(link() for _ in range(r.randint(2, 4))), attr("share", "social", "tags", chance=0.97), 0)

    def block() -> str:
        text = words(1, 8) if r.random() < 0.25 else words(8, 150)
        if r.random() < 0.2:
            text = text[: len(text) // 2] + r.choice([" " + link() + " ", "<b>" + words(1, 3) + "</b>", "<br>", "<em>" + words(1, 4)]) + text[len(text) // 2 :]
        x = r.random()
        if x < 0.8:
            return element("p", text)
        if x < 0.86:
            return element(r.choice(["h2", "h3"]), words(1, 8))
        if x < 0.9:
            return element(r.choice(["ul", "ol"]), "".join(element("li", words(2, 25)) for _ in range(r.randint(2, 6))))
        if x < 0.94:
            return element(r.choice(["blockquote", "pre"]), words(5, 60))
        if x < 0.96:
            return element("figure", "<img>" + element("figcaption", words(2, 15)))
        if x < 0.98:
            return element("table", "".join(element("tr", "".join(element("td", words(1, 5)) for _ in range(3))) for _ in range(3)))
        return element("div", text)

    def article() -> str:
        tag, names = r.choice([("article", ()), ("article", ("post", "article", "entry")), ("main", ()), ("div", ("content", "post", "entry-content", "article-body", "main-content", "story")), ("section", ("content", "article")), ("div", ())])
        parts = [element("h1", words(2, 12))] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            parts.append(block())
            if r.random() < 0.08:
                parts.append(r.choice([advert, side, share, form, notice])())
        return element(tag, "".join(parts), attr(*names, chance=0.9), 1)

    out = []
    for _ in range(n):
        body = [x() for x in (head, menu, notice, advert) if r.random() < 0.55]
        r.shuffle(body)
        center = [article()] + [x() for x in (side, comments, share, advert, form, side) if r.random() < 0.35]
        if r.random() < 0.3:
            center.insert(0, side())
        if r.random() < 0.4:
            center = [element(r.choice(["div", "main", "section"]), "".join(center), attr("wrapper", "container", "layout"))]
        tail = [x() for x in (comments, notice, advert) if r.random() < 0.25] + [foot() for _ in range(r.random() < 0.85)]
        out.append("<!DOCTYPE html><html><head><title>" + words(2, 8) + "</title><script>var a='<p>'</script></head><body>" + "".join(body + center + tail) + r.choice(["</body></html>", ""]))
    return out


def main_text(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url and the main text of pages(page_id, url, html)."""
    common.ship(pages.sparkSession)
    model = model or fit(labelled_pages())

    def rows(batches):
        for b in batches:
            held, texts, size = b.column("html"), [], 0
            at = 0
            for i in range(len(held)):
                texts.append(extract(held[i].as_py(), model))
                size += len(texts[-1])
                if size > 8 << 20 or i == len(held) - 1:
                    yield pa.record_batch([b.column("page_id").slice(at, len(texts)), b.column("url").slice(at, len(texts)), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
                    at, texts, size = i + 1, [], 0

    return pages.select("page_id", "url", "html").mapInArrow(rows, "page_id long, url string, text string")


def op9_tree_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
