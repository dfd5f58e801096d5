"""Tolerant element tree of a page, held in flat lists in document order, with pruning and choice of the main body."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Tags and attribute words that decide what is dropped and how open elements end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"),
}
DROPPED = frozenset("script style noscript template svg canvas iframe object embed form input button select textarea nav aside dialog".split())
DROPPED_ROLES = frozenset("navigation banner search complementary contentinfo dialog".split())
KEPT = frozenset("html body [document] head main article".split())
CHROME_WORDS = (
    "nav navbar menu sidebar side-bar breadcrumb pagination paginator cookie consent gdpr banner advert advertisement ad ads sponsor promo social share sharing follow subscribe newsletter signup paywall "
    "comment comments disqus related recommend trending popular skip-link screen-reader sr-only visually-hidden hidden footer site-footer page-footer masthead site-header toolbar widget modal popup overlay"
).split()
#: Share of the page's text above which nothing is dropped; characters and link share a body needs; points of a paragraph.
LARGE, BODY_CHARS, BODY_LINKS, PARAGRAPH_POINTS = 0.4, 140, 0.55, 60

_CHROME = re.compile(r"(?:^|[-_ ])(?:" + "|".join(map(re.escape, sorted(CHROME_WORDS, key=len, reverse=True))) + r")(?:[-_ ]|$)", re.I)


class Tree:
    """Nodes in document order: ``tag`` (empty for text), ``attrs``, ``text``, ``parent``, ``children``.

    A child always comes after its parent, so sums over subtrees take one pass backwards; nothing recurses, whatever
    the nesting. Broken markup never raises."""

    def __init__(self, source: str | None):
        self.tag, self.attrs, self.text, self.parent, self.children = ["[document]"], [{}], [""], [-1], [[]]
        self.dead: set[int] = set()
        _Builder(self).run(source or "")

    def add(self, tag: str, attrs: dict[str, str], text: str, parent: int) -> int:
        k = len(self.tag)
        for column, value in ((self.tag, tag), (self.attrs, attrs), (self.text, text), (self.parent, parent), (self.children, [])):
            column.append(value)
        self.children[parent].append(k)
        return k

    def walk(self, top: int = 0):  # noqa: ANN201
        """Living nodes below ``top``, and it, in document order."""
        todo = [top]
        while todo:
            k = todo.pop()
            if k in self.dead:
                continue
            yield k
            todo.extend(reversed(self.children[k]))

    def find(self, *tags: str, top: int = 0) -> list[int]:
        return [k for k in self.walk(top) if self.tag[k] in tags and k != top]

    def first(self, tag: str, top: int = 0) -> int | None:
        return next((k for k in self.walk(top) if self.tag[k] == tag and k != top), None)

    def plain(self, top: int = 0) -> str:
        return "".join(self.text[k] for k in self.walk(top))

    def sizes(self) -> tuple[list[int], list[int], list[int]]:
        """Characters of text, of link text, and paragraphs in each living subtree, in one pass backwards."""
        n = len(self.tag)
        chars, links, paragraphs = [0] * n, [0] * n, [0] * n
        gone = [False] * n
        for k in range(1, n):
            gone[k] = k in self.dead or gone[self.parent[k]]
        for k in range(n - 1, 0, -1):
            if gone[k]:
                continue
            if not self.tag[k]:
                chars[k] = len(self.text[k])
            if self.tag[k] == "a":
                links[k] = chars[k]
            up = self.parent[k]
            chars[up] += chars[k]
            links[up] += links[k]
            paragraphs[up] += paragraphs[k] + (self.tag[k] == "p")
        return chars, links, paragraphs

    def prune(self) -> list[str]:
        """Drop what is no content; reasons (tag, or tag.class) in order, each once.

        Scripts, forms, menus and the like always go; site headers and footers outside an article, and elements named
        as chrome, only while they hold no large share of the text."""
        chars = self.sizes()[0]
        total = chars[0]
        reasons: dict[str, None] = {}
        todo = [(0, False)]
        while todo:
            k, in_article = todo.pop()
            below = []
            for c in self.children[k]:
                tag = self.tag[c]
                if not tag or c in self.dead:
                    continue
                small = not total or chars[c] / total <= LARGE
                if tag in DROPPED:
                    reason = tag
                elif tag in KEPT:
                    reason = ""
                elif tag in ("header", "footer") and not in_article:
                    reason = tag if small else ""
                elif small and self._chrome(c):
                    name = (self.attrs[c].get("class") or self.attrs[c].get("id") or tag).split()
                    reason = f"{tag}.{name[0]}" if name else tag
                else:
                    reason = ""
                if reason:
                    reasons.setdefault(reason)
                    self.dead.add(c)
                else:
                    below.append((c, in_article or tag == "article"))
            todo.extend(reversed(below))
        return list(reasons)

    def _chrome(self, k: int) -> bool:
        a = self.attrs[k]
        if a.get("role", "").lower() in DROPPED_ROLES or a.get("aria-hidden", "").lower() == "true" or "hidden" in a:
            return True
        return _CHROME.search(f"{a.get('class', '')} {a.get('id', '')} {a.get('data-testid', '')}") is not None

    def body(self) -> tuple[int, str]:
        """(node, criterion): the longest article, else main, else role=main, else the element with most prose, else all."""
        chars, links, paragraphs = self.sizes()
        for tag in ("article", "main"):
            found = self.find(tag)
            if found:
                best = max(found, key=lambda k: chars[k])
                if len(self.plain(best).strip()) >= BODY_CHARS:
                    return best, tag
        for k in self.find("div", "section"):
            if self.attrs[k].get("role", "").lower() == "main":
                return k, "role=main"
        best, most = None, 0.0
        for k in self.find("div", "section", "td", "body"):
            if chars[k] < BODY_CHARS:
                continue
            n = len(self.plain(k).strip())
            share = links[k] / n if n else 1.0
            points = 0.0 if n < BODY_CHARS or share > BODY_LINKS else n * (1 - share) + PARAGRAPH_POINTS * paragraphs[k]
            if points > most:
                best, most = k, points
        if best is not None:
            return best, "density"
        top = self.first("body")
        return (0 if top is None else top), "whole"


class _Builder(HTMLParser):
    def __init__(self, tree: Tree):
        super().__init__(convert_charrefs=True)
        self.tree, self.open = tree, [0]

    def run(self, source: str) -> None:
        try:
            self.feed(source)
            self.close()
        except Exception:  # what was read so far is kept
            pass

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tree = self.tree
        ended = ENDS.get(tag) or (("p",) if tag in BLOCK else ())
        while len(self.open) > 1 and tree.tag[self.open[-1]] in ended:
            self.open.pop()
        k = tree.add(tag, {a.lower(): v or "" for a, v in attrs}, "", self.open[-1])
        if tag not in VOID:
            self.open.append(k)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tree.add(tag, {a.lower(): v or "" for a, v in attrs}, "", self.open[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            names = [self.tree.tag[k] for k in self.open[1:]]
            if tag in names:
                del self.open[len(names) - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if data:
            self.tree.add("", {}, data, self.open[-1])
