"""Text blocks of HTML bodies, with the tag-class path of the element that holds each."""

from __future__ import annotations

import html as _html
import re
from urllib.parse import urlsplit

# Tags that do not interrupt a text block, hidden tags, void tags, and tags that only structure prose.
INLINE = frozenset("a b strong em i span code sup sub small time abbr u mark img".split())
HIDDEN = frozenset("script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote figure figcaption table caption tbody thead tfoot tr td th dl dt dd pre".split())
CLOSES_P = LEAF - frozenset("li figcaption caption tbody thead tfoot tr td th dt dd".split()) | frozenset("div section article aside header footer nav main form hr".split())
CLOSED_BY = {"li": frozenset({"li"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"td", "th", "tr"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}

_TAG = re.compile(r"<(/?[a-zA-Z][^>\"]*+(?:\"[^\"]*\"[^>\"]*+)*+)>")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BODY = re.compile(r"<body\b[^>]*>", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)
_SPACE = re.compile(r"[ \t\n]+")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_SIGN = {"class": ".", "id": "#", "role": "@"}


class _Tag:
    __slots__ = ("name", "close", "label", "kind")

    def __init__(self, raw: str):
        self.close = raw[0] == "/"
        body = raw[1:] if self.close else raw
        name = re.match(r"[a-zA-Z][\w:-]*", body)[0].lower()
        label = name
        if not self.close and len(body) > len(name):
            for k, a, b, c in _ATTR.findall(body):
                v = (a or b or c).split()
                if v:
                    label += _SIGN[k.lower()] + _DIGITS.sub("0", v[0])
        self.name, self.label = name, label
        self.kind = 0 if name in INLINE else 1 if name in HIDDEN else 2 if name in VOID else 3


_tags: dict[str, _Tag] = {}


def _tag(raw: str) -> _Tag:
    if raw.startswith(("a ", "A ")):  # addresses differ from link to link
        raw = "a"
    t = _tags.get(raw)
    if t is None:
        if len(_tags) > 50_000:
            _tags.clear()
        t = _tags[raw] = _Tag(raw)
    return t


def _one_space(s: str) -> str:
    return (_SPACE.sub(" ", s) if "\n" in s or "\t" in s or "  " in s else s).strip(" ")


def text_blocks(src: str) -> list[tuple[tuple[str, ...], str, bool]]:
    """(path of labels below body, text, holds a link) of each text block, in reading order.

    A block is the longest run of text interrupted by no tag but the inline ones. Text in script, style, noscript
    and template is left out; character references are resolved; space, tab and newline runs become one space.
    Unclosed p, li, td, tr are closed where HTML implies it. Never raises on broken markup.
    """
    if "<!--" in src:
        src = _COMMENT.sub("", src)
    m = _BODY.search(src)
    parts = _TAG.split(src[m.end() :] if m else src)
    out: list[tuple[tuple[str, ...], str, bool]] = []
    names: list[str] = []
    labels: list[str] = []
    buf: list[str] = [parts[0]]
    link = False
    hidden = ""
    for i in range(1, len(parts), 2):
        t = _tag(parts[i])
        after = parts[i + 1]
        if hidden:
            if t.close and t.name == hidden:
                hidden = ""
                buf.append(after)
            continue
        if t.kind == 0:
            if t.name == "a" and not t.close:
                link = True
            buf.append(after)
            continue
        s = "".join(buf)
        if s and not s.isspace():
            if "&" in s:
                s = _html.unescape(s)
            s = _one_space(s)
            if s:
                out.append((tuple(labels), s, link))
        link = False
        buf = []
        if t.close:
            if t.name in names:
                while names.pop() != t.name:
                    labels.pop()
                labels.pop()
        elif t.kind == 1:
            hidden = t.name
            continue
        elif t.kind == 3:
            by = CLOSED_BY.get(t.name)
            while names and ((by and names[-1] in by) or (names[-1] == "p" and t.name in CLOSES_P)):
                names.pop()
                labels.pop()
            if t.name not in ("body", "html"):
                names.append(t.name)
                labels.append(t.label)
        buf.append(after)
    s = "".join(buf)
    if s and not s.isspace():
        s = _one_space(_html.unescape(s))
        if s:
            out.append((tuple(labels), s, link))
    return out


_split: dict[tuple[str, ...], tuple[str, str, bool, bool]] = {}

# Tags of headings, and of blocks that recur by nature and so are no notices.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RECURRING = HEADINGS | frozenset("li td th caption figcaption dt dd".split())


def placed(path: tuple[str, ...]) -> tuple[str, str, bool, bool]:
    """(container path, remainder, heading, may be a notice): the remainder are the bare tags at the end that only
    structure prose.

    A table cell that holds other blocks is a container itself, as in pages laid out by a table; a cell that is all
    there is below a container may hold a notice."""
    got = _split.get(path)
    if got is None:
        k = len(path)
        while k and path[k - 1] in LEAF:
            if path[k - 1] in ("td", "th") and k < len(path):
                break
            k -= 1
        if len(_split) > 50_000:
            _split.clear()
        last = path[-1] if k < len(path) else ""
        got = _split[path] = (">".join(path[:k]), ">".join(path[k:]), last in HEADINGS, last not in RECURRING or len(path) - k == 1 and last in ("td", "th"))
    return got


def container_of(path: tuple[str, ...]) -> tuple[str, str]:
    """The first two of :func:`placed`."""
    return placed(path)[:2]


def title_of(src: str) -> str:
    m = _TITLE.search(src)
    return _SPACE.sub(" ", _html.unescape(m[1])).strip() if m else ""


def host_of(url: str | None) -> str:
    """Lower-case host without leading ``www.``; empty for null or unreadable addresses."""
    if not url:
        return ""
    try:
        return urlsplit(url.strip()).netloc.lower().rpartition("@")[2].partition(":")[0].removeprefix("www.")
    except ValueError:
        return ""


def slug_of(url: str | None) -> str:
    """Last segment of the address path, without a trailing record number."""
    if not url:
        return ""
    try:
        return re.sub(r"-?\d+$", "", urlsplit(url.strip()).path.rstrip("/").rpartition("/")[2].lower())
    except ValueError:
        return ""
