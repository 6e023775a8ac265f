"""Small trees of web pages: reading html, simple tree matching, merging.

A page is read into boxes (sectioning elements and div) that hold runs of text blocks
(paragraphs, headings, list items, cells, bare text). Inline markup is no part of the tree.
Neighbours that are alike become one node, so the tree has the size of the page's layout and
not of its text. Boxes that menus, adverts, forms and the like are made of are named as such
by their element, role, class or id; their text is not kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Elements by what they are, and words of classes, ids and roles.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
MUTE = frozenset("svg math template select button label noscript audio video canvas object datalist head".split())
BOX = frozenset("html body div section article main header footer nav aside form fieldset dialog menu search".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre figure figcaption table caption thead tbody tfoot "
                 "tr td th address details summary hr center hgroup legend".split())
VOID = frozenset("br hr img input meta link source area base col embed track wbr".split())
SHORT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CHROME_TAGS = frozenset("nav footer aside fieldset dialog menu search".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu submenu sidebar aside complementary footer contentinfo banner ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login search share sharing social breadcrumb breadcrumbs "
    "pagination pager related recommended recommendations comment comments respond replies reply disqus widget widgets "
    "toolbar copyright masthead dialog skip".split())
MAIN_WORDS = frozenset("article articlebody content post entry story main".split())
NOT_BEFORE = frozenset("has with no without".split())
MAX_DEPTH = 64

MARKUP = re.compile(
    r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*(?:>|\Z)|(<)[A-Za-z]""",
    re.S)
HINT = re.compile(r"""(?i)(?:^|[\s/"'])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    label: str
    kids: list[Node] = field(default_factory=list)
    count: int = 1
    into: Node | None = None
    number: int = -1

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def final(self) -> Node:
        at = self
        while at.into is not None:
            at = at.into
        return at


def match(a: Node, b: Node, seen: dict | None = None) -> int:
    """Simple tree matching: the nodes of the largest ordered mapping that keeps parents."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    seen = {} if seen is None else seen
    key = (id(a), id(b))
    if key not in seen:
        seen[key] = 1 + _table(a, b, seen)[-1][-1]
    return seen[key]


def _table(a: Node, b: Node, seen: dict) -> list[list[int]]:
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b.kids):
            best_here = max(above[j + 1], row[j])
            if x.label == y.label:
                best_here = max(best_here, above[j] + match(x, y, seen))
            row[j + 1] = best_here
    return best


def merge(a: Node, b: Node, seen: dict | None = None) -> None:
    """``b`` becomes part of ``a`` by their matching; what has no counterpart is put in its place."""
    seen = {} if seen is None else seen
    b.into, a.count = a, a.count + b.count
    best, i, j, kids = _table(a, b, seen), len(a.kids), len(b.kids), []
    while i or j:
        x, y = a.kids[i - 1] if i else None, b.kids[j - 1] if j else None
        if x and y and x.label == y.label and best[i][j] == best[i - 1][j - 1] + match(x, y, seen):
            kids.append((x, y))
            i, j = i - 1, j - 1
        elif j and (not i or best[i][j] == best[i][j - 1]):
            kids.append((y, None))
            j -= 1
        else:
            kids.append((x, None))
            i -= 1
    for x, y in kids:
        if y is not None:
            merge(x, y, seen)
    a.kids = [x for x, _ in reversed(kids)]


def fold(a: Node) -> None:
    """Neighbours with one label and at least half their nodes in common become one."""
    kids: list[Node] = []
    for k in a.kids:
        fold(k)
        last = kids[-1] if kids else None
        if last is not None and last.label == k.label and 4 * match(last, k) >= last.size() + k.size():
            n = last.count
            merge(last, k)
            last.count = n
        else:
            kids.append(k)
    a.kids = kids


def preorder(root: Node, depth: int = 0):
    yield depth, root
    for k in root.kids:
        yield from preorder(k, depth + 1)


def write(root: Node) -> str:
    return "\n".join(f"{d} {n.count} {n.label}" for d, n in preorder(root))


def read(text: str) -> Node:
    path: list[Node] = []
    for line in text.split("\n"):
        depth, count, label = line.split(" ", 2)
        node = Node(label, count=int(count))
        del path[int(depth):]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def label_of(tag: str, attributes: str, in_main: bool) -> tuple[str, bool, bool]:
    """(label, is chrome, is the main part) of a box."""
    words, first = [], ""
    for m in HINT.finditer(attributes):
        value = unescape(m[2] or m[3] or m[4] or "")
        for token in value.split():
            own = [w.lower() for w in WORD.findall(token)]
            words += [w for k, w in enumerate(own) if not k or own[k - 1] not in NOT_BEFORE]
            first = first or "".join(own)
    chrome = next((w for w in words if w in CHROME_WORDS), "")
    if not chrome and not in_main and (tag == "header" or "header" in words):
        chrome = "header"
    if tag in ("html", "body", "main"):
        chrome = ""
    if tag == "form" and not chrome:
        return "form~", False, False  # some sites wrap the whole page in one
    if chrome or tag in CHROME_TAGS:
        return f"{tag}!{chrome or tag}", True, False
    if tag in ("article", "main") or any(w in MAIN_WORDS for w in words):
        return f"{tag}*{'' if tag in ('article', 'main') else first}", False, True
    return f"{tag}.{first}", False, False


class _Reader:
    def __init__(self) -> None:
        self.root = Node("page")
        self.stack: list[tuple[str, Node | None, bool]] = []
        self.box, self.run = self.root, None
        self.hidden = self.mute = self.main = self.depth = 0
        self.parts: list[str] = []
        self.linked, self.link = 0, False
        self.blocks: list[tuple[Node, int, str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not self.hidden:
            if self.run is None:
                self.run = Node("t")
                self.box.kids.append(self.run)
            self.blocks.append((self.run, min(self.linked, len(text)), text))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.mute and not self.hidden:
            raw = unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.link:
                self.linked += len(raw)

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            return self.text(" ")
        if tag == "a":
            self.link = True
        if tag in MUTE:
            self.stack.append((tag, None, True))
            self.mute += 1
        if tag not in BOX and tag not in FLOW:
            if tag in VOID or tag in MUTE or "=" not in attributes or not self.named(tag, attributes):
                return
        if self.mute and self.stack[-1][0] == "head" and tag != "html":
            self.pop_to(len(self.stack) - 1)
        if self.mute:
            return
        for closed in (SHORT.get(tag), {"p"}):
            self.close_short(closed or set())
        self.flush()
        if tag == "hr":
            return
        if tag in BOX or "=" in attributes and self.named(tag, attributes):
            label, chrome, main = label_of(tag, attributes, self.main > 0)
            if self.depth < MAX_DEPTH:
                node = Node(label)
                self.box.kids.append(node)
                self.stack.append((tag, node, chrome))
                self.box, self.run, self.depth = node, None, self.depth + 1
                self.hidden += chrome
                self.main += main
                return
        self.stack.append((tag, None, False))

    def named(self, tag: str, attributes: str) -> bool:
        return tag not in BOX and label_of(tag, attributes, True)[1]

    def close_short(self, tags: set[str]) -> None:
        """End what the next element ends without an end tag, inside the nearest box."""
        for k in range(len(self.stack) - 1, -1, -1):
            tag, node, _ = self.stack[k]
            if tag in tags:
                return self.pop_to(k)
            if tag in BOX or tag in ("ul", "ol", "dl", "table", "td", "th", "blockquote") and tags != {"p"}:
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag == "p" and not any(t == "p" for t, _, _ in self.stack):
            return self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                return self.pop_to(k)
            if self.stack[k][0] in BOX and tag not in BOX:
                return

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, node, flag = self.stack.pop()
            if node is None and flag:
                self.mute -= 1
                continue
            self.flush()
            if node is not None:
                self.hidden -= flag
                self.main -= not flag and "*" in node.label
                self.depth -= 1
                self.box = next((n for _, n, _ in reversed(self.stack) if n is not None), self.root)
                self.run = None
            self.link = False if tag in BOX else self.link


def parse(html: str) -> tuple[Node, list[tuple[int, int, str]]]:
    """The page's folded tree, and its blocks: number of their node in preorder, characters
    inside links, text. An unfinished tag ends the page; what is read until then counts."""
    r, at = _Reader(), 0
    ends: dict[str, re.Pattern] = {}
    while (m := MARKUP.search(html, at)) is not None:
        r.text(html[at : m.start()])
        at = m.end()
        if m[4]:
            at = len(html)
            break
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            r.close(tag)
        elif tag in RAW:
            end = ends.setdefault(tag, re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])")).search(html, at)
            at = end.start() if end else len(html)
        elif m[3].endswith("/") and tag in MUTE:
            continue
        else:
            r.open(tag, m[3])
    r.text(html[at:])
    r.pop_to(0)
    r.flush()
    fold(r.root)
    for n, (_, node) in enumerate(preorder(r.root)):
        node.number = n
    return r.root, [(node.final().number, linked, text) for node, linked, text in r.blocks]
