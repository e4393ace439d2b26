"""Main text of web pages through wrappers inferred per host.

A page is a stream of tags and texts, read as nested elements.  Its first
wrapper is the page itself with runs of equal neighbours folded into repeated
groups.  Wrappers of pages from one host are aligned, token by token among the
children of matching elements: equal texts stay, differing texts become slots,
elements that only one side has become optional, and runs of different length
a repeated group.  The result is a union-free regular expression over tags and
texts, without alternatives.  Wrappers merge like pages do, so wrappers are
merged within each batch of pages, then in groups of bounded size per host until
one is left; what is moved are wrappers, never pages, and equal wrappers are moved
once.  Pages may nest as deep as they like.

The wrapper says where the article is: in the ``article`` and ``main`` elements
that stand in no furniture, unless the host's pages hold more than twice as much
slot text beside them; else, and on pages without such an element, in the
innermost elements that hold all of the host's slot text.  Menus,
headers, footers, sidebars, notices, adverts, forms and comments are known by
element, role, class or id; a class or id alone marks nothing that holds more of
the host's text than the rest.  Texts that are the same at their place on every one of several different
pages and stand in no paragraph or heading are furniture of the template too,
inside the article as well.  Text that differs but stands beside the article
elements of a host whose rule they are is left out.

Defined results: null html is empty, and a page without text gives an empty
text; a null or odd url is a host of its own name ("" if there is none), and a
host of one page has that page as its wrapper; repeated rows give equal rows;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import TEXT_ROWS, batch_rows, grouped_batches, map_batches, parked

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements without article text, if their own end tag closes them; left open, they would swallow what follows.
SKIPPED = frozenset("noscript template svg select optgroup option datalist button object canvas".split())
BLOCK = frozenset(("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tr td th tbody thead tfoot caption section article main "
                   "figure figcaption address hr body html header footer nav aside form details summary center fieldset").split())
INLINE_BREAK = frozenset(["br"])
CLOSES = {"p": frozenset(("p div h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table section article main figure header footer nav aside form "
                          "address hr fieldset details").split()),
          "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
          "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]),
          "button": frozenset(["button"])}
SCOPES = frozenset("ul ol dl table tr tbody thead tfoot div section article main nav aside body header footer form blockquote td".split())
SCOPED_ENDS = frozenset("p li b i a span em strong u small font".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
LISTS = frozenset("ul ol dl table".split())
#: Elements, roles and name parts of what is not the article.
FURNITURE = frozenset("nav footer aside form script style head iframe textarea dialog menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE_WORDS = frozenset(("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer foot masthead topbar toolbar banner ad ads advert "
                             "adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert "
                             "popup modal overlay legal copyright newsletter subscribe subscription signup login share sharing social related recommended comment comments "
                             "reply replies respond disqus discussion pagination pager widget skip hidden").split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
# every attribute in turn, quoted values consumed, so that names inside values are not seen
_ATTR = re.compile(r"([^\s=\"'>/][^\s=\"'>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?|\"[^\"]*\"|'[^']*'")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Words before a name part that make it tell of something else (``has-sidebar``, ``no-comments``).
STATES = frozenset("no not has have with without is hide".split())


class Node:
    """``furniture`` by element, role or attribute is certain; ``named`` by class or id is a
    hint that the host's wrapper may overrule.  Both, and ``article``, are part of the label."""
    __slots__ = ("name", "label", "kids", "furniture", "named", "article", "header", "path")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.kids, self.path = name, [], 0
        found: dict[str, str] = {}
        for m in _ATTR.finditer(attrs) if attrs else ():
            if m[1]:
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = [entities.unescape(found.get("class", "")).split(), entities.unescape(found.get("id", "")).split()]
        parts = [[w.lower() for w in _PART.findall(t)] for ts in names for t in ts]
        self.article = name in ("article", "main") or found.get("role", "").lower() == "main" or "articleBody" in found.get("itemprop", "").split()
        self.furniture = (name in FURNITURE or found.get("role", "").lower() in FURNITURE_ROLES
                          or "hidden" in found or found.get("aria-hidden", "").lower() == "true")
        self.named = name not in ("html", "body") and not self.article and any(
            w in FURNITURE_WORDS and not (i and p[i - 1] in STATES) for p in parts for i, w in enumerate(p))
        self.header = name == "header" or any(w == "header" and not (i and p[i - 1] in STATES) for p in parts for i, w in enumerate(p))
        stable = [*sorted(names[0]), *("#" + w for w in names[1])]
        self.label = name + "".join("." + w for w in stable if not any(c.isdigit() for c in w)) + "".join(
            mark for mark, holds in ((".@off", self.furniture), (".@named", self.named), (".@article", self.article)) if holds)

    def closed(self) -> None:
        """The element's own end tag was met."""
        self.furniture = True
        self.label += ".@off"


_LABELS: dict[str, int] = {}


def below(path: int, label: str) -> int:
    """The path of an element, a number: of its parent's path and its label."""
    n = _LABELS.get(label)
    if n is None:
        if len(_LABELS) > 100_000:
            _LABELS.clear()
        n = _LABELS[label] = int.from_bytes(blake2b(label.encode("utf-8", "replace"), digest_size=8).digest(), "big")
    return (path * 0x9E3779B97F4A7C15 + n + 1) % (1 << 63)


def placed(node: Node, kept: frozenset[int], path: int = 0) -> Node:
    """Paths for all elements; what is furniture by its name alone is so unless its path is in ``kept``."""
    todo = [(node, path)]
    while todo:
        n, n.path = todo.pop()
        for k in n.kids:
            if not isinstance(k, str):
                at = below(n.path, k.label)
                k.furniture = k.furniture or (k.named and at not in kept)
                todo.append((k, at))
    return node


class Open:
    """The open elements of a page, and where among them those of a name, the scopes and those
    that other elements close stand, so that no tag looks through all of them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.named: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.closable: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.named.setdefault(node.name, []).append(at)
        if node.name in SCOPES:
            self.scopes.append(at)
        if node.name in CLOSES:
            self.closable.append(at)

    def cut(self, at: int) -> None:
        """Close the elements from ``at`` on."""
        while len(self.nodes) > at:
            self.named[self.nodes.pop().name].pop()
        for places in (self.scopes, self.closable):
            while places and places[-1] >= at:
                places.pop()

    def last(self, name: str) -> int:
        """The place of the innermost open element of that name, 0 if none; inline ones in the innermost scope only."""
        places = self.named.get(name)
        at = places[-1] if places else 0
        return 0 if name in SCOPED_ENDS and self.scopes and at < self.scopes[-1] else at

    def closed_by(self, name: str) -> int:
        """The place of the innermost open element, from the innermost scope on, that a start tag of that name closes; 0 if none."""
        scope = self.scopes[-1] if self.scopes else 0
        for at in reversed(self.closable):
            if at < scope:
                break
            if name in CLOSES[self.nodes[at].name]:
                return at
        return 0


def parse(html: str | None) -> Node:
    """Elements of a page; ends that are left out are supplied, odd ones ignored."""
    root = Node("#root")
    open_ = Open(root)
    text = html or ""
    at, end = 0, len(text)
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:       # cannot happen: the last choices match any character
            break
        at = m.end()
        piece, name = m[0], m[2]
        if name is None:
            if piece.startswith("<!") or piece.startswith("<?"):
                continue
            kids = open_.nodes[-1].kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += piece
            else:
                kids.append(piece)
            continue
        name = name.lower()
        if m[1]:
            k = open_.last(name)
            if k:
                if name in SKIPPED:
                    open_.nodes[k].closed()
                open_.cut(k)
            continue
        k = open_.closed_by(name)
        if k:
            open_.cut(k)
        node = Node(name, m[3])
        open_.nodes[-1].kids.append(node)
        if name in RAW:
            close = None if m[3].rstrip().endswith("/") and name not in ("script", "style") else \
                re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(text, at)
            # without an end tag only code runs to the end of the page
            at = close.end() if close else end if name in ("script", "style") else at
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            open_.push(node)
    todo = [root]
    while todo:
        n = todo.pop()
        if n.header and not n.article and not _holds_heading(n):
            if n.name == "header":
                n.closed()
            elif n.name not in ("html", "body") and not n.named:
                n.named = True
                n.label += ".@named"
        todo += [k for k in n.kids if not isinstance(k, str)]
    return root


def squeezed(text: str) -> str:
    return " ".join(entities.unescape(text).split())


# ---- wrappers: ["label", kids], ["#", checksums or None, characters], ["+", kids]; as items [node, optional] ----
# Repeated neighbours of one page (``within``) unite their texts' checksums; a text is a slot
# (None) where pages differ in them.

# No function calls itself, as pages nest as deep as they like; between tasks a wrapper is a flat
# list of its nodes (``flat``), as nested text has limits.

def wrapper(node: Node) -> list:
    """The wrapper of one page's element: text as its checksum, repeated neighbours folded."""
    open_: list[tuple[Node, Iterator, list]] = [(node, iter(node.kids), [])]
    while True:
        n, rest, kids = open_[-1]
        for k in rest:
            if isinstance(k, str):
                t = squeezed(k)
                if t:
                    kids.append([["#", [crc32(t.encode("utf-8", "replace"))], len(t)], 0])
            elif k.name not in RAW and k.name not in VOID and k.name != "head":
                open_.append((k, iter(k.kids), []))
                break
        else:
            open_.pop()
            made = [n.label, folded(kids)]
            if not open_:
                return made
            open_[-1][2].append([made, 0])


def flat(w: list) -> list:
    """The nodes of a wrapper in page order: [label, optional, number of children] and ["#", optional, checksums, characters]."""
    out, todo = [], [[w, 0]]
    while todo:
        n, optional = todo.pop()
        if n[0] == "#":
            out.append(["#", optional, n[1], n[2]])
        else:
            out.append([n[0], optional, len(n[1])])
            todo += reversed(n[1])
    return out


def unflat(nodes: list) -> list:
    """The wrapper of its nodes."""
    top: list = []
    open_ = [(top, 1)]
    for t in nodes:
        while open_[-1][1] == len(open_[-1][0]):
            open_.pop()
        if t[0] == "#":
            open_[-1][0].append([["#", t[2], t[3]], t[1]])
        else:
            kids: list = []
            open_[-1][0].append([[t[0], kids], t[1]])
            open_.append((kids, t[2]))
    return top[0][0]


def written(w: list) -> str:
    return json.dumps(flat(w), separators=(",", ":"))


def read(text: str) -> list:
    return unflat(json.loads(text))


def key(item: list) -> str:
    node = item[0]
    return node[0] if node[0] != "+" else "+" + "|".join(key(k) for k in node[1])


def folded(items: list, longest: int = 3) -> list:
    """Repeats of up to ``longest`` neighbours become one repeated group of merged items."""
    out: list = []
    for item in items:
        out.append(item)
        for n in range(1, longest + 1):
            if len(out) >= n + 1 and out[-n - 1][0][0] == "+" and len(out[-n - 1][0][1]) == n and \
                    [key(k) for k in out[-n - 1][0][1]] == [key(k) for k in out[-n:]]:
                group = out[-n - 1][0]
                group[1] = [merged_item(a, b, True) for a, b in zip(group[1], out[-n:])]
                del out[-n:]
                break
            if len(out) >= 2 * n and [key(k) for k in out[-2 * n:-n]] == [key(k) for k in out[-n:]] and \
                    not all(k[0][0] == "#" for k in out[-n:]) and not any(k[0][0] == "+" for k in out[-n:]):
                group = [merged_item(a, b, True) for a, b in zip(out[-2 * n:-n], out[-n:])]
                out[-2 * n:] = [[["+", group], 0]]
                break
    return out


def merged_item(a: list, b: list, within: bool = False) -> list:
    return [merged(a[0], b[0], within), a[1] | b[1]]


def merged(a: list, b: list, within: bool = False) -> list:
    """One wrapper for what both match; their keys are equal."""
    made, todo = _both(a, b, within)
    while todo:
        x, y, into = todo.pop()
        for pair in paired(x, y):
            if len(pair) == 1:
                into.append([pair[0][0], 1])
                continue
            (one, two), group = pair[:2], None
            if key(one) != key(two):        # a repeated group and a single element of it
                group, single = (one, two) if key(one).startswith("+") else (two, one)
                node, more = _both(group[0][1][0][0], single[0], within)
                node = ["+", [[node, group[0][1][0][1]]]]
            else:
                node, more = _both(one[0], two[0], within)
            into.append([node, one[1] | two[1]])
            todo += more
    return made


def _both(a: list, b: list, within: bool) -> tuple[list, list]:
    """What two nodes of one key make, and (children, children, where theirs go) that are still to be paired."""
    if a[0] == "#":
        same = sorted({*a[1], *b[1]}) if within and a[1] and b[1] else a[1] if a[1] == b[1] else None
        return ["#", same, a[2] + b[2]], []
    kids: list = []
    return [a[0], kids], [(a[1], b[1], kids)]


def paired(a: list, b: list) -> Iterator[tuple]:
    """Children side by side: matches in pairs, the rest alone.  A single element matches a
    repeated group of it."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        yield from zip(a, b)
        return
    head = 0
    while head < min(len(a), len(b)) and ka[head] == kb[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    yield from zip(a[:head], b[:head])
    yield from _middle(a[head:len(a) - tail], b[head:len(b) - tail])
    if tail:
        yield from zip(a[-tail:], b[-tail:])


def _same(x: list, y: list) -> bool:
    kx, ky = key(x), key(y)
    return kx == ky or kx == "+" + ky or ky == "+" + kx


def _middle(a: list, b: list) -> list[tuple]:
    """Longest common subsequence by the items' keys; what has no partner stands alone."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if _same(x, y) else max(last[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and _same(a[i - 1], b[j - 1]) and rows[i][j] == rows[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and (not j or rows[i - 1][j] >= rows[i][j - 1]):
            i -= 1
            out.append((a[i],))
        else:
            j -= 1
            out.append((b[j],))
    return out[::-1]


def expression(w: list) -> str:
    """The wrapper, or the list of its nodes, as a regular expression over tags and texts, for people."""
    out, todo = [], [[unflat(w) if isinstance(w[0], list) else w, 0]]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        n, end = x[0], ")?" if x[1] else ""
        begin = "(" if x[1] else ""
        if n[0] == "#":
            out.append(begin + ("#TEXT" if n[1] is None or len(n[1]) > 1 else "text") + end)
            continue
        first, last = ("(", ")+") if n[0] == "+" else (f"<{n[0]}>", f"</{n[0].split('.')[0]}>")
        out.append(begin + first)
        todo.append(last + end)
        for i, k in enumerate(reversed(n[1])):
            todo += [" ", k] if i else [k]
    return "".join(out)


def kids_of(w: list, varies: bool) -> Iterator[tuple[list, bool]]:
    """Children with those of repeated groups; with whether they are not on every page."""
    for k, optional in w[1]:
        if k[0] == "+":
            yield from kids_of(k, varies or bool(optional))
        else:
            yield k, varies or bool(optional)


def marked(label: str) -> bool:
    """Furniture by element, role or attribute."""
    return label.split(".")[0] in FURNITURE or ".@off" in label


def weigh(w: list, slots: bool, kept: frozenset[int] | None, path: int = 0, varies: bool = False) -> int:
    """Characters of texts that differ between pages (``slots``) or of all texts, outside furniture;
    elements that are furniture by name alone count where ``kept`` has their path, or is None."""
    return weights(w, slots, kept, path, varies)[id(w)]


def weights(w: list, slots: bool, kept: frozenset[int] | None, path: int = 0, varies: bool = False) -> dict[int, int]:
    """What ``weigh`` counts below each element that is no furniture, by its identity."""
    found, parent, total = [(w, path, varies)], [-1], [0]
    for i, (n, at, v) in enumerate(found):      # grows as it goes
        for k, kv in kids_of(n, v):
            if k[0] == "#":
                total[i] += k[2] if not slots or kv or k[1] is None else 0
            elif not marked(k[0]):
                p = below(at, k[0])
                if ".@named" not in k[0] or kept is None or p in kept:
                    found.append((k, p, kv))
                    parent.append(i)
                    total.append(0)
    for i in range(len(found) - 1, 0, -1):
        total[parent[i]] += total[i]
    return {id(n): t for (n, _, _), t in zip(found, total)}


def named_elements(w: list, slots: bool, kept: frozenset[int]) -> dict[int, int]:
    """Weights of the outermost elements that are furniture by name alone, by path."""
    out: dict[int, int] = {}
    todo = [(w, 0, False)]
    while todo:
        n, path, varies = todo.pop()
        for k, v in kids_of(n, varies):
            if k[0] != "#" and not marked(k[0]):
                at = below(path, k[0])
                if ".@named" in k[0] and at not in kept:
                    out[at] = out.get(at, 0) + weigh(k, slots, None, at, v)
                else:
                    todo.append((k, at, v))
    return out


def hint_weight(w: list, slots: bool, kept: frozenset[int]) -> int:
    """What ``weigh`` counts in article elements."""
    total, todo = 0, [(w, 0, False)]
    while todo:
        n, path, varies = todo.pop()
        for k, v in kids_of(n, varies):
            at = below(path, k[0])
            if k[0] != "#" and not marked(k[0]) and (".@named" not in k[0] or at in kept):
                if ".@article" in k[0]:
                    total += weigh(k, slots, kept, at, v)
                else:
                    todo.append((k, at, v))
    return total


def content_by_weight(w: list, slots: bool) -> frozenset[int]:
    """Paths of elements that are no furniture in spite of their names: as long as one of them
    holds more of the host's text than is left outside all of them, it holds the article.  Beside
    article elements it must hold twice as much."""
    kept: frozenset[int] = frozenset()
    inside = _below_articles(w)
    while True:
        named, hints = named_elements(w, slots, kept), hint_weight(w, slots, kept)
        fair = {p: n if not hints or p in inside else n / 2 for p, n in named.items()}
        most = max(fair, key=lambda p: (fair[p], p), default=None)
        if most is None or fair[most] <= weigh(w, slots, kept):
            return kept
        kept |= {most}


def _below_articles(w: list) -> set[int]:
    """Paths of article elements and of all elements in them."""
    out, todo = set(), [(w, 0, False)]
    while todo:
        n, path, inside = todo.pop()
        for k, _ in kids_of(n, False):
            if k[0] != "#":
                at, here = below(path, k[0]), inside or ".@article" in k[0]
                if here:
                    out.add(at)
                todo.append((k, at, here))
    return out


def region(w: list, pages: int, kept: frozenset[int]) -> list[str]:
    """Labels from the root to the innermost elements that hold all of the host's slot text outside
    furniture; all elements with these labels belong to it.  No label, and so the whole page, where
    there are too few pages to tell slots from the template."""
    path: list[str] = []
    here, at, told = [(w, False)], 0, told_by_slots(w, pages)
    weight = weights(w, True, kept) if told else {}
    while told:
        total = sum(weight[id(n)] for n, _ in here)
        by_label: dict[str, list] = {}
        for n, varies in here:
            for k, v in kids_of(n, varies):
                if k[0].split(".")[0] in BLOCK - PROSE - LISTS and not marked(k[0]) and (".@named" not in k[0] or below(at, k[0]) in kept):
                    by_label.setdefault(k[0], []).append((k, v))
        label = next((x for x, ns in by_label.items() if total and sum(weight[id(n)] for n, _ in ns) == total), None)
        if label is None:
            return path
        path.append(label)
        here, at = by_label[label], below(at, label)
    return path


def hinted(w: list, pages: int, kept: frozenset[int]) -> bool:
    """Whether article elements are the region of the pages that hold them: not where more than
    twice as much slot text outside furniture stands beside them as in them."""
    slots = told_by_slots(w, pages)
    return not slots or weigh(w, True, kept) <= 3 * hint_weight(w, True, kept)


def told_by_slots(w: list, pages: int) -> bool:
    """Whether there are pages enough to tell the article by the texts that differ."""
    return pages >= 3 and weigh(w, True, None) > 0


def spot(path: int, checksum: int) -> int:
    """A text at its place."""
    return below(path, f"#{checksum}")


def constants(w: list) -> set[int]:
    """Texts, with their places, that every page holds unchanged and that stand in no paragraph or heading."""
    out: set[int] = set()
    todo = [(w, 0, False)]
    while todo:
        n, path, inside = todo.pop()
        for k, varies in kids_of(n, False):
            if varies:
                continue
            if k[0] != "#":
                todo.append((k, below(path, k[0]), inside or k[0].split(".")[0] in PROSE))
            elif k[1] is not None and not inside:
                out |= {spot(path, c) for c in k[1]}
    return out


# ---- extraction ----

def blocks(node: Node, furniture_texts: frozenset[int], top: bool = True) -> list[str]:
    """Texts of the block elements below ``node`` in page order, without furniture."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        t = squeezed("".join(line))
        if t:
            out.append(t)
        line.clear()

    open_ = [(node, iter(node.kids), node.name in PROSE, False)]
    while open_:
        n, rest, prose, block = open_[-1]
        for k in rest:
            if isinstance(k, str):
                if furniture_texts and not prose and spot(n.path, crc32(squeezed(k).encode("utf-8", "replace"))) in furniture_texts:
                    continue
                line.append(k)
            elif k.name in INLINE_BREAK:
                line.append(" ")
            elif k.furniture or k.name in RAW:
                if k.name in BLOCK:
                    end()
            else:
                if k.name in BLOCK:
                    end()
                open_.append((k, iter(k.kids), prose or k.name in PROSE, k.name in BLOCK))
                break
        else:
            open_.pop()
            if block:
                end()
    end()
    return out


def _holds_heading(header: Node) -> bool:
    """A header counts as text only where it holds the heading of an article and no menu."""
    return any(not isinstance(k, str) and k.name in ("h1", "h2") for k in header.kids) and not any(
        not isinstance(k, str) and (k.name in ("nav", "ul") or k.furniture or k.named) for k in header.kids)


def articles(node: Node) -> list[Node]:
    """Outermost article elements that stand in no furniture."""
    out: list[Node] = []
    todo = [k for k in reversed(node.kids) if not isinstance(k, str)]
    while todo:
        k = todo.pop()
        if k.furniture:
            continue
        if k.article:
            out.append(k)
        else:
            todo += [x for x in reversed(k.kids) if not isinstance(x, str)]
    return out


def find_regions(root: Node, path: list[str]) -> list[Node]:
    """All elements below ``root`` that the labels lead to."""
    nodes = [root]
    for label in path:
        nodes = [k for n in nodes for k in n.kids if not isinstance(k, str) and k.label == label]
    return nodes


def main_text(html: str | None, path: list[str] | None, furniture_texts: frozenset[int], kept: frozenset[int] = frozenset(), hints: bool = True) -> str:
    """The text of a page by its host's rule: the region's labels, the template's texts, elements
    that are no furniture in spite of their names, and whether article elements are the region."""
    root = placed(parse(html), kept)
    found = (articles(root) if hints else []) or find_regions(root, path or []) or [root]
    return "\n\n".join(b for node in found for b in blocks(node, furniture_texts))


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower().rstrip(".") if m else ""


def merge_all(wrappers: Iterator[str]) -> str:
    """One wrapper for all (texts in JSON), in sorted order, so that the result is repeatable."""
    total = None
    for w in sorted(set(wrappers)):
        w = read(w)
        total = w if total is None else merged(total, w)
    return written(total)


def text_digest(root: Node) -> int:
    """Of the page's text as it is extracted, to tell copies from different pages."""
    return int.from_bytes(blake2b("\n".join(blocks(root, frozenset())).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def infer(pages: DataFrame, html_col: str = "html", url_col: str = "url", fan_in: int = 32, digests: int = 8) -> DataFrame:
    """(host, wrapper, n_pages, n_texts): wrappers as the JSON of their nodes, one per host.  ``n_texts`` counts
    different page texts; it is exact up to ``digests``, where it stops.

    Wrappers are merged within each batch of pages, then in groups of about ``fan_in`` of one host, again and
    again until each host has one, so a group does not grow with the host's pages.
    """
    def few(found) -> list[int]:
        return sorted(set(found))[:digests]

    def first(b: pa.RecordBatch) -> list:
        by_host: dict[str, list[tuple[str, int]]] = {}
        for h, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            root = parse(h)
            by_host.setdefault(host_of(u), []).append((written(wrapper(root)), text_digest(root)))
        return [pa.array(list(by_host), pa.string()), pa.array([merge_all(w for w, _ in v) for v in by_host.values()], pa.string()),
                pa.array([len(v) for v in by_host.values()], pa.int64()), pa.array([few(d for _, d in v) for v in by_host.values()], pa.list_(pa.int64()))]

    kind = "host string, wrapper string, n long, texts array<long>"
    part = map_batches(pages.select(F.col(html_col).cast("string"), F.col(url_col).cast("string")), kind, first)
    part = part.groupBy("host", "wrapper", "texts").agg(F.sum("n").alias("n")).select("host", "wrapper", "n", "texts")

    def again(df: DataFrame, *keys: str) -> DataFrame:
        number = F.xxhash64(*keys).alias("g")

        def run(batches):
            for t in grouped_batches(batches, 1, 2000):
                by_host: dict[str, list] = {}
                for host, w, n, d in zip(*[t.column(c).to_pylist() for c in ("host", "wrapper", "n", "texts")]):
                    by_host.setdefault(host, []).append((w, n, d))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(by_host), pa.string()), pa.array([merge_all(w for w, _, _ in v) for v in by_host.values()], pa.string()),
                     pa.array([sum(n for _, n, _ in v) for v in by_host.values()], pa.int64()),
                     pa.array([few(x for _, _, d in v for x in d) for v in by_host.values()], pa.list_(pa.int64()))], names=["host", "wrapper", "n", "texts"])

        batch_rows(df.sparkSession, TEXT_ROWS)
        return (df.select(number, "host", "wrapper", "n", "texts").repartition("g").sortWithinPartitions("g")
                .mapInArrow(run, kind))

    turn = 0
    while True:
        part = parked(part, f"wrappers-{turn}")
        parts = part.groupBy("host").agg(F.count("*").alias("parts"))
        if (parts.agg(F.max("parts")).first()[0] or 0) <= 1:
            return part.select("host", "wrapper", F.col("n").alias("n_pages"), F.size("texts").cast("long").alias("n_texts"))
        groups = F.ceil(F.col("parts") / fan_in)
        salted = part.join(parts, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper", "texts", F.lit(turn)), groups))
        part = again(salted, "host", "salt")
        turn += 1


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", constant_pages: int = 5) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A text counts as furniture of the template when all pages of the host hold it
    unchanged and their texts are ``constant_pages`` or more different ones.
    """
    def spec(b: pa.RecordBatch) -> list:
        paths, same, kept, hints = [], [], [], []
        for w, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            w = read(w)
            same.append(sorted(constants(w)) if n >= constant_pages else [])
            content = content_by_weight(w, told_by_slots(w, n))
            kept.append(sorted(content))
            paths.append(region(w, n, content))
            hints.append(hinted(w, n, content))
        return [b.column(0), pa.array(paths, pa.list_(pa.string())), pa.array(same, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int64())),
                pa.array(hints, pa.bool_())]

    rules = parked(map_batches(infer(pages, html_col, url_col, digests=max(8, constant_pages)).select("host", "wrapper", "n_texts"), "host string, path array<string>, same array<long>, kept array<long>, hints boolean", spec), "regions")
    url = F.col(url_col).cast("string")
    # the same rule as host_of
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.+$", ""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    joined = rows.join(rules, "host", "left").select("page_id", "url", "html", "path", "same", "kept", "hints")

    def run(b: pa.RecordBatch) -> list:
        texts = [main_text(h, p, frozenset(s or ()), frozenset(k or ()), a is not False)
                 for h, p, s, k, a in zip(*[b.column(i).to_pylist() for i in (2, 3, 4, 5, 6)])]
        return [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_batches(joined, "page_id long, url string, text string, n_chars long", run)
