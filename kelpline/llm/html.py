"""Main text of web pages by wrappers: union-free expressions inferred from pages of one host."""

from __future__ import annotations

import html as entities
import json
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.shared import stage
from kelpline.llm.urls import host_and_path

SAMPLE = 12  # pages of a host, at most, that its wrapper is inferred from
LEAST = 3  # different pages that must agree before text counts as the template's own
DEPTH = 512  # elements that are nested deeper become siblings there, as in browsers
PERIOD = 4  # parts that repeat as a group, at most
NEARLY = 0.7  # of the text that isn't the template's is in the main element, at least
BROADCAST_BYTES = 32 << 20  # of sampled ids or of wrappers; beyond it they are joined by sort and merge
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "thead": {"table"}, "tbody": {"table"}, "p": {"td", "th", "li", "button", "table"}}
#: Open elements that an implied end doesn't reach beyond, and for each tag those that it ends.
HARD = BLOCKS - {"p", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead"} | {"button"}
CLOSERS = {t: tuple(a for a, by in CLOSED_BY.items() if t in by) for t in set().union(*CLOSED_BY.values())}
#: Elements that hold a page's own text: the template never takes one, nor what holds one or is in one.
OWN = set("article main p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote table figure figcaption".split())
#: Elements that never hold main text, and words of classes, ids and roles that say the same.
ASIDE = set("nav footer aside form script style noscript template iframe button select option input textarea head title svg canvas object video audio dialog menu map datalist search".split())
NOT_MAIN = re.compile(r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|advert(?:s|ising)?|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|ted)?s?|promoted|nav(?:bar|igation)?|menu|breadcrumbs?|footer|foot|masthead|topbar|toolbar|sidebar|side|aside|rail|widget|related|recommend(?:ed|ations)?|share|sharing|social|comments?|disqus|replies|reply|respond|discussion|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|pagination|pager|tags?|copyright|legal|disclaimer|skip|hidden|print-only|contentinfo|complementary|navigation)(?:$|[-_ ])", re.I)
MAIN = re.compile(r"(?:^|[-_ ])(?:article|content|main|post|entry|story|body|text)(?:$|[-_ ])", re.I)
#: In an article, a class says that a container isn't main text if all its parts are words of NOT_MAIN or of these.
CONTAINERS = set("div section ul ol dl table details center".split())
_FILLER = set("area bar block box button buttons card container content form group inner item items label link links list notification outer panel post posts row section slot story stories unit view widget wrap wrapper".split())
_PARTS = re.compile(r"[-_]+")
_ASIDE_ARTICLE = re.compile(r"(?:^| )(?:[a-z]+[-_]+)?(?:comments?|reply|replies|teasers?|related|recommended|recommendations?|promo|promoted|sponsored|advert|advertisement|ad)(?:$| |[-_]+(?:item|card|box|post|article|body|inner|list)(?:$| ))", re.I)
#: A tag reaches to its `>`; quotes count after `=` only, and only if they are closed. What begins and never ends reaches to the end. Each
#: part gives nothing back, so a page of any make is cut in time in proportion to its length.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its sign (tag, classes, id and role), its classes and role, its children in turn: nodes or strings, with entities
    decoded. Set by measure(): size of its text, what it holds, and fp, which is equal for equal elements. template: it is the
    template's own."""

    __slots__ = ("tag", "sign", "classes", "children", "hidden", "chars", "words", "holds_article", "holds_own", "fp", "template")

    def __init__(self, tag: str, sign: str, classes: str = "", hidden: bool = False):
        self.tag, self.sign, self.classes, self.hidden = tag, sign, classes, hidden
        self.children: list[Node | str] = []
        self.chars = self.words = self.fp = 0
        self.holds_article = self.holds_own = False
        self.template: int | None = None

    @property
    def length(self) -> int:
        """Of its text, with one space between words."""
        return self.chars + max(0, self.words - 1)


def _sign(tag: str, attributes: str) -> tuple[str, str, bool]:
    if not attributes or attributes.isspace():
        return tag, "", False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = " ".join(x for x in (found.get("class", ""), found.get("id", ""), found.get("role", "")) if x)
    classes = _SPACE.sub(" ", f"{found.get('class', '')} {found.get('role', '')}").strip()
    names = re.sub(r"\d+", "", names).strip()
    hidden = "hidden" in found or found.get("aria-hidden", "") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) is not None
    return (f"{tag}.{_SPACE.sub(' ', names)}" if names else tag), classes, hidden


def parse(page: str) -> Node:
    """The tree of a page, measured. End tags that are left out are put in where HTML implies them; stray ones are passed over; an unclosed
    element of text style ends with its block. A tag without end is left out with what follows it, as browsers do. Elements nested
    deeper than DEPTH become siblings at that depth, their text in place, and a block ends where such a sibling begins. Takes time in proportion to the page."""
    root = Node("#root", "")
    stack = [root]
    open_at: dict[str, list[int]] = {}
    hard, block_at = [0], [0]
    at, n = 0, len(page)

    def cut(k: int):
        for x in stack[k:]:
            open_at[x.tag].pop()
        del stack[k:]
        while hard[-1] >= k > 0:
            hard.pop()
        while block_at[-1] >= k > 0:
            block_at.pop()

    def put(child: Node | str):
        if len(stack) <= DEPTH:
            stack[-1].children.append(child)
            return
        holder, top = stack[DEPTH - 1], stack[-1]
        if not isinstance(child, str):
            holder.children.append(child)
        elif holder.children[-1] is top:
            top.children.append(child)
        else:  # text that follows what has become a sibling
            again = Node(top.tag, top.sign, top.classes, top.hidden)
            again.children.append(child)
            holder.children.append(again)
            stack[-1] = again

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(entities.unescape(page[at:]))
            break
        if m.start() > at:
            put(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            break
        tag = m[2].lower()
        if m[1]:
            k = open_at[tag][-1] if open_at.get(tag) else 0
            if k and (tag in BLOCKS or block_at[-1] < k):
                cut(k)
            continue
        for_tag = CLOSERS.get(tag, ())
        while k := max((open_at[x][-1] for x in for_tag if open_at.get(x)), default=0):
            if k < max([hard[-1], *(open_at[x][-1] for x in SCOPES.get(tag, ()) if open_at.get(x))]):
                break
            cut(k)
        node = Node(tag, *_sign(tag, m[3]))
        put(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if tag in ("title", "textarea"):
                node.children.append(entities.unescape(page[at : end.start() if end else n]))
            at = end.end() if end else n
            continue
        stack.append(node)
        k = len(stack) - 1
        open_at.setdefault(tag, []).append(k)
        if tag in BLOCKS:
            block_at.append(k)
        if tag in HARD:
            hard.append(k)
    return measure(root)


_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}


def _print(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))


def measure(root: Node) -> Node:
    """Sets what nodes know of what is below them."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        parts = [node.sign]
        node.holds_own = node.tag in OWN
        for c in node.children:
            if isinstance(c, str):
                words = c.split()
                if words:
                    node.chars += sum(map(len, words))
                    node.words += len(words)
                    parts.append(" ".join(words))
            else:
                node.chars += c.chars
                node.words += c.words
                node.holds_own |= c.holds_own
                node.holds_article |= c.holds_article or c.tag in ("article", "main")
                parts.append(f"\1{c.fp:x}")
        node.fp = _print(*parts)
    return root


def lcs(x: list, y: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places; None equals nothing. Exact at every size: rows of the table are bits of integers,
    and where the whole table would take over 64 MB, the first list is halved (Hirschberg)."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head] and x[head] is not None:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail] and x[-1 - tail] is not None:
        tail += 1
    ends = [(len(x) - tail + k, len(y) - tail + k) for k in range(tail)]
    starts = [(k, k) for k in range(head)]
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    return starts + [(i + head, j + head) for i, j in _lcs(x, y)] + ends


def _bits(x: list, y: list) -> list[int]:
    """For each start of x an integer: bit j is zero where the longest common subsequence with y grows at place j."""
    at: dict = {}
    for j, key in enumerate(y):
        if key is not None:
            at[key] = at.get(key, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, rows = full, [full]
    for key in x:
        u = v & at.get(key, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    return rows


def _lcs(x: list, y: list) -> list[tuple[int, int]]:
    if not x or not y:
        return []
    if len(x) * len(y) <= 1 << 29 or len(x) == 1:
        rows = _bits(x, y)
        i, j, out = len(x), len(y), []
        while i and j:
            if x[i - 1] == y[j - 1] and x[i - 1] is not None:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif rows[i] >> j - 1 & 1:
                j -= 1
            else:
                i -= 1
        return out[::-1]

    def upto(x, y):
        raw = np.frombuffer(_bits(x, y)[-1].to_bytes(-(-len(y) // 8), "little"), np.uint8)
        return np.concatenate([[0], np.cumsum(np.unpackbits(raw, bitorder="little")[: len(y)] == 0)])

    half = len(x) // 2
    k = int(np.argmax(upto(x[:half], y) + upto(x[half:][::-1], y[::-1])[::-1]))
    return _lcs(x[:half], y[:k]) + [(i + half, j + k) for i, j in _lcs(x[half:], y[k:])]


class Wrapper:
    """A union-free expression of an element: its sign; its parts in turn, each a wrapper of its own; and its quantity: one, optional (?),
    repeated (+) or both (*). The part `#text` is a literal if text is set, else a slot; `#group` is a run of parts that repeats. fp: of the
    element, while all in it is literal. seen: how many pages it was aligned with."""

    def __init__(self, sign: str, quantity: str = "", parts=(), text=None, seen: int = 1, fp: int | None = None):
        self.sign, self.quantity, self.parts, self.text, self.seen, self.fp = sign, quantity, list(parts), text, seen, fp

    @classmethod
    def of(cls, node: Node) -> Wrapper:
        """A page's tree: all of it is literal."""
        parts = []
        for c in node.children:
            if not isinstance(c, str):
                parts.append(cls.of(c))
            elif words := " ".join(c.split()):
                parts.append(cls("#text", text=words, fp=_print(words)))
        return cls(node.sign, parts=parts, fp=node.fp)

    @property
    def tag(self) -> str:
        return self.sign.partition(".")[0]

    def any(self, test) -> bool:
        """Whether it or something in it passes."""
        todo = [self]
        while todo:
            w = todo.pop()
            if test(w):
                return True
            todo += w.parts
        return False


def _wider(a: str, b: str) -> str:
    some = {a, b} - {""}
    return "" if not some else some.pop() if len(some) == 1 else "*"


def fold(parts: list[Wrapper]) -> list[Wrapper]:
    """Neighbours of one sign become one repeated part, and runs of up to PERIOD parts that follow each other again become a repeated
    group."""
    out: list[Wrapper] = []
    for p in parts:
        if out and out[-1].sign == p.sign:
            out[-1] = align(out[-1], p)
            out[-1].quantity = "" if p.sign == "#text" else _wider(out[-1].quantity, "+")
            continue
        out.append(p)
        for size in range(2, PERIOD + 1):
            if len(out) >= 2 * size and [w.sign for w in out[-size:]] == [w.sign for w in out[-2 * size : -size]]:
                run = [align(a, b) for a, b in zip(out[-2 * size : -size], out[-size:])]
                out[-2 * size :] = [Wrapper(f"#group {' '.join(w.sign for w in run)}", "+", run)]
                break
        # A group that goes on: its parts stand behind it once more.
        for size in range(2, PERIOD + 1):
            if len(out) > size and out[-size - 1].sign == f"#group {' '.join(w.sign for w in out[-size:])}":
                group = out[-size - 1]
                group.parts = [align(a, b) for a, b in zip(group.parts, out[-size:])]
                del out[-size:]
                break
    return out


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """One wrapper for both. What is the same in both, element by element, holds its place as a literal; between such places parts are
    folded and aligned by sign, each time by a longest common subsequence. Texts that differ become a slot; a part that only one side has
    becomes optional; one that repeats on a side becomes repeated."""
    quantity, seen = _wider(a.quantity, b.quantity), a.seen + b.seen
    if a.fp is not None and a.fp == b.fp:
        return Wrapper(a.sign, quantity, a.parts, a.text, seen, a.fp)
    if a.sign == "#text":
        return Wrapper("#text", quantity, seen=seen)
    for w in (a, b):
        if w.fp is not None:  # so far its parts were seen whenever it was
            for p in w.parts:
                p.seen = w.seen
    key = lambda p: p.fp if p.quantity == "" else None
    x, y = a.parts, b.parts
    parts: list[Wrapper] = []
    i = j = 0
    for p, q in [*lcs([*map(key, x)], [*map(key, y)]), (len(x), len(y))]:
        parts += _between(fold(x[i:p]), fold(y[j:q]))
        if p < len(x):
            parts.append(align(x[p], y[q]))
        i, j = p + 1, q + 1
    return Wrapper(a.sign, quantity, parts, seen=seen)


def _between(x: list[Wrapper], y: list[Wrapper]) -> list[Wrapper]:
    """Parts between two places that hold, aligned by sign."""
    parts: list[Wrapper] = []
    i = j = 0
    for p, q in [*lcs([w.sign for w in x], [w.sign for w in y]), (len(x), len(y))]:
        for part in [*x[i:p], *y[j:q]]:
            part.quantity = _wider(part.quantity, "?")
            parts.append(part)
        if p < len(x):
            parts.append(align(x[p], y[q]))
        i, j = p + 1, q + 1
    return parts


def expression(w: Wrapper) -> str:
    """A wrapper as text."""
    if w.sign == "#text":
        return ("#" if w.text is None else json.dumps(w.text, ensure_ascii=False)) + w.quantity
    inner = " ".join(map(expression, w.parts))
    if w.sign.startswith("#group "):
        return f"({inner}){w.quantity}"
    return f"<{w.sign}>{'(' + inner + ')' if inner else ''}{w.quantity}"


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of pages of one host. Equal pages count once."""
    whole, known = None, set()
    for page in pages:
        root = parse(page)
        if root.fp not in known:
            known.add(root.fp)
            one = Wrapper.of(root)
            whole = one if whole is None else align(whole, one)
    return whole


def skeleton(w: Wrapper, within: bool = False) -> list:
    """Where the template's own blocks stand: of the parts that are on all pages in one place, the literals (as fp), and those that have
    such (as [sign, skeleton]), in turn. None if pages are too few.

    Literals have text, are blocks, and hold no article. In an article only what isn't of the kinds that articles are made of (OWN)
    is taken, and only where its sign stands alone."""
    out: list = []
    if w.seen < LEAST:
        return out
    if w.fp is not None:  # so far its parts were seen whenever it was
        for p in w.parts:
            p.seen = w.seen
    within = within or w.tag in ("article", "main")
    signs = [p.sign for p in w.parts]
    for p in w.parts:
        if p.sign.startswith("#") or p.quantity or p.seen != w.seen or p.tag == "head":
            continue
        if p.fp is not None and not p.any(lambda x: x.tag in ("article", "main", "body")):
            own = within and (signs.count(p.sign) > 1 or p.any(lambda x: x.tag in OWN))
            if p.tag in BLOCKS and not own and p.any(lambda x: x.sign == "#text"):
                out.append(p.fp)
        elif sub := skeleton(p, within):
            out.append([p.sign, sub])
    return out


def mark(root: Node, found: list, skip: frozenset[int] = frozenset()) -> list[int]:
    """Marks the nodes of a page that are the template's own, each with the number of its literal in the skeleton, but those of `skip`.
    Returns the numbers of literals that aren't on the page."""
    missing: list[int] = []
    number = 0

    def miss(items: list):
        nonlocal number
        for x in items:
            if isinstance(x, list):
                miss(x[1])
            else:
                missing.append(number)
                number += 1

    def go(node: Node, items: list):
        nonlocal number
        children = [c for c in node.children if not isinstance(c, str)]
        held = lcs([None if isinstance(x, list) else x for x in items], [c.fp for c in children])
        i = j = 0
        for p, q in [*held, (len(items), len(children))]:
            part, there = items[i:p], children[j:q]
            here = dict(lcs([x[0] if isinstance(x, list) else None for x in part], [c.sign for c in there]))
            for k, x in enumerate(part):
                if k in here:
                    go(there[here[k]], x[1])
                else:
                    miss([x])
            if p < len(items):
                if number not in skip:
                    children[q].template = number
                number += 1
            i, j = p + 1, q + 1

    go(root, found)
    return missing


def _aside_article(node: Node) -> bool:
    """Whether an article is a comment or a teaser."""
    return node.tag == "article" and _ASIDE_ARTICLE.search(node.classes) is not None


def _named_aside(names: str) -> bool:
    """Whether a class or role as a whole says that its element isn't main text."""
    for name in names.split():
        parts = [x for x in _PARTS.split(name.lower()) if x]
        if any(NOT_MAIN.search(x) for x in parts) and all(x in _FILLER or x.isdigit() or NOT_MAIN.search(x) for x in parts):
            return True
    return False


def _excluded(node: Node, within_main: bool, article: bool = False) -> bool:
    """Whether an element holds no main text. article: inside an article, ids don't count, and classes only of containers."""
    tag, names = node.tag, node.sign.partition(".")[2]
    if tag in ASIDE:
        return True
    if tag == "header":
        return not within_main
    if article:
        return tag in CONTAINERS and bool(node.classes) and _named_aside(node.classes)
    return bool(names) and NOT_MAIN.search(names) is not None and not (tag in ("body", "html", "main", "article") or MAIN.search(names) and not re.search(r"comment|sidebar|footer|(?:^|[-_ ])ads?(?:$|[-_ ])", names, re.I))


def _main_node(root: Node, marked: bool = False) -> tuple[Node, bool]:
    """Where the main text is, and whether it is in several: the only `article` or `main`, of several the smallest element that holds
    them all (comments and teasers, marked by class or role, don't count). Else, where a template is known, the smallest element around
    NEARLY all text that isn't its own, with the headings beside it; where none is, the element with the most paragraph text of its
    own, else the whole page."""
    best, most = root, 0
    inside: list[list[Node]] = []

    def walk(node: Node, above: list[Node]):
        above.append(node)
        for c in node.children:
            if isinstance(c, str) or c.hidden or _excluded(c, False) or _aside_article(c):
                continue
            if c.tag in ("article", "main"):
                if c.words:
                    inside.append([*above, c])
            elif c.holds_article:
                walk(c, above)
        above.pop()

    def weigh(node: Node):
        nonlocal best, most
        own = 0
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
                continue
            if c.hidden or _excluded(c, False) or c.template is not None:
                continue
            weigh(c)
            if c.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "ul", "ol", "table", "figure", "dl"):
                own += c.length
        if own > most:
            best, most = node, own

    walk(root, [])
    if inside:
        shared = [level[0] for level in zip(*inside) if all(x is level[0] for x in level)]
        return shared[-1], len(inside) > 1
    if marked:
        return _around_slots(root), False
    weigh(root)
    return best, False


def _around_slots(root: Node) -> Node:
    left: dict[int, int] = {}
    out = lambda c: isinstance(c, str) or c.hidden or c.template is not None or _excluded(c, False)
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not out(c)]
    for node in reversed(order):
        left[id(node)] = sum(len(c.strip()) if isinstance(c, str) else left.get(id(c), 0) for c in node.children)
    node = root
    while True:
        inner = [c for c in node.children if id(c) in left]
        held = max(inner, key=lambda c: left[id(c)], default=None)
        # A block of text itself isn't gone into, nor one that would leave a heading outside.
        if held is None or left[id(held)] < NEARLY * left[id(root)] or not any(x.tag in BLOCKS and left.get(id(x)) for x in held.children if not isinstance(x, str)):
            return node
        if any(c.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for c in inner):
            return node
        node = held


def blocks(root: Node, used: set[int] | None = None, marked: bool = False) -> list[str]:
    """The main text's blocks. Nodes that mark() marked (then marked is set) are left out, but an article keeps what articles are made of;
    the numbers of those left out are added to used."""
    out: list[str] = []
    run: list[str] = []
    main, several = _main_node(root, marked)

    def flush():
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    in_main = main.tag in ("article", "main")

    def walk(node: Node, inside: bool, own: bool = False, article: bool = False):
        # A main element around articles has more than main text.
        article = article or node.tag == "article" or node.tag == "main" and not node.holds_article
        inside = inside or node is main
        own = own or node is not main and node.tag in OWN
        for c in node.children:
            if isinstance(c, str):
                if inside:
                    run.append(c)
                continue
            if c.tag in ("br", "wbr", "hr", "img"):
                if inside and c.tag != "wbr":
                    run.append(" ")
                if inside and c.tag == "hr":
                    flush()
                continue
            # A header beside several articles is the site's.
            if c.hidden or _excluded(c, inside and (article or in_main or not several), article) or _aside_article(c):
                continue
            if c.template is not None and not ((article or in_main) and (own or c.holds_own)):
                if inside or not (in_main or several):
                    flush()
                    if used is not None:
                        used.add(c.template)
                continue
            block = c.tag in BLOCKS
            if block and inside:
                flush()
            walk(c, inside, own, article)
            if block and (inside or c is main):
                flush()

    walk(root, main is root)
    flush()
    return out


def main_text(page: str, found: list | None = None, skip: frozenset[int] = frozenset(), used: set[int] | None = None, missing: list[int] | None = None) -> str:
    """The main text of a page, with its host's skeleton if there is one. Where a page without article is mostly the template's own text,
    as on mirrors of one page, what stands on all pages is no sign of a template: then the page is taken by itself."""
    root = parse(page)
    if not found:
        return "\n\n".join(blocks(root))
    gone = mark(root, found, skip)
    if missing is not None:
        missing += gone
    mine: set[int] = set()
    text = "\n\n".join(blocks(root, mine, len(gone) < _literals(found)))
    if mine and not root.holds_article:
        whole = "\n\n".join(blocks(parse(page)))
        if 2 * len(text) < len(whole):
            text = whole
    if used is not None:
        used |= mine
    return text


def _literals(found: list) -> int:
    return sum(_literals(x[1]) if isinstance(x, list) else 1 for x in found)


def _infer(table: pa.Table) -> pa.Table:
    order = sorted(range(table.num_rows), key=lambda i: table["page_id"][i].as_py() or 0)
    pages = [p for i in order if (p := table["html"][i].as_py())]
    wrapper = infer(pages) if pages else Wrapper("")
    return pa.table({"host": pa.array([table["host"][0].as_py()], pa.string()), "wrapper": pa.array([expression(wrapper)]), "skeleton": pa.array([json.dumps(skeleton(wrapper))]), "pages": pa.array([len(pages)], pa.int32())})


def _checked(small: DataFrame, rows: int, size: int) -> DataFrame:
    """A side of a join whose size is known: sent to all if it is small, else joined by sort and merge."""
    return F.broadcast(small) if rows * size <= BROADCAST_BYTES else small.hint("merge")


def wrappers(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, …). Returns (host, wrapper, skeleton, pages): for each host the expression inferred from SAMPLE of its
    pages at most, those whose ids' hashes come first in as many classes, and where in it the template's own blocks stand (JSON).
    The sample is chosen by a minimum for each class, combined before the shuffle. Whether a host's other pages agree: extract()."""
    host, _ = host_and_path()
    rows = pages.select("page_id", host.alias("host"))
    order = F.struct(F.xxhash64("page_id", F.lit(1)).alias("h"), "page_id")
    some = rows.where("page_id is not null").groupBy("host", F.pmod(F.xxhash64("page_id"), F.lit(SAMPLE)).alias("c")).agg(F.min(order).alias("m")).select(F.col("m.page_id").alias("page_id")).distinct()
    some = stage(some, "sample")
    found = pages.select("page_id", host.alias("host"), "html").join(_checked(some, some.count(), 16), "page_id").dropDuplicates(["host", "page_id"])
    return found.groupBy("host").applyInArrow(_infer, "host string, wrapper string, skeleton string, pages int")


def _extract(batches):
    """Columns page_id, url, host, html, skeleton, skip."""
    for batch in batches:
        skeletons: dict = {}
        texts, odd = [], []
        for page, found, skip in zip(batch.column(3), batch.column(4), batch.column(5)):
            page, found = page.as_py() or "", found.as_py()
            if found not in skeletons:
                skeletons[found] = json.loads(found) if found else []
            used, missing = set(), []
            texts.append(main_text(page, skeletons[found], frozenset(skip.as_py() or ()), used, missing))
            odd.append((sorted(used), missing if page else []))
        of = lambda k: pa.array([x[k] for x in odd], pa.list_(pa.int32()))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), of(0), of(1)], ["page_id", "url", "host", "text", "n_chars", "used", "missing"])


_TEXTS = "page_id long, url string, host string, text string, n_chars long, used array<int>, missing array<int>"


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id long, url, html, …). Returns (page_id, url, text, n_chars), a row for each row of pages: the main text of the whole
    html, its blocks joined by empty lines.

    Each page is aligned with its host's wrapper: blocks that stand in one place with one text on all pages of the host, however many,
    are the template's own; what varies is in slots. Main text is what of the slots is in the page's article, or, without one, in the
    element that holds most of their text; menus, headers, footers, sidebars, adverts, forms and comments that vary are known by
    their tags, classes, ids and roles, and so is everything on hosts with fewer than LEAST different pages.

    Pages are read once with what the sample shows. Where some page of a host lacks a block that others left out, the block isn't the
    template's own: pages of such hosts are read again without it. Null and empty html give the empty text; null urls and urls without
    host share one; pages without page_id aren't sampled; repeated rows give repeated rows; pages may be of any length and nested to any depth
    (see parse()); an empty table gives an empty result; other columns aren't looked at."""
    host, _ = host_and_path()
    none = F.lit(None).cast("array<int>")
    found = stage(wrappers(pages).where("skeleton <> '[]'").select(F.col("host").alias("w_host"), "skeleton"), "skeletons")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("skeleton")), F.lit(0)).alias("most")).first()
    rows = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), "html")
    columns = ["page_id", "url", "text", "n_chars"]
    joined = rows.join(_checked(found, size.n, size.most + 100), F.col("host") == F.col("w_host"), "left").select("page_id", "url", "host", "html", "skeleton", none.alias("skip"))
    if not size.n:
        return rows.select("*", F.lit(None).cast("string").alias("skeleton"), none.alias("skip")).mapInArrow(_extract, _TEXTS).select(columns)
    texts = stage(joined.mapInArrow(_extract, _TEXTS), "texts")
    told = lambda c: texts.where(F.size(c) > 0).select("host", F.explode(c).alias("k")).distinct()
    odd = told("used").join(told("missing"), ["host", "k"]).groupBy("host").agg(F.collect_list("k").alias("skip"))  # as long as a skeleton
    odd = stage(odd.join(found, F.col("host") == F.col("w_host")).select("w_host", "skeleton", "skip"), "odd")
    n = odd.count()
    if not n:
        return texts.select(columns)
    side = _checked(odd, n, size.most + 400)
    again = rows.join(side, F.col("host") == F.col("w_host")).select("page_id", "url", "host", "html", "skeleton", "skip").mapInArrow(_extract, _TEXTS)
    rest = texts.join(_checked(odd.select("w_host"), n, 100), F.col("host") == F.col("w_host"), "left_anti")
    return rest.select(columns).unionByName(again.select(columns))
