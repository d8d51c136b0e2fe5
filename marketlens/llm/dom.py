"""Small trees of the block elements of a page, and their alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<more2>[^>]*+)>"
    r"|</?[a-zA-Z][^>]*+\Z|(?P<text><|[^<]++)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names and words of class, id and role, by use. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr img picture".split()
)
CLOSES = {  # an element that starts ends open elements of these names
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "body": ("head",),
}
BARRIERS = frozenset("ul ol table dl article section div body html main".split())
P_STAYS = INLINE | VOID | {"button", "label"}  # these may stand in a paragraph
LEFT_OUT = frozenset("head nav footer aside form button select menu dialog object audio video canvas datalist fieldset".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav menu nav navbar"
    " navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notification alert banner popup modal overlay"
    " newsletter subscribe signup share sharing social related recommended recommendations comment comments respond disqus"
    " discussion footer pagination pager widget toolbar login skip".split()
)
FRAMES = frozenset("html body main article".split())  # class and id words say nothing against these
#: Within an article only these containers can be named out, and only if their names say nothing else.
CONTAINERS = frozenset("div section ul ol dl table details".split())
NEUTRAL_WORDS = frozenset(
    "area bar block body box btn button buttons container content entry form group holder icons inline inner item items js link"
    " links list module outer panel post posts row section slot stories thread title unit wrap wrapper article articles"
    " bottom top left right the a id".split()
)
PAGE_HEAD_WORDS = frozenset("header masthead topbar".split())  # left out unless inside an article


class Node:
    __slots__ = ("label", "children", "text", "out", "article", "slot", "shape")

    def __init__(self, label: str, out: bool, article: bool):
        self.label, self.out, self.article = label, out, article
        self.children: list[Node] = []
        self.text: list[str] | None = None
        self.slot = -1
        self.shape = 0


def _attributes(more: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(more)}


def _left_out(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    return (
        attributes.get("role", "").lower() in LEFT_OUT_ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    )


def _named_out(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether class or id say that an element is no content."""
    if not attributes or tag in FRAMES:
        return False
    words = set(re.findall(r"[a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    if in_article:
        said = {w for w in words - NEUTRAL_WORDS if not w.isdigit()}
        return tag in CONTAINERS and bool(said) and said <= LEFT_OUT_WORDS
    return not LEFT_OUT_WORDS.isdisjoint(words) or not PAGE_HEAD_WORDS.isdisjoint(words)


def parse(html: str, names: bool = True) -> Node:
    """The tree of block elements; the text between them, with inline elements, are leaves '#text'.

    Without ``names``, classes and ids leave nothing out."""
    root = Node("#root", False, False)
    open_: list[tuple[str, Node]] = [("#root", root)]
    text: list[str] = []
    hidden_inline: list[str] = []  # inline elements that are left out, and elements inside them

    def flush() -> None:
        if text:
            words = unescape("".join(text)).split()
            text.clear()
            if words:
                parent = open_[-1][1]
                leaf = Node("#text", parent.out, parent.article)
                leaf.text = words
                parent.children.append(leaf)

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            if not hidden_inline:
                text.append(m["text"])
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, more = tag.lower(), m["more"] or m["more2"] or ""
        if m["end"] or m["end2"]:
            if hidden_inline:
                if tag in hidden_inline:
                    while hidden_inline.pop() != tag:
                        pass
                    continue
                if all(name != tag for name, _ in open_):
                    continue
                hidden_inline.clear()  # the end of a block ends what was left open in it
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    text.append(" ")
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    flush()
                    del open_[k:]
                    break
            continue
        closed = more.endswith("/")
        if tag in RAW:
            if not closed:
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(html, at)
                at = found.end() if found else end
            continue
        if hidden_inline and tag not in P_STAYS and open_[-1][0] == "p":
            hidden_inline.clear()
        if hidden_inline:
            if tag not in VOID and not closed:
                hidden_inline.append(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        attributes = _attributes(more) if more.strip(" /") else {}
        parent = open_[-1][1]
        if tag in INLINE:
            if attributes and not closed and (_left_out(tag, attributes, parent.article) or (names and _named_out(tag, attributes, parent.article))):
                hidden_inline.append(tag)
            continue
        flush()
        if tag not in P_STAYS and open_[-1][0] == "p":
            del open_[-1]
        for name in CLOSES.get(tag, ()):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
                if open_[k][0] in BARRIERS and name != "head":
                    break
        parent = open_[-1][1]
        out = parent.out or _left_out(tag, attributes, parent.article) or (names and _named_out(tag, attributes, parent.article))
        article = not out and (parent.article or tag == "article" or attributes.get("role", "").lower() == "article")
        node = Node(f"{tag}.{attributes.get('class', '')}" if attributes else tag, out, article)
        parent.children.append(node)
        if not closed:
            open_.append((tag, node))
    flush()
    return root


def leaves(node: Node) -> list[Node]:
    found, waiting = [], [node]
    while waiting:
        one = waiting.pop()
        if one.text is not None:
            found.append(one)
        waiting.extend(reversed(one.children))
    return found


def main_blocks(root: Node) -> list[Node]:
    """The text leaves of the articles, unless a main element (the whole page, if there is none) has more
    than twice their text: then these are teasers in it, and it has the text."""
    kept = [n for n in leaves(root) if not n.out]
    inside = [n for n in kept if n.article]
    mains, waiting = [], [root]
    while waiting:
        one = waiting.pop()
        if one.out:
            continue
        if one.label.split(".")[0] == "main":
            mains.append(one)
        else:
            waiting.extend(reversed(one.children))
    wider = [n for m in mains for n in leaves(m) if not n.out] or kept
    return inside if inside and 2 * _length(inside) >= _length(wider) else wider


def _length(blocks: list[Node]) -> int:
    return sum(len(w) for n in blocks for w in n.text)


def number(root: Node) -> None:
    """Gives every node its place in document order, the slot."""
    count, waiting = 0, [root]
    while waiting:
        one = waiting.pop()
        one.slot = count
        count += 1
        waiting.extend(reversed(one.children))


#: Deeper nodes get no slots; in longer lists of children (after equal ends) each takes the next one with its label.
DEEPEST = 200
LONGEST = 400


def _shapes(root: Node) -> None:
    """Equal shapes: the same labels in the same tree."""
    order, waiting = [], [root]
    while waiting:
        one = waiting.pop()
        order.append(one)
        waiting.extend(one.children)
    for one in reversed(order):
        one.shape = hash((one.label, *(c.shape for c in one.children)))


def align(page: Node, wrapper: Node) -> None:
    """Simple tree matching: the largest order-preserving matching of nodes with equal labels and
    matched parents. Matched nodes of the page take over the slots of the wrapper."""
    _shapes(page)
    if not wrapper.shape:
        _shapes(wrapper)
    if page.label == wrapper.label:
        _match(page, wrapper, {}, 0)


def _size(a: Node, b: Node, memory: dict, depth: int) -> int:
    """Number of matched nodes of two trees with equal roots, zero otherwise."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children or depth > DEEPEST:
        return 1
    key = (id(a), id(b))
    if key not in memory:
        left, right, same = _middle(a, b)
        inner = sum(_size(x, y, memory, depth + 1) for x, y in same)
        if left and right and max(len(left), len(right)) > LONGEST:
            inner += sum(_size(x, y, memory, depth + 1) for x, y in _in_order(left, right))
        elif left and right:
            inner += _table(left, right, memory, depth + 1)[-1][-1]
        memory[key] = 1 + inner
    return memory[key]


def _middle(a: Node, b: Node) -> tuple[list[Node], list[Node], list[tuple[Node, Node]]]:
    """Children between the equal shapes at both ends, and the pairs of these. Equal shapes at an end belong
    to some largest matching: no other partner matches more nodes of either."""
    left, right = a.children, b.children
    n = min(len(left), len(right))
    start = 0
    while start < n and left[start].shape == right[start].shape:
        start += 1
    end = 0
    while end < n - start and left[-1 - end].shape == right[-1 - end].shape:
        end += 1
    same = list(zip(left[:start], right[:start])) + list(zip(left[len(left) - end :], right[len(right) - end :]))
    return left[start : len(left) - end], right[start : len(right) - end], same


def _in_order(left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of equal labels: each node with the next one of its label that is left, if there is one."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(right):
        places.setdefault(y.label, []).append(j)
    at, pairs = 0, []
    for x in left:
        own = places.get(x.label, [])
        k = bisect_left(own, at)
        # A partner far ahead would use up all others before it: only as far as the lists are apart.
        if k < len(own) and own[k] - at <= max(LONGEST, abs(len(left) - len(right))):
            pairs.append((x, right[own[k]]))
            at = own[k] + 1
    return pairs


def _table(left: list[Node], right: list[Node], memory: dict, depth: int) -> list[list[int]]:
    rows = [[0] * (len(right) + 1)]
    for x in left:
        above, row = rows[-1], [0]
        for j, y in enumerate(right):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if x.label == y.label:
                both = above[j] + _size(x, y, memory, depth)
                if both > best:
                    best = both
            row.append(best)
        rows.append(row)
    return rows


def _match(a: Node, b: Node, memory: dict, depth: int) -> None:
    a.slot = b.slot
    if depth > DEEPEST:
        return
    left, right, same = _middle(a, b)
    for x, y in same:
        _match(x, y, memory, depth + 1)
    if not left or not right:
        return
    if max(len(left), len(right)) > LONGEST:
        for x, y in _in_order(left, right):
            _match(x, y, memory, depth + 1)
        return
    rows = _table(left, right, memory, depth + 1)
    i, j = len(left), len(right)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            _match(left[i], right[j], memory, depth + 1)
