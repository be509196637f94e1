"""A small document tree with CSS selectors, for use inside vectorised stages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(/?)>|([^<]+|<)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements without content, with raw content, and those an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_STOPS = frozenset("table ul ol dl body html article section div main".split())


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def unwrap(self) -> None:
        p = self.parent
        if p is None:
            return
        at = next(i for i, c in enumerate(p.children) if c is self)
        for c in self.children:
            if isinstance(c, Node):
                c.parent = p
        p.children[at : at + 1] = self.children
        self.parent, self.children = None, []

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def replace(self, other: Node) -> None:
        p = self.parent
        if p is not None:
            p.children = [other if c is self else c for c in p.children]
            other.parent, self.parent = p, None

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def select(self, selector: str) -> list[Node]:
        """Descendants that match, in document order."""
        alternatives = _parse(selector)
        return [n for n in self.walk() if any(_matches(n, a, self) for a in alternatives)]

    def first(self, selector: str) -> Node | None:
        alternatives = _parse(selector)
        return next((n for n in self.walk() if any(_matches(n, a, self) for a in alternatives)), None)


def parse_html(source: str) -> Node:
    """The tree of a page or fragment. Unclosed paragraphs, items and cells end where they must; stray
    end tags are ignored; html, head and body are not invented."""
    root = Node("#document")
    at = root
    skip_to = 0
    for m in _TOKEN.finditer(source):
        if m.start() < skip_to:
            continue
        tag = m.group(2)
        if tag is None:
            raw = m.group(5)
            if raw is not None:
                at.append(entities.unescape(raw) if "&" in raw else raw)
            continue
        tag = tag.lower()
        if m.group(1):
            n = at
            while n is not root and n.tag != tag:
                n = n.parent
            if n is not root:
                at = n.parent
            elif tag == "p":
                at.append(Node("p"))
            continue
        if tag in _ENDS_P:
            n = at
            while n is not root and n.tag not in _STOPS and n.tag != "li" and n.tag != "td":
                if n.tag == "p":
                    at = n.parent
                    break
                n = n.parent
        for ended in _ENDS.get(tag, ()):
            n = at
            while n is not root and not (n.tag in _STOPS and not (tag in ("tbody", "tfoot") and n.tag == "tbody")):
                if n.tag == ended:
                    at = n.parent
                    break
                n = n.parent
        attrs = {}
        for k, a, b, c in _ATTR.findall(m.group(3)):
            value = a or b or c
            attrs.setdefault(k.lower(), entities.unescape(value) if "&" in value else value)
        node = Node(tag, attrs)
        at.append(node)
        if tag in VOID or m.group(4) or (m.group(3).endswith("/") and tag not in RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(source, m.end())
            body = source[m.end() : end.start() if end else len(source)]
            if body:
                node.append(entities.unescape(body) if tag in ("title", "textarea") else body)
            skip_to = end.end() if end else len(source)
            continue
        at = node
    return root


_PART = re.compile(r"(\*|[a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*([iI])?)?\s*\]|:not\(([^()]*)\)|:(scope)")


@lru_cache(4096)
def _compound(text: str) -> tuple:
    """Tests of a compound selector."""
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"selector not understood: {text}")
        tag, cls, ident, attr, op, v1, v2, v3, flag, negated, scope = m.groups()
        if tag and tag != "*":
            tests.append(("tag", tag.lower()))
        elif cls:
            tests.append(("class", cls))
        elif ident:
            tests.append(("id", ident))
        elif attr:
            value = next((x for x in (v1, v2, v3) if x is not None), "")
            tests.append(("attr", attr.lower(), op, value.lower() if flag else value, bool(flag)))
        elif negated is not None:
            tests.append(("not", _compound(negated.strip())))
        elif scope:
            tests.append(("scope",))
        at = m.end()
    return tuple(tests)


@lru_cache(4096)
def _parse(selector: str) -> tuple:
    """Alternatives, each a tuple of (combinator, tests) from the right."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        pieces = re.findall(r">|(?:\[[^\]]*\]|\([^)]*\)|[^\s>\[(])+", alternative.strip())
        steps, combinator = [], " "
        for p in pieces:
            if p == ">":
                combinator = ">"
            else:
                steps.append((combinator, _compound(p)))
                combinator = " "
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _test(n: Node, tests: tuple, scope: Node) -> bool:
    for t in tests:
        kind = t[0]
        if kind == "tag":
            ok = n.tag == t[1]
        elif kind == "class":
            ok = t[1] in n.attrs.get("class", "").split()
        elif kind == "id":
            ok = n.attrs.get("id") == t[1]
        elif kind == "not":
            ok = not _test(n, t[1], scope)
        elif kind == "scope":
            ok = n is scope
        else:
            _, name, op, want, fold = t
            have = n.attrs.get(name)
            if have is None:
                ok = False
            else:
                have = have.lower() if fold else have
                ok = op is None or (op == "=" and have == want) or (op == "*=" and want != "" and want in have) or (op == "^=" and want != "" and have.startswith(want)) or (op == "$=" and want != "" and have.endswith(want)) or (op == "~=" and want in have.split()) or (op == "|=" and (have == want or have.startswith(want + "-")))
        if not ok:
            return False
    return True


def _matches(n: Node, steps: tuple, scope: Node) -> bool:
    if not _test(n, steps[0][1], scope):
        return False
    return _up(n, steps, 0, scope)


def _up(n: Node, steps: tuple, i: int, scope: Node) -> bool:
    if i + 1 == len(steps):
        return True
    if steps[i][0] == ">":
        p = n.parent
        return p is not None and _test(p, steps[i + 1][1], scope) and _up(p, steps, i + 1, scope)
    return any(_test(p, steps[i + 1][1], scope) and _up(p, steps, i + 1, scope) for p in n.ancestors())
