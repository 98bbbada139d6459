"""A small tree of a page, its text and CSS selectors."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "[document] html article aside blockquote body br button canvas caption col colgroup dd div dl dt embed fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li map object ol output p pre progress section table tbody textarea tfoot thead tr ul video".split()
)
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p ul ol pre blockquote".split())
#: An opening tag of the key closes the open elements of these names, up to the nearest of the stops.
CLOSES = {
    "p": ({"p"}, {"div", "article", "section", "td", "li", "blockquote", "body"}),
    "li": ({"li", "p"}, {"ul", "ol"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
}


class Element:
    """A tag with its attributes; children are elements and strings."""

    __slots__ = ("_classes", "attrs", "before", "children", "last", "name", "parent", "place")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.name, self.attrs, self.parent, self.children = name, attrs or {}, parent, []
        #: The element before among its siblings, the number among them from 1, and the last element below.
        self.before: Element | None = parent.last if parent else None
        self.place: int = self.before.place + 1 if self.before else 1
        self.last: Element | None = None
        self._classes: list[str] | None = None
        if parent:
            parent.last = self
            parent.children.append(self)

    @property
    def classes(self) -> list[str]:
        if self._classes is None:
            self._classes = self.attrs["class"].split() if "class" in self.attrs else []
        return self._classes

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def nodes(self) -> Iterator[tuple[Element, Element | str]]:
        """(parent, node) of all that lies below, in document order."""
        stack = [(self, c) for c in reversed(self.children)]
        while stack:
            parent, n = stack.pop()
            yield parent, n
            if isinstance(n, Element):
                stack += [(n, c) for c in reversed(n.children)]

    def text(self) -> str:
        return "".join(n for _, n in self.nodes() if isinstance(n, str)).strip()

    def inner_html(self) -> str:
        out: list[str] = []
        stack: list[Element | str | tuple[str]] = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, tuple):
                out.append(n[0])
            elif isinstance(n, str):
                out.append(escape(n, quote=False))
            else:
                out.append(f"<{n.name}{''.join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())}>")
                if n.name not in VOID:
                    stack.append((f"</{n.name}>",))
                    stack += reversed(n.children)
        return "".join(out)

    def outer_html(self) -> str:
        holder = Element("[document]")
        holder.children = [self]
        return holder.inner_html()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("[document]")
        self.open = [self.root]
        #: For each name, where it stands among the open elements, outermost first.
        self.places: dict[str, list[int]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.add(tag, {k: v or "" for k, v in reversed(attrs)})

    def add(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            closed = [p for n in names if (p := self.places.get(n))]
            if closed:
                stop = max((p[-1] for n in stops if (p := self.places.get(n))), default=0)
                above = [p[i] for p in closed if (i := bisect_right(p, stop)) < len(p)]
                if above:
                    self.close_from(min(above))
        e = Element(tag, attrs, self.open[-1])
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(e)

    def close_from(self, i: int) -> None:
        for e in self.open[i:]:
            self.places[e.name].pop()
        del self.open[i:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_from(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.places.get(tag):
            self.close_from(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def unknown_decl(self, data: str) -> None:
        if data.upper().startswith("CDATA["):
            self.open[-1].children.append(data[6:])


# Elements whose content is no markup, or not wholly.
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
#: Text, or a tag in the plain form that most are written in: without references in its attributes.
_PLAIN = re.compile(r"""([^<]+)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[\t\n\r\f ]+[a-zA-Z][a-zA-Z0-9_-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^\s"'<>&`=][^\s"'<>&`]*(?<!/)))?)*)>""")
#: Attributes of tags that a task remembers: pages repeat their tags.
REMEMBERED = 8192
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")


@lru_cache(REMEMBERED)
def _attributes(written: str) -> dict[str, str]:
    # Of attributes named twice the first counts.
    return {k.lower(): v or w or x for k, v, w, x in reversed(_ATTRIBUTE.findall(written))}


def _plain_tree(html: str) -> Element | None:
    """The tree of a page of plain tags and text alone, in one pass of an expression; None if it holds anything else."""
    b, at = _Builder(), 0
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        said, end, name, attrs = m.groups()
        if said is not None:
            b.open[-1].children.append(unescape(said) if "&" in said else said)
            continue
        name = name.lower()
        if name in RAW or (end and attrs):
            return None
        if end:
            if b.places.get(name):
                b.close_from(b.places[name][-1])
        else:
            b.add(name, _attributes(attrs).copy() if attrs else {})
    return b.root if at == len(html) else None


def parse(html: str | None) -> Element:
    """The tree of a page; damaged or cut pages give what can be read of them."""
    html = (html or "").replace("\0", "")
    if (plain := _plain_tree(html)) is not None:
        return plain
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


Test = Callable[[Element], bool]
_TOKEN = re.compile(r"""\s*([>+~,])\s*|(\s+)|([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)(\()?""")


class SelectorError(ValueError):
    pass


def _closing(s: str, at: int) -> int:
    depth = 1
    for i in range(at, len(s)):
        depth += (s[i] == "(") - (s[i] == ")")
        if not depth:
            return i
    raise SelectorError(f"unclosed parenthesis: {s}")


def _attribute(name: str, op: str | None, value: str) -> Test:
    ops = {None: lambda a: True, "=": lambda a: value in a.split() if name == "class" and " " not in value else a == value, "*=": lambda a: value in a, "^=": lambda a: a.startswith(value), "$=": lambda a: a.endswith(value), "~=": lambda a: value in a.split(), "|=": lambda a: a == value or a.startswith(value + "-")}
    check = ops[op] if not (op == "=" and name == "class") else (lambda a: a == value)
    return lambda e: name in e.attrs and check(e.attrs[name])


def _nth(argument: str) -> Callable[[int], bool]:
    m = re.fullmatch(r"\s*(odd|even|([+-]?\d*)n\s*([+-]\s*\d+)?|\d+)\s*", argument)
    if not m:
        raise SelectorError(f"bad position: {argument}")
    if m[1] in ("odd", "even"):
        return lambda i: i % 2 == (m[1] == "odd")
    if m[1].isdigit():
        return lambda i: i == int(m[1])
    a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
    b = int((m[3] or "0").replace(" ", ""))
    return lambda i: i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _pseudo(name: str, argument: str) -> Test:
    if name == "nth-child":
        at = _nth(argument)
        return lambda e: at(e.place)
    if name == "first-child":
        return lambda e: e.place == 1
    if name == "last-child":
        return lambda e: e.parent is None or e.parent.last is e
    if name in ("not", "is"):
        inner = compiled(argument)
        return lambda e: inner(e) is (name == "is")
    if name == "has":
        direct = argument.strip().startswith(">")
        inner = compiled(argument.strip().lstrip(">"))
        return lambda e: any(inner(x) for x in (e.children if direct else e.walk()) if isinstance(x, Element))
    if name in ("contains", "-soup-contains"):
        text = argument.strip().strip("\"'")
        return lambda e: text in e.text()
    raise SelectorError(f"unknown selector: {name}")


_COMPILED: dict[str, Test] = {}
#: For each selector what its matches have: names and classes (with a dot), or None where some need neither.
_KEYS: dict[str, frozenset[str] | None] = {}


def compiled(selector: str) -> Test:
    """Whether an element matches: tag, *, #id, .class, [attribute], lists, descendants, >, +, ~, :nth-child, :not, :has, :is, :contains."""
    if selector in _COMPILED:
        return _COMPILED[selector]
    s, at = selector.strip(), 0
    lists: list[list[tuple[str, list[Test]]]] = [[("", [])]]
    keys: list[str] = [""]
    if not s:
        raise SelectorError("empty selector")
    while at < len(s):
        m = _TOKEN.match(s, at)
        if not m or m.end() == at:
            raise SelectorError(f"bad selector: {selector}")
        at = m.end()
        mark, space, tag, id_, cls, attr, op, v1, v2, v3, pseudo, paren = m.groups()
        tests = lists[-1][-1][1]
        if mark == ",":
            lists.append([("", [])])
            keys.append("")
        elif mark or space:
            lists[-1].append((mark or " ", []))
            keys[-1] = ""
        elif tag:
            keys[-1] = keys[-1] or (tag.lower() if tag != "*" else "")
            tests.append((lambda t: lambda e: t in ("*", e.name))(tag.lower()))
        elif id_:
            tests.append((lambda v: lambda e: e.attrs.get("id") == v)(id_))
        elif cls:
            keys[-1] = f".{cls}"
            tests.append((lambda v: lambda e: v in e.classes)(cls))
        elif attr:
            tests.append(_attribute(attr.lower(), op, v1 or v2 or v3 or ""))
        else:
            argument = ""
            if paren:
                end = _closing(s, at)
                argument, at = s[at:end], end + 1
            tests.append(_pseudo(pseudo, argument))
    if any(not tests for chain in lists for _, tests in chain):
        raise SelectorError(f"bad selector: {selector}")

    def chain_matches(e: Element, chain: list[tuple[str, list[Test]]], i: int) -> bool:
        for t in chain[i][1]:
            if not t(e):
                return False
        how = chain[i][0]
        if i == 0:
            return True
        if how == ">":
            return e.parent is not None and chain_matches(e.parent, chain, i - 1)
        if how in "+~":
            before = e.before
            while before is not None and not chain_matches(before, chain, i - 1):
                before = before.before if how == "~" else None
            return before is not None
        up = e.parent
        while up is not None:
            if chain_matches(up, chain, i - 1):
                return True
            up = up.parent
        return False

    _KEYS[selector] = frozenset(keys) if all(keys) else None
    if len(lists) == 1:
        only = lists[0]
        _COMPILED[selector] = lambda e: chain_matches(e, only, len(only) - 1)
    else:
        _COMPILED[selector] = lambda e: any(chain_matches(e, c, len(c) - 1) for c in lists)
    return _COMPILED[selector]


class Selectors:
    """Several selectors that are looked for in one walk; an element is tried on those alone whose name or class it has."""

    #: Kinds of elements (name and classes) whose selectors are remembered.
    KINDS = 4096

    def __init__(self, selectors: Iterable[str]):
        self.tests = {s: compiled(s) for s in dict.fromkeys(selectors)}
        self.kinds: dict[tuple[str, str | None], list[tuple[str, Test]]] = {}

    def _of_kind(self, e: Element) -> list[tuple[str, Test]]:
        has = {e.name, *(f".{c}" for c in e.classes)}
        if len(self.kinds) >= self.KINDS:
            self.kinds.clear()
        found = self.kinds[e.name, e.attrs.get("class")] = [(s, test) for s, test in self.tests.items() if _KEYS[s] is None or not has.isdisjoint(_KEYS[s])]
        return found

    def every(self, root: Element) -> dict[str, list[Element]]:
        """All matches of each selector below ``root``, in document order; selectors without any are left out."""
        found: dict[str, list[Element]] = {}
        kinds = self.kinds
        for e in root.walk():
            tests = kinds.get((e.name, e.attrs.get("class")))
            for s, test in self._of_kind(e) if tests is None else tests:
                if test(e):
                    found.setdefault(s, []).append(e)
        return found


def select(root: Element, selector: str) -> list[Element]:
    test = compiled(selector)
    return [e for e in root.walk() if test(e)]


def select_one(root: Element, selector: str) -> Element | None:
    test = compiled(selector)
    return next((e for e in root.walk() if test(e)), None)


HIDDEN = ("script", "style", "template", "noscript")


def display_text(element: Element) -> str:
    """Text with a browser's white space.

    Every edge of an element asks for a break before the next text: a space between neighbouring
    inline elements, a new line at a block, an empty line at a block of content; the strongest that
    was asked for is written. Text under ``pre`` stays as it is.
    """
    out: list[str] = []
    wanted = 0  # 0 nothing, 1 space, 2 line, 3 empty line
    breaks = ("", " ", "\n", "\n\n")
    stack: list[tuple[Element | str, bool, bool]] = [(element, True, False)]
    while stack:
        node, entering, verbatim = stack.pop()
        if isinstance(node, str):
            text = node.strip("\n") if verbatim else re.sub(r"\s+", " ", node)
            if text.strip():
                if not verbatim:
                    wanted = max(wanted, text[0] == " ")
                out += [breaks[wanted] if out else "", text if verbatim else text.strip()]
                wanted = int(not verbatim and text[-1] == " ")
            elif text:
                wanted = max(wanted, 1)
            continue
        strength = 3 if node.name in CONTENT or node.name == "hr" else 2 if node.name in BLOCK else 0
        if node.name == "li":
            strength = 2
        wanted = max(wanted, strength)
        if entering and node.name not in HIDDEN:
            inside = verbatim or node.name == "pre"
            stack.append((node, False, verbatim))
            stack += [(c, True, inside) for c in reversed(node.children)]
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()
