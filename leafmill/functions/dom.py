"""A tolerant HTML tree, CSS and XPath matching on it, and text extraction: the per-row helper of the DOM rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

from leafmill.functions.lists import IndexSpec
from leafmill.plans.rules import index_spec

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label li br mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
_HEAD = "#root"


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.elements()[::-1]

    def text(self) -> str:
        out, stack = [], self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += c.children[::-1]
        return "".join(out)

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def inner(self) -> str:
        return _written([(c, self.tag) for c in reversed(self.children)])

    def outer(self) -> str:
        return _written([(self, "")])


def _written(stack: list[tuple[Node | str, str | None]]) -> str:
    """Markup of nodes and texts, the last first, each with the tag that it stands in; no tag: the text is markup already."""
    out = []
    while stack:
        c, within = stack.pop()
        if isinstance(c, str):
            out.append(c if within in (None, "script", "style") else escape(c, quote=False))
            continue
        out.append(f"<{c.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items()) + ("/>" if c.tag in VOID else ">"))
        if c.tag not in VOID:
            stack.append((f"</{c.tag}>", None))
            stack += [(x, c.tag) for x in reversed(c.children)]
    return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node(_HEAD)

    def _close(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> bool:
        n = self.at
        while n.parent is not None and n.tag not in within:
            if n.tag in tags:
                self.at = n.parent
                return True
            n = n.parent
        return False

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close(("p",), ("td", "th", "li", "div", "article", "section", "table", "button"))
        if tag in _SAME:
            self._close((tag,) if tag not in ("td", "th", "dt", "dd") else ("td", "th", "dt", "dd"), _SAME[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close((tag,), ("article", "div", "section", "table") if tag in INLINE else ())

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except (AssertionError, ValueError):
        pass
    return b.root


# ---- CSS ----

_SIMPLE = re.compile(r"([*\w-]+)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)\s*(?:([~^$*|]?=)\s*[\"']?([^\]\"']*)[\"']?)?\]|:(first-child|last-child|nth-child\((\d+)\)|contains\([\"']?([^)\"']*)[\"']?\)|not\(([^)]*)\))")


@lru_cache(maxsize=2048)
def _compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector {text!r} is not supported")
        at = m.end()
        tag, id_, cls, attr, op, value, pseudo, nth, needle, negated = m.groups()
        if tag and tag != "*":
            tests.append(lambda n, t=tag.lower(): n.tag == t)
        elif id_:
            tests.append(lambda n, v=id_: n.attrs.get("id") == v)
        elif cls:
            tests.append(lambda n, v=cls: v in n.classes())
        elif attr:
            how = {None: lambda a, v: True, "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v), "*=": lambda a, v: v in a, "|=": lambda a, v: a == v or a.startswith(v + "-")}[op]
            tests.append(lambda n, k=attr, v=value, how=how: k in n.attrs and how(n.attrs[k], v))
        elif nth:
            tests.append(lambda n, k=int(nth): n.parent is not None and n.parent.elements()[k - 1 : k] == [n])
        elif needle is not None:
            tests.append(lambda n, v=needle: v in n.text())
        elif negated is not None:
            inner = _compound(negated)
            tests.append(lambda n, f=inner: not all(t(n) for t in f))
        elif pseudo:
            k = 0 if pseudo == "first-child" else -1
            tests.append(lambda n, k=k: n.parent is not None and n.parent.elements()[k] is n)
    return tests


@lru_cache(maxsize=2048)
def _selector(text: str) -> list[list[tuple[str, str]]]:
    """Comma-separated chains of (combinator, compound)."""
    out = []
    for one in re.split(r",(?![^\[(]*[\])])", text):
        parts, how = [], " "
        for p in re.findall(r"[>+~]|(?:[^\s>+~\[(]|\[[^\]]*\]|\([^)]*\))+", one):
            if p in ">+~":
                how = p
            else:
                parts.append((how, p))
                how = " "
        if parts:
            out.append(parts)
    return out


def _fits(n: Node, chain: list[tuple[str, str]]) -> bool:
    tests = _compound(chain[-1][1])
    if not all(t(n) for t in tests):
        return False
    if len(chain) == 1:
        return True
    how, rest = chain[-1][0], chain[:-1]
    if how == " ":
        up = n.parent
        while up is not None:
            if _fits(up, rest):
                return True
            up = up.parent
        return False
    if how == ">":
        return n.parent is not None and _fits(n.parent, rest)
    peers = n.parent.elements()
    before = peers[: peers.index(n)]
    return any(_fits(b, rest) for b in (before if how == "~" else before[-1:]))


def select(root: Node, selector: str) -> list[Node]:
    """Elements under root that match, in page order."""
    chains = _selector(selector)
    return [n for n in root.walk() if any(_fits(n, c) for c in chains)]


def taken(items: list, spec: IndexSpec) -> list:
    n = len(items)
    if spec.kind == "indices":
        return [items[i] for i in spec.values if -n <= i < n]
    if spec.kind == "range":
        return items[spec.start or 0 : spec.stop]
    if spec.kind == "exclude":
        return [x for i, x in enumerate(items) if not (spec.start <= i < spec.stop if spec.stop is not None else i in spec.values)]
    return items


# ---- texts ----


def block_text(node: Node) -> str:
    """Inline content joined, each block on a line of its own."""
    lines: list[list[str]] = [[]]
    filled = False  # whether the line has more than blanks
    stack: list[Node | str | None] = node.children[::-1]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            lines[-1].append(c)
            filled = filled or not c.isspace() and c != ""
        elif c is None or c.tag not in ("script", "style"):  # None: a block ends
            if filled and (c is None or c.tag not in INLINE):
                lines.append([])
                filled = False
            if c is not None:
                if c.tag not in INLINE or c.tag == "br":
                    stack.append(None)
                stack += c.children[::-1]
    return "\n".join(x for x in (" ".join("".join(p).split()) for p in lines) if x)


def spaced_text(node: Node) -> str:
    """Descendant text with a space before an element where there is none."""
    # (element, its pieces so far, its children that are left)
    stack: list[tuple[Node, list[str], list]] = [(node, [], node.children[::-1])]
    while True:
        n, out, left = stack[-1]
        if left and not isinstance(left[-1], str):
            c = left.pop()
            stack.append((c, [], c.children[::-1]))
            continue
        if left:
            out.append(left.pop())
            continue
        said = "".join(out)
        said = said.strip() if n.tag != _HEAD else said
        stack.pop()
        if not stack:
            return said
        before = next((x for x in reversed(stack[-1][1]) if x), "")
        stack[-1][1].append(" " + said if said and before and not before[-1].isspace() else said)


def attribute(nodes: list[Node], what: str) -> list[str]:
    """One text per element: text, html, ownText, allText, textNodes, or an attribute; trimmed, without empty ones."""
    low = what.lower()
    get = {"text": block_text, "": block_text, "html": Node.inner, "outerhtml": Node.outer, "owntext": Node.own_text, "alltext": Node.text, "textnodes": lambda n: "\n".join(x.strip() for x in n.children if isinstance(x, str) and x.strip()), "all": Node.outer}.get(low)
    return [x for x in ((get(n) if get else n.attrs.get(what, "")).strip() for n in nodes) if x]


# ---- rules ----


def css(root: Node, rule: str) -> list[str]:
    """selector@what with an index specification; [what] defaults to text."""
    selector, _, what = rule.rpartition("@") if "@" in rule else (rule, "", "")
    spec, selector = index_spec(selector)
    return attribute(taken(select(root, selector), spec) if selector else [root], what)


_STEP = re.compile(r"^(.*?)(?:\.(-?\d+)|!(\d+(?::\d+|,\d+)*))?$", re.S)


def chain_step(nodes: list[Node], step: str) -> list[Node]:
    """class.x, tag.x, id.x, text.needle, children or CSS, each with .n or !n."""
    base, index, gone = _STEP.match(step.strip()).groups()
    kind, _, name = base.partition(".")
    out: list[Node] = []
    held: set[int] = set()
    for n in nodes:
        if kind == "class" and name:
            found = [x for x in n.walk() if all(c in x.classes() for c in name.replace(".", " ").split())]
        elif kind == "tag" and name:
            found = [x for x in n.walk() if x.tag == name.lower()]
        elif kind == "id" and name:
            found = [x for x in n.walk() if x.attrs.get("id") == name]
        elif kind == "text" and name:
            hits = [x for x in n.walk() if name in x.text()]
            found = ([x for x in hits if x.tag == "a"] or [x for x in hits if name in x.own_text()] or hits)[:1]
        elif base == "children":
            found = n.elements()
        else:
            found = select(n, base) if base else [n]
        out += [x for x in found if id(x) not in held]
        held.update(map(id, found))
    if index is not None and out:
        i = int(index)
        return [out[i]] if -len(out) <= i < len(out) else [out[0] if i >= 0 else out[-1]]
    if gone:
        lo, _, hi = gone.partition(":")
        drop = set(range(int(lo), int(hi))) if hi else {int(x) for x in gone.split(",")}
        return [x for i, x in enumerate(out) if i not in drop]
    return out


_NODE_TEXTS = frozenset("text textnodes owntext alltext html outerhtml all href src alt title content data-src data-original value".split())


def chain(root: Node, rule: str) -> list[str]:
    """step@step@what: the texts of the last step's elements."""
    *steps, last = rule.split("@")
    if last.lower() not in _NODE_TEXTS:
        steps, last = [*steps, last], "text"
    nodes = [root]
    for s in steps:
        if s:
            nodes = chain_step(nodes, s)
    return attribute(nodes, last)


def chain_value(root: Node, rule: str) -> str:
    """The first alternative of a || b with a text; several elements by line, an attribute of the first only."""
    for one in rule.split("||"):
        got = chain(root, one.strip())
        if got:
            last = one.strip().rpartition("@")[2].lower()
            return got[0] if last in ("href", "src", "alt", "title", "content", "data-src", "data-original", "value") else "\n".join(got)
    return ""


def chain_list(root: Node, rule: str) -> list[Node]:
    """Elements of a list rule; alternatives of the last step are put one after the other."""
    *steps, last = [s for s in rule.split("@") if s]
    nodes = [root]
    for s in steps:
        nodes = chain_step(nodes, s)
    return [x for one in last.split("||") for x in chain_step(nodes, one)]


# ---- XPath subset ----

_CONDITION = r"\[(?:\"[^\"]*\"|'[^']*'|[^\]\"'])*\]"
_XSTEP = re.compile(rf"(//?)(@?[\w*-]+(?:\(\))?|\.\.|\.)((?:{_CONDITION})*)")


@lru_cache(maxsize=2048)
def _xsteps(path: str) -> list[tuple[str, str, list[str]]]:
    """(separator, name, conditions) of a path's steps; what is beyond the subset raises ValueError."""
    path = path if path.startswith("/") else "//" + path
    steps = _XSTEP.findall(path)
    if "".join(map("".join, steps)) != path or any(name.endswith("()") and name != "text()" for _, name, _ in steps):
        raise ValueError(f"path {path!r} is not supported")
    return [(sep, name, [c[1:-1] for c in re.findall(_CONDITION, conds)]) for sep, name, conds in steps]


def _split(text: str, word: str) -> list[str]:
    """text cut at a word that stands outside of quotes."""
    out, at = [""], 0
    for m in re.finditer(rf"\"[^\"]*\"|'[^']*'|({re.escape(word)})", text):
        out[-1] += text[at : m.start()] + ("" if m[1] else m[0])
        at = m.end()
        if m[1]:
            out.append("")
    return [*out[:-1], out[-1] + text[at:]]


def _xtest(n: Node, cond: str, place: int, size: int) -> bool:
    cond = cond.strip()
    if cond.isdigit():
        return place == int(cond)
    if cond == "last()":
        return place == size
    for word, join in ((" and ", all), (" or ", any)):
        if len(parts := _split(cond, word)) > 1:
            return join(_xtest(n, c, place, size) for c in parts)
    if m := re.match(r"^(contains|starts-with)\(\s*(@[\w-]+|text\(\)|\.)\s*,\s*['\"](.*)['\"]\s*\)$", cond):
        value = n.attrs.get(m[2][1:], "") if m[2][0] == "@" else n.own_text() if m[2] == "text()" else n.text()
        return m[3] in value if m[1] == "contains" else value.startswith(m[3])
    if m := re.match(r"^(@[\w-]+|text\(\)|\w+|\.)\s*(!?=)\s*['\"](.*)['\"]$", cond):
        k = m[1]
        values = [n.attrs[k[1:]]] if k[0] == "@" and k[1:] in n.attrs else [] if k[0] == "@" else [n.own_text().strip()] if k == "text()" else [n.text().strip()] if k == "." else [c.text().strip() for c in n.elements() if c.tag == k]
        return any((v == m[3]) == (m[2] == "=") for v in values)
    if m := re.match(r"^position\(\)\s*(<=|>=|<|>|=)\s*(\d+)$", cond):
        k = int(m[2])
        return {"<": place < k, ">": place > k, "<=": place <= k, ">=": place >= k, "=": place == k}[m[1]]
    if not re.match(r"^@?[\w-]+$", cond):
        raise ValueError(f"condition [{cond}] is not supported")
    return cond[1:] in n.attrs if cond.startswith("@") else any(c.tag == cond for c in n.elements())


def xpath(root: Node, query: str) -> list[str]:
    """Texts of a path of //, /, names, *, @attribute, text(), .., and conditions; unions by |."""
    out: list[str] = []
    for path in _split(query, "|"):
        nodes, values = [root], None
        for sep, name, conds in _xsteps(path.strip()):
            if name.startswith("@") or name == "text()":
                owners = [x for n in nodes for x in ([n, *n.walk()] if sep == "//" else [n])]
                values = [n.attrs.get(name[1:], "") for n in owners] if name[0] == "@" else [c.strip() for n in owners for c in n.children if isinstance(c, str)]
                break
            found: list[Node] = []
            held: set[int] = set()
            for n in nodes:
                pool = [n.parent] if name == ".." and n.parent else [n] if name == "." else list(n.walk()) if sep == "//" else n.elements()
                groups: dict[int, list[Node]] = {}
                for x in pool:
                    if name in ("*", ".", "..") or x.tag == name.lower():
                        groups.setdefault(id(x.parent), []).append(x)
                for peers in groups.values():
                    for cond in conds:
                        peers = [x for k, x in enumerate(peers, 1) if _xtest(x, cond, k, len(peers))]
                    found += [x for x in peers if id(x) not in held]
                    held.update(map(id, peers))
            nodes = found
        out += [v for v in (values if values is not None else [spaced_text(n) for n in nodes]) if v]
    return out


# ---- content ----

#: Attributes that hold lazy images, fixed values.
IMAGE_ATTRS = ("src", "data-src", "data-original", "data-url", "data-echo", "data-lazy-src")


def content_text(node: Node) -> str:
    """Paragraph text with a blank line between blocks; list items by line; scripts, styles and images left out."""
    return "\n\n".join(block_text(node).split("\n"))


def images(node: Node, base: str = "") -> list[str]:
    """The images below an element, the first filled attribute of each, resolved; none twice."""
    found = (next((v for a in IMAGE_ATTRS if (v := n.attrs.get(a, "").strip())), "") for n in node.walk() if n.tag == "img")
    return list(dict.fromkeys(urljoin(base, x) for x in found if x))


#: Tags that cleaned content keeps, fixed values.
ALLOWED = frozenset(("p", "br", "div", "span", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "strong", "em", "b", "i", "img"))


def whitelisted(node: Node, allowed: frozenset[str] = ALLOWED) -> str:
    out: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(c, False) for c in reversed(node.children)]  # bool: is markup already
    while stack:
        c, done = stack.pop()
        if isinstance(c, str):
            out.append(c if done else escape(c, quote=False))
        elif c.tag not in ("script", "style", "noscript", "iframe"):
            if c.tag in allowed:
                src = f' src="{escape(c.attrs["src"])}"' if c.tag == "img" and c.attrs.get("src") else ""
                out.append(f"<{c.tag}{src}>")
                if c.tag in VOID:
                    continue
                stack.append((f"</{c.tag}>", True))
            stack += [(x, False) for x in reversed(c.children)]
    return "".join(out)
