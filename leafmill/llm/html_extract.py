"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags, with the tags, classes and ids above them.  Each block
has ancestor features (tags and class words of its ancestors) and text features (length, links, punctuation, place).  The field has
two labels, article and other; it is trained on labelled pages by stochastic gradient ascent of the conditional
likelihood (forward and backward sums over the chain), and a page's labels are decoded by Viterbi.

The labelled pages come from labelled_pages(): layouts of many kinds, with and without telling tags, filled with
invented words, so that no page of the corpus is needed; pages of your own can be given to train() instead.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[a-z]+")
_SKIP = frozenset("script style noscript template iframe svg math select textarea button object title head canvas audio video".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video select button".split())
#: Raw elements whose content is text up to their own end tag, whatever looks like a tag or comment in it.
_UNPARSED = frozenset("script style noscript iframe textarea title".split())
_CODE = frozenset({"script", "style"})
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br del".split())
_CLOSES = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


#: Elements that shut a paragraph in: a block inside one does not end the paragraph around it.
_SCOPE = ("table", "td", "th", "caption", "object", "marquee", "applet", "template", "button", "html")


class Path:
    """The tags above a block, linked to those further up; ``new`` are the feature names that those do not have yet."""

    __slots__ = ("new", "score", "tag", "up")

    def __init__(self, tag: str, up: Path | None, new: list[str]):
        self.tag, self.up, self.new, self.score = tag, up, new, None

    def names(self) -> list[str]:
        out, at = [], self
        while at is not None:
            out += at.new
            at = at.up
        return out


class Block:
    __slots__ = ("linked", "path", "text", "words")

    def __init__(self, text: str, path: Path | None, linked: float):
        self.text, self.path, self.linked = text, path, linked
        self.words = text.count(" ") + 1


class _Open:
    """The open elements of a page: where each tag stands among them, and the path that they make.

    Every step costs as much as it opens and closes, however deep the page is.
    """

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[Path | None] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.held: Counter = Counter()  # open elements that bring each feature name

    @property
    def path(self) -> Path | None:
        return self.paths[-1] if self.paths else None

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, named: tuple[str, ...]) -> None:
        inline = tag in _INLINE
        path = self.path
        if not inline or named:
            names = dict.fromkeys([f"t:{tag}", *[f"c:{w}" for w in named]])
            path = Path(tag, path, [n for n in names if not self.held[n]])
            self.held.update(path.new)
        self.places[tag].append(len(self.tags))
        if not inline:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.paths.append(path)

    def cut(self, k: int) -> None:
        """Close element k and all inside it."""
        while len(self.tags) > k:
            tag, path = self.tags.pop(), self.paths.pop()
            self.places[tag].pop()
            if tag not in _INLINE:
                self.blocks.pop()
            if path is not self.path:
                for n in path.new:
                    self.held[n] -= 1

    def close(self, tag: str) -> None:
        """An end tag: the last such element ends; an inline one only inside its block."""
        k = self.last(tag)
        if k >= 0 and (tag not in _INLINE or not self.blocks or self.blocks[-1] < k):
            self.cut(k)

    def make_room(self, tag: str) -> None:
        """What the start of a block ends: the paragraph around it, and an item of its kind."""
        k = self.last("p")
        if k > self.last(*_SCOPE):
            self.cut(k)
        if tag in _CLOSES:
            k = self.last(*_CLOSES[tag])
            if k > self.last(*_HOLDS[tag]):
                self.cut(k)


def _after_raw(page: str, tag: str, at: int, missing: dict[str, int]) -> int | None:
    """Where a raw element ends whose content starts at ``at``, or None if it is not closed; missing has from where on a tag is not."""
    start = at
    if start >= missing.get(tag, len(page) + 1):
        return None
    if tag in _UNPARSED:
        if m := _END[tag].search(page, at):
            return m.end()
    elif _END[tag].search(page, at):
        while m := _TOKEN.search(page, at):
            at, inner = m.end(), (m[2] or m[5] or "").lower()
            if inner == tag and (m[1] or m[4]):
                return at
            if inner in _UNPARSED and not (m[1] or m[4]) and not m[0].endswith("/>"):
                at = _after_raw(page, inner, at, missing) or at
    missing[tag] = start
    return None


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in their order; unclosed and misnested tags are tolerated.

    The start tag of a raw element without an end tag is passed over, so that the rest of the page stays; of an
    unclosed script or style the code up to the next tag goes with it.
    """
    out: list[Block] = []
    stack = _Open()
    text: list[str] = []
    path: Path | None = None
    begun = False  # whether the block has text other than white space, which sets its path
    links = [0, 0, 0]  # open anchors, letters inside, letters
    missing: dict[str, int] = {}
    at = upto = 0  # where text that is not taken yet and the next search start

    def flush():
        nonlocal path, begun
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block(whole, path, links[1] / max(1, links[2])))
            text.clear()
        path, begun = None, False
        links[1] = links[2] = 0

    def add(piece: str):
        nonlocal path, begun
        if "&" in piece:
            piece = html.unescape(piece)
        if piece:
            if not begun and not piece.isspace():
                path, begun = stack.path, True
            text.append(piece)
            n = len(piece.strip())
            links[2] += n
            if links[0]:
                links[1] += n

    while m := _TOKEN.search(page, upto):
        tag = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        if m.start() > at:
            add(page[at : m.start()])
        at = upto = m.end()
        if not tag:
            continue
        if tag in _RAW and not closing:
            if not m[0].endswith("/>"):
                end = _after_raw(page, tag, at, missing)
                if end is None and tag in _CODE:
                    after = _TOKEN.search(page, at)
                    end = after.start() if after else len(page)
                at = upto = at if end is None else end
            if tag not in _INLINE:
                flush()
            continue
        if tag == "a":
            links[0] = 0 if closing else 1
        if tag == "br":
            add(" ")
            continue
        block = tag not in _INLINE
        if block:
            flush()
        if closing:
            stack.close(tag)
            continue
        if block:
            stack.make_room(tag)
        if tag not in _VOID and not m[0].endswith("/>"):
            named = tuple(w for a in _ATTR.findall(m[3] or m[6] or "") for w in _PIECE.findall((a[1] or a[2] or a[3]).lower())) if (m[3] or m[6]) else ()
            stack.push(tag, named)
    if at < len(page):
        rest = page[at:]
        add(rest if "<" not in rest or not re.match(r"<[/!a-zA-Z]", rest) else "")
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that each block has: all those of its path, then its own."""
    return [(b.path.names() if b.path else []) + f for b, f in zip(found, own_features(found), strict=True)]


def own_features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block besides those of its path."""
    out, n = [], len(found)
    longest = max((b.words for b in found), default=1)
    for i, b in enumerate(found):
        tag = b.path.tag if b.path else ""
        f = ["bias", f"p:{tag}"]
        f.append(f"w:{min(9, int(math.log2(b.words)))}")
        f.append(f"rel:{int(4 * b.words / longest)}")
        f.append(f"link:{int(4 * b.linked)}")
        f.append(f"end:{b.text[-1] if b.text[-1] in '.!?:;,…»”' else 'o'}")
        f.append(f"comma:{min(3, b.text.count(', '))}")
        f.append(f"stop:{min(3, b.text.count('. '))}")
        f.append(f"at:{int(5 * i / n)}")
        if b.text[0] in "©®|»›<•·" or "©" in b.text:
            f.append("mark")
        if "@" in b.text or "http" in b.text:
            f.append("address")
        f.append(f"x:{tag}:{min(4, int(math.log2(b.words)))}:{b.linked > 0.5}")
        out.append(f)
    return out


class Crf:
    """Weights of features for the label article (against other), and of label pairs."""

    def __init__(self):
        self.weight: dict[str, float] = defaultdict(float)
        self.step = [[0.0, 0.0], [0.0, 0.0]]

    def _scores(self, fs: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(k, 0.0) for k in f) for f in fs]

    def label(self, found: list[Block]) -> list[int]:
        """Viterbi labels of a page's blocks; what a path adds to the scores is summed up once."""
        get = self.weight.get

        def above(path: Path | None) -> float:
            chain = []
            while path is not None and path.score is None:
                chain.append(path)
                path = path.up
            total = path.score if path else 0.0
            for x in reversed(chain):
                total = x.score = total + sum(get(n, 0.0) for n in x.new)
            return total

        return self.decode([above(b.path) + s for b, s in zip(found, self._scores(own_features(found)), strict=True)])

    def decode(self, s: list[float]) -> list[int]:
        """Viterbi labels by the blocks' scores; other wins ties."""
        if not s:
            return []
        w, back = self.step, []
        a, b = 0.0, s[0]
        for e in s[1:]:
            a0, b0, a1, b1 = a + w[0][0], b + w[1][0], a + w[0][1], b + w[1][1]
            back.append((int(b0 > a0), int(b1 > a1)))
            a, b = max(a0, b0), max(a1, b1) + e
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def climb(self, fs: list[list[str]], labels: list[int], rate: float, decay: float) -> None:
        """One gradient step on a page's conditional log-likelihood."""
        n, s, w = len(fs), self._scores(fs), self.step
        fwd, bwd = [(0.0, s[0])], [(0.0, 0.0)] * n
        log_add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        for e in s[1:]:
            a, b = fwd[-1]
            fwd.append((log_add(a + w[0][0], b + w[1][0]), log_add(a + w[0][1], b + w[1][1]) + e))
        for i in range(n - 2, -1, -1):
            a, b = bwd[i + 1][0], bwd[i + 1][1] + s[i + 1]
            bwd[i] = (log_add(w[0][0] + a, w[0][1] + b), log_add(w[1][0] + a, w[1][1] + b))
        z = log_add(*fwd[-1])
        for i in range(n):
            g = rate * (labels[i] - math.exp(fwd[i][1] + bwd[i][1] - z))
            if abs(g) > 1e-6:
                for k in fs[i]:
                    self.weight[k] += g - rate * decay * self.weight[k]
        grad = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n - 1):
            grad[labels[i]][labels[i + 1]] += 1
            for x in (0, 1):
                for y in (0, 1):
                    grad[x][y] -= math.exp(fwd[i][x] + w[x][y] + (s[i + 1] if y else 0.0) + bwd[i + 1][y] - z)
        for x in (0, 1):
            for y in (0, 1):
                w[x][y] += 0.3 * rate * grad[x][y]


def train(pages: list[tuple[str, list[int]]], epochs: int = 8, seed: int = 5) -> Crf:
    """Fit on pages with one label (1: article) a leaf block."""
    data = [(features(blocks(p)), y) for p, y in pages]
    data = [(f, y) for f, y in data if f and len(f) == len(y)]
    model, rng = Crf(), random.Random(seed)
    for e in range(epochs):
        rng.shuffle(data)
        for f, y in data:
            model.climb(f, y, 0.15 / (1 + 0.3 * e), 0.002)
    model.weight = dict(model.weight)
    return model


def labelled_pages(n: int = 500, seed: int = 17) -> list[tuple[str, list[int]]]:
    """Invented pages with their blocks' labels, from layouts drawn by rule."""
    rng = random.Random(seed)
    parts = ["ka", "to", "mi", "ren", "sol", "va", "dor", "el", "pi", "nu", "tha", "er", "in"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))

    def sentence(lo: int, hi: int) -> str:
        w = [word() for _ in range(rng.randint(lo, hi))]
        if len(w) > 6:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + rng.choice("....!?")

    prose = lambda k: " ".join(sentence(2, 18) for _ in range(k))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))

    def page() -> tuple[str, list[int]]:
        out, labels = [], []

        def put(markup: str, text: str | None = None, label: int = 0):
            out.append(markup if text is None else markup.replace("$", text))
            if text is not None:
                labels.append(label)

        def items(k: int, linked: bool = True):
            put(rng.choice(["<ul>", "<ul class=menu>", "<ul class='list'>"]))
            for _ in range(k):
                put('<li><a href="/x">$</a></li>' if linked else "<li>$</li>", words(1, 4))
            put("</ul>")

        def box(tag: str, name: str, inside):
            put(f'<{tag}{rng.choice([" class", " id"])}="{name}">' if name else f"<{tag}>")
            inside()
            put(f"</{tag}>")

        pick = rng.choice
        noise = {
            "header": lambda: box(pick(["header", "div"]), pick(["header", "masthead", "site-header", "top"]), lambda: (put(pick(["<h1>$</h1>", "<p>$</p>", "<div>$</div>"]), words(1, 4)), put("<p>$</p>", prose(1)))),
            "nav": lambda: box(pick(["nav", "nav", "div"]), pick(["nav", "menu", "navigation", "breadcrumb"]), lambda: items(rng.randint(2, 8))),
            "bare_nav": lambda: box("nav", "", lambda: items(rng.randint(2, 8))),
            "notice": lambda: box(pick(["div", "section", "p"]), pick(["notice", "cookie", "consent", "alert", "banner", "warning", "message"]), lambda: put(pick(["<div>$</div>", "$"]), prose(rng.randint(1, 3)))),
            "ad": lambda: box(pick(["div", "aside", "ins"]), pick(["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement"]), lambda: put(pick(["<p>$</p>", "$", '<a href="/b">$</a>']), prose(rng.randint(1, 2)))),
            "sidebar": lambda: box(pick(["aside", "div", "section"]), pick(["sidebar", "side", "widget", "related", "rail"]), lambda: (put("<h3>$</h3>", words(1, 3)), put("<p>$</p>", prose(rng.randint(1, 5))), items(rng.randint(1, 5)))),
            "bare_aside": lambda: box("aside", "", lambda: put("<p>$</p>", prose(rng.randint(1, 5)))),
            "form": lambda: box("form", pick(["", "subscribe", "search", "newsletter", "signup"]), lambda: (put("<label>$</label><input type=text>", words(1, 2)), put("<p>$</p>", prose(1)))),
            "comments": lambda: box(pick(["div", "section", "ol"]), pick(["comments", "comment-list", "discussion", "responses", "replies"]), lambda: [box(pick(["div", "article", "li"]), pick(["comment", "reply", "comment-body"]), lambda: (put("<b>$</b>", word()), put("<p>$</p>", prose(rng.randint(1, 6))))) for _ in range(rng.randint(1, 4))]),
            "share": lambda: box("div", pick(["share", "social", "tags", "toolbar"]), lambda: items(rng.randint(2, 4))),
            "footer": lambda: box(pick(["footer", "footer", "div"]), pick(["", "footer", "site-footer", "copyright", "bottom"]), lambda: put(pick(["<p>$</p>", "$"]), "© " * rng.randint(0, 1) + prose(rng.randint(1, 2)))),
        }

        def article():
            for k in range(rng.randint(2, 12)):
                kind = rng.random()
                if k == 0 and kind < 0.85:
                    put("<h1>$</h1>", words(2, 12), 1)
                elif kind < 0.62:
                    put(pick(["<p>$</p>", "<p><b>$</b></p>", "<p>$ <em></em></p>", "<p><b>$<br>"]), prose(rng.choice([1, 1, 2, 4, 8])), 1)
                elif kind < 0.72:
                    put(pick(["<h2>$</h2>", "<h3>$</h3>"]), words(1, 7), 1)
                elif kind < 0.8:
                    put(pick(["<ul>", "<ol>"]))
                    for _ in range(rng.randint(1, 4)):
                        put("<li>$</li>", pick([words(2, 6), prose(1)]), 1)
                    put("</ul></ol>")
                elif kind < 0.86:
                    put(pick(["<blockquote>$</blockquote>", "<figure><figcaption>$</figcaption></figure>", "<pre>$</pre>", "<table><tr><td>$</td></tr></table>"]), prose(1), 1)
                elif kind < 0.9:
                    put('<p>$ <a href="/y">more</a></p>', prose(3), 1)
                elif kind < 0.97:
                    noise[pick(["ad", "share", "form", "notice", "bare_aside", "sidebar"])]()
                else:
                    put("<p>$</p>", words(1, 2) + ".", 1)

        put("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
        for name in rng.sample(["header", "nav", "bare_nav", "notice", "ad", "sidebar", "form"], rng.randint(1, 4)):
            noise[name]()
        wrap = rng.random()
        if wrap < 0.4:
            box("article", "", article)
        elif wrap < 0.55:
            box("main", pick(["", "main", "content"]), article)
        elif wrap < 0.9:
            box(pick(["div", "section", "article", "td"]), pick(["content", "post", "entry", "story", "article-body", "article", "main", "post-content", "text", "body"]), article)
        else:
            box("div", "", article)
        for name in rng.sample(["comments", "sidebar", "ad", "share", "form", "notice", "bare_aside", "footer"], rng.randint(0, 4)):
            noise[name]()
        noise["footer"]()
        put("</body></html>")
        return "".join(out), labels

    made = [page() for _ in range(n)]
    return [(p, y) for p, y in made if len(blocks(p)) == len(y)]


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled_pages())


def extract_text(page: str | None, model: Crf) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(found, model.label(found), strict=True) if y)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", model: Crf | None = None) -> DataFrame:
    """pages with out_col, the main text of the whole html; '' for null, empty, or no article.

    Rows are read one by one, so repeated rows give equal texts; a column named out_col is replaced, all others stay.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([extract_text(t.as_py(), shared.value) for t in b], pa.string())

    return pages.withColumn(out_col, F.arrow_udf(run, "string")(F.col(html_col)))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
