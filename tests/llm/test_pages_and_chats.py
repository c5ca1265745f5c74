import hashlib
import html
import random
import re
import time
from collections import defaultdict

import pytest
from leafmill.llm import chat_format, html_extract

PAGE = """<html><head><title>x</title></head><body><header><h1>Site name</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, and more of them. Agree?</div><article><h1>A &amp; B</h1><p>First   text,
with <b>bold<br>words. It goes on, and on.<p>Second&nbsp;one &lt;p&gt; here.</p><form><label>Mail</label><p>Sign up now.</p></form><!-- <p>gone</p> -->
<script>var t="</p><p>no</p>";</script><aside class="ad">Buy this thing today.</aside><p>Last.</p></article>
<section class="comments"><div class="comment"><p>I think this is a good text, really. Thank you, all.</p></div></section><footer>&copy; me</footer>"""


def test_article_without_the_rest():
    assert html_extract.extract_text(PAGE, html_extract.default_model()) == "A & B\n\nFirst text, with bold words. It goes on, and on.\n\nSecond one <p> here.\n\nLast."


def test_pages_of_the_tables(spark, sf):
    for r in html_extract.op2_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_accuracy_on_unseen_layouts():
    model, right, n = html_extract.default_model(), 0, 0
    for page, labels in html_extract.labelled_pages(200, seed=1234):
        got = model.label(html_extract.blocks(page))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        n += len(labels)
    assert right > 0.97 * n


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<"), (4, "plain"), (5, "<article><p>x" * 3000), (5, "<!-- never closed"), (6, "<script>never closed"), (7, '<p title="a>b" class=\'c\'>q</p><a href="x'), (8, "</div></p>" * 50), (9, "<p " + "a='" * 3000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, html string, text string")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(isinstance(r["text"], str) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0

ARTICLE = "<article><h1>A title</h1><p>The first text goes on, and on.</p><p>The second one, too.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        "<script>for(i=0;i<n;i++){f(i);}</script>",
        "<script>if (a<b) x = '<!--';</SCRIPT >",
        "<style><!-- p{}</style>",
        "<noscript><img src='x></noscript>",
        "<template><script>while(a<b){}</script><p>no</p></template>",
        "<svg><!-- </svg> --><text>no</text></svg>",
        "<noscript>",
        "<button>",
        "<select><option>",
        "<object data=x>",
        "<script>var x = 1;",
        "<title>a <b</title>",
    ],
)
def test_raw_elements_end_at_their_own_end_tag(before):
    got = [b.text for b in html_extract.blocks(f"<p>Top</p>{before}{ARTICLE}<p>Last</p>")]
    assert got == ["Top", "A title", "The first text goes on, and on.", "The second one, too.", "Last"]


def test_text_of_unclosed_elements_and_all_class_words_stay():
    assert [b.text for b in html_extract.blocks("<p>a</p><button>b<p>c</p>")] == ["a", "b", "c"]
    assert [b.text for b in html_extract.blocks("<button><script>no()</script>a<p>b</p><script>no(")] == ["a", "b"]
    words = [chr(97 + i) * 3 for i in range(20)]
    (block,) = html_extract.blocks(f'<div class="{" ".join(words)}">x</div>')
    assert block.path.names() == ["t:div", *[f"c:{w}" for w in words]] and block.path.up is None
    assert len(html_extract.blocks("<button>x" * 20_000)) == 20_000


def brute_best(model, fs):
    import itertools

    s = [sum(model.weight.get(k, 0.0) for k in f) for f in fs]
    value = lambda y: sum(a for a, b in zip(s, y, strict=True) if b) + sum(model.step[a][b] for a, b in itertools.pairwise(y))
    return max(value(y) for y in itertools.product((0, 1), repeat=len(fs))), value


def test_viterbi_is_the_best_path():
    model, rng = html_extract.Crf(), random.Random(2)
    model.step = [[0.5, -0.7], [-0.2, 0.9]]
    model.weight = {k: rng.uniform(-2, 2) for k in "abcdef"}
    for n in range(1, 9):
        fs = [rng.sample("abcdef", 2) for _ in range(n)]
        best, value = brute_best(model, fs)
        assert value(model.decode(model._scores(fs))) == pytest.approx(best)


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", None), (2, 1, "assistant", "b <\\/s> [\\\\INST] <s"), (2, 0, None, "a["), (3, 0, "system", "<|endoftext|> é\n\n "), (None, None, "user", "x"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "assistant", "long text " * 20_000), (6, 0, "</s>", "<s>"), (6, 1, "assistant", "")]


def test_deep_and_misnested_pages_take_time_by_length():
    model = html_extract.default_model()
    for inside in ("<div class='c{0} x'>text {0} words here.", "<div><b>text {0} words.</i></span><li>", "<p><span><b>text {0} words.</p></table>", "<div><p>one <div>two {0}"):
        page = "<html><body>" + "".join(inside.format(i) for i in range(8000))
        began = time.process_time()
        found = html_extract.blocks(page)
        model.label(found)
        assert time.process_time() - began < 2 and len(found) >= 8000


def test_paths_hold_every_tag_and_class_above_a_block():
    rng = random.Random(6)
    for _ in range(200):
        tags = [(rng.choice(["div", "section", "b", "span", "li", "td"]), rng.choice(["", "a", "a b", "c"])) for _ in range(rng.randint(0, 9))]
        page = "".join(f'<{t} class="{c}">' if c else f"<{t}>" for t, c in tags if t not in ("li", "td")) + "some words"
        (block,) = html_extract.blocks(page)
        kept = [(t, c) for t, c in tags if t not in ("li", "td") and (c or t not in ("b", "span"))]
        want = {f"t:{t}" for t, _ in kept} | {f"c:{w}" for _, c in kept for w in c.split()}
        names = block.path.names() if block.path else []
        assert set(names) == want and len(names) == len(want)


def test_a_block_ends_the_paragraph_around_it_at_any_depth():
    page = "<p>" + "<b>" * 20 + "one<div>two</div>three<table><tr><td><p>four<div>five</div></td></tr></table><p>six<table><tr><td><div>seven</div></td></tr></table>"
    got = {b.text: [t for t in b.path.names() if t.startswith("t:")] if b.path else [] for b in html_extract.blocks(page)}
    assert "t:p" in got["one"] and "t:p" not in got["two"] and "t:p" in got["four"] and "t:p" not in got["five"]


@pytest.mark.parametrize("part", [chat_format.PART_TOKENS, 4])
def test_chats_come_back(spark, part):
    df = spark.createDataFrame([(*c, "clash") for c in CHATS], "conv_id long, turn long, role string, text string, ids string")
    made = chat_format.format_chats(df, part_tokens=part)
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    want = defaultdict(list)
    for c, t, r, x in CHATS:
        want[c].append((t if t is not None else -1, r or "", x or ""))
    assert got.keys() == want.keys()
    whole = defaultdict(str)
    for r in made.orderBy("conv_id", "part").collect():
        whole[r["conv_id"]] += r["formatted"]
        assert len(r["ids"]) == len(r["mask"])
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(whole[c])
        pieces = re.split(r"<s>|\[INST\]|\[/INST\]</s>", whole[c])  # the text can be parsed too
        assert [(chat_format.unescape(pieces[3 * k + 1]), chat_format.unescape(pieces[3 * k + 2])) for k in range(len(turns))] == [(r, x) for _, r, x in turns]


def test_chats_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_chats(empty)).count() == 0
