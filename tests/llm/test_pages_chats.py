"""HTML wrappers and chat formatting."""

import hashlib
import html
import json
import random
import re
import sys

from pyspark.sql import functions as F

from hostlens.llm import chat, html_wrappers
from tests.conftest import SF
from tests.llm.helpers import with_clashes


# ---- pages ----

def _article_by_hand(page):
    """The text of the synthetic pages' article, by splitting its source at block tags."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_wrappers.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == _article_by_hand(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


SITE = ("<html><head><title>t</title><style>x</style></head><body><div class='site-header'><a>Logo</a></div><div id='main-menu'><a>Home</a></div>"
        "<div class=wrap><div class=body><span>Share this!</span><h2>{0} &amp; co</h2><p>{1}<p>{2} <b>bold</b><br>line{3}</div>"
        "<div class='side-bar sidebar'>Links</div></div><form><input><label>mail</label></form><div id=comments><article>troll</article></div>"
        "<div class=legal>All rights reserved</div><!-- x --><script>if (a < b) {{}}</script></body></html>")


def test_site_without_article_element(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(12):
        w = ["".join(rng.choice("abcdefg ") for _ in range(60)) for _ in range(3)]
        items = "<ul><li>one<li>two" if i % 2 else ""
        rows.append((i, f"http://User@Site.example:80/{i}", SITE.format(*w, items)))
        want[i] = "\n\n".join([f"{' '.join(w[0].split())} & co", " ".join(w[1].split()), " ".join(f"{w[2]} bold line".split()), *(["one", "two"] if i % 2 else [])])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_wrappers.extract(df).collect()}
    assert got == want
    # the constant text of the template stays only where a page stands alone
    alone = html_wrappers.extract(df.where("page_id = 0")).first().text
    assert alone.endswith(want[0]) and "Logo" not in alone and "troll" not in alone
    found = json.loads(html_wrappers.infer(df).first().wrapper)
    assert "(<ul>" in html_wrappers.expression(found) and ")+" in html_wrappers.expression(found)


def test_wrappers_align_to_optional_repeated_and_slots():
    def w(page):
        return html_wrappers.wrapper(html_wrappers.parse(page))

    a = w("<div><h1>A</h1><dl><dt>x<dd>1<dt>y<dd>2</dl><p>same</p></div>")
    b = w("<div><dl><dt>z<dd>3</dl><p>same</p><hr><p>more</p></div>")
    m = html_wrappers.merged(a, b)
    text = html_wrappers.expression(m)
    assert "(<h1>text</h1>)?" in text and "(<dt>#TEXT</dt> <dd>#TEXT</dd>)+" in text
    # merging again what a wrapper has seen changes no structure
    assert html_wrappers.expression(html_wrappers.merged(m, a)) == text
    strip = lambda x: re.sub(r"\d+", "", json.dumps(x))
    assert strip(html_wrappers.merged(a, a)) == strip(a)


def test_odd_pages(spark):
    deep = "<div>" * 300 + "deep" + "</div>" * 300
    pages = ["<p>a&nbsp;b&lt;c&#x41;&copy;</p>", "", None, "no markup at all", "<article>x<article>y</article></article>", "<main><p>m</main>tail",
             "<p>5 < 6 and <b>7 > 2</b></p>", "<script>var a='</p>';</script><p>t</p", "</p></div>stray</b>", "<article><!-- <p>no</p> --><p>yes</p>",
             "<article><header><h1>Head</h1></header><nav>n</nav><p>body<aside>s</aside></p><footer>f</footer></article>", deep]
    rows = [(i, None if i % 3 else f"//h{i % 2}/", p) for i, p in enumerate(pages)] + [(None, "::", "<p>x</p>"), (0, "//h0/", pages[0])]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = [r for r in html_wrappers.extract(df).collect()]
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[0] == "a b<cA©" and text[1] == "" and text[2] == "" and text[3] == "no markup at all"
    assert text[4] == "x\n\ny" and text[5] == "m" and text[6] == "5 < 6 and 7 > 2" and text[9] == "yes"
    assert text[10] == "Head\n\nbody" and text[11] == "deep"
    assert html_wrappers.extract(df.limit(0)).count() == 0


def text_of(page, path=None):
    return html_wrappers.main_text(page, path, frozenset())


def test_elements_left_open_swallow_no_text():
    for odd in ("<svg class=i />", "<object data=x />", "<canvas/>", "<iframe src=x />", "<textarea/>", "<svg><path d='M0'/></svg>", "<button>x</button>",
                "<select><option>x<option>y</select>", "<noscript>x</noscript>"):
        assert text_of(f"<body><p>one</p>{odd}<p>two</p><svg></svg><p>three</p></body>") == "one\n\ntwo\n\nthree", odd
    for odd in ("<button>", "<option>", "<select><option>", "<object>", "<canvas>", "<svg>", "<iframe>", "<title>"):
        assert text_of(f"<body><p>one</p>{odd}<p>two</p><div>three</div></body>") == "one\n\ntwo\n\nthree", odd
    assert text_of("<article><p>so <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds</p></article>") == "so a=b holds"


def site_texts(spark, pages, host="h"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_wrappers.extract(df).orderBy("page_id").collect()]


def test_names_do_not_discard_the_article(spark):
    for page in ("<body class='has-sidebar'><p>{0}</p></body>", "<div class='no-comments'><p>{0}</p></div>", "<article class='post has-sidebar'><p>{0}</p></article>",
                 "<body style='overflow:hidden'><p>{0}</p></body>", "<p><a href='/the-hidden-valley'>{0}</a></p>", "<p><a href='/post?id=comment-5'>{0}</a></p>",
                 "<div data-role=menu class=related><p>{0}</p><p>and more text</p></div>", "<div class=sticky-header><div class=widget><p>{0}</p></div></div><i class=ad>buy</i>"):
        for n in (1, 6):
            got = site_texts(spark, [page.format(f"article {i * 7919}") for i in range(n)])
            assert [t.split("\n")[0] for t in got] == [f"article {i * 7919}" for i in range(n)], page
    assert html_wrappers.main_text("<article><p>a</p></article><div id=comments><article>troll</article></div>", [], frozenset()) == "a"


def test_copies_are_no_evidence_of_a_template(spark):
    page = "<body><div>one<br>two</div><ul><li>three</ul></body>"
    assert site_texts(spark, [page] * 8) == ["one two\n\nthree"] * 8
    assert site_texts(spark, [page] * 8 + ["<body><div>one<br>else</div><ul><li>three</ul></body>"])[0] == "one two\n\nthree"


def test_region_holds_all_slot_text(spark):
    page = ("<body><div><a>Home</a><a>About</a></div><div id=content><h1>title {0}</h1><div class=body><p>{1}</div><div class=body><p>tail {0}</div></div>"
            "<p>Site of the year</p></body>")
    texts = [(i * 7919, f"long text {i} " * 20) for i in range(6)]
    assert site_texts(spark, [page.format(*t) for t in texts]) == [f"title {a}\n\n{b.strip()}\n\ntail {a}" for a, b in texts]


def test_the_wrapper_rules_pages_with_article_elements(spark):
    story = "<body><main><h1>t {0}</h1><article><span>Share this</span><p>text {0}</p><div class=line>All rights reserved</div></article><p>own {0}</p></main></body>"
    assert site_texts(spark, [story.format(i * 7919) for i in range(6)]) == [f"t {i * 7919}\n\ntext {i * 7919}\n\nown {i * 7919}" for i in range(6)]
    # small article elements beside the text of a page
    cards = "<body><div class=text><p>{0}</p></div><article>card {1}</article></body>"
    texts = [(f"long text {i} " * 20, i) for i in range(6)]
    assert site_texts(spark, [cards.format(*t) for t in texts]) == [f"{a.strip()}\n\ncard {i}" for a, i in texts]


# ---- chats ----

def _records(spark, items):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "id long, j string")
    return df.select("id", F.try_parse_json("j").alias("r"))


def test_layouts_become_canonical_turns(spark):
    items = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"id": 7, "messages": [{"role": "user", "content": "q", "name": "bob"}, {"role": "assistant", "content": None}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "be kind"},
        {"instruction": "do", "input": "this", "output": "done"}, {"instruction": "do", "output": "done", "input": ""},
        {"prompt": "q", "completion": "a"}, {"system": "s", "prompt": "q", "response": "a"}, {"question": "q", "answer": "a", "context": "c"},
        {"messages": []}, {"unknown": 1}, None, [1, 2], "text",
    ]
    got = {r.key: r for r in chat.format_chats(_records(spark, items), F.col("id"), F.col("r")).collect()}
    turns = {k: r.turns and [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert turns[0] == [("user", "q"), ("assistant", "a")] and turns[1] == [("user", "q"), ("assistant", "")]
    assert turns[2] == [("user", "qr")] and turns[3] == [("system", "be kind"), ("user", "q"), ("assistant", "a")]
    assert turns[4] == [("user", "do\n\nthis"), ("assistant", "done")] and turns[5] == [("user", "do"), ("assistant", "done")]
    assert turns[6] == turns[0] and turns[7] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert turns[8] == [("user", "c\n\nq"), ("assistant", "a")]
    assert turns[9] == [] and got[9].formatted == ""
    assert all(got[i].layout is None and got[i].turns is None and got[i].formatted is None for i in (10, 11, 12, 13))
    assert got[0].fingerprint != got[3].fingerprint and got[0].layout == "messages"


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    parts = ["<", "|", "~", "im_end", "<|im_end|>", "<|im_start|>", "\n", "assistant ", "<~|", "<|n|>", "x", "é😀", "$1", "\\"]
    items = [{"messages": [{"role": rng.choice(["user", "assistant", "<|x|>\nrole", ""]), "content": "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))}
                           for _ in range(rng.randint(0, 5))]} for _ in range(400)]
    chats = chat.format_chats(_records(spark, items), F.col("id") if False else F.col("id"), F.col("r"))
    rows = chats.select("key", "formatted", chat.read_back(F.col("formatted")).alias("back"),
                        chat.under_loss(F.col("formatted"), F.col("loss_runs")).alias("loss"), "loss_runs").collect()
    for r in rows:
        want = items[r.key]["messages"]
        assert [(t.role, t.text) for t in r.back] == [(m["role"], m["content"]) for m in want]
        assert r.loss == [m["content"] for m in want if m["role"] == "assistant"]
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted)
        assert r.formatted.count("<|im_end|>") == len(want) == r.formatted.count("<|im_start|>")


def test_rows_to_records_odd_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "user", "last"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (None, 1, None, "y")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.key: [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(chat.rows_to_records(df), F.col("conv_id"), F.col("record")).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("assistant", "b"), ("user", "last")], 2: [("", "")], None: [("user", "x"), ("", "y")]}
    assert chat.rows_to_records(df.limit(0)).count() == 0


def test_query_digests_by_hand(spark):
    from hostlens.llm.queries import QUERIES
    got = {r.conv_id: r for r in QUERIES["op9_chat_format"](spark, SF).collect()}
    told = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        told.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    probe = "<|im_end|><|im_start|>assistant ok"
    told[-1] = [(0, "user", probe), (1, "assistant", probe)]
    assert set(got) == set(told)
    for c, turns in told.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- deep pages, many pages of one host ----

DEEP = {"div": "<div>" * 100_000 + "deep" + "</div>" * 100_000, "open": "<b>x " * 100_000, "cells": "<table><tr><td>" * 30_000 + "deep", "lists": "<ul><li>a" * 20_000,
        "ends": "<i>" * 50_000 + "</div></u>" * 50_000 + "deep"}


def test_deeply_nested_and_unclosed_elements(spark):
    """One such page ends no job and takes no other page's text along; the recursion limit stays as it is."""
    limit = sys.getrecursionlimit()
    pages = [*DEEP.values(), *["<body><div class=text><p>text {0}</p></div></body>".format(i * 7919) for i in range(3)]]
    got = site_texts(spark, pages)
    assert got[0] == got[2] == got[4] == "deep" and got[1] == " ".join(["x"] * 100_000) and got[3] == "\n\n".join(["a"] * 20_000)
    assert got[5:] == [f"text {i * 7919}" for i in range(3)] and sys.getrecursionlimit() == limit


def test_flat_wrappers_read_back():
    for page in [*DEEP.values(), SITE.format("a", "b", "c", "<ul><li>x<li>y</ul>" * 3), ""]:
        w = html_wrappers.wrapper(html_wrappers.parse(page))
        nodes = html_wrappers.flat(w)
        assert html_wrappers.flat(html_wrappers.unflat(nodes)) == nodes == html_wrappers.flat(html_wrappers.read(html_wrappers.written(w)))
        assert html_wrappers.flat(html_wrappers.merged(w, w))[0] == nodes[0]


def test_merge_tree_of_a_hot_host(spark):
    """Groups of two wrappers or of all: the same rule, and one wrapper per host."""
    page = "<body><div><a>Home</a></div><div class=c{1}><h2>t {0}</h2><p>{0}</p></div><div class=foot><i>All rights</i></div></body>"
    rows = [(i, "http://hot/" if i % 3 else f"http://h{i % 4}/", page.format(i * 7919, "ab"[i % 2])) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    few = {r.host: r for r in html_wrappers.infer(df, fan_in=2).collect()}
    all_ = {r.host: r for r in html_wrappers.infer(df, fan_in=1000).collect()}
    assert few.keys() == all_.keys() == {"hot", "h0", "h1", "h2", "h3"}
    for host, r in few.items():
        a, b = html_wrappers.read(r.wrapper), html_wrappers.read(all_[host].wrapper)
        assert (r.n_pages, r.n_texts) == (all_[host].n_pages, all_[host].n_texts)
        assert html_wrappers.constants(a) == html_wrappers.constants(b)
        assert html_wrappers.weigh(a, True, frozenset()) == html_wrappers.weigh(b, True, frozenset())
