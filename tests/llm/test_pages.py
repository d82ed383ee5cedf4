"""Operators over web pages."""

import gzip
import hashlib
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from daybook.llm import html_text, warc

FRAME = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{}</body></html>"
PROSE = "This paragraph runs on for a while, with commas, and it ends in a full stop. Then another sentence follows it."

PAGES = [
    # The article, its heading and all of its blocks, without what surrounds it.
    (
        '<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now, it is great. Really, do.</div><article><h1>A &amp; B</h1>'
        "<p><b>One  two.<br><p>Three,\n\tfour &lt;five&gt;.</p><ul><li>item<li>item 2</ul><!-- <p>no</p> --></article><footer>&copy; us, 2020.</footer>",
        "A & B\nOne two.\nThree, four <five>.\nitem\nitem 2",
    ),
    # Named parts inside main: a form, an aside, comments that are articles themselves.
    (
        f'<header><h1>Site</h1></header><div id="page" class="with-sidebar"><div class="sidebar"><p>{PROSE}</p></div><main><h2>Head</h2><p>Body, fine.</p>'
        "<aside>By the way.</aside><form>Name <input name=n></form><table><tr><td>a<td>b</table>"
        f'<section id="comments"><article class="comment"><p>{PROSE}</p></article></section></main></div>',
        "Head\nBody, fine.\na\nb",
    ),
    # No article element: the container of the running text, short blocks included.
    (
        f'<div class="menu"><a>x</a> <a>y</a></div><div class="content"><h2>Short</h2><p>{PROSE}</p><p>Ok</p><div><p>{PROSE} More.</p></div></div>'
        f'<div class="cookie-notice">We use cookies, ok? We do.</div><div id="relatedPosts"><p>{PROSE}</p></div><div role="navigation">To, the, top.</div>',
        f"Short\n{PROSE}\nOk\n{PROSE} More.",
    ),
    # One paragraph that outweighs its heading.
    (f"<article><h1>Title</h1><p>{PROSE * 9}</p></article>", f"Title\n{PROSE * 9}"),
    # A header inside the article belongs to it; hidden text doesn't.
    ('<main><article><header><h1>T</h1></header><p>Text <span hidden>not this</span>here.</p><p style="display: none">nor this</p></article></main>', "T\nText here."),
    # Scripts with tags in strings, entities without semicolon, stray and unclosed tags.
    ('<article><p>a &lt b</p></div></p><script>var t="</p><p>x</p>";</script><p>c <i>d</i>e &nbsp; f', "a < b\nc de f"),
    ('<article><p>he said <a href="x" title="a > b">"so"</a> 1 < 2 & 3 &#8364; &#x41; &unknown;</p></article>', 'he said "so" 1 < 2 & 3 € A &unknown;'),
]


@pytest.mark.parametrize("body, text", PAGES)
def test_main_text(body, text):
    assert html_text.main_text(FRAME.format(body)) == text


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain  text", "plain text"), ("<p>only</p>", "only"), ("<div" * 4000, ""), ('<a "' * 3000 + "x>y", "y"),
    ("<nav>menu</nav>", ""), ("<p>x</p><div", "x"), ("<" * 3000, "<" * 3000), ("<script>", ""), ("<!-- open", ""), ("a<br>b", "a b"),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert html_text.main_text(deep) == "x"
    long = FRAME.format("<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>")
    assert html_text.main_text(long) == "\n".join([PROSE] * 5000)


def test_paths_of_running_text_score_above_links():
    found, _ = html_text.blocks(f"<div><p><a>one</a></p><p><a>two</a></p></div><section><p>{PROSE}</p><p>{PROSE}</p></section>")
    scores = html_text.path_scores(found)
    assert [t for _, t in found] == ["one", "two", PROSE, PROSE] and min(scores[2:]) > max(scores[:2])


CARDS = "".join(f"<article><h3>Card {i}</h3><p>Read on</p></article>" for i in range(6))


@pytest.mark.parametrize("body", [
    "<div class=story>{}</div><div class=cards>" + CARDS + "</div>",
    "<div class=cards>" + CARDS + "</div><div class=story>{}</div>",
    CARDS + "<div>{}</div>" + CARDS,
    "<article><h3>Card</h3></article><div><div>{}</div></div>",
    "<div class=lists><p><a>One</a></p><p><a>Two</a></p><p><a>Three</a></p></div><div>{}</div>",
])
@pytest.mark.parametrize("story", [[PROSE], [PROSE, PROSE + " More."], ["Head", PROSE * 3, "Ok", PROSE, PROSE]])
def test_path_scores_alone_find_the_story(body, story):
    assert html_text.main_text(FRAME.format(body.format("".join(f"<p>{t}</p>" for t in story)))) == "\n".join(story)


@pytest.mark.parametrize("body, text", [
    # A title and a lead before a body that holds more than nine tenths, whatever its blocks are.
    (f'<div id=page><h1>T</h1><p class=lead>{PROSE}</p><div class=body>{f"<p>{PROSE}</p>" * 10}</div></div>', "\n".join(["T"] + [PROSE] * 11)),
    (f'<div id=page><h1>T</h1><p class=lead>{PROSE}</p><div class=body>{PROSE * 10}</div></div>', f"T\n{PROSE}\n{PROSE * 10}"),
    (f'<div id=page><h1>T</h1><p class=lead>A lead.</p><div class=body><p>{PROSE}</p></div></div>', f"T\nA lead.\n{PROSE}"),
    (f'<div class=title><h1>T</h1></div><div class=body><p>{PROSE}</p></div>', f"T\n{PROSE}"),
    # The end of the text beside the article.
    (f"<main><article><p>{PROSE * 19}</p></article><p>{PROSE}</p></main>", f"{PROSE * 19}\n{PROSE}"),
    (f"<main><article><p>{PROSE}</p></article><p>Tail.</p></main>", f"{PROSE}\nTail."),
    (f"<main><article><p>{PROSE * 19}</p></article><div><p>{PROSE}</p></div></main>", f"{PROSE * 19}\n{PROSE}"),
    # Two parts of the text with cards between, which hold no selected block; short blocks of the parts stay.
    (f"<div><div class=one><h2>One</h2><p>{PROSE}</p><p>Ok</p></div><div class=cards>{CARDS}</div><div class=two><h2>Two</h2><p>{PROSE}</p></div></div>",
     f"One\n{PROSE}\nOk\nTwo\n{PROSE}"),
    (f"<main><h1>T</h1><div class=cards>{CARDS}</div><div class=story><p>{PROSE}</p><p>Ok</p></div></main>", f"T\n{PROSE}\nOk"),
    # Nothing is dropped inside the article of the text.
    (f"<article><div><h1>T</h1></div><div><p>{PROSE}</p></div><div>x</div><div><p>{PROSE}</p></div><table><tr><td>1</table></article>", f"T\n{PROSE}\nx\n{PROSE}\n1"),
])
def test_all_selected_blocks_and_their_headings_stay(body, text):
    assert html_text.main_text(FRAME.format(body)) == text


@pytest.mark.parametrize("body, text", [
    # Anchors of headings, inline elements and sections name nothing; classes, roles and other elements' ids do.
    (f'<article><section id="discussion"><h2 id="search-api">Search</h2><p>{PROSE}</p></section><section id="related-work"><h2><span id="Notifications">Notes</span></h2>'
     f'<p>{PROSE}</p></section><section class="related"><p>{PROSE}</p></section><div id="comments"><p>{PROSE}</p></div><section id="toc"><p>Toc</p></section></article>',
     f"Search\n{PROSE}\nNotes\n{PROSE}\nToc"),
    (f'<div><h2 id="header">Head</h2><p>{PROSE} <a id="comments">See</a></p></div><section id="related"><p>{PROSE}</p></section>', f"Head\n{PROSE} See"),
    # Formulas and examples are text.
    (f"<article><p>{PROSE} With <math><mi>x</mi><mo>=</mo><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr></mtable></math> it ends.</p><xmp><p>a &amp;  b</p></xmp><p>z</p></article>",
     f"{PROSE} With x= 1 2 it ends.\n<p>a &amp; b</p>\nz"),
    (f"<article><p>{PROSE}</p><nav><xmp>no</xmp></nav><xmp hidden>no</xmp><xmp>an end </article></xmp></article>", f"{PROSE}\nan end </article>"),
    # What is nested deeper than the tree is closed by its own end tags alone, and named parts there are known.
    (f'<div><article>{"<div>" * 250}<nav>Menu</nav><p>{PROSE}</p>{"</div>" * 250}<p>After</p></article></div>', f"{PROSE}\nAfter"),
    (f'<div class="layout sidebar">{"<div>" * 250}<article><p>{PROSE}</p></article>{"</div>" * 250}</div>', PROSE),
    (f'<article><p>{PROSE} <span hidden>no <span>no</span> no</span> yes</p></article>', f"{PROSE} yes"),
])
def test_nothing_of_an_article_is_cut_by_a_word_or_a_cap(body, text):
    assert html_text.main_text(FRAME.format(body)) == text


def test_awkward_nesting_takes_linear_time():
    n = 20000
    for page in ("<div>" * n + "</p></b>" * n + "x", "<div>" * n + "<article>x</article>" * 2000, "<blockquote>" * n + "<p>x" * n, "<span hidden>" * n + "</span>" * n + "x"):
        assert html_text.main_text(page).startswith("x")


def test_extract_keeps_rows_and_columns(spark):
    rows = [(i % 3, f"u{i}", FRAME.format(b), "x") for i, (b, _) in enumerate(PAGES)] + [(None, None, None, "x"), (0, "u0", FRAME.format(PAGES[0][0]), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row string")
    got = sorted((str(r.page_id), str(r.url), r.text) for r in html_text.extract(df, ["page_id", "url"]).collect())
    assert got == sorted([(str(i % 3), f"u{i}", t) for i, (_, t) in enumerate(PAGES)] + [("None", "None", ""), ("0", "u0", PAGES[0][1])])
    assert html_text.extract(df.limit(0), ["page_id"]).isEmpty()


LONGER = "".join(f"<p>{PROSE} {i}</p>" for i in range(6))


@pytest.mark.parametrize("before, after", [
    ('<article class="post-12 type-post category-social tag-share">', "</article>"),
    ('<article id="search" class="share">', "</article>"),
    ('<div class="post tag-search">', "</div>"),
    ('<main><h1>Title</h1><div class="social-policy">', "</div></main>"),
    ('<main><h1>Title</h1><div class="comments">', "</div></main>"),
    ('<article><p class="related-work">Work of others, in a sentence, is here.</p><div class="code-comment"><p>Comments in code, too.</p></div>', "</article>"),
])
def test_topics_and_the_only_text_of_a_page_are_not_hidden_by_their_class(before, after):
    text = html_text.main_text(FRAME.format(f'{before}{LONGER}{after}<div class="cookie-notice"><p>{PROSE}</p></div>'))
    assert all(f"{PROSE} {i}" in text for i in range(6)) and text.count(PROSE) == 6
    for part in ("Work of others", "Comments in code"):
        assert (part in text) == (part in before)


@pytest.mark.parametrize("name", ["comments-area", "CommentList", "reader-comments", "related-posts", "share_buttons", "cookie-banner", "sidebar-widget", "newsletter-signup"])
def test_named_parts_are_hidden_even_if_they_are_longer(name):
    page = FRAME.format(f'<article>{LONGER}</article><div class="{name}">{LONGER.replace("<p>", "<p>Not this. ")}</div><div class="{name} x"><p>Not this.</p></div>')
    assert "Not this" not in html_text.main_text(page) and html_text.main_text(page).count(PROSE) == 6


def test_attributes_of_any_length_and_quotes_that_never_close():
    svg = "data:image/svg+xml;utf8,<svg>" + "<path d='M1 1'/>" * 3000 + "</svg>"
    assert html_text.main_text(f'<article>{LONGER}<p>one <img src="{svg}"> two</p></article>').endswith("one two")
    many = " ".join(f'data-{i}="a > b"' for i in range(400))
    assert html_text.main_text(f"<article>{LONGER}<p {many}>three, four</p></article>").endswith("three, four")
    assert PROSE in html_text.main_text(f'<article>{LONGER}<p title="open>five</p></article>')
    start = time.time()
    html_text.main_text('<a href="x>' * 100001)
    html_text.main_text("<a href='x\" >" * 100001)
    assert time.time() - start < 20


# --- WARC

LONG = "<p>ünï " + "x" * 1000 + "</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
RECORDS = [
    (1, "http://a/1", LONG), (2, "http://a/2\r\nX: y z", LONG), (9, "http://a/9", LONG), (9, "http://a/9", LONG), (3, None, "short"), (4, "u", "short"),
    (5, "u", None), (6, "u", ""), (None, "u", LONG), (7, "u", "y" * 1000), (8, "u", "y" * 999), (10, "u", "\r\n\r\n" + "z" * 1200), (11, "u", "\r\n\r\n" + "z" * 1200),
    (None, "n", "q" * 1500), (None, "n", "q" * 1500), (12, "u", "😀" * 300),
]


@pytest.fixture
def archive(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in RECORDS], "page_id long, url string, html string, payload string").repartition(3)
    return warc.write(df, str(tmp_path / "archive"))


def test_archives_come_back(spark, archive):
    got = sorted(tuple(map(str, r)) for r in warc.read(spark, *archive).collect())
    want, answered = [], set()
    for i, _, html in RECORDS:
        body = (html or "").encode()
        same = [j for j, _, h in RECORDS if h == html and j is not None]
        first = max(same, default=None) if len(body) >= warc.LEAST else i
        response = len(body) < warc.LEAST or first == i and html not in answered
        if response:
            answered.add(html)
        kind, refers = ("response", None) if response else ("revisit", first)
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), kind, refers, True))
    assert got == sorted(tuple(map(str, w)) for w in want)


def test_files_are_warc_with_unique_fresh_records(archive):
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(archive[0]).glob("part-*")))
    at, ids, kinds, named = 0, set(), [], set()
    while at < len(raw):
        head, _, rest = raw[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n" and re.fullmatch(rb"<urn:uuid:[0-9a-f-]{36}>", fields[b"WARC-Record-ID"])
        ids.add(fields[b"WARC-Record-ID"])
        kinds.append(fields[b"WARC-Type"])
        if kinds[-1] == b"warcinfo":
            info = fields[b"WARC-Record-ID"]
        else:
            assert b" " not in fields[b"WARC-Target-URI"]
            named.add(fields[b"WARC-Warcinfo-ID"])
        at += len(head) + 4 + size + 4
    # rows that repeat page and payload are records of their own, one of them a response
    assert len(kinds) == len(ids) == len(RECORDS) + 1 and named == {info}
    assert (kinds.count(b"revisit"), kinds.count(b"warcinfo")) == (6, 1)


def test_payloads_of_slots_without_revisits_stay_where_they_are(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", f"{i % 40} " + "x" * 1200) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    plan = warc.records(df, "a", "d")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan
    for slots in (1, 7, 1 << 20):  # all, some and next to no payloads pass the shuffle
        monkeypatch.setattr(warc, "SLOTS", slots)
        found = warc.read(spark, *warc.write(df, str(tmp_path / str(slots)))).collect()
        assert {(r.page_id, r.record_type, r.refers_to, r.intact) for r in found} == {
            (i, "response" if i >= 60 else "revisit", None if i >= 60 else max(j for j in range(100) if j % 40 == i % 40), True) for i in range(100)
        }


def test_an_empty_table_and_another_archive(spark, tmp_path, archive):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, *warc.write(empty, str(tmp_path / "empty"))).isEmpty()
    other = warc.write(spark.createDataFrame(RECORDS[:2], "page_id long, url string, html string"), str(tmp_path / "other"))
    assert other[1] != archive[1] and warc.read(spark, *other).count() == 2


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    path, name = warc.write(spark.createDataFrame([(1, "u", "y" * 1200), (2, "u", "y" * 1200), (3, "u", "z")], "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    lines = spark.read.option("lineSep", warc.CRLF * 2).text(path)
    broken = lines.select(F.regexp_replace("value", "y{1200}", "y" * 1199 + "x").alias("value"))
    broken.coalesce(1).write.option("lineSep", warc.CRLF * 2).option("compression", "gzip").text(str(tmp_path / "b"))
    assert {r.page_id: r.intact for r in warc.read(spark, str(tmp_path / "b"), name).collect()} == {1: True, 2: False, 3: True}
