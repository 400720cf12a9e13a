import math
import random

import numpy as np

from linecensus.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a>More</a></ul></nav>
<div class="ad">Buy this wonderful thing today, it is very cheap and good for everyone.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph<br>of the <b>art</b>icle, with enough words in it.<p>Short.
<form action=x>Your name <input></form><aside>See also this other long story about something else entirely.</aside>
<p>A &lt;tag&gt; and caf&eacute;.</p></article>
<section id="comments"><article class="comment"><p>I read this very long comment and liked it a lot, thank you.</article></section>
<div class="cookie-notice">We use cookies.</div><footer>&copy; 2024</footer><script>var x="</p>";</script></body>"""
TEXT = "Title & more\nFirst paragraph of the article, with enough words in it.\nShort.\nA <tag> and café."


def test_article_without_everything_else():
    assert H.main_text(PAGE) == TEXT


def test_feeding_in_parts_gives_the_same(monkeypatch):
    for size in (1, 7, 64):
        monkeypatch.setattr(H, "FEED", size)
        assert H.main_text(PAGE) == TEXT


def test_page_without_article_takes_the_dense_region():
    long = "This is a sentence of running text that goes on for a while and has no tags in it at all. " * 3
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div class=story><p>{long}</p><p>Brief.</p><p>{long}</p></div></body>"
    assert H.main_text(page) == f"{long.strip()}\nBrief.\n{long.strip()}"


def test_lists_tables_and_quotations_in_the_text():
    long = " ".join(["word"] * 80)
    menu = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    for n in (2, 5, 12):
        items = [f"short item of the list {i}" for i in range(n)]
        inner = {
            "ul": "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>",
            "table": "<table>" + "".join(f"<tr><td>{i}</td></tr>" for i in items) + "</table>",
            "quote": "<blockquote>" + "".join(f"<p>{i}</p>" for i in items) + "</blockquote>",
        }
        for block in inner.values():
            text = f"<p>{long}</p>" * 6
            page = f"<body><div><ul>{menu}</ul></div><div>{text}{block}<div class=ad>Buy.</div>{text}</div></body>"
            assert H.main_text(page) == "\n".join([long] * 6 + items + [long] * 6)


def test_short_article_beside_a_long_one():
    long = " ".join(["word"] * 80)
    page = f"<body><article>{f'<p>{long}</p>' * 8}</article><article><p><b>Brief</b> <i>news</i>.</p></article></body>"
    assert H.main_text(page) == "\n".join([long] * 8 + ["Brief news."])


def test_form_round_the_article_and_broken_nesting():
    assert H.main_text("<form><main><p>Text in a form.</main></form>") == "Text in a form."
    assert H.main_text("<article><p><b>One<br><p>Two</article></div></p>") == "One\nTwo"
    assert H.main_text("plain &lt;text&gt; only <") != ""


LONG = " ".join(["word"] * 80)


def test_names_of_states_and_marks_round_the_page_hide_nothing():
    text = f"<p>{LONG}</p>" * 6
    whole = "\n".join([LONG] * 6)
    for page in (
        f'<div class="page no-sidebar">{text}</div>',
        f'<article class="post comments-open">{text}</article>',
        f'<body class="single comments-enabled"><article>{text}</article>',
        f'<body><form id="aspnetForm"><div class="content">{text}</div></form>',
        f'<div class="news-related-topic">{text}</div>',
        f'<article><div class="text-with-ads">{text}</div></article>',
        f'<div class="popup">{text}</div>',
        f'<div class="hasSidebar widget">{text}</div>',
    ):
        assert H.main_text(page) == whole


def test_marked_elements_beside_the_text_go():
    text = f"<p>{LONG}</p>" * 4
    for mark in (
        'class="cookie-notice"', 'id="sidebarLeft"', 'class="col ad_slot"', 'role="complementary"',
        'class="comment-list"', 'class="newsletter"', "hidden",
    ):
        for page in (f"<div>{text}<div {mark}><p>{LONG}</p></div>{text}</div>", f"<article>{text}<div {mark}><p>{LONG}</p></div>{text}</article>"):
            assert H.main_text(page) == "\n".join([LONG] * 8), mark
    form = "<form><label>Name <input></label><p>Send us a message of any length you like</p></form>"
    assert H.main_text(f"<div>{text}{form}</div>") == "\n".join([LONG] * 4)


def test_reader_comments_go_even_if_longer_than_the_article():
    comments = "".join(f'<div class="comment"><p>{LONG}</p></div>' for _ in range(9))
    assert H.main_text(f"<article><p>{LONG}</p></article><div id=comments>{comments}</div>") == LONG


def test_a_list_of_links_between_text_blocks_is_a_menu():
    text = f"<p>{LONG}</p>" * 4
    menu = "".join(f"<li><a href=/{i}>Section number {i}</a></li>" for i in range(6))
    assert H.main_text(f"<div>{text}<ul>{menu}</ul>{text}</div>") == "\n".join([LONG] * 8)
    some = "".join(f"<li>A point with a <a href=/{i}>link</a> in it</li>" for i in range(3))
    kept = ["A point with a link in it"] * 3
    assert H.main_text(f"<div>{text}<ul>{some}</ul>{text}</div>") == "\n".join([LONG] * 4 + kept + [LONG] * 4)


def test_smoothing_against_a_plain_sum():
    chance = random.Random(1)
    for n in (1, 2, 5, 9, 10, 40):
        ratios = [chance.random() * 50 for _ in range(n)]
        reach = 5
        plain = []
        for i in range(n):
            near = [j for j in range(n) if abs(i - j) <= reach]
            weights = [math.exp(-0.5 * ((i - j) / H.SIGMA) ** 2) for j in near]
            plain.append(sum(w * ratios[j] for w, j in zip(weights, near)) / sum(weights))
        np.testing.assert_allclose(H.smoothed(np.array(ratios)), plain)


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (4, "u", PAGE), (4, "u", PAGE), (5, "u", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = H.extract_text(pages).collect()
    assert [(r.page_id, r.url) for r in found] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in found[:5]] == ["", "", TEXT, TEXT, TEXT]
    assert [r.n_chars for r in found] == [len(r.text) for r in found]
    assert found[5].n_chars == 5 * 200_000 - 1
    assert H.extract_text(pages.limit(0)).collect() == []


def test_generated_pages():
    chance = random.Random(4)
    for k in range(200):
        blocks = [" ".join(["word"] * chance.randint(1, 60)) + f" {k}." for _ in range(chance.randint(1, 12))]
        menu = "".join(f"<li><a href=/x>item {i}</a></li>" for i in range(chance.randint(0, 30)))
        body = "".join(chance.choice(["<p>{}</p>", "<h2>{}</h2>", "<p><i>{}</i><br>"]).format(b) for b in blocks)
        page = f"<html><body><nav><ul>{menu}</ul></nav><article>{body}</article><footer>foot {k}</footer></body></html>"
        assert H.main_text(page) == "\n".join(blocks)
