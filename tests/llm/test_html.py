import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelight.llm import html_text as H

LONG = "A sentence that is long enough to be text, and then some more words to make it longer still. "


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain words", "plain words"),
        (f"<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One\n  two</p><p>Short.</p></article><footer>c</footer>", "T & U\n\nOne two\n\nShort."),
        ("<article><p><b>Head<br><p>Body</p><aside>x</aside><p>End &lt;b&gt;</p></article>", "Head\n\nBody\n\nEnd <b>"),
        (f"<div id='menu'><p>{LONG}</p></div><div><p>{LONG}</p></div><div class='reader-comments'><p>{LONG}</p></div>", LONG.strip()),
        (f"<body><script>var a = '<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p></body>", LONG.strip()),
        (f"<main><form><p>Subscribe {LONG}</p></form><p>Kept</p><div class='ad-slot'>Buy</div><p>Too</p></main>", "Kept\n\nToo"),
        ("<article><p>a &nbsp; b&#x41;</p></article>", "a bA"),
        ("<article><p>2 < 3 and 4 > 1</p></article>", "2 < 3 and 4 > 1"),
        ("<article><p>never closed", "never closed"),
        (f"<table><tr><td>{LONG}</td><td>{LONG}</td></tr></table>", f"{LONG.strip()}\n\n{LONG.strip()}"),
    ],
)
def test_pages(page, expected):
    assert H.main_text(page) == expected


def test_links_are_furniture_without_a_main_element():
    links = "".join(f"<li><a href='/{i}'>Some link number {i} with words</a></li>" for i in range(9))
    assert H.main_text(f"<div><ul>{links}</ul></div>" + "<div><hr></div>" + f"<div><p>{LONG}</p></div>") == LONG.strip()


@settings(max_examples=150, deadline=None)
@given(st.text("<>/pab \"'=!-&;", max_size=60))
def test_any_markup_ends(page):
    H.main_text(page)


def test_planted_articles_come_back():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeirst") for _ in range(rng.randint(1, 9)))
    for _ in range(60):
        blocks = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        page = f"<html><head><title>t</title></head><body><header>h {word()}</header><div class='ad'>{word()} {word()}</div><article>{body}</article><div class='comments'><p>{LONG}</p></div><footer>{LONG}</footer></body></html>"
        assert H.main_text(page) == "\n\n".join(blocks)


def test_long_pages_take_linear_time():
    assert H.main_text("<div " * 20_000) == ""
    assert len(H.main_text("<article>" + "<b>x" * 20_000)) == 20_000


def test_column(spark):
    df = spark.createDataFrame([(1, "<article><p>x</p></article>"), (2, None)], "page_id long, html string")
    assert [r["t"] for r in df.select(H.main_text_column(F.col("html")).alias("t")).collect()] == ["x", ""]
    assert df.limit(0).select(H.main_text_column("html").alias("t")).count() == 0


def test_short_regions_and_wrappers_named_as_furniture():
    from cuelight.llm import html_text

    long = "A paragraph that is long enough to make a region of its own on any page. " * 2
    share = "<div class='share'>Share this</div>"
    page = f"<div><h1>Title</h1>{share}<p>{long}</p>{share}<p>Short one.</p>{share}<p>{long}</p></div>"
    assert html_text.main_text(page) == "\n\n".join(["Title", long.strip(), "Short one.", long.strip()])
    for tag in ("main", "article"):
        text = f"<div class='layout sidebar-right'><nav>Menu</nav><{tag}><p>{long}</p>{share}<p>End.</p></{tag}></div>"
        assert html_text.main_text(text) == f"{long.strip()}\n\nEnd."
    assert html_text.main_text(f"<p>{long}</p><div class='comments'><article>{long} no</article></div>") == long.strip()
    assert html_text.main_text(f"<nav><main>{long}</main></nav>") == ""


def test_the_curve_chooses_regions():
    """What the curve does changes the text: links make no surge, and regions end where it dives."""
    body = "<p>" + "An article's own words go on for a while. " * 4 + "</p>"
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Another story of ours {i}</a></li>" for i in range(6)) + "</ul></div>"
    notice = "<div class=ad>Buy</div>"
    inside = f"<main>{body}{notice}{links}</main>"
    assert "Another story" not in H.main_text(inside)
    assert H.main_text(inside) == H.main_text(f"<main>{body}</main>")
    # between two surges the same region belongs to the text
    assert "Another story" in H.main_text(f"<main>{body}{notice}{links}{notice}{body}</main>")
    # a closing line that is no link stays, in a main element
    assert H.main_text(f"<main>{body}{notice}<p>The end.</p></main>").endswith("\n\nThe end.")
    # without the element, a lower floor takes more regions
    page = f"<div>{body}</div>{notice}<div><p>Twenty letters of text</p></div>"
    low = H.Blocks(surge=20)
    assert "Twenty" not in H.main_text(page) and "Twenty" in H.main_text(page, low)
    # an empty main element doesn't hide the text beside it
    assert H.main_text(f"<div>{body}</div><main></main>") == H.main_text(body)


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 100_000 + "</i>" * 200_000,
        "<i>" * 100_000 + "<b>" * 100_000 + "</i>" * 100_000,
        "<main><div class=ad>" * 50_000 + "<p>x" * 50_000,
        "<i><p>" * 50_000 + "</i>x" * 50_000,
    ],
)
def test_unmatched_and_deep_tags_take_linear_time(page):
    import time

    began = time.process_time()
    H.main_text(page[: len(page) // 4])
    quarter = time.process_time() - began
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 12 * quarter + 1
