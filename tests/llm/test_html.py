import html
import re
import time

import numpy as np
import pytest

from strainshift.llm import html_text
from strainshift.llm.html_text import Page, extract_pages, main_text, path_scores

LONG = "This is a sentence of the article, with some words in it. "


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>One.<p>Two, three.", "One. Two, three."),
    (f"<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T&eacute;</h1><p><b>{LONG}<br><p>a \n b&nbsp;c</p></article><footer>f</footer>",
     f"Té {LONG}a b c"),
    (f"<div id=header>Site</div><div class='content no-sidebar'><h2>H</h2><p>{LONG}</p><p>Short</p><div class=comments><p>{LONG * 9}</p></div></div><div class=sidebar>s</div>",
     f"H {LONG}Short"),
    (f"<body><div class=ad>Buy this, now.</div><div><p>{LONG}</p><form>Name <input></form><script>var t='</p>'</script><p>x</p></div>", f"{LONG}x"),
    (f"<article><p>{LONG * 3}</p></article><article class=comment><p>{LONG * 20}</p></article>", (LONG * 3)[:-1]),
    (f"<div><p>{LONG}</p><table><tr><td>c1<td>c2</table><ul><li>i<li>j</ul></div><!-- {LONG} -->", f"{LONG}c1 c2 i j"),
    (f"<div><p>x < y{LONG}</p><p>in<i>li</i>ne <a href=q>l</a></p></div><style>p {{}}", f"x < y{LONG}inline l"),
    (f"<div><div class='site-notice'>We use cookies.</div><p>{LONG}</p><p aria-hidden=true>no</p><p>end</p", f"{LONG}end"),
])
def test_main_text(page, text):
    assert main_text(page) == " ".join(text.split())


@pytest.mark.parametrize("out", ["<a class='skip-link' href=#m>Out</a>", "<span class=ad>Out <span>of</span> it</span>", "<a class=share href=x>Out <b>now</b></a>",
                                 "<small class='social-icon'>Out<br>of</small>", "<span hidden>Out</span>", "<a class=share><div>Out</div></a>",
                                 "<span class=ad>Out <a class=share>of</span></a>", "<a class=share>Out <a class=share>of</a>"])
def test_inline_elements_out_end_at_their_end_tag(out):
    kept = f"{LONG}{LONG}second {LONG}".strip()
    paragraphs = f"<p>{LONG}</p><p>{LONG}</p><p>second {LONG}</p>"
    assert main_text(f"<body>{out}{paragraphs}</body>") == kept
    assert main_text(f"<body><article><div>{out}{paragraphs}</div></article></body>") == kept
    assert main_text(f"<body><div><p>{LONG}</p>{out}<p>{LONG}</p><p>second {LONG}</p></div></body>") == kept
    assert main_text(f"<div><p>{LONG}</p><p>{LONG} {out} second {LONG}</p></div>") == kept


def test_inline_elements_out_without_end_tag():
    assert main_text(f"<body><span class=ad><div>Out</span></div><p>{LONG}</p><p>next, {LONG}</p>") == f"{LONG}next, {LONG}".strip()
    assert main_text(f"<div><p>{LONG}<span class=ad>Out<p>next</p></div><p>end") == f"{LONG}next"
    assert main_text(f"<div><div>{LONG}<a class=share>Out</div><p>next, {LONG}</p></div>") == f"{LONG}next, {LONG}".strip()
    assert main_text(f"<p>{LONG}wo<span class=ad>Out</span>rd") == f"{LONG}word"


def test_path_sums():
    page = Page("<div><p>aaaa, bb.</p><p>cc</p><ul><li><a href=x>dddd</a></li></ul></div>")
    assert [(b[0], b[1], page.path_name(page.path[b[2]])) for b in page.blocks] == [("aaaa, bb.", 0, "div/p"), ("cc", 0, "div/p"), ("dddd", 4, "div/ul/li")]
    own = [11 / 2 * np.log2(2 + 2 / 2)] * 2 + [0.0]
    smooth = [(own[max(i - 1, 0)] + own[i] + own[min(i + 1, 2)]) / 3 for i in range(3)]
    fused = [(smooth[0] + smooth[1]) / 2] * 2 + [smooth[2]]
    assert np.allclose(path_scores(page), [(f + o) / 2 for f, o in zip(fused, own)])


BYLINE = "<div>Site</div><div>Motto of the site</div><div>Edition</div>"
MENU = "<ul>" + "<li><a href=x>Some menu entry</a></li>" * 5 + "</ul>"


@pytest.mark.parametrize("page, text", [
    # Nothing names the article here: paths of the paragraphs are content, the rest is not.
    (f"<body>{BYLINE}{MENU}<h1>Title</h1><p>{LONG * 3}</p><p>Short</p><p>{LONG * 2}</p><div>Imprint</div></body>", f"Title {LONG * 3}Short {LONG * 2}"),
    (f"<body><div>{MENU}{BYLINE * 9}</div><div><h2>T</h2><p>{LONG * 3}</p><ul><li>one<li>two</ul><p>{LONG * 4}</p></div><div><span>Imprint</span></div></body>",
     f"T {LONG * 3}one two {LONG * 4}"),
    (f"<table><tr><td>{MENU}</td><td><p>{LONG * 4}</p>{MENU}<p>{LONG * 2}</p></td><td>Weather</td></tr></table>", LONG * 6),
    # Sections of unequal length are one article.
    (f"<div><div>{BYLINE * 9}</div><div><section><p>{LONG * 9}</p><p>{LONG}</p></section><section><p>{LONG * 4}</p><p>{LONG * 2}</p></section></div></div>", LONG * 16),
])
def test_pages_without_telling_names(page, text, monkeypatch):
    want = " ".join(text.split())
    assert main_text(page) == want
    monkeypatch.setattr(html_text, "path_scores", lambda p: np.ones(len(p.blocks)))
    assert main_text(page) != want  # the ratios decide


@pytest.mark.parametrize("tag", ["p class='side note'", "p class=legal", "div class=tags-list", "section id=discussion", "div class=copyright", "div class='widget text'"])
def test_vague_names_inside_content_stay(tag):
    end = tag.split()[0]
    for text in ("In short.", LONG.strip()):
        assert main_text(f"<article><p>{LONG}</p><{tag}>{text}</{end}><p>{LONG}</p></article>") == f"{LONG}{text} {LONG}".strip()
        assert main_text(f"<body><div><p>{LONG}</p><{tag}>{text}</{end}><p>{LONG}</p></div></body>") == f"{LONG}{text} {LONG}".strip()


@pytest.mark.parametrize("tag", ["div class=ad", "div class='cookie-notice'", "div id=comments", "nav", "aside", "form", "div class=sidebar", "div role=navigation", "div style='display: none'"])
def test_named_parts_go_wherever_they_are(tag):
    end = tag.split()[0]
    for text in ("In short.", LONG * 20):
        part = f"<{tag}><p>{text}</p></{end}>"
        for page in (f"<body>{part}<article><p>{LONG}</p><p>{LONG}</p></article></body>", f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>",
                     f"<body><div><p>{LONG}</p>{part}<p>{LONG}</p></div></body>", f"<body><p>{LONG}</p><p>{LONG}</p>{part}</body>"):
            assert main_text(page) == (LONG * 2).strip()


def test_lowered_paths_are_paths_of_their_own():
    page = Page("<div><p>aaaa, bb.</p><p class=legal>aaaa, bb.</p><p class=ad>aaaa, bb.</p></div>")
    assert [page.path_share[page.path[e]] for *_, e in page.blocks] == [1.0, 0.25, 0.0]
    own = np.array([1, 0.25, 0]) * 9 * np.log2(2 + 2)
    smooth = [(own[max(i - 1, 0)] + own[i] + own[min(i + 1, 2)]) / 3 for i in range(3)]
    assert np.allclose(path_scores(page), [(smooth[0] + own[0]) / 2, (smooth[1] + own[1]) / 2, -1])


def test_work_grows_with_the_page():
    def seconds(make, n):
        page, at = make(n), time.perf_counter()
        main_text(page)
        return time.perf_counter() - at

    for make in (lambda n: "<div>text, " * n, lambda n: "<a " * n, lambda n: "<a '>' " * n, lambda n: "<x>" * n + "</y>" * n, lambda n: "<i>" * n + "</b>" * n + "x",
                 lambda n: "<b>x<div>" * n, lambda n: "<p>x, <b>y</p>" * n):
        assert seconds(make, 40000) < 12 * max(seconds(make, 10000), 0.05)


def test_tags_that_do_not_end():
    assert main_text(f"<p>{LONG}</p><p>x <a 'q <b>y</b>") == f"{LONG}x y"
    assert main_text(f"<p>{LONG}</p><p>x <a '>' y") == f"{LONG}x ' y"


def test_long_and_deep_pages_end():
    assert len(main_text("<div>" * 20000 + LONG + "</div>" * 20000)) == len(LONG) - 1
    assert main_text("<p>" + "w, " * 300000 + "</p>").count("w") == 300000


def test_table_rows(spark, sf):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", f"<p>{LONG}</p>", "x"), (3, "u", f"<p>{LONG}</p>", "x"), (None, "u", "é", "x")],
                               "page_id bigint, url string, html string, text string")
    rows = sorted(map(tuple, extract_pages(df).collect()), key=str)
    assert rows == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", LONG[:-1], len(LONG) - 1), (3, "u", LONG[:-1], len(LONG) - 1), (None, "u", "é", 1)], key=str)
    assert extract_pages(df.limit(0)).count() == 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():  # these pages say where their article is
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert main_text(r.html) == want
