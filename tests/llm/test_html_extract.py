import re
from html import unescape

import pytest

from admitflow.llm.html_extract import extract, main_text
from admitflow.session import read

SCHEMA = "page_id long, url string, html string, text string, host int, main string"
FRAME = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{margin:0}}</style><script>var t=\"</p><article>no\";</script></head><body><header class=top>Site</header>"
    "<nav><ul><li><a href='/'>Home</a></ul></nav><div class=\"cookie-notice\">We use cookies</div><div class='ad'>Buy</div><article><h1>A &amp; B</h1>{body}"
    "<aside>Related</aside><form><input><p>Sign up</p></form><section class='comments'><p>First!</p></section></article><div id=sidebar>More</div><footer>&copy; x</footer></body></html>"
)


def test_extract():
    html = FRAME.format(body="<p>One <b>bold</b>\n  word&nbsp;&lt;x&gt;<br>next<p>Two &quot;q&quot; 1 < 2 &amp<ul><li>item</li><li>it<i>e</i>m</ul><!-- <p>no</p> --><div title='a>b'>deep</div>")
    assert extract(html) == 'A & B\n\nOne bold word <x> next\n\nTwo "q" 1 < 2 &\n\nitem\n\nitem\n\ndeep'
    assert extract(None) == extract("") == extract("<script>x</script>") == ""
    assert extract("plain &eacute; text") == "plain é text"
    assert extract("<div><p>cut <b>off") == "cut off"
    assert extract("<article><div style='overflow:hidden' data-x=hidden class='overflow-hidden'>seen</div><div style='display: none'>no</div><p hidden>no</p>x</article>") == "seen\n\nx"
    assert extract("<article><p>open <!-- never closed <p>x</p>") == "open"
    assert extract("<body><div class=x><p>Real text that is long.</p></div><div class=y><a href=z>link</a></div></body>") == "Real text that is long."


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example.com:80/{i}", FRAME.format(body=f"<p>text {i}</p>")) for i in range(6)]
    rows += [(10, None, None), (11, "http://h0.example.com/x", ""), (12, "nothing", "<p>alone"), (12, "nothing", "<p>alone"), (13, "http://big.example.com/", f"<article>{'<p>word word</p>' * 20_000}</article>")]
    got = main_text(spark.createDataFrame([(*r, "c", 1, "c") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == f"A & B\n\ntext {i}" and by[i].n_chars == len(by[i].text) for i in range(6))
    assert by[10].text == by[11].text == "" and by[12].text == "alone" and by[13].text.count("\n\n") == 19_999


def test_empty(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    want = {}
    for r in pages.collect():  # these pages hold one article of headings and paragraphs
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1|li|ul)>", body)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    for r in main_text(pages).collect():
        assert r.text == want[r.page_id]


def frames(spark, pages):
    rows = [(i, f"http://one.example.com/{i}", html, "c", 1, "c") for i, html in enumerate(pages)]
    return [r.text for r in sorted(main_text(spark.createDataFrame(rows, SCHEMA)).collect())]


def test_template_without_names(spark):
    """Menu and copyright lines carry no name: their text repeats, so it is template; the slot between is what varies."""
    page = "<html><body><div class=x1>menu of the site</div><div class=x2><h1>Title {0}</h1><p>text {0} of this page</p></div><div class=x3>all rights kept</div></body></html>"
    assert frames(spark, [page.format(i) for i in range(4)]) == [f"Title {i}\n\ntext {i} of this page" for i in range(4)]


def test_mixed_layouts_have_a_slot_each(spark):
    shells = ["<article>{0}</article>"] * 4 + ["<main>{0}</main>"] * 3 + ["<div class=post>{0}</div>"] * 3
    pages = [f"<html><body><nav>n</nav><div id=w>{s.format(f'<h1>T{i}</h1><p>text {i} is here for a while</p><p>All rights kept</p>')}</div><div class=z{i % 2}>go on</div></body></html>" for i, s in enumerate(shells)]
    assert frames(spark, pages) == [f"T{i}\n\ntext {i} is here for a while" + "\n\nAll rights kept" * (i < 7) for i in range(10)]


def test_copies_on_one_host_keep_their_text(spark):
    page = "<html><body><nav>n {0}</nav><article><h1>Same</h1><p>the same long text on all of them</p><p>ends here</p></article></body></html>"
    assert set(frames(spark, [page.format(i) for i in range(6)])) == {"Same\n\nthe same long text on all of them\n\nends here"}


def test_names_judge_containers_only():
    html = "<article><p class='share price'>Up</p><p id='promotion'>Moved</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><div class='main-content no-sidebar'>kept</div><div class='share'>Tweet</div></article>"
    assert extract(html) == "Up\n\nMoved\n\nso x=2\n\nkept"


STRANGE = "post-comments article-comments content-sidebar entry-share article-footer story-ads comment-body sidebar-content main-nav post_share shareButtons ad-container cookie-bar newsletter-box side-bar ad-2 articleComments entry-meta-share".split()
KEPT = "social-impact share-price ad-hoc no-sidebar has-comments main-content entry-content login-security navigation-systems article-header footer-design comment-culture story post".split()


@pytest.mark.parametrize("name", STRANGE)
def test_boilerplate_named_as_content_too_goes(name):
    for attribute in ("class", "id"):
        assert extract(f"<article><h1>T</h1><p>Text of it.</p><div {attribute}='{name}'><p>Strange words.</p></div></article>") == "T\n\nText of it."
        assert extract(f"<body><div class=post><h1>T</h1><p>Text of it, long enough.</p><div {attribute}='x {name}'><p>Strange words.</p></div></div></body>") == "T\n\nText of it, long enough."


@pytest.mark.parametrize("name", KEPT)
def test_subjects_stay(name):
    for attribute in ("class", "id"):
        assert extract(f"<article><h1>T</h1><p>Text.</p><section {attribute}='{name}'><p>More of it.</p></section></article>") == "T\n\nText.\n\nMore of it."


def test_doubtful_names_need_links_or_a_place_outside():
    for name in ("id='reactions'", "class='related work'", "class=menu", "id=related", "class='post-related'"):
        assert extract(f"<article><h1>T</h1><section {name}><p>Acid meets base.</p></section></article>") == "T\n\nAcid meets base."
        assert extract(f"<article><h1>T</h1><p>Text.</p><section {name}><p><a href=x>Acid</a> and <a href=y>base</a></p></section></article>") == "T\n\nText."
        assert extract(f"<body><article><h1>T</h1><p>Text.</p></article><section {name}><p>Acid meets base.</p></section></body>") == "T\n\nText."
        assert extract(f"<body><div class=x><h1>T</h1><p>A paper without an article element.</p><section {name}><p>Acid meets base.</p></section></div></body>") == "T\n\nA paper without an article element.\n\nAcid meets base."


def test_a_name_never_takes_the_article_away():
    assert extract("<div class='content-sidebar-wrap'><main><h1>T</h1><p>Text.</p></main><div class=sidebar>no</div></div>") == "T\n\nText."
    assert extract("<div id=widget><h1>T</h1><p>Text.</p></div>") == "T\n\nText."
    assert extract("<div class=comments-page><h1>T</h1><p>Text.</p><div class=comments><article class=comment-body><p>First!</p></article></div></div>") == "T\n\nText."


def test_deep_nesting_is_linear():
    assert extract("<div>" * 100_000 + "x" + "</b></div>" * 100_000) == "x"
    assert extract("<article>" + "<p>a</i>" * 50_000 + "</article>").count("a") == 50_000
