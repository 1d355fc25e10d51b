import pytest

from spanloom.llm import html_text
from spanloom.llm.html_text import extract, main_text

LONG = "The cat and the dog went to the park with a ball that was in the shed of the house, and it is what it was for all of them."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article_element():
    html = page(f"<nav><ul><li><a href=/a>a</a></li></ul></nav><!-- ad --><div class='ad'>{LONG}</div><article><h1>Head</h1><p><b>{LONG}<br><p>Of.</p><ul><li><a href=1>some other page to read next</a></ul>"
                f"<div class='reader-comments'><p>{LONG}</div></article><aside>{LONG}</aside><footer>&copy; x</footer>")
    assert main_text(html) == f"Head\n\n{LONG}\n\nOf."


def test_page_without_article_element():
    html = page(f"<header><p>{LONG}</header><div id=cookie-notice>{LONG}</div><div><h2>Title here</h2><p>{LONG}<p>Yes &eacute; &lt;b&gt; &amp;<p>{LONG}</div><div><a href=1>link one</a> <a href=2>link two and three</a></div>"
                f"<form>{LONG}</form><p>Log in | Sign up | Terms | 12 34 | Imprint | Careers | Press | Jobs | Map | RSS</p><footer>{LONG}</footer>")
    assert main_text(html) == f"Title here\n\n{LONG}\n\nYes é <b> &\n\n{LONG}"


@pytest.mark.parametrize("wrapper", ["main class='content has-sidebar'", "article class='post no-comments'", "div class='layout-with-sidebar'", "div class='ad-free'", "div class='sidebar-layout'",
                                     "div class='elementor-widget elementor-widget-text-editor'", "div class=widget", "div class='share search notice'", "div class=sidebar", "div id=post-comments", "form"])
def test_a_mark_is_no_verdict(wrapper):
    text = f"{LONG} {LONG}"
    html = page(f"<nav><a href=1>one</a></nav><{wrapper}><h2>Title here</h2><p>{text}<p>Yes.<p>{text}</{wrapper.split()[0]}><footer>{LONG}</footer>")
    assert main_text(html) == f"Title here\n\n{text}\n\nYes.\n\n{text}"


def test_marks_around_articles():
    text = f"{LONG} {LONG}"
    assert main_text(page(f"<div class=sidebar><div id=comments><article><p>{text}<p>Yes.</article></div></div>")) == f"{text}\n\nYes."
    assert main_text(page(f"<article><p>{text} {text}</p><div id=comments><article class=comment><p>{text}</article></div></article>")) == f"{text} {text}"
    assert main_text(page(f"<div><p>{text}</p></div><div class=sidebar><p>{text} no</p></div>")) == text


def test_the_article_element_is_one_feature():
    text, links = f"{LONG} {LONG}", "Log in | Sign up | Terms | 12 34 | Imprint | Careers | Press | Jobs | Map | RSS"
    cards = "".join(f"<article><h3><a href={i}>Some other page to read next</a></h3><p>Teaser of it.</p></article>" for i in range(3))
    assert main_text(page(f"<div><h1>Head</h1><p>{text}<p>{LONG}<p>{text}</div><p>{links}</p>{cards}")) == f"Head\n\n{text}\n\n{LONG}\n\n{text}"
    assert main_text(page(f"<article><p>{text}<p>{text}</article><p>{links}</p><div><p>{text}<p>{LONG}<p>Of.</div>")) == "\n\n".join([text] * 3 + [LONG, "Of."])
    assert main_text(page(f"<main><h1>Head</h1><article><p>{text}<p>Of.</article><div><p>{links}</p><p>Jobs</p></div></main>")) == f"Head\n\n{text}\n\nOf."
    assert main_text(page(f"<article><p>{text}<p><a href=1>{LONG}</a><p>Of.<p>{links}<aside>{LONG}</aside></article>")) == f"{text}\n\n{LONG}\n\nOf.\n\n{links}"
    assert main_text(page("<article><p>" + "kissa istuu matolla ja nukkuu " * 9 + "<p>" + "koira juoksee " * 9 + f"</article><footer>{LONG}</footer>")).count("koira") == 9


FOREIGN = {
    "fi": "Kissa istui matolla ja katseli ikkunasta, kun lumi satoi hiljalleen pihalle. Koira nukkui uunin vieressä eikä välittänyt mistään. ",
    "pl": "Kot siedział przy oknie i patrzył, jak śnieg powoli pada na podwórko. Pies spał obok pieca i niczym się nie przejmował. ",
    "tr": "Kedi pencerenin önünde oturmuş, karın bahçeye yavaşça yağışını izliyordu. Köpek sobanın yanında uyuyordu. ",
    "ru": "Кот сидел у окна и смотрел, как снег медленно падает во двор. Собака спала у печки и ни о чём не беспокоилась. ",
    "zh": "猫坐在窗边，看着雪慢慢地落在院子里。狗睡在炉子旁边，什么都不在乎。",
    "ar": "جلست القطة بجانب النافذة تراقب الثلج وهو يتساقط ببطء في الفناء. نام الكلب بجوار الموقد ولم يهتم بشيء. ",
}


@pytest.mark.parametrize("language", FOREIGN)
@pytest.mark.parametrize("wrapper", ["div", "article"])
def test_languages_without_listed_stop_words(language, wrapper):
    text = (FOREIGN[language] * 8)[:400].strip()
    html = page(f"<nav><a href=1>{text[:9]}</a> <a href=2>{text[:12]}</a></nav><{wrapper}><h1>{text[:20].strip()}</h1><p>{text}</p><p>{text[:30].strip()}</p><p>{text}</p></{wrapper}><div><a href=3>{text[:90]}</a></div><footer>{text}</footer>")
    assert main_text(html) == "\n\n".join([text[:20].strip(), text, text[:30].strip(), text])


@pytest.mark.parametrize("wrapper", ["div", "article"])
def test_code_takes_the_side_of_its_neighbours(wrapper):
    text, code = f"{LONG} {LONG}", "def f(x):\n    return [y ** 2 for y in x if y % 3 == 1] + [len(x)] * 12"
    html = page(f"<{wrapper}><p>{text}</p><pre><code>{code}</code></pre><p>{text}</p></{wrapper}><footer><pre>{code}</pre></footer>")
    assert main_text(html) == f"{text}\n\n{' '.join(code.split())}\n\n{text}"


def test_first_pass_on_labelled_blocks():
    """The rules of the first pass, block by block: in, out or open."""
    listed, cards = f"{LONG} {LONG}", "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron"
    for text, links, code, foreign, label in [(listed, 0, False, False, True), (LONG, 0, False, False, True), (listed, len(listed), False, False, False), ("Short one.", 0, False, False, None), (cards, 0, False, False, False),
                                              (cards, 0, True, False, None), (FOREIGN["fi"] * 2, 0, False, True, True), (FOREIGN["fi"] * 2, 300, False, True, False), (FOREIGN["fi"][:60], 0, False, True, None),
                                              (cards * 4, 0, False, True, None), ("", 0, False, True, None)]:
        assert html_text.plain_pass(html_text.Block(text, links, "", False, code=code), html_text._stops(text), foreign) is label, text


def test_ties_of_the_second_pass_go_to_the_earlier_block():
    make = lambda heading=False: html_text.Block("x", 0, "", heading)
    for labels, heading, want in [([True, None, False], False, True), ([False, None, True], False, False), ([False, None, True], True, True), ([None, True], False, True), ([True, None, None, False], False, True)]:
        found = [make(heading) for _ in labels]
        assert html_text.second_pass(found, labels, False)[labels.index(None)] is want


def test_nested_main_and_article():
    assert main_text("<main><main><p>one</p></main></main>") == main_text("<article><main>one") == main_text("<main><article>one") == "one"


def test_hard_pages():
    assert main_text(None) == main_text("") == main_text("   ") == main_text("<p></p>") == ""
    assert main_text("a < b &amp &#65;") == "a < b & A"
    assert main_text("<article><p>a\n\t b</p><p>open <i>c") == "a b\n\nopen c"
    assert main_text("<article><p title='x > y'>one</p></div></section><p>two</article>") == "one\n\ntwo"
    assert main_text("<article>x<script>if (a<b) {") == "x"
    assert main_text("<article><p>" + "word " * 100_000 + "</article>") == ("word " * 100_000).strip()
    assert main_text("<article>" + "<div>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize("part", ["<", '<a href="x ', "<a title='", "<div>", "<script>", "<!--", "</div>", "<p "])
def test_broken_markup_takes_linear_time(part):
    main_text(part * 50_000)


def test_table(spark):
    rows = [(1, "u", "<article><p>é x</p></article>", "c"), (2, None, None, "c"), (None, "v", "", None), (4, "w", "<article>same</article>", "c"), (4, "w", "<article>same</article>", "c")]
    out = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, id string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in out.collect()) == [(-1, "v", "", 0), (1, "u", "é x", 3), (2, "", "", 0), (4, "w", "same", 4), (4, "w", "same", 4)]
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pages_of_the_given_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    have = {r.page_id: r.text for r in extract(pages).collect()}
    for p in pages.collect():
        inside = re.search("<article>(.*?)(</article>|$)", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert have[p.page_id] == "\n\n".join(x for x in parts if x)
