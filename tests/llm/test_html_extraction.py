import random
import re
from html.parser import HTMLParser

import pytest

from marketlens.llm import dom, html_extraction, queries


class Article(HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "br", "article"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def brute(html):
    parser = Article()
    parser.feed(html or "")
    parser.close()
    blocks = (" ".join("".join(b).split()) for b in parser.blocks)
    return " ".join(b for b in blocks if b)


def text_of(html):
    return " ".join(" ".join(n.text) for n in dom.main_blocks(dom.parse(html)))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.op9_html_extraction(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute(pages[r.page_id].html)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b &amp; c&lt;d &#233;&#x1F642; &am", "a b & c<d é🙂 &am"),
        ("<div><h1> T </h1>x <b>y</b>z<br>w<ul><li>1<li>2</ul></div>", "T x yz w 1 2"),
        ("<body><nav>m</nav><header>h</header><main><p>a</p><aside>s</aside></main><footer>f</footer>", "a"),
        ("<article><header><h1>t</h1></header><p>a</p><div class='comments'><article>c</article></div></article>x", "t a"),
        ("<p>a</p><!-- <p>no</p> --><script>if(a<b)'</p>'</script><style>p{}</style><p>b", "a b"),
        ("<div class='cookie-notice'>c</div><div id=sidebar>s</div><form>f</form><div class='ad'>x</div><p>a", "a"),
        ('<p title="a>b">a</p><p class="x>b</p><p>c</p>', "a b c"),
        ("<p>a <span class='share'>s<b>t</b></span> b", "a b"),
        ("<p>a <span class='ad'>x</p><p>b <span class='ad'>y<p>c<div><i hidden>z</div>d", "a b c d"),
        ("<table><tr><td>1<td>2<tr><td>3</table>1 < 2 <p", "1 2 3 1 < 2"),
        ("<p>a</p><script>never closed <p>b</p>", "a"),
        ("<DIV hidden>h</DIV><P>A\n\t B</P>", "A B"),
        ("<p>a" + "<div>" * 5000 + "b", "a b"),
    ],
)
def test_pages(html, text):
    assert text_of(html) == text


def test_simple_tree_matching():
    wrapper = dom.parse("<div><h1>a</h1><p>b</p><ul><li>1</li></ul></div>")
    dom.number(wrapper)
    page = dom.parse("<div><h1>x</h1><ul><li>2</li><li>3</li></ul></div>")
    dom.align(page, wrapper)
    slots = {" ".join(n.text): n.slot for n in dom.leaves(wrapper)}
    found = {" ".join(n.text): n.slot for n in dom.leaves(page)}
    assert found["x"] == slots["a"] and slots["1"] in (found["2"], found["3"]) and -1 in (found["2"], found["3"])


def plain_matching(a, b):
    if a.label != b.label:
        return 0
    rows = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + plain_matching(x, y))
    return 1 + rows[-1][-1]


def nodes(root):
    return [root, *(n for c in root.children for n in nodes(c))]


def test_matchings_are_the_largest():
    rng = random.Random(6)

    def html(depth):
        return "".join(f"<{t}>{html(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "p", "ul", "section"], k=rng.randint(0, 4)))

    for _ in range(150):
        wrapper, page = dom.parse(html(3)), dom.parse(html(3))
        dom.number(wrapper)
        dom.align(page, wrapper)
        slots = [n.slot for n in nodes(page) if n.slot >= 0]
        assert len(slots) == len(set(slots)) == plain_matching(page, wrapper)


def test_deep_and_long_pages():
    for html in ("<div>" * 5000 + "a", "<p>a</p><h2>b</h2>" * 3000, "<p>a</p><div><p>b</p></div>" * 2000):
        wrapper, page = dom.parse("<h1>x</h1>" + html), dom.parse(html + "<ul><li>c</ul>")
        dom.number(wrapper)
        dom.align(page, wrapper)
        assert any(n.slot >= 0 for n in page.children)


def site(n):
    """Pages without telling names: only what varies is content."""
    pages = []
    for i in range(n):
        ad = f"<div><p>win prize {i}</p></div>" if i % 3 == 0 else ""
        pages.append(
            (i, f"https://User@Shop.example:80/{i}", f"<body><div><p>Our shop</p><p>Call us</p></div>{ad}<div><h2>Story {i}</h2><p>Text {i} of it</p></div><div><p>All rights</p></div>")
        )
    return pages


@pytest.mark.parametrize("limit", [html_extraction.BROADCAST_BYTES, 0])
def test_constant_blocks_are_template(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", limit)
    rows = site(30) + [(100, "https://other.example/", site(1)[0][2]), (101, None, "<p>a"), (None, "https://shop.example/x", None), (5, "https://shop.example/5", "")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, host string, slot int").repartition(3)
    found = {(r.page_id, r.url): r.text for r in html_extraction.main_text(df).collect()}
    assert len(found) == len(rows)
    for i in range(30):
        text = found[i, f"https://User@Shop.example:80/{i}"]
        assert re.fullmatch(rf"(win prize {i} )?Story {i} Text {i} of it", text), text
    assert found[100, "https://other.example/"].startswith("Our shop Call us") and found[101, None] == "a"
    assert found[None, "https://shop.example/x"] == "" and found[5, "https://shop.example/5"] == ""


def test_empty_table(spark):
    assert html_extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "html",
    ["<body class='has-sidebar'><p>a</p>", "<html class='no-banner'><p>a</p>", "<main id='login-main'><p>a</p></main>", "<article class='post social'><p>a</p></article>"],
)
def test_class_words_do_not_take_whole_pages(html):
    assert text_of(html) == "a"


def test_wrapper_named_after_what_it_holds(spark):
    pages = ["<div class='with-menu'><nav>m</nav><article><p>a</p></article></div>", "<div id='content' class='no-sidebar'><p>b</p></div>"]
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in html_extraction.main_text(df).orderBy("page_id").collect()] == ["a", "b"]


@pytest.mark.parametrize(
    "part",
    [
        "<h2 id='related-work'>t</h2>", "<h2 id='comments'>t</h2>", "<p class='notice'>t</p>", "<div class='social history'>t</div>",
        "<section class='widget-design'>t</section>", "<header class='banner'><h1>t</h1></header>", "<span class='promo'>t</span>",
        "<ul class='list menu-of-the-day'><li>t</ul>",
    ],
)
def test_article_text_is_kept_whatever_its_names(part):
    assert text_of(f"<body><nav>m</nav><article><p>first</p>{part}<p>last</p></article>") == "first t last"


@pytest.mark.parametrize("part", ["<div class='comments'>c</div>", "<ul id='share-buttons'><li>c</ul>", "<section class='related posts'>c</section>", "<div class='ad-slot-3'>c</div>"])
def test_frames_within_an_article_are_left_out(part):
    assert text_of(f"<article><p>first words</p>{part}<p>last words</p></article>") == "first words last words"


def test_text_around_teasers():
    intro = "A long introduction that is the text of this page, with a teaser after it."
    assert text_of(f"<main><p>{intro}</p><article><h2>Teaser</h2></article></main>") == f"{intro} Teaser"


def test_copies_of_a_page_do_not_become_template(spark):
    """Eight copies and another page; then a host with enough pages, one of them many times."""
    copy, other = "<div><h1>Head</h1><p>The text</p></div>", "<div><h1>Other</h1><p>More</p></div>"
    rows = [(i, "https://a.example/", copy) for i in range(8)] + [(8, "https://a.example/", other)]
    rows += [(100 + i, "https://b.example/", site(12)[i][2]) for i in range(12)] + [(200 + i, "https://b.example/", site(12)[1][2]) for i in range(60)]
    found = {r.page_id: r.text for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(9)] == ["Head The text"] * 8 + ["Other More"]
    assert {found[200 + i] for i in range(60)} == {"Story 1 Text 1 of it"} == {found[101]}


def test_template_never_takes_a_whole_page(spark):
    same = "<div><p>Nothing here yet</p></div>"
    rows = [(i, "https://a.example/", f"{same}<!-- {i} -->") for i in range(9)]
    found = html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {"Nothing here yet"}


def test_long_lists_are_matched_past_labels_without_partner():
    wrapper = dom.parse("<ul>" + "<li>a</li>" * 500 + "</ul><p>end</p>")
    page = dom.parse("<ul><div>x</div>" + "<li>a</li><div>y</div>" * 500 + "</ul><p>end</p>")
    dom.number(wrapper)
    dom.align(page, wrapper)
    assert sum(n.slot >= 0 for n in page.children[0].children) == 500
