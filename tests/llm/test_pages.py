import time

import pytest

from postmatch.llm import pages

CASES = [
    ("<ul><li>A<li>B</ul>", "A\nB"),
    ("<p>a<b>b</b>c<p>d", "abc\nd"),
    ("<p>a<br>b\n c</p>", "a b c"),
    ("x &lt;b&gt; &amp;&#233;&nbsp;\n  y", "x <b> &é y"),
    ("<div class='ad'>x</div><div class=no-sidebar>y</div>", "y"),
    ("<main><header>H</header><p>t</main>z", "H\nt"),
    ("<body><header>H</header>k<form>q</form><article>c<article class=comment>no</article></article>", "c"),
    ("<script>if(a<b){'</p>'}</script>ok<STYLE>p{}</STYLE>", "ok"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<p title='>'>q</p><!-- no --><p hidden>w</p>", "q"),
    ("<article><h1>T</h1><p>a</p><aside>s</aside><section id=comments>c</section></article><p>o</p>", "T\na"),
    ("<div role=navigation>n</div><div id=cookie-notice>k</div>t", "t"),
    ("a<b", "a<b"), ("", ""), ("<html><head><title>t</title></head><body></body>", ""),
]


@pytest.mark.parametrize("source, want", CASES)
def test_single_pages(source, want):
    assert pages.Page(source).text(set()) == want


def test_odd_markup_is_quick():
    start = time.process_time()
    for source in ('<a "' * 20000, "<" * 100000, "<div>" * 20000, "</p>" * 30000, "<!--" * 30000, "<p>" * 50000,
                   "<b>" * 20000 + "</p>" * 2000, "<ul><li>" * 5000):
        pages.Page(source).text({1})
    assert time.process_time() - start < 30


def site(host, n, body):
    return [(k, f"https://{host}/p/{k}", body(k)) for k in range(n)]


def test_what_recurs_on_a_host_goes(spark):
    box = "<div class=x1>We are hiring</div>"
    rows = site("a.org", 20, lambda k: f"{box}<p>text {k}</p><div>own {k}</div>")
    rows += [(100 + k, f"http://B.org/{k}", f"{box}<p>b {k}</p>") for k in range(3)]  # too few pages
    rows += [(200, None, None), (None, "not an address", "<p>z</p>"), (300, "https://a.org/q", ""), rows[0]]
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows],
                                  "page_id bigint, url string, html string, text string, key int")
    got = pages.main_text(frame.repartition(3)).collect()
    want = []
    for i, url, _ in rows:
        if i is None:
            text = "z"
        elif i < 20:
            text = f"text {i}\nown {i}"
        elif i < 103:
            text = f"We are hiring\nb {i - 100}"
        else:
            text = ""
        want.append((i, url, text, len(text)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_article_text_stays_however_often_it_recurs(spark):
    rows = site("c.org", 12, lambda k: f"<div>menu</div><article><p>same</p><p>{k}</p><div>share us</div></article>")
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text for r in pages.main_text(frame).collect()} == {f"same\n{k}" for k in range(12)}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert pages.main_text(frame).count() == 0


def test_menus_and_adverts_go_at_any_depth():
    deep = "<div>" * 300 + "<p>story</p><nav>MENU</nav><div class=ad>ADVERT<p>more</p></div><p>end</p>" + "</div>" * 300
    assert pages.Page(f"<body>{deep}</body>").text(set()) == "story\nend"
    assert pages.Page(f"<article>{deep}</article>").text(set()) == "story\nend"


def test_long_attributes_are_no_text():
    long = "x> <y " * 10_000
    assert pages.Page(f'<p title="{long}">one</p><p title=\'{long}\'>two</p>').text(set()) == "one\ntwo"
    assert pages.Page('<p title="open>one</p><p>two</p>').text(set()) == "one\ntwo"


def test_many_unclosed_elements_take_time_in_proportion():
    began = time.perf_counter()
    page = pages.Page("<div>" * 40_000 + "x</p></span>" * 20_000)
    assert page.text(set()) and time.perf_counter() - began < 60


def test_a_teaser_does_not_hide_the_story():
    story = "<div>" + "a long story " * 20 + "</div>"
    assert pages.Page(f"{story}<article>teaser</article>").text(set()) == ("a long story " * 20).strip() + "\nteaser"
    assert pages.Page(f"<div>short</div><article>{story}</article>").text(set()) == ("a long story " * 20).strip()
