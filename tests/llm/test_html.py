import time

import pytest

from pitchspark.llm.html_layout import extracted, page_text


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain  words\n here", "plain words here"), ("<br>", ""),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<div>a</div><div>b<div>c", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<b>x</b> <i>y</i>z", "x yz"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=9><li>a<li>b<li value=3>c", "9. a\n10. b\n3. c"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>", "Name   N\nalpha  1"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>aaaaaa<td>b<td>c</table>", "wide       z\naaaaaa  b  c"),
    ("<table>stray<tr><td>a</table>", "stray\n\na"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table>b<td>c</table>", "a        c\n\nin  ner\n\nb"),
    ("<table><caption>Cap<tr><td>a</table>", "Cap\na"),
    ("<pre>a\n   b</pre>c", "a\n   b\n\nc"),
    ("<title>t</title><style>p{}</style><script>if (a<b) '</p>'</script>x", "x"),
    ("<style>.a, #b{color:red; display : none} i{visibility:hidden}</style>"
     "<p class='z a'>no<p id=b>no<i>no</i><p class=z>yes", "yes"),
    ("<p hidden>no<p style='display:none'>no<p style='color:red'>yes", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<noscript>no</noscript><template>no</template><textarea> a\n b</textarea>", " a\n b"),
    ("a<!-- b --> c<!doctype x><?php d ?><![CDATA[e]]>f", "a cf"),
    ("&lt;p&gt; &amp; &eacute;&#x41;", "<p> & éA"),
    ("1 < 2 and <3", "1 < 2 and <3"),
    ("<p title='a > b'>x</p><p title=\"never ends>y", "x\n\ny"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"),
    ("<blockquote>a<br>b</blockquote>", "    a\n    b"),
    ("<select><option>a<option>b</select><input type=submit value=Go><input value=no>", "a\nb\nGo"),
    ("<li>alone<td>cell</b></p>", "- alonecell"),
    ("<HTML><BODY><H1>a</H2>b", "a\n\nb"),
    ("<q>x</q> <img alt=no>y", '"x" y'),
    ("<p>unfinished <a href", "unfinished <a href"),
    ("<script>never closed", ""),
    ("İ<title>x</title>y", "İy"),
])
def test_page_text(html, text):
    assert page_text(html) == text


def test_deep_and_long_pages():
    assert page_text("<div>" * 50_000 + "x") == "x"
    assert page_text("<ul><li>" * 300 + "x").endswith("- x")
    assert page_text("<b title='>" * 20_000 + "x").endswith("x")
    assert page_text("<table><tr><td>a<td colspan=1000>b<td>c</table>" * 3).count("a") == 3
    assert page_text("word " * 300_000) == ("word " * 300_000).strip()


@pytest.mark.parametrize("broken", ["<a ", "<a x='", "</b ", "<!-- ", "<p <", "<a b=\"c' "])
def test_tags_that_never_end_take_linear_time(broken):
    began = time.perf_counter()
    page_text("seen" + broken * (1_000_000 // len(broken)))
    assert time.perf_counter() - began < 5


def test_indents_are_bounded():
    for tag in ("<ul><li>x", "<blockquote>x<p>y", "<dl><dd>x"):
        page = tag * 2000
        assert len(page_text(page)) < 30 * len(page)
        assert page_text(tag * 10).count("x") == 10


def test_extracted(spark):
    rows = [(1, "u", "<p>a", "t"), (None, None, None, None), (1, "u", "<p>a", "t"), (2, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extracted(pages)
    assert out.columns == ["page_id", "url", "text", "_text"]
    assert sorted(r["_text"] for r in out.collect()) == ["", "", "a", "a"]
    assert extracted(pages.limit(0)).count() == 0
    assert extracted(pages.select("html")).columns == ["text"]


@pytest.mark.parametrize(("html", "text"), [
    ("<style>@media print{.nav{display:none}}</style><p class=nav>yes", "yes"),
    ("<style>@media (max-width:600px){.a{display:none}} .b{display:none}</style><p class=a>yes<p class=b>no", "yes"),
    ("<style>@media screen and (min-width: 40em){.a{display:none}}</style><p class=a>no<p>yes", "yes"),
    ("<style>@media (400px <= width < 50rem), print{.a{display:none}}</style><p class=a>yes", "yes"),
    ("<style>@media not print{.a{display:none}}@media not all and (color){.b{display:none}}</style>"
     "<p class=a>no<p class=b>yes", "yes"),
    ("<style>@media only screen{@media print{.a{display:none}}.b{display:none}}</style><p class=a>yes<p class=b>no", "yes"),
    ("<style>@font-face{src:url(x)}@keyframes k{from{visibility:hidden}}.b{display:none}</style><p class=b>no<p>yes", "yes"),
    ("<style>@media\nprint{.a{display:none}}@media(max-width: 9px){.a{display:none}}</style><p class=a>yes", "yes"),
    ("<style media=print>.a{display:none}</style><p class=a>yes", "yes"),
    ("<style>.menu{display:none} .menu{display:block}</style><p class=menu>yes", "yes"),
    ("<style>.menu{display:none!important} .menu{display:block}</style><p class=menu>no", ""),
    ("<style>#a{display:none} .a{display:block}</style><p class=a id=a>no<p class=a>yes", "yes"),
    ("<style>.a{display:none} p.a{display:block}</style><p class=a>yes<div class=a>no</div>", "yes"),
    ("<style>.a{display:none}</style><p class=a style='display:flex'>yes<p class=a style='color:red'>no", "yes"),
    ("<style>.a{display:none} .a{display:nonsense}</style><p class=a>no<p>yes", "yes"),
    ("<style>.m{display:none} nav .m{display:block}</style><nav><p class=m>yes</nav>", "yes"),
    ("<style>.m{display:none} nav > p.m:first-child{display:block}</style><p class=m>yes<div class=m>no</div>", "yes"),
    ("<style>.m{display:none} .d:hover .m{display:block}</style><div class=d><p class=m>no</div>", ""),
    ("<style>[hidden]{display:block}</style><p hidden>yes", "yes"),
    ("<style>nav .m{display:none} .m a[href]{visibility:hidden}</style><nav><p class=m>yes</nav>", "yes"),
    ("<style>.a{visibility:hidden} .b{visibility:visible}</style><div class=a>no<b class=b>yes</b></div>", "yes"),
    ("<svg><title>no</title><path d='M0 0'/><defs><text>no</text></defs>no<text x=1>one</text>"
     "<g><text>two<tspan>!</tspan></text></g></svg>after", "one two! after"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("<svg><path d=x><p>out</p>", "out"),
    ("<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac>"
     "<annotation encoding=tex>no</annotation></math>", "x= 1 2"),
])
def test_what_a_screen_shows(html, text):
    assert page_text(html) == text
