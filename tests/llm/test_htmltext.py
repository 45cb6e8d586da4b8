import re
from html import escape

import pytest

from quarry.llm.htmltext import P, deduced, extracted, main_text, parse
from quarry.llm.queries import op6_main_text

SCHEMA = "page_id long, url string, html string, text string, host string, texts string"


def text_of(page):
    blocks = [b for b in parse(page) if not b.out]
    level = max((b.main for b in blocks), default=0)
    return "\n\n".join(b.text() for b in blocks if b.main == level)


def test_parse_cases():
    cases = {
        "<p>a  b\n c<p>d": "a b c\n\nd",
        "<article><h1>T &amp; U</h1><p><b>x<br>y</article>tail": "T & U\n\nx y",
        "<nav>n</nav><main><p>m</p><aside>s</aside><p>q</p></main><footer>f</footer>": "m\n\nq",
        "<article><p>one</p><div class='comments'><article><p>no</p></article></div></article>": "one",
        "<article><p>one</p></article><section id=comments><article class=comment>no</article></section>": "one",
        "<article>a<form>f<input></form><script>if (a < b) { x('</p>') }</script><style>p{}</style>z</article>": "a\n\nz",
        "<article><p>1 < 2 &lt;b&gt; &eacute;&#233;&#xe9; &nope; &amp;amp;</p><!-- <p>c</p> --></article>": "1 < 2 <b> ééé &nope; &amp;",
        "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>": "a\n\nb\n\nc\n\nd",
        "<article><div class='cookie-notice'>n</div><p>a <span>b</span><em>c</em></p></article>": "a bc",
        "<title>t</title><p title='a > b'>x</p><div hidden>h</div><div role=alert>r</div>": "x",
        "<article><p>a&nbsp;  b</p></article>": "a b", "plain text": "plain text", "<": "<", "<p": "", "<article": "", "<!--": "", "": "", "<script>x": "", "a <![CDATA[b<c]]> d": "a b<c d",
    }
    for page, want in cases.items():
        assert text_of(page) == want, page


def test_raw_content_is_no_markup():
    cases = {
        "<script>for(i=0;i<n;i++){f()}</script><article>a<p>b</article>": "a\n\nb",
        "<article>a<SCRIPT>x='<!--'; if(i<n)y</Script >b<style>a<b{}</STYLE\n>c</article><script>i<n</script>": "abc",
        "<article>a<script>s('</scripted>'+\"<p title='\")</script>b</article><p>tail": "ab",
        "<article>a<template><script>i<n</template></script><p>t</p></template>b<svg><path d='</svg>'/><!-- </svg> --></svg>c</article>": "abc",
        "<article>a<textarea><!-- <p></textarea>b<iframe/>c<script>i<n": "abc",
    }
    for page, want in cases.items():
        assert text_of(page) == want, page


def test_template_of_unmarked_pages(spark):
    def page(i, extra=""):
        return f"<html><body><div class=x>Site of things</div><div class=y>Call us today</div><div class=z>Terms</div><div class=body><div>Own text {i}</div><div>Common line</div>{extra}</div></body></html>"

    rows = [(i, f"http://h.example.com/{i}", page(i, "<div>Common only here</div>" if i % 4 == 0 else ""), "", "", "") for i in range(12)]
    rows += [(100, "http://other.example.com/", page(0), "", "", ""), (101, None, page(1), "", "", ""), (102, "http://h.example.com/x", None, "", "", ""), (None, "", "", "", "", ""), (5, "http://h.example.com/5", page(5), "", "", "")]
    got = main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    assert by[3, "http://h.example.com/3"].text == "Own text 3"
    assert by[4, "http://h.example.com/4"].text == "Own text 4\n\nCommon only here"
    assert by[100, "http://other.example.com/"].text.startswith("Site of things")
    assert by[102, "http://h.example.com/x"].text == "" and by[None, ""].n_chars == 0
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_an_article_stay(spark):
    rows = [(i, f"https://h.example.org/{i}", f"<html><body><nav>n{i}</nav><article><h1>Same</h1><p>{escape('a < b')}</p></article><footer>f</footer></body></html>", "", "", "") for i in range(30)]
    assert {r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Same\n\na < b"}


@pytest.mark.parametrize("marked", [1, 8])
def test_template_of_a_host_with_marked_pages(spark, marked):
    """Marked pages with the host's frame leave its template to the pages without a mark."""

    def page(i):
        own = f"<article><p>Own text {i}</p></article>" if i < marked else f"<div class=body><div>Own text {i}</div></div>"
        return f"<html><body><div class=x>Site of things</div><div class=y>Call us today</div><div class=z>Terms</div>{own}</body></html>"

    rows = [(i, f"http://h.example.com/{i}", page(i), "", "", "") for i in range(12)]
    assert {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: f"Own text {i}" for i in range(12)}


def test_template_inside_marked_parts(spark):
    def page(i):
        return f"<html><body><p>Site</p><main><div>Share this story</div><article><h1>Title {i}</h1><div class=x>Call us today</div><p>Own text {i}</p><div class=y>Terms</div></article></main></body></html>"

    rows = [(i, f"http://h.example.com/{i}", page(i), "", "", "") for i in range(12)]
    rows += [(i, f"http://h.example.net/{i}", f"<main><article><p>Same</p></article><div>Of day {i}</div></main><div>Tail {i}</div>", "", "", "") for i in range(20, 32)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Title {i}\n\nOwn text {i}" for i in range(12)} | {i: f"Same\n\nOf day {i}" for i in range(20, 32)}


def test_table_against_plain_reading(spark):
    import html

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op6_main_text(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_very_long_page():
    page = "<article>" + "<p>word " * 50_000 + "<div>" * 3000 + "x"
    assert text_of(page).count("word") == 50_000


def stripped(page):
    """The page without any mark: no element that says what it is for, no class, id or role."""
    page = re.sub(r"<(/?)(?:nav|article|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"<(div|p|ul|li|span)\s[^>]*>", r"<\1>", page)


def test_table_without_marks(spark):
    """The template alone finds the same text on nearly all pages."""
    sf = "/root/testdata/sf0.01"
    want = {(r.page_id, r.url): r.text for r in op6_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert not any(re.search("article|class=|<nav|<footer", stripped(r.html)) for r in pages)
    rows = [(r.page_id, r.url, stripped(r.html), "", "", "") for r in pages]
    got = {(r.page_id, r.url): r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    same = sum(got[k] == want[k] for k in want) / len(want)
    print("pages with the same text without marks", same)
    assert same >= 0.95


def test_repeated_pages_keep_their_text(spark):
    page = "<html><body><div>Site</div><div><h1>T</h1><p>Own text of it</p></div></body></html>"
    for n in (1, 2, 3, 4, 7):
        rows = [(i % 2, f"http://h.example.com/{i % 2}", page, "", "", "") for i in range(n)]
        assert [r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()] == ["T\n\nOwn text of it"] * n
    other = [(9, f"http://h.example.com/o{i}", page.replace("Own", f"Other {i}").replace("T<", f"T{i}<"), "", "", "") for i in range(5)]
    got = main_text(spark.createDataFrame(rows + other, SCHEMA)).collect()
    assert sorted(r.text for r in got) == sorted(["T\n\nOwn text of it"] * 7 + [f"T{i}\n\nOther {i} text of it" for i in range(5)])


def plain_template(pages, share=0.5, least=3, size=3):
    """Template texts from occurrence vectors held whole: (path, text) of the root's class and of the classes nested into it."""
    from quarry.llm.htmltext import tree_of

    pages = list(dict.fromkeys(pages))
    vectors = {}
    for i, page in enumerate(pages):
        blocks = [b for b in parse(page) if not b.out]
        for token in [("path", p) for p in tree_of(blocks).weight] + [("text", b.path, b.text()) for b in blocks]:
            v = vectors.setdefault(token, [0] * len(pages))
            v[i] += 1
    if len(pages) < least:
        return set()
    classes = {}
    for token, v in vectors.items():
        classes.setdefault(tuple(v), set()).add(token)
    every = (1,) * len(pages)
    frame, inside = {t[1] for t in classes[every] if t[0] == "path"}, {every}
    grown = True
    while grown:
        grown = False
        for v, ts in classes.items():
            if v in inside or len(ts) < size or sum(map(bool, v)) < max(least, share * len(pages)):
                continue
            shortest = min((t[1] for t in ts), key=len)
            while shortest not in frame:
                shortest = shortest.rpartition("/")[0]
            if all(t[1] == shortest or t[1].startswith(f"{shortest}/") for t in ts):
                inside.add(v)
                frame |= {t[1] for t in ts if t[0] == "path"}
                grown = True
    return {t[1:] for v in inside for t in classes[v] if t[0] == "text"}


def test_templates_against_whole_vectors(spark):
    """Classes by hashes summed over pages are those of the vectors themselves, with nested ones and repeated pages."""
    import random

    from pyspark.sql import functions as F

    from quarry.llm.htmltext import _token, templates

    rng, rows = random.Random(4), []
    for h in range(8):
        for i in range(rng.choice([2, 3, 6, 12])):
            inner = "".join(f"<li>offer {k}</li>" for k in range(4))
            box = f"<div><ul>{inner}</ul><div><p>deep a</p><p>deep b</p><p>deep c</p></div></div>" if rng.random() < 0.7 else ""
            page = f"<div><p>Site {h}</p></div><div><h1>Title {i}</h1><p>{rng.choice(['Same', f'Own {i}'])}</p></div>{box}<div>Foot</div>"
            rows += [(f"h{h}", page)] * rng.choice([1, 1, 1, 2, 3])
    df = spark.createDataFrame(rows, "host string, html string").withColumn("page", F.xxhash64("html"))
    df = df.join(df.groupBy("host", "page").agg(F.count("*").alias("rows")), ["host", "page"])
    got = {r.host: set(r.texts) for r in templates(df).collect()}
    for h in {r[0] for r in rows}:
        assert got.get(h, set()) == {_token("text", *t) for t in plain_template([p for k, p in rows if k == h])}, h


def test_fractions_of_rows_add_up():
    assert all(r * pow(r, -1, P) % P == 1 for r in (1, 2, 3, 1000, 10**9))


def test_marks_among_paragraphs():
    page = "<body><p>Of the day</p><article><h1>T</h1><div><p>long body of it, long body of it</p><p>more</p></div></article><p>Of the night</p></body>"
    assert extracted(page, set(), None) == "T\n\nlong body of it, long body of it\n\nmore"
    assert extracted(page.replace("article", "main"), set(), None) == "T\n\nlong body of it, long body of it\n\nmore"
    assert extracted("<div><a>x</a></div><article><p><a>one</a></p><p><a>two</a></p></article>", set(), None) == "one\n\ntwo"


def test_tree_alone():
    page = "<div><a href=x>one</a> <a href=y>two two two two two</a></div><div><h1>T</h1><div><p>body of it</p></div></div><div>short</div>"
    assert extracted(page, set(), None) == "T\n\nbody of it"
    assert deduced([{"token": 1, "kind": "path", "path": "", "vector": 1, "weight": 0, "headed": 0, "main": 0}]) == ([], "")


def test_templates_too_large_to_broadcast(spark):
    """The same rows when templates are joined by host, a large one's pages dealt to several tasks."""
    rows = [(i, f"http://h{i % 3 if i % 5 else 0}.example.com/{i}", f"<div><p>Site</p></div><div><h1>Title {i}</h1><p>Own text {i}</p></div><div>Foot</div>", "", "", "") for i in range(60)]
    rows += [(99, None, "<p>alone</p>", "", "", "")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, main_text(df).collect()))
    assert sorted(map(str, main_text(df, broadcast_mb=0.0, per_task=7).collect())) == want and any("Title 7\\n\\nOwn text 7" in w for w in want)
