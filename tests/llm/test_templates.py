"""Main texts against hand-made pages, a plain reading of the given ones, and recounted occurrence vectors."""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict

from casework.llm import pagetree, queries, templates

SMALL = "/root/testdata/sf0.01"


def plain(html: str | None) -> str:
    """Article of a given page: all of them have one `article` of headings and paragraphs."""
    if not html:
        return ""
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [re.sub(r"<[^>]*>", " ", p) for p in re.split(r"</?(?:p|h1)>", article)]
    lines = [" ".join(html_lib.unescape(p).split()) for p in parts]
    return "\n".join(x for x in lines if x)


def test_query_on_given_pages(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op11_template_slots"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        found = got[r.page_id]
        assert (found.url, found.text, found.n_chars) == (r.url, plain(r.html), len(plain(r.html))), r.page_id


def texts(spark, rows: list[tuple]) -> dict:
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    return {r.id: r.text for r in templates.main_texts(pages).collect()}


def unnamed(i: int, paragraphs: list[str], extra: str = "") -> str:
    """A page without any telling element: only the template can tell the article."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<html><body><div class=top><a href=/>Home</a> <a href=/n>News {i}</a></div><div class=wrap><div class=left><p>Tags {i} and others</p></div>"
        f"<div class=text><h1>Title {i}</h1>{body}<p>All rights of this text are with its author</p>{extra}</div></div>"
        f"<div class=low><p>Imprint</p></div></body></html>"
    )


def test_template_tells_the_article(spark):
    words = [f"Sentence {k} of many words that nobody repeats anywhere else on this site" for k in range(40)]
    rows = [(i, f"https://a.example/{i}", unnamed(i, words[4 * i:4 * i + 4])) for i in range(8)]
    got = texts(spark, rows)
    assert got == {i: "\n".join([f"Title {i}", *words[4 * i:4 * i + 4]]) for i in range(8)}


def test_copies_keep_their_text(spark):
    words = [f"Sentence {k} of many words" for k in range(6)]
    page = f"<body><nav>menu</nav><article><h1>One</h1>{''.join(f'<p>{w}</p>' for w in words)}</article></body>"
    near = [page.replace("Sentence 5", f"Sentence 5{i}") for i in range(6)]
    rows = [(i, "https://b.example/x", page) for i in range(5)] + [(10 + i, "https://b.example/y", p) for i, p in enumerate(near)]
    got = texts(spark, rows)
    assert all(got[i] == "\n".join(["One", *words]) for i in range(5))
    assert all(got[10 + i] == "\n".join(["One", *words[:5], f"Sentence 5{i} of many words"]) for i in range(6))


def test_apart_elements_and_odd_markup(spark):
    rows = [
        (1, "http://c/1", """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
          <header><h1>Site</h1></header><nav>Menu</nav><div id="cookie-notice">We use cookies</div><main><article class="post"><header><h1>A &amp; B&nbsp;&copy;</h1></header>
          <p>First<br>line <b>bold<p>Second &lt;tag&gt; &#233;<script>x("</p>")</script> end<!-- no --><div class="ad-box">Buy</div>
          <ul><li>one<li>two <a href="x>y">link</a></ul><form><label>Name</label></form><aside>See also</aside></article>
          <section id="comments"><article class="comment"><p>Nice!</p></article></section></main><footer>Foot</footer>"""),
        (2, "http://c/2", "no markup at all &amp; so on"), (3, "http://c/3", "<p>open <i>tags"), (4, "http://c/4", "<script>only"), (5, None, ""), (6, "http://c/6", None),
        (7, "::", "<article>x</article>"), (7, "::", "<article>x</article>"), (None, "http://c/8", "<main><p>y</p></main>"), (9, "http://c/9", "<div>a<div>b</div>c</div>"),
        (10, "http://c/10", "<article><p>" + "word " * 200_000 + "</p></article>"), (11, "http://c/11", "<a b='\"c><article>q</article>"),
        (12, "http://c/12", "<!-- <article>no</article>"), (13, "http://c/13", "<article><table><tr><td>1<td>2<tr><td>3</table><pre>a\n b</pre></article>"),
    ]
    got = texts(spark, rows)
    assert got[1] == "A & B ©\nFirst line bold\nSecond <tag> é end\none\ntwo link"
    assert (got[2], got[3], got[4], got[5], got[6]) == ("no markup at all & so on", "open tags", "", "", "")
    assert (got[7], got[None], got[9]) == ("x", "y", "a\nb\nc")
    assert got[10] == " ".join(["word"] * 200_000) and got[11] == "q" and got[12] == "" and got[13] == "1\n2\n3\na b"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert templates.main_texts(empty).count() == 0


def test_classes_are_equal_vectors(spark):
    def page(i: int) -> str:
        order = ["<div class=x>x</div>", "<div class=y>y</div>"]
        return f"<body><ul>{'<li>i' * (i + 1)}</ul><div class=z>z</div>{''.join(order if i % 2 else order[::-1])}<p>{i}</p></body>"

    pages = [(i, "http://d/", page(i)) for i in range(6)] + [(9, "http://d/", page(0))]
    found = templates.occurrences(spark.createDataFrame(pages, "page_id long, url string, html string"))
    vectors = defaultdict(dict)
    for r in found.collect():
        if not r.is_text:
            vectors[r.token][r.page] = r.n
    grouped = templates.classes(found)
    got = defaultdict(set)
    for r in grouped.filter("not is_text").collect():
        assert r.pages == 6 and r.on == len(vectors[r.token])
        got[r.vector].add(r.token)
    want = defaultdict(set)
    for token, counts in vectors.items():
        want[tuple(sorted(counts.items()))].add(token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    # x and y change places, so neither has one place in their class; li is a class of its own.
    kept = {r.token for r in templates.in_order(found, grouped).collect()}
    body = pagetree._path(0, "body", "")
    names = {pagetree._path(body, "div", c): c for c in "xyz"}
    assert {names[t] for t in kept if t in names} == {"z"}
    assert pagetree._path(pagetree._path(body, "ul", ""), "li", "") in kept
