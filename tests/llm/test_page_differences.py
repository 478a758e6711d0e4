import random
from dataclasses import replace
from html.parser import HTMLParser

import pytest

from tests.llm.data import prose
from uqframe.llm import page_differences
from uqframe.llm.page_differences import Settings, common_lines, kept_lines, numbered, page_lines

SCHEMA = "page_id long, url string, html string, text int, host string"


def texts(spark, rows, s=Settings(), n=3):
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], SCHEMA).repartition(n)
    return sorted(tuple(r) for r in page_differences.main_text(df, s).collect())


class Article(HTMLParser):
    """The blocks of ``article``, read by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.held = False, [], ""

    def end(self):
        text = " ".join(self.held.split())
        self.out += [text] if text else []
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p"):
            self.end() if self.inside else None
            self.inside, self.held = self.inside or tag == "article", ""
        self.held += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if self.inside and tag in ("article", "h1", "p"):
            self.end()
            self.inside = tag != "article"

    def handle_data(self, data):
        self.held += data if self.inside else ""


def test_whole_table(spark):
    """Markup says where the article of the given pages is; nothing else may be lost or kept."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = []
    for r in pages.collect():
        p = Article()
        p.feed(r.html)
        p.close()
        text = "\n\n".join(p.out)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(tuple(r) for r in page_differences.main_text(pages).collect()) == sorted(want)


def bare(host, k, body, extra=""):
    """A page whose frame no element or class gives away."""
    html = (f"<html><body><div><div>Home of {host}</div><div>Products</div><div>About us</div></div><div>"
            + "".join(f"<p>{p}</p>" for p in body) + f"</div><div>{extra}All rights of {host} are kept</div></body></html>")
    return (k, f"http://{host}/a/{k:04d}.html", html)


def test_differences_without_any_mark(spark):
    bodies = {k: prose(k, 60).split("\n") for k in range(120)}
    rows = [bare(f"h{k % 3}.example", k, bodies[k], f"Page {k} <br> ") for k in bodies]
    # the line that holds the page's number is never shared, nor is any line of the text
    want = [(k, "\n\n".join([*[" ".join(p.split()) for p in bodies[k]], f"Page {k} All rights of h{k % 3}.example are kept"]))
            for k in sorted(bodies)]
    assert [(i, t) for i, _, t, _ in texts(spark, rows)] == want
    assert texts(spark, rows, replace(Settings(), block_rows=10)) == texts(spark, rows)


def test_a_place_of_shared_lines_goes_as_a_whole(spark):
    """One page's own menu entry lies where all other pages hold shared ones."""
    rows = []
    for k in range(60):
        menu = "".join(f"<li>{w}</li>" for w in (["Start", "News", "Shop"] + (["Only here"] if k == 7 else [])))
        rows.append((k, f"https://a.example/x/{k:03d}", f"<div class=c><ul>{menu}</ul></div><section><p>{prose(k, 40)}</p></section>"))
    got = {i: t for i, _, t, _ in texts(spark, rows)}
    assert got == {k: " ".join(prose(k, 40).split()) for k in range(60)}


def test_copies_say_nothing(spark):
    body = prose(1, 80).split("\n")
    rows = [bare("c.example", k, body) for k in range(30)]
    kept = texts(spark, rows)
    assert all(" ".join(body[0].split()) in t for _, _, t, _ in kept)
    # among other pages, copies lose the frame and nothing else
    rows += [bare("c.example", 100 + k, prose(50 + k, 60).split("\n")) for k in range(30)]
    rows = [(k, f"http://c.example/{'%03d' % (k * 7 % 61)}", html) for k, (_, _, html) in enumerate(rows)]
    got = {i: t for i, _, t, _ in texts(spark, rows)}
    assert {got[k] for k in range(30)} == {"\n\n".join(" ".join(p.split()) for p in body)}


def test_shared_passages_of_articles_stay(spark):
    passage = "A license line that very many articles hold."
    rows = [(k, f"http://d.example/{k}", f"<nav>Menu {k}</nav><article><h1>T{k}</h1><p>{passage}</p><p>{prose(k, 30)}</p>"
             f"</article><div>Other text {k}</div>") for k in range(40)]
    for i, _, t, _ in texts(spark, rows):
        assert t == "\n\n".join([f"T{i}", passage, " ".join(prose(i, 30).split())])


@pytest.mark.parametrize("html, lines", [
    ("", []), ("plain  text\n here", ["plain text here"]), ("a<p>b<p>c", ["a", "b", "c"]),
    ("<p>x &amp;&lt; &eacute; &#65;&#x42; &nosuch; &am</p>", ["x &< é AB &nosuch; &am"]),
    ("<p>a<b>b</b>c<br>d <!-- <p>no --> e", ["abc d e"]),
    ("<script>var t='</p><p>no'</script ><style>p{}</style><p>yes<script>never closed <p>no", ["yes"]),
    ("<p title=\"a > b\">in</p><p title='it'>two</p><p it's>three</p>", ["in", "two", "three"]),
    ("<p>cut <a href=\"x", ["cut"]), ("1 < 2 and 3 > 2 <3", ["1 < 2 and 3 > 2 <3"]),
    ("<nav>n</nav><div class='x ad-box'>a<p>b</p></div><p>t</p><footer>f<p>g</footer>", ["t"]),
    ("<main><header><h1>T</h1></header><p>x<aside>s</aside>y<form>f</form></main>z", ["T", "x", "y"]),
    ("<article><p>a</p><section class='comments'><article><p>c</p></article></section></article>", ["a"]),
    ("<ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>p<td>q<tr><td>r</table>", ["one", "two", "three", "p q", "r"]),
    ("<div hidden>h</div><p aria-hidden=true>i</p><template><p>t</p></template><p>s</p>", ["s"]),
    ("<DIV>A</DIV><P CLASS=Sidebar>B</P>", ["A"]), ("\x00 <p>  z   y</p>", ["\x00", "z y"]),
])
def test_lines_of_a_page(html, lines):
    assert kept_lines(html, set(), set()) == lines


def test_hostile_pages():
    for html in ("<div>" * 30_000 + "x", "<a \"" * 30_000, "<p class='" * 20_000, "<" * 100_000, "<!--" * 50_000,
                 "</p>" * 50_000, "<p>x" * 50_000, "&" * 100_000, "<li>" * 20_000 + "y", "<div>" * 30_000 + "</p><tr></ul>" * 30_000):
        page_lines(html)
    assert kept_lines("<p>" + "long " * 300_000 + "</p>", set(), set()) == [("long " * 300_000).strip()]


def test_common_lines():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.randrange(8) for _ in range(r.randrange(9))] for _ in range(2))
        x, y = (sorted(numbered(s), key=numbered(s).get) for s in (a, b))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
        got = common_lines(numbered(a), numbered(b))
        assert len(got) == best[len(x)][len(y)] and got == sorted(got)
        rest = iter(y)
        assert all(x[k] in rest for k in got)


def test_awkward_rows(spark):
    rows = [(1, "http://a/x", None), (2, None, "<p>t</p>"), (3, "", ""), (None, "http://a/x", "<p>u</p>"),
            (4, "no url at all", "<p>v</p>"), (4, "no url at all", "<p>v</p>"), (4, "no url at all", "<p>w</p>")]
    got = {(r[0], r[2]) for r in texts(spark, rows[:3] + rows[4:])}
    assert got == {(1, ""), (2, "t"), (3, ""), (4, "v"), (4, "w")}
    assert len(texts(spark, rows[4:])) == 3
    assert texts(spark, []) == []
    df = spark.createDataFrame([(*rows[3], 1, "h")], SCHEMA)
    assert [tuple(r) for r in page_differences.main_text(df).collect()] == [(None, "http://a/x", "u", 1)]
