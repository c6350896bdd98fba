import html
import re

import pytest

from zephyrine.llm import htmltext


def main(source):
    page = htmltext.Page(source)
    return page.text(htmltext.choose(htmltext.alone(page), 1))


CASES = [
    ("", ""),
    ("plain &amp; <b>bold</b>", "plain & bold"),
    ("<p>", ""),
    ("<script>only()</script>", ""),
    ("<article><h1>T</h1><p>on<b>e</b><br>two<p>three &lt;b&gt;</article><footer>f</footer>", "T one two three <b>"),
    ("<nav><p>menu</nav><main><p>a</p><aside>x</aside><p>b</p></main>", "a b"),
    ("<article><p>a</p><div class='ad-box'>buy</div><form>f<input></form><p>b</p><footer>x</footer></article>", "a b"),
    ("<article>a<section id=comments><article>mine</article></section>b</article>", "a b"),
    ("<div class='layout sidebar-left'><article>text</article></div>", "text"),
    ("<article><header><h1>Head</h1></header><p>b\n \t c&nbsp;d</article>", "Head b c d"),
    ("<article>a<!-- c > d -->b<script>if (1<2) '</p>'</script>c<style>p{}</style></article>", "abc"),
    ('<article><p title="x > y">q</p></article>', "q"),
    ("<div class=notice>n</div><article>t</article><div class='cookie-banner'>c</div>", "t"),
    ("<article><ul><li>a<li>b<ul><li>c</ul></ul></article>", "a b c"),
    ("<article>&copy; &#x41;&#66; &am &amp x</article>", "© AB &am & x"),
    ("<article><p>cut off <b>in the mid", "cut off in the mid"),
    ("<article>a</span>b</div>c</article>", "abc"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_single_pages(source, want):
    assert main(source) == want


def test_no_article_element():
    source = "<div class=menu><a href=1>m</a></div><div id=c><p>hello text of some length</p><p>and more</p></div>"
    assert main(source) == "hello text of some length and more"


def test_template_without_semantic_names(spark):
    """The article's slot is found from what a host's pages share."""
    rows = []
    for i in range(12):
        body = "".join(f"<p>text {i} number {j} with words of its own {i * j}</p>" for j in range(3 + i % 4))
        links = "".join(f"<li><a href={j}>link {j}</a></li>" for j in range(5))
        rows.append((i, f"https://u:p@Host.example:80/{i}", f"<html><body><div><ul>{links}</ul></div><div><div>{body}</div></div><div>foot</div></body></html>"))
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, source in rows:
        want = re.search(r"</ul></div><div><div>(.*?)</div>", source)[1]
        assert got[i] == re.sub(r"(<[^>]*>)+", " ", want).strip()


def nameless(i):
    """A page without telling names: in the article's own element stand texts of the host, and beside it
    an element whose text is new on every page and, on this one, longer than the article."""
    body = [f"text {i} number {j} with words of its own {i * j + j}" for j in range(3 + i % 4 * (i != 5))]
    other = " ".join(f"other{i}x{j}" for j in range(30 if i == 5 else 3))
    shared = "<div>Tell your friends about this story</div>", "<div>More from this place every day</div>"
    links = "".join(f"<li><a href={j}>link {j}</a></li>" for j in range(5))
    source = f"<html><body><div><ul>{links}</ul></div><div><div>{shared[0]}{''.join(f'<p>{x}</p>' for x in body)}{shared[1]}</div><div>{other}</div></div><div>foot</div></body></html>"
    return source, " ".join(body)


def test_template_tells_slots_from_the_hosts_text(spark):
    """By the template alone: a page by itself gives other text."""
    rows = [(i, f"http://h.example/{i}", nameless(i)[0]) for i in range(12)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: nameless(i)[1] for i in range(12)}
    assert all(main(nameless(i)[0]) != nameless(i)[1] for i in range(12))


def test_copies_keep_their_text(spark):
    """Where all pages of a host are the same, their text is not the template's."""
    source, want = nameless(3)
    source, want = source.replace("<div>Tell your friends about this story</div>", ""), want + " More from this place every day"
    rows = [(i, "http://h.example/", source) for i in range(8)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(want in r.text for r in got)


def test_nested_classes():
    """Classes by equal counts on every page and by what encloses them; a lone token is none."""
    pages = [htmltext.Page(f"<div><ul>{'<li><a>x</a></li>' * n}</ul></div><div>{'<p>y</p>' * k}</div>") for n, k in ((2, 3), (3, 3), (4, 1))]
    tokens = {}
    for i, page in enumerate(pages):
        for path, n in page.opened.items():
            t = tokens.setdefault(path, [0, 0, 0])
            t[0] += 1
            t[1] += n
            t[2] += hash((i, n))
    rows = [(p, a, b, c, c, 0, 0, 0, "") for p, (a, b, c) in tokens.items()]
    assert htmltext.nested(rows, 3) == {"/div", "/div/ul", "/div~2", "/div/ul/li", "/div/ul/li/a"}


def test_long_attributes(spark):
    """Whatever stands in an attribute is markup, however long; the last of very many elements keeps its text."""
    data = "data:text/html,<p>no</p>" + "a>b" * 40_000
    assert main(f"<article><p title=\"{data}\" lang='{data}'>yes</p></article>") == "yes"
    assert main("<article>" + "<div class=x>a</div>" * 300 + "</article>") == " ".join("a" * 300)
    names = " ".join(f"n{i}" for i in range(60))
    assert main(f"<article><div class='{names} one'>a</div><div class='{names} two'>b</div></article>") == "a b"
    assert main("<article><p title=\"never closed>text</p></article>") == "text"


def plain(source):
    m = re.search(r"<article>(.*?)(</article>|\Z)", source or "", re.S)
    text = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", m[1])) if m else ""
    return " ".join(html.unescape(text).split())


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_whole_table(spark, sf, broadcast, monkeypatch):
    monkeypatch.setattr(htmltext, "BROADCAST", broadcast)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(-1, None, None), (-2, None, ""), (None, "http://x.example/", "<article>t</article>")], pages.schema)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in htmltext.main_text(pages.unionByName(extra)).collect()}
    want = {r.page_id: (r.url, plain(r.html), len(plain(r.html))) for r in pages.unionByName(extra).collect()}
    assert got == want


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, text string, host string, main string")
    assert htmltext.main_text(df).count() == 0
    df = spark.createDataFrame([(1, "http://a/", "<article>x</article>", "t", "h", "m")] * 2, df.schema)
    assert [tuple(r) for r in htmltext.main_text(df).collect()] == [(1, "http://a/", "x", 1)] * 2


def test_host_of(spark):
    urls = ["http://A.b/c", "https://u@h:1/x", "//h2/x", "", None, "nothing", "ftp://x?y", "http://"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(htmltext.host_column("url")).collect()]
    assert got == [htmltext.host_of(u) for u in urls] == ["a.b", "h", "h2", "", "", "", "x", ""]


DEEP = "".join(f"<div class='{'utility-' * 9}{i}'>" for i in range(30))


@pytest.mark.parametrize("top", ["<article>", "<div id=c>", DEEP + "<article>", DEEP + "<div id=c>"])
def test_long_paths_in_the_article(spark, top):
    """Text deep in the article stays, on single pages and by a host's template, wherever paths get too long."""

    def source(i):
        line = "<font>line {} {} of a long text<br>" if "article" in top else "<p>line {} {} of a long text</p>"
        lines = "".join(line.format(i, j) for j in range(200))
        return f"<nav><a href=1>menu</a></nav>{top}<p>first {i}</p>{DEEP}<p>deep {i}</p>{'</div>' * 30}{lines}"

    def want(i):
        return " ".join([f"first {i} deep {i}", *(f"line {i} {j} of a long text" for j in range(200))])

    assert main(source(0)) == want(0)
    rows = [(i, f"http://h/{i}", source(i)) for i in range(6)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (want(i), len(want(i))) for i in range(6)}
