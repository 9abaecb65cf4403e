import time

import pytest

from corpusloom.llm import html_text as H

ARTICLE = "<article class='post-12'><h1>T &amp; U</h1><p>One <b>two</b>\n three<p>Four &lt;x&gt;<div class=ad>Buy now please</div><ul><li>a<li>b</ul></article>"


def one(html, paths=()):
    return H.extract(html, list(paths))


def test_article_of_a_full_page():
    page = f"<!doctype html><html><head><title>no</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><header><p>head of the site with quite a long text, longer than all</p></header><nav><a href=x>Menu</a></nav><!-- <p>no</p> --><main>{ARTICLE}<section id=comments><p>what readers say, at great length, over and over again</p></section></main><aside>side</aside><form><p>sign up</form><footer>&copy; foot</footer></body></html>"
    assert one(page) == "T & U\nOne two three\nFour <x>\na\nb"


def test_wins_over_the_page():
    body = "<html><body><div class=story><p>Short.</p></div><div class=other><p>A far longer text that stands beside the story on this page alone.</p></div></body></html>"
    assert one(body) == "A far longer text that stands beside the story on this page alone."
    assert one(body, [">html>body>div.none", ">html>body>div.story"]) == "Short."


def test_odd_html():
    assert one(None) == one("") == one("<p>") == one("<script>x") == ""
    assert one("just text & more") == "just text & more"
    assert one("<p>a<b>b<br>c<p>d") == "ab c\nd"
    assert one("1 < 2 <p>x</q></p>") == "1 < 2\nx"
    assert one('<p title="a>b">x</p>y') == "x\ny"
    assert one("<body><div><p>x</div><p>y") in ("x", "y", "x\ny")
    assert one("<p>tail <a href='") == "tail"


@pytest.mark.parametrize("aside", ["<button>x</button>", "<span hidden>x</span>", "<span class='ad'>x y</span>", "<select><option>x<option>y</select>", "<object>x<b>y</b></object>", "<script>x</script>", "<a class='share' href='#'>x</a>", "<b aria-hidden='true'>x <i>y</i></b>", "<object><p>x</p></object>"])
def test_elements_set_aside_inside_a_line(aside):
    """What is dropped inside a paragraph neither stays nor divides it."""
    assert one(f"<p>one two {aside} three <b>four</b> five</p><p>six</p>") == "one two three four five\nsix"
    assert one(f"<p>one{aside}two") == "onetwo"
    assert one(f"<div>{aside}<p>one two</p>{aside}</div>") == "one two"


def test_unclosed_elements_set_aside():
    assert one("<p>one <button>x</p><p>two</p>") == "one\ntwo"
    assert one("<p>one <span class=ad>x <span hidden>y</span> z</span> two <em hidden>q") == "one two"
    assert one("<ul><li>a <button>x<li>b</ul>c") == "a\nb\nc"
    # A block ends the paragraph and what is open in its line, as browsers read it.
    assert one("<p>one <span hidden><div>in</div> more</span> two") == "one\nin\nmore two"


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "http://h.org", "<p>x y", "a", "b", "c", "d", 5)], "page_id int, url string, html string, row string, host string, paths string, votes string, `_ho.st` int")
    assert H.extract_text(df).first().asDict() == {"page_id": 1, "url": "http://h.org", "html": "<p>x y", "row": "a", "host": "b", "paths": "c", "votes": "d", "_ho.st": 5, "text": "x y"}


def test_classes_are_generalised():
    page = H.parse("<div class='B post-123 a'><p>x</div>")
    assert page.path_of(len(page.nodes) - 1) == ">div.a.b.post-N"
    page = H.parse("<div class='a>b'><ul><li>x</ul></div>")
    assert [page.path_number(page.path_of(k)) for k in range(3)] == [n.path for n in page.nodes] == [0, 1, 2]


def test_consensus(spark):
    good = "<body><div class=story><p>The story number {0} of the host, as all others have it.</p></div><div class=extra><p>{1}</p></div></body>"
    rows = [(k, "http://H.org/a", good.format(k, "x")) for k in range(9)] + [(9, "http://h.org/b", good.format(9, "long " * 60)), (10, None, good.format(10, "")), (11, "http://e.org", ""), (12, "http://e.org", None)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, paths int")
    got = {r["page_id"]: r["text"] for r in H.extract_text(df).collect()}
    assert got == {k: f"The story number {k} of the host, as all others have it." + "\nx" * 0 for k in range(11)} | {11: "", 12: ""}
    assert H.extract_text(df.limit(0)).count() == 0


def test_brute_force_on_plain_articles(spark):
    """On pages of one make, the text is what a look for the article's tags gives."""
    import html
    import re

    rows = [(k, f"http://h{k % 3}.net/", f"<html><body><nav><ul><li><a href='/'>n{k}</a></ul></nav><article><h1>H {k}</h1>" + "".join(f"<p>P{j} &eacute;&amp; {'w ' * j}</p>" for j in range(k % 5 + 1)) + "</article><footer>f</footer></body></html>") for k in range(40)]

    def look(page):
        inner = re.search("<article>(.*)</article>", page)[1]
        return "\n".join(" ".join(html.unescape(x).split()) for x in re.split("<[^>]*>", inner) if x)

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract_text(df).collect()} == {k: look(p) for k, _, p in rows}


def test_nested_and_sibling_containers_are_whole():
    lead, body = "lead " * 16, "body " * 200
    assert one(f"<article><h1>T</h1><div class=lead><p>{lead}</p></div><div class=body><p>{body}</p></div></article>") == f"T\n{lead.strip()}\n{body.strip()}"
    assert one(f"<article><p>{lead}</p><ul><li>{body}</ul></article>") == f"{lead.strip()}\n{body.strip()}"
    assert one(f"<body><div id=page><div class=lead><p>{lead}</p></div><div class=body><p>{body}</p></div></div></body>") == f"{lead.strip()}\n{body.strip()}"
    assert one(f"<body><div class=a><p>{lead}</p></div><div class=b><p>{body}</p></div></body>") == f"{lead.strip()}\n{body.strip()}"
    assert one(f"<body><div class=x><p>{lead}</p></div><main><h1>T</h1><article><p>{body}</p></article><ul><li><a href=a>more of the like</a></ul></main></body>") == f"T\n{body.strip()}\nmore of the like"
    assert one("<body><div><p><a href=a>only links</a></div></body>") == "only links"


def test_consensus_of_two_templates_and_of_nested_containers(spark):
    rows = [(k, "http://a.org/", f"<body><div class=one><p>{'story ' * 50}{k}</p></div></body>") for k in range(6)]
    rows += [(k, "http://a.org/", f"<body><div class=one><p>tease</p></div><div class=two><p>{'other ' * 50}{k}</p></div></body>") for k in range(6, 10)]
    rows += [(k, "http://b.org/", f"<article><div class=body><p>{'text ' * 50}{k}</p></div></article>") for k in range(10, 30)]
    rows += [(30, "http://b.org/", f"<article><h1>Title</h1><div class=body><p>{'text ' * 50}30</p></div></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_text(df).collect()}
    assert got == {k: f"{('story ' if k < 6 else 'other ' if k < 10 else 'text ') * 50}{k}" for k in range(30)} | {30: "Title\n" + "text " * 50 + "30"}


def test_words_of_wrappers_are_no_verdict():
    article = "<article><h1 class=header>Title</h1><p class=notice-text>One.<p>Two.<div class=ad>Buy</div></article>"
    for names in ("class='content has-sidebar'", "id=page class=no-sidebar", "class=menu-open", "class=share-enabled", "class=sidebar", "id=overlay", "class=search", "class=related"):
        assert one(f"<body><div class=menu>Site</div><div {names}>{article}</div><div class=site-footer><p>foot</p></div></body>") == "Title\nOne.\nTwo.", names
    assert one(f"<body><form id=aspnetForm>{article}</form></body>") == "Title\nOne.\nTwo."
    assert one("<body><div id=page class=sidebar><div class=post-header>By Jane Doe</div><p>A <b>bold</b> text of the page.<p>More of it.</div><div class=widget><p>w</div></body>") == "By Jane Doe\nA bold text of the page.\nMore of it."


def test_boilerplate_words_still_drop():
    article, long = "<article><h1>Title</h1><p>One.</article>", "<p>" + "said " * 99 + "</p>"
    for names in ("class=comments", "class=post-comments", "class=sidebar", "class='widget left-sidebar'", "id=cookie-banner", "class=site-footer", "class=related-posts"):
        assert one(f"<body>{article}<div {names}>{long}</div></body>") == "Title\nOne.", names
    assert one(f"<body>{article}<div class=comments><article class=comment>{long}</article></div></body>") == "Title\nOne."
    assert one(f"<body><div class=story><p>The page's own story.</p></div><div class=comments>{long}</div></body>") == "The page's own story."
    assert one("<div class=ad>Buy</div><form><p>sign up</form><div class=cookie-notice><p>We use cookies</div>") == ""


HOSTILE = {
    "open quotes": "<a b='" * ((5 << 20) // 6),
    "open quotes of both kinds": "<a b='<a c=\"" * 200_000,
    "unclosed tags": "<a " * ((5 << 20) // 3),
    "bare signs": "<" * (5 << 20),
    "nested div": "<div>" * 100_000 + "x",
    "nested div with classes": "<div class='a b'>" * 100_000 + "x" + "</div>" * 100_000,
    "nested adverts": "<div class=ad>" * 100_000 + "x",
    "nested bodies": "<body>x" * 100_000,
    "unmatched ends": "<span>" * 8_000 + "</i>" * 300_000,
    "ends behind a container": "<i>" + "<div>" * 8_000 + "</i>" * 300_000,
    "items in open spans": "<span>" * 8_000 + "<li>x" * 100_000,
    "links in open spans": "<span>" * 8_000 + "<a>x" * 100_000,
    "open comments": "<!-- " * 300_000,
    "open scripts": "<script>" * 300_000,
    "declarations": "<!x" * 300_000,
    "headings": "<h1>" * 50_000 + "<b>x" * 50_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_length_only(name):
    began = time.perf_counter()
    H.extract(HOSTILE[name], [">html>body>div.a.b"])
    assert time.perf_counter() - began < 8


def test_quotes_count_after_an_equals_sign_only():
    assert one("<p title='it's'>x</p>y") == "x\ny"
    assert one('<p a"b>x</p><p c=d"e>y</p>') == "x\ny"
    assert one("<p title = 'a>b' data-x=\"c'>d\">x") == "x"
    assert one("<p title='never closed>x</p>y") == "x\ny"
    assert one("a </> b </ p> c <? d > e") == "a b c e"


def test_paths_by_hash():
    page = H.parse("<body><div class='b a1'><ul><li>x</ul></div><p>y")
    p = H.parsed("<body><div class='b a1'><ul><li>x</ul></div><p>y")
    assert p.paths == [H.path_hash(page.path_of(k)) for k in range(len(page.nodes))] and len(set(p.paths)) == len(page.nodes)
    assert all(-(1 << 63) <= x < 1 << 63 for x in p.paths)


def test_many_hosts(spark):
    """Each of 800 hosts by its own winners."""
    good = "<body><div class=story{0}><p>The story {1} of the host, as all have it.</p></div><div class=extra><p>{2}</p></div></body>"
    rows = [(h * 10 + k, f"http://h{h}.org/{k}", good.format("" if h % 2 else "s", k, "long " * 30 if k == 3 and h % 5 == 0 else "x")) for h in range(800) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(40)
    got = {r["page_id"]: r["text"] for r in H.extract_text(df, keep_html=False).collect()}
    assert got == {i: f"The story {i % 10} of the host, as all have it." for i, *_ in rows}


def test_html_only_if_asked_for(spark):
    df = spark.createDataFrame([(1, "http://h.org", "<p>x y")], "page_id int, url string, html string")
    assert H.extract_text(df).columns == ["page_id", "url", "html", "text"] and H.extract_text(df, keep_html=False).columns == ["page_id", "url", "text"]
