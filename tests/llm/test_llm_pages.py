from lexiloom.llm import html_extract as H


def page(body, head="<title>T &amp; U</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>'
FOOT = "<footer>&copy; host</footer>"
CASES = [
    (page(NAV + "<div class=ad>Buy</div><article><h1>T &amp; U</h1><p>One  two<br>three</p><p></p><p><b>Four.<br><p>Fi&#118;e &lt;x&gt;</article>" + FOOT), "T & U\nOne two three\nFour.\nFive <x>"),
    (page(NAV + "<main><div class='cookie-notice'>Accept</div><p>Text</p><aside>Side</aside><form><p>Mail <input></p></form><section id='comments'><p>First!</p></section></main>"), "Text"),
    (page("<header>Site</header><article><header><h1>Head</h1></header><p>Body<script>var t='</p>';</script> on</p></article>"), "Head\nBody on"),
    (page("<header>Site</header><article class=post><header class='entry-header'><h1>Own</h1></header><div class='share-bar'>Share</div><p>Text</p></article>"), "Own\nText"),
    (page("<article><p>cut off &am"), "cut off &am"),
    (page("<article><p>a &amp"), "a &"),
    (page("<article><p>a<p>b</div></article><p>after</p>"), "a\nb"),
    ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "x\ny\n1\n2"),
    ("", ""),
    (None, ""),
    ("no markup at all", "no markup at all"),
    (page("<!-- <article><p>hidden</p></article> --><article><p>seen</p></article>"), "seen"),
    (page("<article>" + "<p>long</p>" * 20000 + "</article>"), "\n".join(["long"] * 20000)),
    ("<a " * 3000, ""),
]


def test_roles_alone():
    for html, want in CASES:
        assert H.main_text(html or "") == want


def plain(host_pages):
    """Fixed texts of a host by definition: the same text at the same path on at least half of its pages."""
    seen = {}
    for k, h in enumerate(host_pages):
        for b in {(b.path, b.text) for b in H.parse(h)}:
            seen.setdefault(b, set()).add(k)
    return {b for b, on in seen.items() if len(on) * 2 >= len(host_pages) and len(on) > 1}


def test_template_of_a_host_without_article_elements(spark):
    rows = []
    for i in range(8):
        body = f"<div class=top><span>My Site</span></div><div class=box><a href=/1>One link</a> <a href=/2>Two link</a></div><div class=col><h2>Title {i}</h2><p>Varying text number {i}, long enough to be the article of page {i}.</p><p>More of it {i * 7}.</p></div><div class=end>All rights reserved</div>"
        rows.append((i, f"http://one.example/{i}", page(body), "x"))
    rows += [(100, None, page("<p>alone</p>"), "x"), (101, "http://two.example/", None, "x"), (102, "not a url", "", "x"), (103, "http://three.example/p", page(NAV + "<article><p>Art</p></article>"), "x"), (103, "http://three.example/p", page(NAV + "<article><p>Art</p></article>"), "x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r.host: r for r in H.templates(docs).collect()}
    assert {H._hash(p, t) for p, t in plain([r[2] for r in rows[:8]])} >= set(found["one.example"].fixed)
    assert len(found["one.example"].fixed) >= 2
    got = {}
    for r in H.extract(docs).collect():
        got.setdefault(r.page_id, []).append((r.url, r.text, r.n_chars))
    for i in range(8):
        text = f"Title {i}\nVarying text number {i}, long enough to be the article of page {i}.\nMore of it {i * 7}."
        assert got[i] == [(f"http://one.example/{i}", text, len(text))]
    assert got[100] == [(None, "alone", 5)] and got[101][0][1:] == ("", 0) and got[102][0][1:] == ("", 0)
    assert [x[1] for x in got[103]] == ["Art", "Art"]


def test_copies_of_a_page_keep_their_text(spark):
    html = page(NAV + "<article><h1>Same</h1><p>Everywhere the same.</p></article>" + FOOT)
    docs = spark.createDataFrame([(i, f"http://h.example/{i}", html) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(docs).collect()} == {"Same\nEverywhere the same."}
    assert H.extract(docs.where("false")).count() == 0


def test_whole_table_against_regular_expressions(spark, sf_dir):
    """The test pages' articles, by a plainer way that knows their markup."""
    import re
    from html import unescape

    from lexiloom.llm.common import read_table

    pages = read_table(spark, sf_dir, "pages")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        a = r.html.index("<article>") + 9
        b = r.html.find("</article>")
        parts = [re.sub(r"<[^<>]*>|<[a-z/][^<>]*$", " ", x) for x in re.split("</?(?:p|h1)>", r.html[a : b if b >= 0 else len(r.html)])]
        assert got[r.page_id] == "\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)


def extracted(spark, bodies):
    docs = spark.createDataFrame([(i, f"http://h.example/{i}", page(b)) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r.text for r in H.extract(docs).orderBy("page_id").collect()]


def test_lines_repeated_in_every_article_go(spark):
    own = [f"Own text of page {i}, and some more of it." for i in range(6)]
    bodies = [NAV + f"<article><h1>Title {i}</h1><p>Get our letter every week.</p><p>{t}</p><p>Thanks for reading.</p></article>" + FOOT for i, t in enumerate(own)]
    assert extracted(spark, bodies) == [f"Title {i}\n{t}" for i, t in enumerate(own)]


def test_copies_beside_other_pages_keep_their_text(spark):
    copy = "<article><h1>Same</h1><p>" + "Everywhere the same. " * 5 + "</p><p>Seen {} times</p></article>"
    got = extracted(spark, [copy.format(i) for i in range(5)] + [f"<article><h1>Other {i}</h1><p>Text {i}</p></article>" for i in range(3)])
    assert got[:5] == ["Same\n" + "Everywhere the same. " * 4 + f"Everywhere the same.\nSeen {i} times" for i in range(5)]
    assert got[5:] == [f"Other {i}\nText {i}" for i in range(3)]


def test_a_teaser_article_is_not_the_text(spark):
    own = [f"Long text number {i}. " * 10 for i in range(6)]
    bodies = [f"<div class=col><h2>Title {i}</h2><p>{t}</p></div><article><p>Next: story {i}</p></article>" for i, t in enumerate(own)]
    assert extracted(spark, bodies) == [f"Title {i}\n{t.strip()}" for i, t in enumerate(own)]
