from lakeingest.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="post">
<header><a href=/>Site</a></header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>{title}</h1><p class=byline>By A</p></header><p>{a} &amp; <b>bold</b>
 next<p>{b}<br>after</p><script>bad()</script><div class="ad">Buy</div><form><p>Mail</p><input></form>
<ul><li>one<li>two</ul><!-- no --><aside>See also</aside><p hidden>gone</p></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>First!</p></article></section></main>
<div class="sidebar"><p>Popular</p></div><footer>&copy; Site</footer></body></html>"""


def rows(spark, pages):
    return spark.createDataFrame(pages, "page_id int, url string, html string")


def test_article_only(spark):
    pages = [(k, f"http://Host.example/{k}", PAGE.format(title=f"Title {k}", a=f"first {k}", b=f"second {k}")) for k in range(6)]
    for r in w.main_text(rows(spark, pages)).collect():
        k = r["page_id"]
        assert r["text"] == f"Title {k}\n\nfirst {k} & bold next\n\nsecond {k} after\n\none\n\ntwo"
        assert r["n_chars"] == len(r["text"]) and r["url"] == f"http://Host.example/{k}"


def test_template_found_by_the_wrapper(spark):
    """Without an article element: the container with the varying text, without its constant lines."""
    page = "<body><div class=top><p>Welcome to the site</p></div><div class=text><p>Share this story</p><h2>{}</h2><p>{}</p><p>{}</p></div><div class=end>About us</div>"
    pages = [(k, f"https://h.example/{k}", page.format(f"T{k}", f"body {k} " * 9, f"more {k} " * 7)) for k in range(5)]
    for r in w.main_text(rows(spark, pages)).collect():
        k = r["page_id"]
        assert r["text"].split("\n\n") == [f"T{k}", ("body %d " % k * 9).strip(), ("more %d " % k * 7).strip()]


def test_hard_pages(spark):
    same = "<article><p>equal text of copies</p></article>"
    pages = [(1, None, None), (2, "http://a.b", ""), (3, "no host", "<p>alone"), (4, "http://c.d/x", "a < b <i>x</i>"), (None, "http://e.f", "<!-- open"),
             (6, "http://e.f/1", "<article><p>" + "w " * 60_000), *[(k, "http://copy.x/", same) for k in (7, 7, 8, 9, 10)]]
    docs = rows(spark, pages).selectExpr("*", "'x' as host", "'x' as rule", "'x' as text")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in w.main_text(docs).collect()), key=str)
    want = [(0, ""), (1, ""), (2, ""), (3, "alone"), (4, "a < b x"), (6, ("w " * 60_000).strip()), *[(k, "equal text of copies") for k in (7, 7, 8, 9, 10)]]
    assert got == sorted(want, key=str)
    assert w.main_text(rows(spark, [])).collect() == []


def test_names_of_states_and_misread_names():
    page = "<body class=has-sidebar><nav>Home</nav><div class='page with-sidebar'><div class=content><p>inside</p></div><div class=sidebar>out</div></div>"
    assert [(t, o) for _, t, o, _ in w.read_blocks(page)] == [("Home", True), ("inside", False), ("out", True)]
    assert w.extract("<div class=widget><p>only text</p></div><nav>Menu</nav>", None) == "only text"


def test_folding_and_alignment():
    blocks = [("a", str(k), False, "") if k % 2 else ("b", str(k), False, "") for k in range(8)]
    nodes = w.stream([("h", "t", False, ""), *blocks, ("f", "end", False, "")])
    assert [(x[0], x[1]) for x in nodes] == [(["h"], False), (["b", "a"], True), (["f"], False)]
    other = w.stream([("h", "u", False, ""), ("n", "only here", False, ""), ("f", "end", False, "")])
    both = {tuple(x[0]): (x[1], x[2], x[3] is None) for x in w.align(nodes, other)}
    assert both == {("h",): (False, False, True), ("b", "a"): (True, True, True), ("n",): (False, True, False), ("f",): (False, False, False)}


def test_text_of_several_containers_stays():
    page = "<body><div class=intro><p>intro {0}</p></div><div class=text><p>long {0} and more of it</p><ul><li>item {0} of a list<li>second {0} of a list</ul></div></body>"
    wrapper = w.align(w.stream(w.read_blocks(page.format(1))), w.stream(w.read_blocks(page.format(2))))
    want = "intro 1\n\nlong 1 and more of it\n\nitem 1 of a list\n\nsecond 1 of a list"
    assert w.extract(page.format(1), w.decide(wrapper)) == want == w.extract(page.format(1), None)


def test_elements_left_open():
    """No end tag of the head, or of a skipped element: the text behind it stays."""
    assert w.extract("<html><head><title>T</title><meta charset=x><body><article><p>text", None) == "text"
    assert w.extract("<article><div><button>Share</div><p>text</p></article>", None) == "text"
    assert w.extract("<article><p>one <select><option>a</p><p>two</p></article>", None) == "one\n\ntwo"
    assert "text" in w.extract("<article><noscript><p>text", None)
    assert w.extract("<article><noscript><div>no</div><script>'</article>'</script></noscript><p>text</article>", None) == "text"
