import pytest

from tideline.llm.html import extract_main_text, main_blocks


def text(page):
    return " ".join(t for t, _ in main_blocks(page))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        ("plain &lt;text&gt; &#65;&nbsp;b", "plain <text> A b"),
        ("<p>a<p>b<b>c</b>d<br>e", "a bcd e"),
        ("<nav>n</nav><article><h1>T</h1><p>x  \n y</p></article><footer>f</footer>", "T x y"),
        ("<article><p>a</p><aside>s</aside><div class='comments'><p>c</p></div><form>f</form></article>", "a"),
        ("<body><header>h</header><main><h1>A</h1><ul><li>1<li>2</ul></main><div>z</div>", "A 1 2"),
        ("<div class='cookie-notice'>c</div><div id=content><p>long text here</p></div><div class=adBox>a</div>", "long text here"),
        ("<article>a<script>if (x<y) t('</p>')</script>b<!-- c --><style>p{}</style></article>", "ab"),
        ("<script>never closed", ""),
        ("<p hidden>h</p><p style='display: none'>n</p><p>v</p>", "v"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<<a 'b>x", "<x"),
        ("<p title='a > b'>t</p>", "t"),
        ("<ul><li><a href=x>one link</a></ul><p>prose with a <a href=y>link</a> in it</p>", "prose with a link in it"),
    ],
)
def test_blocks(page, expected):
    assert text(page) == expected


def page(body):
    return f"<html><head><title>t</title></head><body><div>{body}</div></body></html>"


def test_templates_are_found_by_host(spark):
    note = "<div><p>Read this on every page of ours</p></div>"
    quoted = "<p>A passage that some articles quote</p>"
    rows = [(k, f"http://A.org/{k}", page(f"{note}<p>own text {k}</p>{quoted if k % 3 == 0 else ''}")) for k in range(12)]
    rows += [(100 + k, f"https://b.org/{k}", page(f"{note}<p>elsewhere {k}</p>")) for k in range(3)]
    rows += [(200 + k, f"//c.org/{k}", page("<p>one article under many addresses</p>")) for k in range(9)]
    rows += [(None, None, None), (300, "", "<p>x</p>"), (300, "", "<p>x</p>"), (301, "no address", "<p>" + "y " * 60_000 + "</p>")]
    frame = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, host int")
    found = {}
    for r in extract_main_text(frame).collect():
        found.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    for k in range(12):
        assert found[k][0]["text"] == f"own text {k}" + (" A passage that some articles quote" if k % 3 == 0 else "")
        assert found[k][0]["n_template_blocks"] == 1
    assert found[100][0]["text"] == "Read this on every page of ours elsewhere 0"
    assert found[200][0]["text"] == "one article under many addresses"
    assert found[None][0]["text"] == "" and len(found[300]) == 2 and found[301][0]["n_chars"] == 119_999


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_main_text(frame).collect() == []


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>Text <span class=ad>Buy</span> goes on</p>", "Text goes on"),
        ("<div>prose<button>Share</button></div>", "prose"),
        ("<div>Real text <span class=ad><div>x</div></span></div>", "Real text"),
        ("<p>a <a class='promo' href=x>offer</a><b>b</b></p>", "a b"),
        ("<p>a <svg><text>drawn</text></svg>b <svg/>c</p>", "a b c"),
        ("<p>" + "\u0130" * 40 + "</p><script>x</script><p>kept</p>", "\u0130" * 40 + " kept"),
        ("<p>\u0130\u0130</p><style>y</STYLE >abc", "\u0130\u0130 abc"),
    ],
)
def test_inline_marks_and_raw_ends(page, expected):
    assert text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<div class="content with-sidebar"><p>a</p></div>', "a"),
        ('<div id="page" class="no-sidebar has-header"><p>a</p></div>', "a"),
        ('<article class="post comment-open"><p>a</p></article>', "a"),
        ('<article data-id="ad"><p>a</p></article>', "a"),
        ('<div class="search-result"><p>a</p></div><section id="related-work">b</section>', "a b"),
        ('<div class="sidebar"><article><p>a</p></article></div>', "a"),
        ('<div class="ad-slot-2">x</div><div class="siteFooter">y</div><div id="user_comments">z</div><p>a</p>', "a"),
        ("<p>see <a>all of this sentence is a link</a></p>", "see all of this sentence is a link"),
        ('<div class="post"><header><h1>T</h1></header><p>a</p></div>', "T a"),
        ('<article><p>a</p><div class=comments><article class=comment><p>c</p></article></div></article>', "a"),
        ('<article><p>a</p></article><div class=comments><article><p>c</p></article></div>', "a"),
        ("<ul><li>a<li>b</ul></li><p>c", "a b c"),
    ],
)
def test_names_do_not_delete_articles(page, expected):
    assert text(page) == expected


@pytest.mark.parametrize("unit", ["<div>x", "<div><li>x", "<ul><li><div>x", "<p><b>x", "<a><span>x", "</div>x<li>"])
def test_deep_nesting_takes_time_in_proportion(unit):
    import time

    taken = []
    for n in (4_000, 40_000):
        started = time.process_time()
        assert len(text(unit * n)) >= n
        taken.append(time.process_time() - started)
    assert taken[1] < 40 * max(taken[0], 0.02)


def test_templates_need_no_tags(spark):
    """Repeated parts of pages without any semantic tag go by the template step alone, and the steps say so."""
    menu = "<div><div>Home</div><div>News</div></div>"
    foot = "<div><div>Write to us</div></div>"
    quoted = "<div>A passage that every third article quotes</div>"
    rows = [(k, f"http://a.org/{k}", f"<body>{menu}<div><div>own text {k}</div>{quoted if k % 3 == 0 else ''}</div>{foot}") for k in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in extract_main_text(frame).collect()}
    for k in range(30):
        assert found[k]["text"] == f"own text {k}" + (" A passage that every third article quotes" if k % 3 == 0 else "")
        assert (found[k]["n_template_blocks"], found[k]["n_rule_blocks"], found[k]["n_outside_blocks"], found[k]["n_link_blocks"]) == (3, 0, 0, 0)
    assert sum(len(t.split()) > 5 for t in (text(r[2]) for r in rows)) == 30  # without the step all is kept


def test_against_counting_in_plain_python(spark, sf_dir):
    """Templates, texts and counts of the given pages equal those of counting on the driver."""
    import re
    from collections import Counter, defaultdict

    from tideline.llm.html import MIN_PAGES, MIN_SHARE, judge, parse

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    host = lambda url: re.match(r"(?:\w+:)?//([^/?#:]*)", url or "")
    hosts = {i: (host(u)[1].lower() if host(u) else "") for i, u, _ in rows}
    parsed = {i: parse(h or "") for i, _, h in rows}
    contents, counts = defaultdict(dict), defaultdict(Counter)
    for i, page in parsed.items():
        contents[hosts[i]][" ".join(t for t, _ in judge(page).blocks)] = set(page.digests) - {-1}
    for name, seen in contents.items():
        for digests in seen.values():
            counts[name].update(digests)
    for r in extract_main_text(pages).collect():
        name, n = hosts[r["page_id"]], len(contents[hosts[r["page_id"]]])
        templates = {h for h, times in counts[name].items() if times >= max(MIN_PAGES, MIN_SHARE * n) and n >= MIN_PAGES}
        want = judge(parsed[r["page_id"]], frozenset(templates))
        assert r["text"] == " ".join(t for t, _ in want.blocks)
        assert (r["n_template_blocks"], r["n_rule_blocks"], r["n_outside_blocks"], r["n_link_blocks"]) == tuple(want[1:])
