import random
import re

from quarry.llm import html_extract
from quarry.llm.html_extract import blocks, common_lines, extract, op9_html_extract


def texts(page, role="main"):
    return [t for r, t in blocks(page) if r == role]


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body class="home article-page">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div>
    <main><article><header><h1>Head&amp;line</h1></header><p>One <b>two<br>three</b>  &lt;four&gt;
    <p>Five&nbsp;six<ul><li>a<li>b</ul><aside>Rel</aside><div class='ad-box'>Buy</div><form>Mail <input name=x></form>
    <table><tr><td>c1<td>c2</table><!-- <p>no</p> --><section id="comments"><p>Nice!</p></section></article></main>
    <div id=sidebar>Side</div><footer>&copy; me</footer></body></html>"""
    assert texts(page) == ["Head&line", "One two three <four>", "Five six", "a", "b", "c1", "c2"]
    assert texts(page, "open") == []


def test_inline_chrome_leaves_blocks_whole():
    page = "<article><div class=entry-header><h1>Title</h1></div><p>One <span class='ad'>Buy</span>two <button>Share</button>three<script>x()</script>.</p><p><span class=promo>Ad</span>Real <em>text</em></p><p><span class=ad><div>Block ad</div></span>after</p></article>"
    assert texts(page) == ["Title", "One two three.", "Real text", "after"]
    assert texts("<html><head><title>T</title><body><p>x", "open") == ["x"] and texts("<html><head><meta charset=u><body>y<svg><text>z</text></svg>", "open") == ["y"]


def test_broken_markup():
    assert texts("<article><p><b>a<br><p>b</p></article><footer>x") == ["a", "b"]
    assert texts("<article>a<p>b") == ["a", "b"]
    assert texts("a</p>b<x", "open") == ["a", "b"] and texts("", "open") == [] and blocks(None) == []
    assert texts("<article>1 < 2 & 3 &am") == ["1 < 2 & 3 &am"]
    assert texts("<p>" + "x " * 50000, "open") == [("x " * 50000).strip()]


def test_quotes_and_strays():
    assert texts("<article><p data-x=don't>one</p><p>it's</p></article><footer>f") == ["one", "it's"]
    assert texts("<article><p title=\"a>one</p><p>two</p></article>") == ["one", "two"]
    assert texts("<article><p title='a>b' x='<p>'>one</p><p class=\"x\"\">two</article>") == ["one", "two"]
    assert texts("<article><a href=/x?a=1&b='2>one</a> = <b c = \"d>e\">two</b></article>") == ["one = two"]


def test_mains_in_odd_places():
    assert texts("<article>Text<article class='comment'><p>Nice</p></article></article><article class=comment-body>No</article>") == ["Text"]
    assert texts("<article class=comment>No</article><p>x") == [] and texts("<article class=comment>No</article><p>x", "open") == ["x"]
    assert texts("<div class='comment-layout'><main><p>Text</p><div class=comments>No</div></main></div>") == ["Text"]
    assert texts("<div class='comment-layout'><article><p>Text</p></article></div>") == ["Text"]
    assert texts("<aside>Ad<main><p>Text</p></main>") == ["Text"] and texts("<aside>Ad<article><p>Text</p></article>") == ["Text"]
    assert texts("<article>A</article><section class=comments><article>B</article></section>") == ["A"]
    assert texts("<article><p class=alert>Mind the gap</p><p>E = <math><mi>m</mi></math></p><p class=notice>No</p></article>") == ["Mind the gap", "E = m"]


def test_deep_nesting_is_linear():
    import time

    began = time.time()
    n = 60_000
    assert texts("<div>" * n + "<article>x" + "</div>" * n) == ["x"] and texts("<article>" + "<b>" * n + "<p>y</p>" * 1000) == ["y"] * 1000
    assert time.time() - began < 20


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        shared = [x for x, s in zip(a, common_lines(a, b)) if s]
        assert len(shared) == lcs(a, b)
        it = iter(b)
        assert all(x in it for x in shared)


def test_names_inside_the_main_element():
    text = lambda page: [t for r, t in blocks(page) if r == "main"]
    for name in ("share-price", "form-factor", "menu-planning", "ad-hoc", "notice-period", "search"):
        assert text(f'<article><p class="{name}">kept</p><p>and</p></article>') == ["kept", "and"], name
        assert text(f'<main><section id="{name}"><p>kept</p></section></main>') == ["kept"], name
    assert text('<article><div class="related-work"><p>a</p></div><p>b</p></article>') == ["a", "b"]
    assert text('<article class="promotion-of-health"><p>a</p></article>') == ["a"] and text('<article class="post ad"><p>a</p></article><article><p>b</p></article>') == ["b"]
    for name in ("share-buttons", "x related", "Comments", "cookie-notice", "newsletter", "ad"):
        assert text(f'<article><p>a</p><div class="{name}">gone</div></article>') == ["a"], name
    assert text('<article><p>a</p><div role="complementary">gone</div><nav>gone</nav><form>gone</form><aside>gone</aside><footer>gone</footer></article>') == ["a"]
    assert text('<article><p>a</p></article><article id="comment-12" class="comment-body"><p>gone</p></article>') == ["a"]


def test_long_pages_align_in_bounded_memory(monkeypatch):
    import tracemalloc

    rng = random.Random(4)
    monkeypatch.setattr(html_extract, "CELLS", 12)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        shared = [x for x, s in zip(a, common_lines(a, b)) if s]
        it = iter(b)
        assert len(shared) == lcs(a, b) and all(x in it for x in shared)
    monkeypatch.undo()
    lines = list(range(6000))
    other = lines[:]
    rng.shuffle(other)
    tracemalloc.start()
    assert sum(common_lines(lines, other)) > 100
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_nearest_page_differencing(spark):
    page = lambda own: f"<body><div>Welcome</div>{own}<div>Imprint</div></body>"
    rows = [
        (1, "http://h.com/a/1", page("<p>first</p><p>both</p>")), (2, "http://h.com/a/2", page("<p>second</p><p>both</p>")),
        (3, "http://h.com/b/9", page("<p>lone</p>")), (4, "http://other.com/a/1", page("<p>only</p>")),
        (5, "http://h.com/a/3?x", "<article>Welcome</article><div>second</div>"), (6, None, None), (7, "no url", "<p>n</p>"), (8, "http://h.com/c/9", page("<p>lone too</p>")),
        (8, "http://h.com/c/9", page("<p>lone too</p>")),
    ]
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    got = sorted((r.page_id, r.text) for r in extract(df).collect())
    by = dict(got)
    assert by[1] == "first" and by[4] == "Welcome\n\nonly\n\nImprint" and by[5] == "Welcome" and by[6] == "" and by[7] == "n"
    counts = {r.page_id: (r.n_lines, r.n_shared) for r in extract(df).collect()}
    assert counts[1] == (4, 3) and counts[2] == (4, 3) and counts[5] == (2, 1) and counts[4] == (3, 0)  # every page meets its neighbour, guarded lines stay
    alone = {r.page_id: r.text for r in extract(df, structure=False).collect()}
    assert alone[5] == "" and alone[1] == "first" and alone[6] == ""
    assert len(got) == 9 and by[3] == "Welcome\n\nlone\n\nImprint"  # the only page alone in its directory
    assert [t for i, t in got if i == 8] == ["Welcome\n\nlone too\n\nImprint"] * 2  # a copy is no neighbour
    assert by[2] == "second"  # shares Welcome, both and Imprint with page 1
    assert extract(df.limit(0)).collect() == []


def test_neighbours_in_a_large_directory(spark):
    n = 4500
    rows = [(i, f"http://h.com/d/{i:05d}", f"<body><p>own {i}</p><p>link {i}</p><p>link {i + 1}</p></body>") for i in range(n)]
    rows += [(n + i, f"http://h.com/e/{i}", f"<body><p>link {i}</p><p>e {i}</p></body>") for i in range(2)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    # each page shares a line with the page before only; the first with the page after
    assert got == {0: "own 0\n\nlink 0"} | {i: f"own {i}\n\nlink {i + 1}" for i in range(1, n)} | {n: "link 0\n\ne 0", n + 1: "link 1\n\ne 1"}


def plain(html):
    """The text of these synthetic pages, by plain means."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    import html as h

    parts = re.split(r"</?(?:p|h1)>", inner)
    cleaned = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in parts]
    return "\n\n".join(x for x in cleaned if x)


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op9_html_extract(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
