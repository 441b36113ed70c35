import time

import pytest

from threadloom.llm import html


def text(source):
    root = html.parse(source)
    return html.main_text(root, {}, ())


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<body><nav>menu</nav><article><h1>T &amp; U</h1><p>a\n b<p>c<b>d</b>e</article><footer>f</footer>", "T & U\na b\ncde"),
        ("<article><p>one<br>two</p><!-- no <p>x</p> --><script>var t='</p>';</script><div class=\"ad\">buy</div><ul><li>x<li>y</ul></article>", "one two\nx\ny"),
        ("<body><header>site</header><p>1 &lt; 2 &#233; &euro;</p><section id='comments'><p>me too</p></section><form>f</form>", "1 < 2 é €"),
        ("<article><header><h1>Head</h1></header><p>a < b <i>c</i></p><aside>side</aside><div hidden>h</div></article>", "Head\na < b c"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<article><p>loaded header<p>address: 1</p></article><div class='loading'>x</div>", "loaded header\naddress: 1"),
    ],
)
def test_blocks(source, want):
    assert text(source) == want


@pytest.mark.parametrize("limit", [html.BROADCAST_KEYS, -1])
def test_templates_by_host(spark, limit):
    box = "<div class='x'><p>Part of the network</p></div>"
    rows = [(i, "https://a.example/p", f"<body>{box}<div><p>story {i}</p></div></body>", 1) for i in range(20)]
    rows += [(100 + i, "https://b.example/p", f"<body><div><p>other {i}</p></div>{box}</body>", 1) for i in range(3)]
    rows += [(None, None, None, 1), (7, "https://a.example/p", rows[7][2], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").drop("text").repartition(3)
    got = sorted(((r.page_id, r.text) for r in html.extract(pages, broadcast_keys=limit).collect()), key=str)
    want = [(i, f"story {i}") for i in range(20)] + [(7, "story 7"), (None, "")] + [(100 + i, f"other {i}\nPart of the network") for i in range(3)]
    assert got == sorted(want, key=str)
    assert html.extract(pages.limit(0)).count() == 0


def test_a_wrapper_of_an_article_is_no_template(spark):
    page = "<body><div id='page'><p>Tagline</p><div id='content'><article><p>story {}</p></article></div></div></body>"
    pages = spark.createDataFrame([(i, "https://a.example/p", page.format(i)) for i in range(20)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html.extract(pages).collect()) == [(i, f"story {i}") for i in range(20)]


def test_templates_inside_articles_go_by_distinct_pages(spark):
    notice = "<div class='x'><p>Members read on.</p></div>"
    rows = [(i, "https://a.example/p", f"<article><p>story {i} <b>the</b> end</p>{notice if i < 6 else ''}</article>") for i in range(100)]
    rows += [(200 + i, "https://b.example/p", f"<article><p>story {i}</p>{notice}</article>") for i in range(5)]
    # one page at many addresses, with something else around it
    rows += [(300 + i, f"https://c.example/{i}", f"<div>menu {i}</div><article><p>copied</p>{notice}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"story {i} the end" for i in range(100)} | {200 + i: f"story {i}\nMembers read on." for i in range(5)} | {300 + i: "copied\nMembers read on." for i in range(20)}


def test_templates_of_a_section_of_a_large_host_go(spark):
    box = "<div class='x'><a>Section</a> <a>front</a></div>"
    rows = [(i, "https://a.example/p", f"<body>{box if i < 20 else ''}<p>story {i} <a>more</a></p></body>") for i in range(400)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i} more" for i in range(400)}


def test_prose_of_articles_stays_however_often_it_recurs(spark):
    proverb, links = "<p>Many hands make light work.</p>", "<ul><li><a href=/1>More</a></li><li><a href=/2><b>Most read</b></a></li></ul>"
    mixed = "<ul><li>see <a href=/1>this</a></li></ul>"
    rows = [
        (i, "https://a.example/p", f"<article><h1>Summary</h1><p>story {i}</p>{proverb if i < 6 else ''}<div>{proverb}</div>{links}{mixed}<div id=promo><p>Join us.</p></div><p class=lead>Said often.</p></article>")
        for i in range(400)
    ]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    told = "Many hands make light work."
    assert got == {i: "\n".join(["Summary", f"story {i}", *([told] if i < 6 else []), told, "see this", "Said often."]) for i in range(400)}


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><pre><code>x = 1 <span class='hljs-comment'># one</span></code></pre></article>", "x = 1 # one"),
        ("<article><h2 class='comments'>Replies</h2><h2 id='share'>On sharing</h2><p class='notice'>n <span class='search'>s</span></p></article>", "Replies\nOn sharing\nn s"),
        ("<main><div class='related-work'>r</div><div id='login-steps'>l</div><section id='comments'>c</section></main>", "r\nl\nc"),
        ("<article><p>press <button>OK</button> or <label>name</label></p><fieldset>f</fieldset><textarea>t &lt;</textarea><dialog>d</dialog></article>", "press OK or name\nf\nt <\nd"),
        ("<article>a<div class='x ad'>ad</div><ul class='share-list'><li>s</ul><div class='comments'>c</div><div class='advertisement'>x</div></article>", "a"),
        ("<main><article>a<div class='related'>r</div></article><div class='sidebar'>s</div><button>b</button></main>", "a\nr"),
        ("<body><label>l</label><div class='related-work'>r</div><p>b</p>", "b"),
    ],
)
def test_names_inside_articles_drop_only_clear_boxes(source, want):
    assert text(source) == want


@pytest.mark.parametrize(
    "source",
    ["<div>" * 100_000 + "</span>" * 100_000, "<a \"x " * 150_000, "<a x=\"x " * 120_000, "<b>" * 150_000 + "<hr>" * 100_000, "<!" * 400_000, "<span><article>" + "<div>" * 90_000 + "</span>" * 90_000,
     "<li>" * 200_000, "<table>" + "<td>" * 100_000 + "</li>" * 100_000, "<" * 800_000, "<p title='" * 90_000, "&" * 500_000, "<td " * 200_000, "</" * 400_000],
)
def test_long_hostile_pages_take_linear_time(source):
    began = time.process_time()
    root = html.parse(source)
    html.subtrees(root, "h")
    html.main_text(root, {}, ())
    assert time.process_time() - began < 15


def test_tags_with_odd_quotes():
    assert text("<article><p title=don't class='a>b'>one</p><p data-x=\"it's\">two</p></article>") == "one\ntwo"
    assert text("<article>1 <2 and a<b>c</b> <x</article>") == "1 <2 and ac <x"
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table>") == "a\nb\nc\nd\ne\nf"
    assert text("<div><span><div>a</span>b</div>c</div>") == "a\nb\nc" or text("<div><span><div>a</span>b</div>c</div>") == "a\nbc"


def test_very_long_page(spark):
    page = "<article>" + "<p>" + "word " * 400_000 + "</p></article>"
    out = html.extract(spark.createDataFrame([(1, "http://h/", page, "x")], "page_id long, url string, html string, key string")).first()
    assert len(out.text) == 5 * 400_000 - 1


def test_against_a_plain_count(spark):
    """Templates by brute force: each block's own text, counted over the pages of a host by eye of their strings."""
    import random
    from collections import defaultdict

    rnd = random.Random(4)
    boxes = [f"Box {k} of the site" for k in range(12)]
    pages, said = [], {}
    for i in range(120):
        host = f"h{i % 3}.example"
        parts = [(f"story {i} part {k}", False) for k in range(3)] + [(b, True) for b in boxes if rnd.random() < 0.1] + [(f"Proverb {k}", False) for k in range(4) if rnd.random() < 0.3]
        rnd.shuffle(parts)
        said[i] = (host, parts)
        # boxes are named containers; prose stands in bare ones
        pages.append((i, f"https://{host}/{i}", "<html><body><article>" + "".join(f"<div{' class=x' if box else ''}><p>{p}</p></div>" for p, box in parts) + "</article></body></html>"))
    on = defaultdict(set)
    for i, (host, parts) in said.items():
        for p, _ in parts:
            on[host, p].add(i)
    said = {i: (host, [p for p, _ in parts], {p for p, box in parts if box}) for i, (host, parts) in said.items()}
    want = {i: "\n".join(p for p in parts if p not in named or len(on[host, p]) <= html.MIN_PAGES) for i, (host, parts, named) in said.items()}
    assert max(len(on[h, "Proverb 0"]) for h, _, _ in said.values()) > html.MIN_PAGES
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want and any(len(p.split("\n")) < len(said[i][1]) for i, p in want.items()) and any("Box" in t for t in want.values())
