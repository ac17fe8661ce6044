import pytest
from pyspark.sql import functions as F

from gaugeflow.llm.html import Page, _hash, extract_text, host_of, page_nodes, style_tree

FULL = (
    '<!DOCTYPE html><html><head><title>Not &lt;this&gt;</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li>menu<li>more</ul></nav><div class="cookie-notice">We use cookies</div><div id="sidebar"><p>side</p></div>'
    '<main><article><header><h1>Title &amp; more</h1></header><div class="ad">Buy</div><p>one <b>two</b>three<br>four\n five<p>six&nbsp;seven<!-- no -->'
    '<ul><li>x<li>y</ul><form><input value="z">Name</form><p hidden>gone</p><section class="comments"><p>nice post</p></section></article></main>'
    "<aside>related</aside><footer>&copy; foot</footer></body></html>"
)


def test_main_text():
    assert Page(FULL).main_text() == "Title & more\none twothree four five\nsix seven\nx\ny"


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("", ""),
        ("plain a < b & c", "plain a < b & c"),
        ("<p>one<p>two", "one\ntwo"),
        ("<article><p><b>open<p>next</article>after", "open\nnext"),
        ('<article><p title="x > y">in</p></article>', "in"),
        ("<article>&#228;&eacute;&amp;lt; &am</article>", "äé&lt; &am"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><script>never ends <p>x", ""),
        ("<nav>only menus</nav>", ""),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article>" + "<div>" * 3000 + "deep" + "</article>", "deep"),
    ],
)
def test_markup(markup, text):
    assert Page(markup).main_text() == text


def test_boilerplate_of_a_host_goes_by_entropy(spark):
    rows = [(i, f"http://a.example/{i}", f'<body><div class="box">Always the same words</div><div class="text"><p>story number {i}</p></div></body>') for i in range(12)]
    rows += [(50, "http://b.example/1", rows[0][2]), (51, None, None), (52, None, ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    found = extract_text(pages).collect()
    assert len(found) == len(rows)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[3] == "story number 3" and texts[50] == "Always the same words\nstory number 0" and texts[51] == texts[52] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    nodes = page_nodes(pages.select("url", "html", F.lit(0).cast("long").alias("copy")))
    tree = {(r["host"], r["path"]): r for r in style_tree(nodes).filter("value IS NULL").collect()}
    assert tree["a.example", ">body>div.box"]["content"] == 0 and tree["a.example", ">body>div.text"]["content"] > 0.9
    assert extract_text(pages.limit(0)).count() == 0


def test_hosts():
    assert host_of("HTTPS://User@M.Example.org:80/x?u=//y") == "m.example.org" and host_of(None) == "" and host_of("no url") == ""


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<body class='has-sidebar'><article><p>in</article>", "in"),
        ("<div class='layout with-sidebar'><article><p>in</article></div>", "in"),
        ("<div class='sidebar'><article><p>in</article></div>", "in"),
        ("<article class='post has-comments'><p>in</article>", "in"),
        ("<main id='share-page'><p>in</main>", "in"),
        ("<article><section class='related-work'><p>in</section><div class='promo-history'>too</div></article>", "in\ntoo"),
        ("<article><p>in<div class='share-buttons'>x</div><div id='ad-slot-2'>y</div><div class='comments'><article>z</article></div></article>", "in"),
    ],
)
def test_a_name_alone_removes_no_article(markup, text):
    assert Page(markup).main_text() == text


def test_what_a_host_repeats_inside_articles_goes_by_entropy(spark):
    box = "<div class='about'><p>Written by the staff</p></div>"
    deep = "<div>" * 40 + "<div class='end'>Read on</div><div class='story'>depth {0}</div>" + "</div>" * 40
    page = "<body class='has-sidebar'><article class='post has-comments'><p>story {0}</p>" + box + "<div class='promo-history'>{1}</div><div class='related-work'>work {0}</div>" + deep + "</article></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i, i // 6)) for i in range(12)]
    rows += [(20, "http://b.example/1", page.format(20, 0))]
    rows += [(30 + i, f"http://c.example/{i}", page.format(30, 0)) for i in range(9)]  # copies of one page
    rows += [(50 + i, f"http://d.example/{i}", f"<body><div>{'<div>' * 30}<div class='x'>same</div><div class='y'>own {i}</div>") for i in range(8)]
    found = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "story 3\nwork 3\ndepth 3"
    assert found[20] == "story 20\nWritten by the staff\n0\nwork 20\nRead on\ndepth 20"
    assert found[30] == "story 30\nWritten by the staff\n0\nwork 30\nRead on\ndepth 30"
    assert found[51] == "own 1"


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_near_copies_of_a_page_keep_their_text(spark):
    story = "<h1>One title</h1><p>The same long story, told again and again.</p><p>It has a second paragraph, too.</p>"
    outside = [(i, f"http://a.example/?s={i}", f"<body data-session='{i}'><article>{story}</article><footer>{i}</footer></body>") for i in range(5)]
    inside = [(10 + i, f"http://b.example/?s={i}", f"<body><article>{story}<p>Session {i}</p></article></body>") for i in range(5)]
    bare = [(20 + i, f"http://c.example/?s={i}", f"<body><div>{story}</div><div class='n'>{i}</div></body>") for i in range(5)]
    found = texts_of(spark, outside + inside + bare)
    text = "One title\nThe same long story, told again and again.\nIt has a second paragraph, too."
    assert [found[i] for i in range(5)] == [text] * 5
    assert [found[10 + i] for i in range(5)] == [f"{text}\nSession {i}" for i in range(5)]
    assert [found[20 + i] for i in range(5)] == [f"{text}\n{i}" for i in range(5)]


def test_a_plain_paragraph_repeated_in_articles_goes(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><h1>Title {i}</h1><p>Story number {i}, with words of its own.</p><p>Buy now for less.</p></article>") for i in range(8)]
    rows.append((9, "http://b.example/9", rows[0][2]))
    found = texts_of(spark, rows)
    assert [found[i] for i in range(8)] == [f"Title {i}\nStory number {i}, with words of its own." for i in range(8)]
    assert found[9].endswith("Buy now for less.")


def test_tree_against_plain_counting(spark):
    import math
    from collections import Counter, defaultdict

    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div class='a'>x{i % 3}</div><div class='b'><p>y{i // 4}</p><p>same</p></div>{'<hr><div>z</div>' * (i % 2)}</body>") for i in range(24)]
    rows += rows[:6]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {(r["host"], r["path"], r["value"]): r for r in style_tree(page_nodes(pages.select("url", "html", F.xxhash64("html").alias("copy")))).collect()}
    values, blocks = defaultdict(dict), defaultdict(set)
    for _, url, markup in rows:
        page, host = Page(markup), host_of(url)
        for path, two in page.nodes.items():
            for kind, parts in enumerate(two):
                values[host, path, kind][page.main_text()] = tuple(parts)
        for text, nodes in page.main_blocks():
            if nodes:
                blocks[host, nodes[-1].path, text].add(page.main_text())

    def entropy(kinds):
        m, counts = len(kinds), Counter(kinds.values()).values()
        return -sum(n / m * math.log(n / m) for n in counts) / math.log(m) if m > 1 else 1.0

    for (host, path, kind), kinds in values.items():
        assert found[host, path, None][("presentation", "content")[kind]] == pytest.approx(entropy(kinds)), path
    repeated = {k: v for k, v in blocks.items() if len(v) > 1}
    assert len(found) == len({k[:2] for k in values}) + len(repeated)
    for (host, path, text), own in repeated.items():
        assert found[host, path, _hash([text])]["content"] == pytest.approx(1 - len(own) / len(values[host, path, 1]))
