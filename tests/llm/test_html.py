import pytest

from chronoweave.llm import html


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a\n  b</p><p>c</p>", "a b\nc"), ("a<br>b<br/>c", "a\nb\nc"), ("<p>a <b>b</b>c <i>d</i></p>", "a bc d"),
        ("<article><h1>T</h1><p>x</p></article><p>out</p>", "T\nx"), ("<nav>m</nav><main><p>x</p></main><footer>f</footer>", "x"),
        ("<p>x</p><script>if (a < b) { '<p>no</p>' }</script><style>p{}</style>", "x"), ("<head><title>t</title></head><body><p>x</p></body>", "x"),
        ("<div class='ad-banner'>buy</div><p>x</p>", "x"), ('<div id="comments"><p>c</p></div><p>x</p>', "x"), ("<div class=adult><p>x</p></div>", "x"), ("<p>x<!-- <p>c</p> -->y</p>", "xy"),
        ("<p>&lt;b&gt; &#233;&eacute;&#x41; &nbsp; z</p>", "<b> éé A z".replace(" A", "A")), ("<p>a", "a"), ("<p title='<p>'>a</p>", "a"), ("<article><p>q</p><aside>s</aside><p>r</p></article>", "q\nr"),
        ("<form><p>f</p></form><p hidden>h</p><p style='display: none'>n</p><p>x</p>", "x"), ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
        ("<ul><li>a</li><li>b</li></ul>", "a\nb"), ("<table><tr><td>a</td><td>b</td></tr></table>", "a\nb"), ("<textarea>t</textarea><p>x</p>", "x"),
        # a left-out element ends with what it stands in, and by the end tags that HTML implies
        ("<article><p class=notice>n<p>x</article>", "x"), ("<article><ul><li class='nav'>m<li>x</ul><p>y</p></article>", "x\ny"), ("<main><div><p class='ad'>a</div><p>x</p></main>", "x"),
        # names that only contain such a word
        ("<article><p class='social-history'>a</p><p class='share-prices'>b</p><p class='cookie-notice'>n</p></article>", "a\nb"), ("<article class='post has-sidebar share'><p>x</p></article>", "x"),
        ("<div class='overflow-hidden'><p>x</p></div>", "x"), ("<div data-x='hidden'><p>x</p></div>", "x"), ("<article><p>x</p><article class='comment'><p>c</p></article></article>", "x"),
        # marks in comments and empty marks are none
        ("<!-- <article > --><p>x</p>", "x"), ("<main></main><p>x</p>", "x"), ("<article><span><p>x</span><p>y</article><p>z</p>", "x\ny"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def lcs(a, b):
    best = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + (a[i - 1] == b[j - 1]))
            else:
                best[i, j] = 0
    return best[len(a), len(b)]


def test_longest_common_subsequence():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = sorted(html.common_lines(a, b))
        assert len(got) == lcs(a, b)
        it = iter(b)
        assert all(any(x == a[k] for x in it) for k in got)  # in order


def page(*lines):
    return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"


def test_template_lines_go(spark):
    rows = [(k, f"https://h.example/a/{k}?q=1", page("Home", f"own {k}", "shared tail")) for k in range(6)]
    rows += [(10, "https://other.example/x", page("Home", "alone", "shared tail")), (11, None, page("no url")), (12, "https://h.example/a/m", "<article><p>Home</p></article>"), (13, "x", None)]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)).collect()}
    assert [got[k]["text"] for k in range(6)] == [f"own {k}" for k in range(6)]
    assert got[10]["text"] == "Home\nalone\nshared tail" and got[11]["text"] == "no url" and got[12]["text"] == "Home" and got[13]["text"] == "" and got[13]["n_chars"] == 0
    assert got[10]["url"] == "https://other.example/x" and got[10]["n_chars"] == 22
    assert got[12]["n_shared"] is None and got[12]["marked"] and not got[0]["marked"] and got[0]["n_shared"] == 2


def test_equal_pages_keep_their_text(spark):
    """Copies at one URL and at neighbouring ones, with and without another page on the host."""
    rows = [(k, "http://one.example/a", page("Home", "text")) for k in (1, 2)] + [(k, f"http://two.example/a/{k}", page("Home", "text")) for k in range(3, 9)]
    rows += [(20, "http://two.example/b", page("Home", "else")), (None, None, page("Home"))]
    got = sorted((r["page_id"] or 0, r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect())
    assert got == [(0, "Home"), (1, "Home\ntext"), (2, "Home\ntext"), *[(k, "text") for k in range(3, 9)], (20, "else")]


def test_a_mark_in_a_comment_spoils_nothing(spark):
    rows = [(1, "http://h/a/1", "<!-- <article > -->" + page("Home", "one")), (2, "http://h/a/2", page("Home", "two")), (3, "http://h/a/3", "<main></main>" + page("Home", "three"))]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {1: "one", 2: "two", 3: "three"}


@pytest.mark.parametrize("block", [500, 3, 2, 1])
def test_neighbours_don_t_depend_on_blocks(spark, monkeypatch, block):
    """Each page against the nearer of its two neighbours in the order of all pages."""
    import random

    monkeypatch.setattr(html, "BLOCK_PAGES", block)
    rng = random.Random(4)
    rows = [(k, f"http://h{k % 3}.example/{rng.choice('ab')}/{rng.choice('cd')}/{k}", page(*[rng.choice("uvwxyz") * 3 for _ in range(6)])) for k in range(40)]
    rows += [(100 + k, u + "/copy", h) for k, u, h in rows[:10]]
    every = sorted((u.split("/")[2], "/" + "/".join(u.split("/")[3:]), k, [x for x, _ in html.blocks(h)]) for k, u, h in rows)
    ordered, of, want = [], {}, {}
    for x in every:  # equal pages of a host are one, at the least path
        if (x[0], *x[3]) not in of:
            ordered.append(x)
        of.setdefault((x[0], *x[3]), []).append(x[2])
    for i, (host, path, k, lines) in enumerate(ordered):
        near = [ordered[j] for j in (i - 1, i + 1) if 0 <= j < len(ordered) and ordered[j][0] == host]
        other = max(near, key=lambda x: html.shared_prefix(x[1], path))
        gone = html.common_lines(lines, other[3])
        want |= {same: "\n".join(x for n, x in enumerate(lines) if n not in gone) for same in of[host, *lines]}
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == want


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x", "y")], "page_id bigint, url string, html string, text string, host string")
    assert [tuple(r)[:4] for r in html.extract(df).collect()] == [(1, "u", "a", 1)]
    assert html.extract(df.where("false")).count() == 0


def test_long_page_and_deep_nesting():
    assert html.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(html.main_text("<p>word</p>" * 20_000).split("\n")) == 20_000
    assert html.main_text("<" * 20_000).count("<") >= 0
