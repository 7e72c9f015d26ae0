import random
import time
from functools import lru_cache

from corpusprep.llm import page_diff as H


def text(html):
    return H.main_text([H.block_lines(html)], 0)


def test_structure():
    assert text("<body><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p><b>One  two<br>three.<br><p>Four</p></article><footer>&copy; x</footer>") == "T & U\n\nOne two three.\n\nFour"
    assert text("<main><p>a</p><aside>no</aside><article class='comment'>no</article><div class='share-bar'>no</div><p>b<script>if (a<b) x('</p>')</script> c</p></main>") == "a\n\nb c"
    assert text("<article><header><h1>T</h1></header><div class=article-header>H</div><p>x <span class=ad>no</span> y</p><form><p>no</p></form><section id=comments><p>no</p></section></article>") == "T\n\nH\n\nx y"
    assert text("<div class='has-sidebar'><p>1 < 2 &lt;b&gt; it's <i>so</i></p><p title=it's>q</p></div>") == "1 < 2 <b> it's so\n\nq"
    assert text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>") == "a\n\nb\n\nc\n\nd"
    assert text("<article><p>cut &am") == "cut &am" and text("") == "" and text("<p") == "" and text("<!-- <p>a</p> --><p>b") == "b"
    assert text("<article><p>a<!-- x --> b</p><style>p{}</style><p>c") == "a b\n\nc"
    assert text("<div class='cookie-notice'><p>We use</p></div><div role=banner>x</div><p>kept</p>") == "kept"


def test_names_are_no_proof():
    story, menu = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4)), "<div class=menu><a>Home</a> <a>News</a></div>"
    want = "\n\n".join(f"{'word ' * 30}{i}" for i in range(4))
    for wrapper in ("<div class='page-with-sidebar'>", "<div class='sidebar-left page'>", "<form id=aspnetForm>", "<div class='header-fixed'><div class='toolbar_on'><form>"):
        assert text(f"{menu}{wrapper}{menu}{story}") == want
        assert text(f"{menu}{wrapper}{menu}<article>{story}</article><p>other</p><div class=comments>{story}</div>") == want
    assert text(f"<article>{story}<div class='social-science'><p>{'fact ' * 40}</p></div><div class=social-links><a>{'share ' * 30}</a></div></article>") == want + "\n\n" + ("fact " * 40).strip()
    # small forms, sidebars, and whatever holds comments, notices or adverts stay out
    assert text(f"<article>{story}<form><p>Name</p></form><div class=sidebar><p>{'aside ' * 30}</p></div></article>") == want
    assert text(f"<p>short</p><div class=comments>{story}</div><div class='cookie-notice'>{story}</div><div class=ad>{story}</div><nav>{story}</nav>") == "short"


def test_hostile_nesting_takes_linear_time():
    n = 100_000
    for page, want in (("<div>" * n + "</p>" * n + "x", "x"), ("<span>" + "<div>" + "<b>" * n + "</span>" * n + "x", "x"), ("<div class=sidebar>" * n + "x", "x"),
                       ("<li>a" * n, "\n\n".join("a" * n)), ("<a ='" * n, ""), ("<!-- " * n, ""), ("<p><form>" * n + "</p>" * n + "x", "x")):
        start = time.process_time()
        assert text(page) == want
        assert time.process_time() - start < 30


def test_lcs_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        a = [r.choice("abcd") for _ in range(r.randint(0, 9))]
        b = [r.choice("abcd") for _ in range(r.randint(0, 9))]

        @lru_cache(None)
        def best(i, j):
            if i == len(a) or j == len(b):
                return 0
            return max(best(i + 1, j), best(i, j + 1), 1 + best(i + 1, j + 1) if a[i] == b[j] else 0)

        got = sorted(H.common_lines(a, b))
        assert len(got) == best(0, 0)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_differencing_of_unmarked_pages(spark):
    top, end = "<div>Site title</div><ul><li>Home<li>News</ul>", "<div>All our pages</div>"
    rows = [(i, f"http://h{i % 2}.example/p/{i:03}", f"{top}<p>Story {i}</p><p>Told {i} times</p>{end}", "x") for i in range(200)]
    rows += [(300, "http://h0.example/p/004?x=1", rows[4][2], "x"), (301, None, "<p>alone", "x"), (302, "http://h0.example/q", None, "x"), (302, "http://h0.example/q", None, "x"),
             (303, "odd url", "", "x"), (None, "http://h9.example/", "<article>a\t b</article>", "x"), (304, "http://h1.example/big", f"<article><p>{'word ' * 200_000}</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    out = H.extract(df).collect()
    assert len(out) == len(rows)
    got = {o.page_id: o.text for o in out}
    for i in range(200):
        assert got[i] == f"Story {i}\n\nTold {i} times", i
    assert got[300] == got[4] and got[301] == "alone" and got[302] == got[303] == "" and got[None] == "a b"
    assert got[304] == ("word " * 200_000).strip()
    assert H.extract(df.where("false")).count() == 0


def test_runs_of_equal_pages_and_edges_of_ranges(spark):
    top, end = "<div>Site title</div>", "<div>All our pages</div>"
    page = lambda *own: f"{top}{''.join(f'<p>{x}</p>' for x in own)}{end}"
    rows, want = [], {}

    def put(url, html, text):
        want[len(rows)] = text
        rows.append((len(rows), url, html))

    for i in range(150):  # equal pages, longer than any task holds
        put(f"http://a.example/m?x={i}", page("One story"), "One story")
    put("http://a.example/a", page("First"), "First")
    put("http://a.example/z", page("Last"), "Last")
    for i in range(40):
        put(f"http://b.example/{i // 3:02}/{i % 3}", page(f"Story {i // 3}", "Told"), f"Story {i // 3}")
    for i in range(70):  # nothing but one page at many URLs
        put(f"http://c.example/?x={i}", page("Alone"), "Site title\n\nAlone\n\nAll our pages")
    put("http://d.example/", "<article>Marked</article>", "Marked")
    put("http://d.example/", "", "")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    parts, coalesce = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            out = H.extract(df).collect()
            assert len(out) == len(rows) and {o.page_id: o.text for o in out} == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_neighbours_of_edges():
    e = [(0, 0, "h", "a"), (0, 1, "h", "b"), (1, 0, "h", "b"), (3, 0, "h", "b"), (4, 0, "h", "b"), (4, 1, "h", "c"), (4, 8, "h", "d"), (4, 9, "i", "d")]
    assert H.edge_neighbours(e) == [(0, 0, None, None, 0, 1), (0, 1, 0, 0, 4, 1), (1, 0, 0, 0, 4, 1), (3, 0, 0, 0, 4, 1), (4, 0, 0, 0, 4, 1), (4, 9, None, None, None, None)]


def test_lcs_by_bits():
    r = random.Random(3)
    for n in range(300):
        a, b = ([r.choice("abcd"[:1 + n % 4]) for _ in range(r.randint(0, 30))] for _ in range(2))
        got = sorted(H.common_lines(a, b, dense=0))
        assert len(got) == len(H.common_lines(a, b, dense=10**9))
        it = iter(b)
        assert all(a[i] in it for i in got)
    # 10^10 equal pairs
    n = 100_000
    start = time.process_time()
    assert len(H.common_lines(["cell"] * n + ["own"], ["row", "cell"] * (n // 2))) == n // 2
    assert time.process_time() - start < 60


def test_every_page_passes_through_differencing(spark):
    top, end = "<div>Site title</div>", "<div>All our pages</div>"
    rows = [(i, f"http://a.example/{i:03}", f"{top}<article><p>Story {i}</p><p>As told before</p></article>{end}") for i in range(60)]
    rows += [(i, f"http://b.example/{i:03}", f"{top}<main><p>Story {i}</p><p>As told before</p></main>{end}") for i in range(60, 90)]
    rows += [(i, f"http://c.example/{i:03}", f"{top}<p>Story {i}</p><p>As told before</p>{end}") for i in range(90, 120)]
    rows += [(120, "http://d.example/", f"{top}<article><p>Alone</p></article>"), (121, "http://e.example/", "<nav>no lines</nav>")]
    # more equal pages than a task holds, between two others
    rows += [(200 + i, f"http://f.example/m?x={i}", f"{top}{'<p>Equal</p>' if i % 2 else '<article>Equal</article>'}{end}") for i in range(2500)]
    rows += [(130, "http://f.example/a", f"{top}<p>First"), (131, "http://f.example/z", f"<p>Last</p>{end}")]
    got = {o.page_id: (o.text, o.n_shared, o.n_restored) for o in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = {i: (f"Story {i}\n\nAs told before", 3, 1) for i in range(90)} | {i: (f"Story {i}", 3, 0) for i in range(90, 120)} | {120: ("Alone", 0, 0), 121: ("", 0, 0)}
    want |= {200 + i: ("Equal", 2, 0) for i in range(2500)} | {130: ("First", 1, 0), 131: ("Last", 1, 0)}
    assert got == want


def test_extract_against_main_text(spark):
    r = random.Random(4)
    wraps = ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<main><p>z<article>{}</article></main>"]
    rows = []
    for k in range(400):
        block = lambda n: "".join(f"<p>{r.choice('abcdefgh')}</p>" for _ in range(n))
        page = r.choice([None, "", *[block(r.randint(0, 2)) + r.choice(wraps).format(block(r.randint(0, 3))) + block(r.randint(0, 2)) for _ in range(9)]])
        rows.append((k, r.choice([None, *[f"http://{r.choice('xy')}.example/{k // r.randint(1, 9):03}?q={k}" for _ in range(19)]]), page))
    hosts = {}
    for k, url, page in sorted(rows, key=lambda x: (x[1] or "").split("?")[0][7:] + f" {x[0]:03}"):
        hosts.setdefault((url or "http://")[7:8], []).append((k, H.block_lines(page or "")))
    want = {k: H.main_text([p for _, p in pages], i) for pages in hosts.values() for i, (k, _) in enumerate(pages)}
    df = spark.createDataFrame(rows + rows[:50], "page_id long, url string, html string").repartition(3)
    # rows given twice are one run
    parts, coalesce = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            out = H.extract(df).collect()
            assert len(out) == 450 and {o.page_id: o.text for o in out} == want, n
            assert sum(o.n_restored for o in out) > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
