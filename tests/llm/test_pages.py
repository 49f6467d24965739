import random
import re
from collections import Counter
from itertools import combinations

import pytest
import xxhash

from genoplane.llm import html_text, url_rules

SCHEMA = "page_id long, url string, html string, host string, text string, rule int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "t", 1) for i, u, h in rows], SCHEMA).repartition(3)


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for says, h, p in url_rules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, says)
    return host, path, *(best or (None, None))


URLS = [
    None, "", "no scheme", "http://Example.COM/en/7x", "https://a.example.com/en/8", "http://notexample.com/en/7", "http://com/en/", "http://x.com?/en/", "http://x.com/EN/1",
    "http://b.net/de/1", "http://example.net/de/81#a", "http://c.org/es/?q=1&r", "ftp://http://d.org/es/", "http://x.org/es", "://com/en/", "http://e.net#/de/",
]


def url_tokens(url, host, path):
    if url is None:
        url = ""
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url)
    out = {"host:" + x for x in host.split(".") if x} | {"path:" + x for x in path.lower().split("/") if x}
    out |= {"query:" + n for n in (x.split("=", 1)[0] for x in (query[1] if query else "").split("&")) if n}
    return out | ({"fragment"} if "#" in url else set()) | ({"scheme:" + url.split("://", 1)[0]} if "://" in url else set())


def brute_verdicts(urls, min_support, min_confidence, min_labelled=0.5):
    split = [plain_rule(u) for u in urls]
    items = [frozenset(url_tokens(u, s[0], s[1])) for u, s in zip(urls, split)]
    held = [xxhash.xxh64_intdigest(u.encode(), 42) % 2**64 if u is not None else 42 for u in urls]
    held = [(h - 2**64 if h >> 63 else h) % 5 == 0 for h in held]
    learn = [(t, s[3]) for t, s, h in zip(items, split, held) if s[3] and not h]
    on = {}
    for k, (t, _) in enumerate(learn):
        for x in t:
            on.setdefault(x, set()).add(k)
    first = {}
    for x in sorted(on):
        if len(on[x]) >= min_support * len(learn):
            first.setdefault(frozenset(on[x]), x)
    chosen = set(first.values())
    least = -(-min_support * len(learn) // 1)
    seen, says = Counter(), Counter()
    for t, v in learn:
        for n in range(1, len(t & chosen) + 1):
            for c in combinations(sorted(t & chosen), n):
                seen[c] += 1
                says[c, v] += 1
    mined = []
    for (c, v), n in says.items():
        met = [(s[3], h) for t, s, h in zip(items, split, held) if set(c) <= t]
        tested = [x == v for x, h in met if x and h]
        if n >= least and n / seen[c] >= min_confidence and sum(1 for x, _ in met if x) >= min_labelled * len(met) and tested and sum(tested) >= min_confidence * len(tested):
            mined.append((c, v, n / seen[c], n / len(learn)))
    mined = [m for m in mined if not any(set(o[0]) < set(m[0]) and o[1] == m[1] and o[2] >= m[2] for o in mined)]
    out = []
    for u, t, s in zip(urls, items, split):
        met = [m for m in mined if set(m[0]) <= t]
        best = max(met, key=lambda m: (m[2], m[3], len(m[0]), " ".join(m[0])), default=None)
        out.append((s[0], s[1], s[2], s[3] or (best[1] if best else "allow")))
    return out


def test_verdicts_match_brute_force(spark):
    rng = random.Random(6)
    host = lambda: f"{rng.choice(['www', 'm', 'blog'])}.{rng.choice(['example', 'other'])}.{rng.choice(['com', 'com', 'com', 'net', 'org'])}"
    urls = URLS + [f"http{rng.choice(['', 's'])}://{host()}/{rng.choice(['en', 'en', 'en', 'de', 'es'])}/{rng.choice([7, 8, 9])}{rng.choice(['', '?ref=x&by=y', '#top'])}" for _ in range(220)]
    rows = [(k, u, None) for k, u in enumerate(urls)] + [(None, urls[20], "")]
    got = url_rules.judge(pages_of(spark, rows), min_support=0.03, min_confidence=0.7).collect()
    want = brute_verdicts([u for _, u, _ in rows], 0.03, 0.7)
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, ((i, *w) for (i, _, _), w in zip(rows, want))))
    assert any(r.rule is None and r.mined for r in got) and any(r.rule is None and r.verdict == "block" for r in got)


def test_mined_rules_decide_open_urls_of_the_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = url_rules.judge(pages).collect()
    assert sum(r.rule is None and r.mined is not None for r in got) > 50
    rule, says = url_rules.written_rule(url_rules.RULES)
    rows = url_rules.split_url(pages).withColumn("verdict", says).withColumn("tokens", url_rules.tokens())
    told = [(r.held_out_right, r.held_out_urls) for r in url_rules.mine(rows).collect()]
    assert sum(a for a, _ in told) > 0.8 * sum(b for _, b in told)


def test_wide_urls_do_not_multiply_rules(spark):
    names = "&".join(f"q{k}=1" for k in range(60))
    rows = [(k, f"http://h{k % 3}.example.com/en/{k}?{names}", None) for k in range(200)] + [(1000 + k, f"http://h{k % 3}.example.com/fr/{k}?{names}", None) for k in range(20)]
    got = url_rules.judge(pages_of(spark, rows)).collect()
    assert len(got) == 220 and all(r.verdict == "block" for r in got if r.page_id >= 1000)


def test_empty_pages(spark):
    empty = pages_of(spark, [(1, "http://a.com", "x")]).limit(0)
    assert url_rules.judge(empty).count() == 0
    assert html_text.extract_pages(empty).count() == 0


def page(article, menu="Home", tail="</article><footer>&copy; us</footer></body></html>"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">{menu}</a></li></ul></nav><!-- c --><div class="ad">Buy</div><article>{article}{tail}'


CASES = [
    ("<h1>A &amp; B</h1><p><b>one\n two<br>three<p>four</p>", "A & B\none two three\nfour"),
    ("<p>x<script>bad</script> y</p><aside>no</aside><form><p>no</p></form><p>&lt;p&gt; z&nbsp;</p>", "x y\n<p> z"),
    ("<div class='user-comments'><p>no</p></div><ul><li>a<li>b</ul>tail", "a\nb\ntail"),
    ("<header><h1>Kept</h1></header><p>text</p><footer>no</footer>", "Kept\ntext"),
    ("<p>é 日本 " + "long " * 20000 + "</p>", "é 日本 " + ("long " * 20000).strip()),
    ("", ""),
]


@pytest.mark.parametrize("article,text", CASES)
def test_extract_single_page(article, text):
    assert html_text.extract(page(article), html_text.induce([page(article)])) == text
    assert html_text.extract(page(article), None) == text


def test_truncated_pages():
    whole = page("<p>one &amp; two</p><p>three</p>", tail="")
    assert html_text.extract(whole, None) == "one & two\nthree"
    assert html_text.extract(whole[: whole.index("&amp;") + 3], None) == "one &am"
    assert html_text.extract(whole + "<p cla", None) == "one & two\nthree"
    assert html_text.extract("plain words only", None) == "plain words only"
    assert html_text.extract(None, None) == html_text.extract("", {"constants": [], "region": "/x"}) == ""


def test_tree_matching_is_largest_alignment():
    a = html_text.parse("<div><p>1</p><ul><li>a</li></ul><p>2</p></div>")
    b = html_text.parse("<div><p>1</p><p>3</p></div>")
    size, pairs = html_text.tree_match(a, b)
    assert size == 6  # root, div, two p and their texts
    assert [(x, y) for _, x, y in pairs] == [("2", "3"), ("1", "1")] or [(x, y) for _, x, y in pairs] == [("1", "1"), ("2", "3")]


def test_constant_nodes_are_template_and_varying_ones_content(spark):
    rows = []
    for k in range(12):
        body = f"<div class='box'><p>Welcome to our site</p><div class='main-text'><p>Story {k} begins here.</p><p>It goes on {k * k} times and more.</p></div><p>All rights kept</p></div>"
        rows.append((k, f"http://site.example.org/{k}", f"<html><body>{body}</body></html>"))
    rows += [(100, "http://lone.example.org/", page("<p>Welcome to our site</p>")), (101, None, None), (102, "http://site.example.org/e", ""), (5, rows[5][1], rows[5][2]), (None, rows[3][1], rows[3][2])]
    for broadcast_bytes in (0, 1 << 20):
        got = html_text.extract_pages(pages_of(spark, rows), broadcast_bytes=broadcast_bytes).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.page_id == 100:
                assert r.text == "Welcome to our site"
            elif r.page_id in (101, 102):
                assert (r.text, r.n_chars) == ("", 0)
            else:
                k = 3 if r.page_id is None else r.page_id
                assert r.text == f"Story {k} begins here.\nIt goes on {k * k} times and more." and r.n_chars == len(r.text)


@pytest.mark.parametrize("tag", ["article", "div"])
def test_parts_beside_the_body_stay(tag):
    made = lambda k: f"<html><body><{tag}><h1>Title {k}</h1><p>Lead {k}</p><div class=body><p>{f'Story {k} is long. ' * 50}</p></div><p>Last part {k}</p></{tag}></body></html>"
    wrapper = html_text.induce([made(k) for k in range(4)])
    for k in (0, 9):
        assert html_text.extract(made(k), wrapper) == f"Title {k}\nLead {k}\n{(f'Story {k} is long. ' * 50).strip()}\nLast part {k}"


def test_teasers_are_not_the_page():
    teaser = "<html><body><div><p>" + "Long story. " * 20 + "</p></div><article><p>Read more</p></article></body></html>"
    assert html_text.extract(teaser, None) == ("Long story. " * 20).strip() + "\nRead more"


def extracted(spark, made):
    """{page_id: text} for (page_id, url, html)."""
    return {r.page_id: r.text for r in html_text.extract_pages(pages_of(spark, made)).collect()}


def test_template_is_counted_over_every_different_page(spark):
    body = lambda notice, k: f"<html><body><div class=box><p>{notice}</p><p>Story {k} of its own.</p></div></body></html>"
    # A hot host with copies of one page, another under a second url, and small hosts.
    rows = [(k, f"http://hot.org/{k}", body("Welcome", 0)) for k in range(200)] + [(1000 + k, f"http://hot.org/a/{k}", body("Welcome", k)) for k in range(20)]
    rows += [(2000 + 10 * h + k, f"http://small{h}.org/{k}", body(f"Notice {h}", k)) for h in range(8) for k in range(3)]
    # Two different pages and 50 copies show no template.
    rows += [(3000 + k, f"http://copies.org/{k}", body("Kept", k % 2)) for k in range(50)]
    # Sections with notices of their own, and a second layout on one page in four.
    rows += [(4000 + k, f"http://wide.org/s{k % 4}/{k}", body(f"Menu of {k % 4}", k)) for k in range(40)]
    other = lambda k: f"<html><body><div class=wide><p>Second layout</p><p>Other {k} text.</p></div></body></html>"
    rows += [(5000 + k, f"http://two.org/{k}", other(k) if k % 4 == 0 else body("First layout", k)) for k in range(40)]
    # A text that 4 pages of 20 share is no template.
    rows += [(6000 + k, f"http://few.org/{k}", body("Same by chance" if k < 4 else f"Lead {k}", k)) for k in range(20)]
    got = extracted(spark, rows)
    assert {got[k] for k in range(200)} == {"Story 0 of its own."}
    assert all(got[1000 + k] == f"Story {k} of its own." for k in range(20))
    assert all(got[2000 + 10 * h + k] == f"Story {k} of its own." for h in range(8) for k in range(3))
    assert all(got[3000 + k] == f"Kept\nStory {k % 2} of its own." for k in range(50))
    assert all(got[4000 + k] == f"Story {k} of its own." for k in range(40))
    assert all(got[5000 + k] == (f"Other {k} text." if k % 4 == 0 else f"Story {k} of its own.") for k in range(40))
    assert all(got[6000 + k] == ("Same by chance" if k < 4 else f"Lead {k}") + f"\nStory {k} of its own." for k in range(20))


def test_induced_in_memory_as_by_spark(spark):
    made = [f"<body><p>Top</p><p>Text {k}</p><div>{'Often' if k % 3 else k}</div></body>" for k in range(9)]
    wrapper = html_text.induce(made + made[:3])
    got = extracted(spark, [(k, "http://one.org/x", s) for k, s in enumerate(made + made[:3])])
    assert all(got[k] == html_text.extract(s, wrapper) == (f"Text {k}" if k % 3 else f"Text {k}\n{k}") for k, s in enumerate(made))


def test_template_blocks_with_links_and_bold_text():
    made = lambda k: f"<html><body><div><a>Home</a> <a>Terms</a></div><p><b>Notice:</b> read <i>on</i></p><p>Story <b>{k}</b> here.</p></body></html>"
    wrapper = html_text.induce([made(k) for k in range(4)])
    assert html_text.extract(made(7), wrapper) == "Story 7 here."


def test_template_behind_many_children():
    made = lambda k: "<body><div>" + "".join(f"<p>Item {k} {j}</p>" for j in range(300)) + "<p>Closing note</p></div></body>"
    assert html_text.extract(made(7), html_text.induce([made(k) for k in range(4)])).endswith("\nItem 7 299")
    a, b = ("<div>" + "<p>x</p>" * n + "<h2>End</h2></div>" for n in (250, 240))
    assert ("/div/h2", "End", "End") in html_text.tree_match(html_text.parse(a), html_text.parse(b))[1]


def brute_match(a, b):
    """Simple tree matching by its recursive definition, on (label, children)."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(x, y))
    return m[-1][-1] + 1


def random_tree(rng, depth=0):
    return rng.choice("abc"), [random_tree(rng, depth + 1) for _ in range(rng.choice([0, 1, 2, 3, 5]) if depth < 4 else 0)]


@pytest.mark.parametrize("cells", [1 << 22, 1])
def test_tree_matching_equals_brute_force(cells, monkeypatch):
    monkeypatch.setattr(html_text, "TABLE_CELLS", cells)
    rng = random.Random(4)
    for _ in range(150):
        a, b = ("r", random_tree(rng)[1]), ("r", random_tree(rng)[1])
        source = lambda t: f"<x{t[0]}>{''.join(map(source, t[1]))}</x{t[0]}>"
        assert html_text.tree_match(html_text.parse(source(a)), html_text.parse(source(b)))[0] == brute_match(a, b) + 1
        shapes = html_text.Shapes()
        number = lambda t: shapes.number(t[0], tuple(map(number, t[1])))
        xs, ys = [number(t) for t in a[1]], [number(t) for t in b[1]]
        pairs = shapes.align(xs, ys)
        assert sum(shapes.weight(xs[i], ys[j]) for i, j in pairs) + 1 == brute_match(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_wrapper_decides_without_names():
    """Texts of menus, adverts and footers vary, no element has a telling name: the structure tells them apart."""
    made = lambda k, n: (
        f"<html><body><div><ul>{''.join(f'<li><a href=/{k}{j}>Link {k} {j}</a></li>' for j in range(5))}</ul></div><div class=x><span>Buy {k} now</span></div>"
        f"<div class=story><h1>Title {k}</h1><div class=text>{''.join(f'<p>Part {j} of {k}.</p>' for j in range(n))}</div><p>Closing {k}</p></div><div class=y>All rights {k}</div></body></html>"
    )
    wrapper = html_text.induce([made(k, 1 + k % 4) for k in range(8)])
    want = "\n".join(["Title 99", *(f"Part {j} of 99." for j in range(7)), "Closing 99"])
    assert html_text.extract(made(99, 7), wrapper, names=False) == html_text.extract(made(99, 7), wrapper) == want
    assert html_text.extract(made(99, 7), None) != want


def test_names_are_whole():
    kept = "<article><div class='ad-hoc-queries'><p>One</p></div><p id='related-work'>Two</p><div class='header'>Three</div><div class='ad-1'>no</div><div class='site-header menu'>no</div></article>"
    assert html_text.extract(f"<body>{kept}</body>", None) == "One\nTwo\nThree"


def test_deep_and_wide_pages(spark):
    deep = lambda k: "<html><body>" + "<div>" * 1500 + f"Text {k}" + "</div>" * 1500 + "<p>x</p>" * k + "</body></html>"
    wide = lambda k: "<html><body><div>" + "".join(f"<p>Item {j} {k}</p><b>and {k}</b><ul><li>x{j} {k}</ul>" for j in range(5000 + k)) + "</div></body></html>"
    alternating = lambda k: "<body><div>" + "".join("<p>a</p><h2>b</h2>"[: 8 if (j * k) % 3 else 17] for j in range(3000)) + f"{k}</div></body>"
    rows = [(k, "http://deep.org/", deep(k)) for k in range(3)] + [(10 + k, "http://wide.org/", wide(k)) for k in range(3)] + [(20 + k, "http://alt.org/", alternating(k)) for k in range(1, 4)]
    rows += [(30, "http://open.org/", "<div>" * 50_000 + "end"), (31, "http://open.org/", "<b>" * 50_000 + "</i>" * 50_000 + "end"), (32, "http://open.org/", "<p" * 50_000)]
    got = extracted(spark, rows)
    assert all(got[k].startswith(f"Text {k}") for k in range(3))
    assert all(got[10 + k].count("\n") == 3 * (5000 + k) - 1 for k in range(3))
    assert got[30] == got[31] == "end"


def test_pages_of_the_data_need_the_wrapper(spark):
    """Without names the wrapper alone gives the text that it gives with them, on every page; without either, menus stay."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    texts = lambda **options: {r.page_id: r.text for r in html_text.extract_pages(pages, **options).collect()}
    alone, both = texts(names=False), texts()
    assert alone == both
    bare = {r.page_id: html_text.extract(r.html, None, names=False) for r in pages.collect()}
    assert sum(bare[k] != both[k] for k in both) > 0.9 * len(both)


@pytest.mark.parametrize("parts", [[1, 2, 3, 4], [3, 3, 3, 3]])
@pytest.mark.parametrize("tag", ["article", "div class=story"])
def test_headings_and_lines_that_articles_share_stay(spark, parts, tag):
    """Repeated headings, a licence line and anchors in the content; constants outside of it, and shared lists of links in it, go."""
    if tag != "article" and len(set(parts)) == 1:
        return  # nothing varies and no element is called article: constants can't be told from shared lines

    def made(k):
        text = "".join(f"<p>Part {j} of {k}.</p>" for j in range(parts[k % 4]))
        shared = "<h2 id=introduction>Introduction</h2>", "<h2>References</h2><p>Text under a free licence.</p>"
        return f"<html><body><p>Welcome to all</p><{tag}><h1>Title {k}</h1>{shared[0]}<div>{text}</div>{shared[1]}<p><a href=/a>All</a> <a href=/b>Terms</a></p></{tag.split()[0]}></body></html>"

    got = extracted(spark, [(k, f"http://shared.org/{k}", made(k)) for k in range(8)])
    wrapper = html_text.induce([made(k) for k in range(8)])
    for k in range(8):
        want = [f"Title {k}", "Introduction", *(f"Part {j} of {k}." for j in range(parts[k % 4])), "References", "Text under a free licence."]
        assert got[k] == html_text.extract(made(k), wrapper) == "\n".join(want)


def test_anchors_name_nothing_in_articles():
    kept = "<h2 id=search>Search</h2><h3 id='navigation'>Navigation</h3><section id=related><p>Related work</p></section><div class='section' id=share><p>Shares</p></div><blockquote class=comment><p>Quoted</p></blockquote>"
    gone = "<section id=comments><p>no</p></section><div id=sidebar><p>no</p></div><section class=related><p>no</p></section><div class=comment><p>no</p></div>"
    assert html_text.extract(f"<body><article><p>One</p>{kept}{gone}</article></body>", None) == "One\nSearch\nNavigation\nRelated work\nShares\nQuoted"
    assert html_text.extract("<body><div id=sidebar><p>no</p></div><section id=related><p>no</p></section><p id=search>Two</p></body>", None) == "Two"


def test_wide_pages_of_different_children():
    """Many children of different names, or of one name and different structure, are aligned without all pairs of subtrees."""
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:05d}")
    wide = lambda end, n: "<body><div>" + "".join(f"<div class='{name(k)}{end if k % 7 == 0 else ''}'><p>t</p></div>" for k in range(n)) + "</div></body>"
    size, pairs = html_text.tree_match(html_text.parse(wide("x", 2000)), html_text.parse(wide("y", 2000)))
    assert len(pairs) == sum(k % 7 > 0 for k in range(2000))
    rng = random.Random(5)
    mixed = lambda: "<body>" + "".join("<div>" + "".join(f"<{rng.choice(['p', 'h2', 'ul', 'pre'])}>x" for _ in range(8)) + "</div>" for _ in range(1500)) + "</body>"
    a, b = html_text.parse(mixed()), html_text.parse(mixed())
    shapes = html_text.Shapes()
    tops = [html_text.skeleton(t, shapes) for t in (a, b)]
    body = [t.kids[0].kids for t in tops]
    pairs = shapes.align(*([k.shape for k in kids] for kids in body))
    assert len(pairs) > 0.9 * min(map(len, body)) and all(p < q for p, q in zip(pairs, pairs[1:]))
    assert len(shapes.known) < html_text.KNOWN_WEIGHTS


@pytest.mark.parametrize("cells", [1 << 22, 50, 1])
def test_alignments_do_not_depend_on_a_switch_by_size(cells, monkeypatch):
    """The weights and pairs of small lists, whichever way they are made; equal alignments are told apart in one way."""
    rng = random.Random(6)
    source = lambda t: f"<x{t[0]}>{''.join(map(source, t[1]))}</x{t[0]}>"
    trees = [("r", [random_tree(rng) for _ in range(rng.choice([2, 9]))]) for _ in range(120)]
    for a, b in zip(trees[::2], trees[1::2]):
        pages = [html_text.parse(source(t)) for t in (a, b)]
        found = []
        for weighed, table in ((1 << 40, 1 << 40), (-1, cells)):
            monkeypatch.setattr(html_text, "WEIGHED_CELLS", weighed)
            monkeypatch.setattr(html_text, "TABLE_CELLS", table)
            shapes = html_text.Shapes(exact=True)
            number = lambda t: shapes.number(t[0], tuple(map(number, t[1])))
            xs, ys = ([number(t) for t in tree[1]] for tree in (a, b))
            found.append((html_text.tree_match(*pages)[0], shapes.align(xs, ys), [row.tolist() for row in shapes._rows(xs, ys)]))
        assert found[0] == found[1] and found[0][0] == brute_match(a, b) + 1
        assert sum(found[1][2][i][j] for i, j in found[1][1]) + 1 == brute_match(a, b)


def test_long_lists_are_aligned_by_exact_weights():
    """Far over WEIGHED_CELLS: the weights of the definition, and a template block is found by what is in it, as it is in a short list."""
    rng = random.Random(7)
    trees = [("r", [("d", [(rng.choice("abcd"), []) for _ in range(8)]) for _ in range(400)]) for _ in range(2)]
    source = lambda t: f"<x{t[0]}>{''.join(map(source, t[1]))}</x{t[0]}>"
    assert html_text.tree_match(*(html_text.parse(source(t)) for t in trees))[0] == brute_match(*trees) + 1


def test_all_frequent_tokens_of_a_url_are_mined(spark):
    # Fifteen query names, each on other URLs; x, on the most of them, was beyond the twelve rarest.
    names = [f"q{k}" for k in range(14)]
    urls = [("x", *[n for j, n in enumerate(names) if i >> j % 7 & 1 == j // 7]) for i in range(128)] + [("x",)] * 3
    rows = spark.createDataFrame([(str(i), ["x", *u[1:], *[n for n in names[:13] if i == 5 and n not in u]], "block") for i, u in enumerate(urls)], "url string, tokens array<string>, verdict string")
    items = url_rules.frequent_items(rows, 1).collect()
    assert max(len(r.tokens) for r in items) > 12 and all("x" in r.tokens for r in items)


def test_written_rules_decide_on_odd_urls(spark):
    def plain(url):
        head, found, rest = (url or "").partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest if found else "").groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, says) for says, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    urls = [None, "", "://", "com/en/", "HTTP://Example.COM/en/7", "http://a.example.com/en/7x", "http://xexample.com/en/7", "http://.com/en/", "http://a.com:80/en/", "http://a.com/en?/en/", "x\ny://a.org/es/\n", "a://b://x.com/en/", "http://\u0130.com/en/", "http://\u212a.com/en/", "http://a.com./en/", "a" * 100_000 + "://a.net/de/8", "http://EXAMPLE.net/de/8?q#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_rules.judge(pages).collect():
        host, path, rule, says = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (says is None or r.verdict == says)
