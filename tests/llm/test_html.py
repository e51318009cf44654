"""Main text of pages: matching by brute force, broken markup, template by markup and by comparison of pages."""

import random

import pytest
from pyspark.sql import functions as F

from samples import MIDDLE, WORDS, sentence

from quern.llm import catalogue, html_extract



def page(rng, host, i, style):
    paras = [sentence(rng, rng.randint(15, 40)).replace("né", "n&eacute;") for _ in range(rng.randint(2, 6))]
    plain = [p.replace("n&eacute;", "né") for p in paras]
    title = f"Title {i} {rng.choice(WORDS)} &amp; more"
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
    text = "\n".join([title.replace("&amp;", "&"), *plain])
    if style == 0:  # stated by the markup
        source = f"<html><head><title>x</title><style>p{{}}</style></head><body><header><h1>{host}</h1></header><nav><a href=/>Home</a></nav><div class='sidebar'><p>{sentence(rng, 9)}</p></div><article>{body}<div class='ad-slot'>Buy {rng.choice(WORDS)}</div></article><section id='comments'><p>I {rng.choice(WORDS)} this</p></section><form><input><p>Search</p></form><div class='cookie-notice'>We use cookies</div><footer>(c) {i}</footer><script>var a='<p>no</p>'</script></body></html>"
    else:  # only visible by comparing pages
        pool = ["Read our magazine.", "Subscribe today.", "Our partners.", "Win a trip."]
        source = f"<html><body><div><div>Home | About | Contact us</div><div>{rng.choice(pool)}</div><div><div>{body}</div></div><div>All rights of {host} reserved.</div></div></body></html>"
    return source, text


@pytest.mark.parametrize("style,count", [(0, 4), (1, 60)])
def test_article_text(spark, style, count):
    rng = random.Random(4)
    rows, want = [], {}
    for h in range(3):
        for i in range(count):
            source, text = page(rng, f"h{h}.com", i, style)
            rows.append((h * 1000 + i, f"http://h{h}.com/{i}", source))
            want[rows[-1][0]] = text
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.02 * len(want), (got[wrong[0]], want[wrong[0]])


def random_tree(rng, depth):
    tag = rng.choice("uvw")
    return f"<{tag}>" + "".join(random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)) + f"</{tag}>"


def brute_match(a, b):
    """Greatest ordered match of two trees, by the plain recursion."""
    if a.name != b.name:
        return 0
    if a.boiler or b.boiler:
        return 1
    x, y = html_extract._elements(a), html_extract._elements(b)
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + brute_match(x[i], y[j]))
    return 1 + table[-1][-1]


def matched(page, reference):
    m = html_extract.Matcher()
    m.shape(page)
    m.shape(reference)
    return m


@pytest.mark.parametrize("arrays", [0, 10**9])
def test_tree_matching_is_the_largest_ordered_match(monkeypatch, arrays):
    monkeypatch.setattr(html_extract, "ARRAYS", arrays)
    rng = random.Random(2)
    for n in [1] * 40 + [4, 9, 16]:
        a, b = (html_extract.parse("".join(random_tree(rng, 3) for _ in range(rng.randint(1, n)))) for _ in range(2))
        m = matched(a, b)
        assert m.score(a.shape, b.shape) == brute_match(a, b)
        score, pairs = m.pairs(m.kids[a.shape], m.kids[b.shape])
        x, y = html_extract._elements(a), html_extract._elements(b)
        assert score + 1 == m.score(a.shape, b.shape) == 1 + sum(brute_match(x[i], y[j]) for i, j in pairs)
        assert all(i < k and j < n for (i, j), (k, n) in zip(pairs, pairs[1:]))


def test_matches_of_any_breadth_and_depth():
    # the trailing template is found behind any number of siblings, whether they begin alike or not
    for head in ("", "<h2>x</h2>", "<h3>a</h3>" * 60):
        page = html_extract.parse(head + "<p>a</p>" * 250 + "<div>t</div><p>z</p>")
        m = html_extract.Matcher()
        reference = html_extract.reference_of(["<p>a</p>" * 320 + "<div>t</div>"], m)
        m.shape(page)
        html_extract.align(page, reference, m)
        assert [x.slot for x in page.kids if x.name == "div"] == [reference.kids[-1].slot] and reference.kids[-1].slot >= 0
        assert sum(x.slot >= 0 for x in page.kids) == 251
    rng = random.Random(3)
    wide = [html_extract.parse("<u>" * 3 + "".join(random_tree(rng, 2) for _ in range(500))) for _ in range(2)]
    m = matched(*wide)
    assert m.score(wide[0].shape, wide[1].shape) == brute_match(*wide)
    deep = html_extract.parse("<div>" * 10_000 + "x")
    other = html_extract.parse("<div>" * 6_000 + "<p>y</p>" + "<div>" * 3_000 + "x")
    m = matched(deep, other)
    assert m.score(deep.shape, other.shape) == 1 + 9_000
    html_extract.align(deep, html_extract.reference_of(["<div>" * 10_000 + "<b>x"] * 2, m), m)
    assert html_extract.blocks(deep)[0][2] == "x"


@pytest.mark.parametrize("source,want", [
    ('<p>a <a href="x>link</a> b</p>', "a link b"),
    ("<p>a <a href='x>link</a> b</p>", "a link b"),
    ('<p title="1 > 0">a</p>', "a"),
    ('<p data-x="<b>no</b>" id=q>a</p>', "a"),
    ('<p title="say "it" now">a</p>', "a"),
    ("<p>1 < 2 & 3 &lt; 4", "1 < 2 & 3 < 4"),
    ("<p>a<script>x</p>", "a"),
])
def test_broken_markup(source, want):
    assert "\n".join(x[2] for x in html_extract.blocks(html_extract.parse(source))) == want


@pytest.mark.parametrize("value,want", [
    ("ad", 2), ("ad-slot", 2), ("adSlot", 2), ("mainmenu", 2), ("comment-body", 2), ("post-comments", 2), ("article-footer", 2), ("sidebar left", 2), ("cookie-notice", 1), ("share_buttons", 2),
    ("legal-notice", 1), ("related-articles", 1), ("search-box", 1), ("site-header", 1), ("ad-choices", 1),
    ("legal-notice-story", 0), ("search-results", 0), ("article-header", 0), ("entry", 0), ("header-story notice", 0), ("lead", 0), ("reading", 0), ("adverse", 0),
])
def test_what_names_say(value, want):
    assert html_extract.grade(value) == want


def many(spark, sources, host="a.com"):
    """The texts of pages of one host, by id."""
    rows = [(i, f"http://{host}/{i}", x) for i, x in enumerate(sources)]
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_of_template_alone_are_empty(spark):
    rng = random.Random(20)
    template = "<div>Home | About</div>{}<div>All rights reserved</div>"
    paras = [f"<p>{sentence(rng, 20)}</p>" for _ in range(9)]
    got = many(spark, [template.format(p) for p in paras] + [template.format("")] * 3)
    assert [got[i] for i in range(9)] == [p[3:-4] for p in paras] and [got[i] for i in (9, 10, 11)] == [""] * 3


def test_articles_keep_what_several_pages_share(spark):
    rng = random.Random(21)
    shared, note = sentence(rng, 20), "Share this with your friends."
    own = [[sentence(rng, 15) for _ in range(2)] for _ in range(10)]
    pages = [f"<div>Home</div><article><p>{a}</p><p>{shared if i < 6 else c}</p><div>{note}</div></article>" for i, (a, c) in enumerate(own)]
    got = many(spark, pages)
    assert got == {i: f"{a}\n{shared if i < 6 else c}" for i, (a, c) in enumerate(own)}


def test_all_articles_of_a_page(spark):
    got = many(spark, ["<nav>n</nav><main><p>lead</p><article><h1>A</h1><p>one</p></article><article><header><div><h2>B</h2></div>by x</header><p>two</p></article><div class=comments><article>c</article></div></main>"])
    assert got == {0: "A\none\nB\nby x\ntwo"}


def test_names_are_weighed(spark):
    rng = random.Random(22)
    prose = [sentence(rng, 30) for _ in range(12)]
    notice, ad = sentence(rng, 30), [sentence(rng, 30) for _ in range(12)]
    links = "".join(f"<a href=/{i}>{sentence(rng, 4)}</a> " for i in range(10))
    pages = [f'<div class="site-notice">{notice}</div><div class="announcement">{p}</div><div class="ad">{a}</div><div class="related">{links}</div><p class="legal-notice-story">S{i}</p><div class="search-box">Find it</div>' for i, (p, a) in enumerate(zip(prose, ad))]
    got = many(spark, pages)
    assert got == {i: f"{p}\nS{i}" for i, p in enumerate(prose)}
    # a host of one page rests on the names, but for paragraphs of the article
    text = sentence(rng, 12)
    assert many(spark, [f'<div class="announcement">{prose[0]}</div><article><p class="search">{text}</p><p class="search">Go</p><div class="notice">{prose[1]}</div></article>']) == {0: text}


def test_joined_by_blocks_like_by_hosts(spark, monkeypatch):
    rng = random.Random(23)
    rows = [(i % 50, f"http://h{i % 3}.com/", page(rng, f"h{i % 3}.com", i, 1)[0]) for i in range(90)] + [(None, None, None), (1, "http://h0.com/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = []
    for limit in (1_000_000, -1):
        monkeypatch.setattr(html_extract, "BROADCAST_TEXTS", limit)
        monkeypatch.setattr(html_extract, "BROADCAST_BYTES", limit * 32)
        got.append(sorted(map(tuple, html_extract.extract(pages).collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_null_and_repeated_ids(spark):
    rng = random.Random(24)
    texts = [sentence(rng, 20) for _ in range(40)]
    rows = [(None if i % 2 else 7, "http://a.com/", f"<div>Menu</div><p>{t}</p>", "clash", -1) for i, t in enumerate(texts)] + [(7, "http://a.com/", f"<div>Menu</div><p>{texts[0]}</p>", "clash", -1)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, h long")
    assert html_extract.seed_ids(pages).count() == html_extract.SEEDS
    assert sorted(r.text for r in html_extract.extract(pages).collect()) == sorted(texts + [texts[0]] * 3)


def test_equals_a_plain_reading_of_the_given_pages(spark):
    """The given pages state their template by tags: what is left of them, read with the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.now, self.skip, self.inside = [], [], 0, False

        def end(self):
            text = " ".join("".join(self.now).split())
            self.blocks += [text] if text else []
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag not in ("b", "a"):
                self.end()
            self.inside |= tag == "article"

        def handle_endtag(self, tag):
            if tag not in ("b", "a"):
                self.end()
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.now.append(data)

    want = {}
    for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect():
        p = Plain()
        p.feed(r.html or "")
        p.end()
        want[r.page_id] = "\n".join(p.blocks)
    got = {r.page_id: (r.text, r.n_chars) for r in catalogue.queries()["op2_html_extraction"](spark, MIDDLE).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_every_unmatched_node_is_inserted():
    got = html_extract.reference_of(["<div><p>a</p><h2>b</h2></div>", "<div><p>a</p><p>b</p><h2>b</h2><p>c</p></div>"], html_extract.Matcher())
    assert [x.name for x in html_extract._elements(got.kids[0])] == ["p", "p", "h2", "p"]


def test_template_that_the_reference_lacks(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for i in range(120):
        paras = [sentence(rng, 20) for _ in range(rng.randint(1, 8))]
        body = "".join(f"<p>{x}</p>" for x in paras)
        notice = "<blockquote>We move to new offices.</blockquote>" if i % 10 == 0 else ""
        if i % 8 == 3:  # another layout
            source = f"<table><tr><td>Home | Contact</td><td><ul><li>{body}</li></ul></td></tr></table>"
        else:
            source = f"<div><div>Home | Contact</div>{notice}<div>{body}</div></div>"
        rows.append((i, "http://a.com/x", source))
        want[i] = "\n".join(paras)
    least = sorted(spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", F.xxhash64("page_id", "html").alias("h")).collect(), key=lambda r: r.h)[: html_extract.SEEDS]
    few = {r.page_id for r in least}
    # pages that are in the reference show neither the notice nor the other layout
    rows = [(i, u, f"<div><div>Home | Contact</div><div>{''.join(f'<p>{x}</p>' for x in want[i].split(chr(10)))}</div></div>" if i in few else s) for i, u, s in rows]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 4, 5, 30])
def test_small_hosts_have_all_their_seeds(spark, n):
    rows = [(i, f"http://h{h}.com/", "h", f"<p id=x{i}>{i}</p>") for h in range(6) for i in range(h * 100, h * 100 + n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, html string")
    chosen = html_extract.seed_ids(pages.withColumn("host", F.col("url")))
    assert [r.n for r in chosen.groupBy("host").agg(F.count("*").alias("n")).collect()] == [min(n, html_extract.SEEDS)] * 6


@pytest.mark.parametrize("n", [250, 700])
def test_texts_of_a_slot_go_by_themselves(spark, n):
    """60 authors stay whatever the host's size; a pool of four goes, but not a text that stands in its place once."""
    rng = random.Random(14)
    pool, rows, want = ["Read our magazine.", "Subscribe today.", "Our partners.", "Win a trip."], [], {}
    for i in range(n):
        text, author = sentence(rng, 20), f"By {WORDS[i % 20]} {'abc'[i // 20 % 3]}"
        lead = "The same lead on most pages." if i % 5 < 3 else sentence(rng, 9)
        other = "This is only here." if i == 7 else rng.choice(pool)
        rows.append((i, "http://a.com/x", f"<div><h3>{author}</h3><h4>{lead}</h4><div>{other}</div><p>{text}</p></div>"))
        want[i] = "\n".join([author, *([lead] if i % 5 >= 3 else []), *([other] if i == 7 else []), text])
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want




def unlike(n, seed):
    """Sibling paragraphs with unlike markup within their lines."""
    rng = random.Random(seed)
    return "".join("<p>" + "".join(f"<{t}>{i}</{t}> " for t in rng.choices(["b", "i", "a", "em", "code", "sup"], k=rng.randint(1, 9))) + f"w{i}</p>" for i in range(n))


def test_unlike_siblings_cost_little():
    import time

    matcher = html_extract.Matcher()
    began = time.process_time()
    reference = html_extract.reference_of([unlike(2000, 1), unlike(2000, 2)], matcher)
    page = html_extract.parse(unlike(2000, 3))
    matcher.shape(page)
    html_extract.align(page, reference, matcher)
    assert time.process_time() - began < 5 and len(matcher.memo) < 10_000
    assert len({x[0] for x in html_extract.blocks(page)}) == 2000, "each paragraph has its slot"


def test_unlike_structures_keep_a_bounded_memo(monkeypatch):
    """Items of unlike structure, more pairs than are kept: the pairs are those of a matcher that keeps all."""
    rng = random.Random(4)
    item = lambda: "<li>" + "".join(f"<div>{'<p>x</p>' * rng.randint(1, 4)}</div>" for _ in range(rng.randint(1, 5))) + "</li>"
    lists = ["".join("<section><ul>" + "".join(item() for _ in range(12)) + "</ul></section>" for _ in range(6)) for _ in range(2)]

    def slots(kept):
        monkeypatch.setattr(html_extract, "KEPT", kept)
        matcher = html_extract.Matcher()
        reference = html_extract.reference_of(lists[:1], matcher)
        page = html_extract.parse(lists[1])
        matcher.shape(page)
        html_extract.align(page, reference, matcher)
        return [x[0] for x in html_extract.blocks(page)]

    assert slots(10) == slots(10**9)


ARTICLE = "<header>Top</header><article><h1>Title</h1><p>Lead text of the day.</p>{}</article><footer>end</footer>"


@pytest.mark.parametrize("inner,want", [
    ("<p>Mass <math><mi>m</mi><mo>=</mo><mn>2</mn><annotation>m=2</annotation></math> grows.</p>", "Mass m=2 grows."),
    ('<div class="menu-review">The soup was hot and the bread was fresh.</div>', "The soup was hot and the bread was fresh."),
    ('<div class="share-of-market">It fell to a third last year.</div>', "It fell to a third last year."),
    ('<div class="widget"><p>' + "A long text in a widget. " * 8 + "</p></div>", ("A long text in a widget. " * 8).strip()),
    ('<aside class="pullquote"><p>Words that were said.</p></aside>', "Words that were said."),
    ('<aside>Other news</aside><div class="widget">Tags</div><div class="share-buttons">Share</div><div class="comments"><p>' + "I think so too. " * 10 + "</p></div>", None),
])
def test_names_within_an_article(inner, want):
    got = [x[2] for x in html_extract.blocks(html_extract.parse(ARTICLE.format(inner)))]
    assert got == ["Title", "Lead text of the day."] + ([want] if want else [])
