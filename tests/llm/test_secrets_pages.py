from __future__ import annotations

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from atlasweave.llm import pages, secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans_against_brute_force():
    rng = random.Random(1)
    pieces = ["password", "Token", "api_key", "APIKEY", "ſecret", "toKen", " = ", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef00", "0123456789abcdef", "xyz", " ", "é", "hunter2hunter2", "="]
    for _ in range(5000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        assert secrets.base_spans(text) == brute(text), text


def test_random_strings_found_and_words_left(spark):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    good = ["".join(rng.choices(alphabet, k=40)) for _ in range(200)]
    dull = ["internationalisation" * 4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "path/to/some/ordinary/file/name", "ThisIsAnOrdinaryCamelCaseIdentifierName", "1234567890" * 4 + "x", "_" * 60]
    rows = [(k, f"see {t} here") for k, t in enumerate(good + dull)] + [(900, None), (901, ""), (902, "token = 'abcdefabcdefabcdef'")]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = [k for k in range(200) if any(s.kind == 3 for s in got[k].spans)]
    assert len(hits) >= 180
    assert all(got[k].spans[-1].start == 4 for k in hits)
    assert not any(s.kind == 3 for k in range(len(dull)) for s in got[200 + k].spans)
    assert got[900].spans == [] and got[901].base == []
    assert [(s.kind, s.start) for s in got[902].spans] == [(0, 0), (2, 9)]
    shown = secrets.find_secrets(spark.createDataFrame(rows[-1:], "doc_id long, text string")).select(secrets.joined("base").alias("x")).first().x
    assert shown == "assign:0:27,hex:9:27"
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_random_strings_in_runs_of_mixed_marks(spark):
    rng = random.Random(3)
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    frames = ["com/reset-link/{}", "user_id/{}", "{}-x+y", "a_b/{}/c_d"]
    keys = ["".join(rng.choices(plain, k=40)) for _ in range(100)]
    wide = ["".join(rng.choices(plain + "+/", k=60)) for _ in range(100)]
    rows = [(k, f"see {frames[k % 4].format(key)} here") for k, key in enumerate(keys)] + [(100 + k, f"see my_{key} here") for k, key in enumerate(wide)]
    dull = ["path/to/some_ordinary-file/name_of/things", "ThisIsAnOrdinaryCamelCaseIdentifierName/and_more"]
    rows += [(200 + k, f"see {t} here") for k, t in enumerate(dull)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    covered = lambda k, key: any(a <= rows[k][1].index(key) and rows[k][1].index(key) + len(key) <= b for a, b in got[k])
    assert sum(covered(k, key) for k, key in enumerate(keys)) >= 90
    assert sum(covered(100 + k, key) for k, key in enumerate(wide)) >= 90
    assert not any(got[200 + k] for k in range(len(dull)))
    key = keys[0]
    assert (15, 55) in [(a, b) for a, b, *_ in secrets.candidates(f"com/reset-link/{key}", [])]
    assert not secrets.candidates(f"com/reset-link/{key}", [(0, 0, 55)])


def page(body, article):
    return f"<html><head><title>t &amp; x</title><script>var a='</p>';</script></head><body>{body}<article>{article}</article><footer>&copy; me</footer></body>"


def text_of(source, templates=frozenset()):
    return pages.main_text(pages.parse(source), templates)


def test_main_text():
    assert text_of(page("<nav><a>m</a></nav><div class='ad'>buy</div>", "<h1>A &lt;b&gt; c</h1><p>one<br>two  \n three<p>four &am &amp")) == "A <b> c\n\none two three\n\nfour &am &"
    assert text_of("") == "" and text_of("<p") == "" and text_of("plain") == "plain"
    assert text_of("<body><p>a<aside>x</aside><form>f</form><ul><li>1<li>2</ul><div id=comments><p>no</div><!-- c --><p>b") == "a\n\n1\n\n2\n\nb"
    assert text_of("<div class='with-sidebar'><main><p>in</p></main></div><div class=sidebar>out</div>") == "in"
    assert text_of("<article><p>yes</p><section class='comment-list'><p>no</p></section></article>") == "yes"


def test_deeply_nested_pages(spark):
    deep = "<div>" * 3000 + "<p>x</p>" + "</div>" * 3000
    assert text_of(deep) == "x" and text_of(f"<article>a{deep}b</article>") == "a\n\nx\n\nb"
    df = spark.createDataFrame([(1, "http://a.b/", deep)], "page_id long, url string, html string")
    assert pages.main_texts(df).first().main_text == "x"


def test_templates_by_host_and_copies_kept(spark):
    box = "<div><p>Join our club today</p></div>"
    rows = [(k, f"http://Site.example/{k}", page("", f"<p>story {k}</p>{box}")) for k in range(30)]
    rows += [(100 + k, f"http://other.example/{k}", page("", f"<p>same</p>{box}")) for k in range(30)]  # copies of one page
    rows += [(200, None, page("", "<p>x</p>")), (201, "u", None), (202, "http://site.example/z", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t"))
    for few in (100, 0):
        got = {r.page_id: r.main_text for r in pages.main_texts(df, few=few).collect()}
        assert [got[k] for k in range(30)] == [f"story {k}" for k in range(30)]
        assert {got[100 + k] for k in range(30)} == {"same\n\nJoin our club today"}
        assert (got[200], got[201], got[202]) == ("x", "", "")
    assert pages.main_texts(df.limit(0)).count() == 0


def test_quoted_passages_of_articles_kept(spark):
    quote, box, points = "<div><p>quoted by five</p></div>", "<div><p>Join our club today</p></div>", "<ul><li>point one</li></ul>"
    rows = [(k, f"http://site.example/{k}", page("", f"<p>story {k}</p>{quote if k < 5 else ''}{points}{box}")) for k in range(40)]
    rows += [(100 + k, f"http://lists.example/{k}", f"<body><p>story {k}</p>{points}</body>") for k in range(20)]  # no article
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (100, 0):
        got = {r.page_id: r.main_text for r in pages.main_texts(df, few=few).collect()}
        assert [got[k] for k in range(40)] == [f"story {k}" + ("\n\nquoted by five" if k < 5 else "") + "\n\npoint one" for k in range(40)]
        assert [got[100 + k] for k in range(20)] == [f"story {k}" for k in range(20)]


def test_templates_of_varying_words_go_by_shape(spark):
    """No article element and no telltale names: what recurs in shape outside the main text goes, at hosts with enough pages."""

    def body(k):
        menu = "".join(f"<li><a href='/{k}{j}'>go{k}{j}</a></li>" for j in range(3 + k % 4))
        return f"<body><div><ul>{menu}</ul></div><div><h2>Title {k}</h2><p>{'long story ' * 30}{k}</p><p>end {k}</p></div><div>offer{k} of the day</div></body>"

    rows = [(k, f"http://many.example/{k}", body(k)) for k in range(12)] + [(100, "http://one.example/", body(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    story = lambda k: f"Title {k}\n\n{'long story ' * 30}{k}\n\nend {k}"
    for few in (100, 0):
        got = {r.page_id: r.main_text for r in pages.main_texts(df, few=few).collect()}
        assert [got[k] for k in range(12)] == [story(k) for k in range(12)]
        assert got[100] == f"go10\n\ngo11\n\ngo12\n\ngo13\n\n{story(1)}\n\noffer1 of the day"


class Article(HTMLParser):
    """The article's blocks, found by the standard library's parser; enough for the markup of the tables."""

    BLOCKS = {"article", "h1", "h2", "h3", "h4", "p", "ul", "ol", "li", "div", "section", "blockquote", "pre", "table", "tr", "td", "th", "figure", "figcaption"}
    LEFT_OUT = {"nav", "footer", "header", "aside", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.left_out, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attributes):
        self.depth += tag == "article"
        self.left_out += tag in self.LEFT_OUT
        if tag in self.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.blocks.append("")
        self.depth -= tag == "article"
        self.left_out -= tag in self.LEFT_OUT

    def handle_data(self, data):
        if self.depth and not self.left_out:
            self.blocks[-1] += data


def article_of(source):
    parser = Article()
    parser.feed(source)
    parser.close()
    return "\n\n".join(block for block in (" ".join(x.split()) for x in parser.blocks) if block)


def test_query_of_pages_against_another_parser(spark):
    from atlasweave.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op5_pages(spark, "/root/testdata/sf0.01").collect()}
    want = {r.page_id: article_of(r.html or "") for r in rows}
    assert got == {r.page_id: (r.url, want[r.page_id], len(want[r.page_id])) for r in rows}


def test_templates_decide_where_a_host_has_pages_enough(spark):
    """Counted again by plain loops: without the template subtrees most pages read otherwise, as rules leave alone what was counted."""
    from collections import defaultdict

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    trees = {r.page_id: pages.parse(r.html or "") for r in rows}
    beside, judged, mains = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in rows:
        root, host = trees[r.page_id], pages.host_of(r.url)
        text = pages.main_text(root, frozenset())
        mains[host].add(text)
        outside = pages._outside(root, pages._holders(root))
        for node in pages._walk(root):
            if node.tag in pages._COUNTED and not node.main:
                beside[host, node.content].add(text)
            if id(node) in outside:
                beside[host, node.shape].add(text)
                judged[host, pages._form_hash(node)].add(text)

    def recurring(counts, host):
        return {x for (h, x), texts in counts.items() if h == host and len(texts) >= pages.RECURS and len(texts) >= pages.SHARE * len(mains[host])}

    got = {r.page_id: r.main_text for r in pages.main_texts(spark.createDataFrame(rows)).collect()}
    changed = enough = 0
    for r in rows:
        host, root = pages.host_of(r.url), trees[r.page_id]
        subtrees, forms = recurring(beside, host), recurring(judged, host)
        assert got[r.page_id] == pages.main_text(root, subtrees | forms)
        enough += len(mains[host]) >= pages.RECURS
        changed += pages.main_text(root, forms) != got[r.page_id]
    assert changed == enough > len(rows) / 2


def test_rare_chrome_of_large_hosts_goes_by_rules(spark):
    rows = [(k, f"http://site.example/{k}", page("<nav><a href='/'>home</a></nav>" + ("<div class='cookie-notice'>We bake</div><p>stray</p>" if k == 7 else ""), f"<p>story {k}</p>")) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (100, 0):
        got = {r.page_id: r.main_text for r in pages.main_texts(df, few=few).collect()}
        assert got == {k: f"story {k}" for k in range(30)}


def test_long_flat_pages_and_clashing_columns(spark):
    flat = "<article>" + "<p>a b</p><br>" * 100_000 + "</article>"
    df = spark.createDataFrame([(1, "http://a.b/", flat, 5), (2, None, None, None)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in pages.main_texts(df, out_col="text").collect()}
    assert got == {1: "\n\n".join(["a b"] * 100_000), 2: ""}


def test_hashes_take_linear_time():
    import time

    def seconds(n):
        source = "<div>" * n + "<p>x</p>" + "</div>" * n + "<a " * n
        began = time.perf_counter()
        pages.parse(source)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16_000) < 40 * max(seconds(2000), 1e-3)  # 8 times the size; quadratic time would be 64 times
