"""Spans against an HTML parser, parents against their definition, runs and prefixes on inline spans."""

import html.parser
import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from textmill.operators import tree as tr


def _nearest_above(spans, n):
    """The latest earlier span of greater (size, bold); the root, where the size reaches its."""
    if n == 0:
        return -1
    if spans[n][0] >= spans[0][0]:
        return 0
    return max([i for i in range(1, n) if spans[i] > spans[n]], default=0)


def _plain_outline(spans):
    n = len(spans)
    parent = [_nearest_above(spans, i) for i in range(n)]
    kids = [[j for j in range(n) if parent[j] == i] for i in range(n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    run = [0] * n
    for k in kids:
        at = 0
        while at < len(k):
            end = at
            while end < len(k) and not kids[k[end]]:
                end += 1
            if end > at:
                run[k[at]] = end - at
            at = max(end, at + 1)
    return parent, depth, [len(k) for k in kids], [int(any(kids[j] for j in k)) for k in kids], run


def _random_spans(rnd):
    docs = [[(float(rnd.choice([10, 12, 14, 16, 18])), rnd.randint(0, 1)) for _ in range(rnd.randint(0, 25))]
            for _ in range(200)]
    return docs + [[], [(12.0, 0)], [(12.0, 0), (12.0, 1), (12.0, 0)], [(14.0, 0), (14.0, 1), (12.0, 0), (14.0, 0)]]


def test_outline_is_its_definition():
    for spans in _random_spans(random.Random(11)):
        got = tr.outline([s for s, _ in spans], [b for _, b in spans])
        assert tuple(map(list, got)) == tuple(map(list, _plain_outline(spans))), spans


def test_outline_of_columns_and_slices():
    docs = _random_spans(random.Random(12))
    sizes = pa.array([[s for s, _ in d] for d in docs], pa.list_(pa.float64()))
    bolds = pa.array([[b for _, b in d] for d in docs], pa.list_(pa.int32()))
    got = tr._outlines(sizes.slice(3), bolds.slice(3)).to_pylist()
    for d, g in zip(docs[3:], got, strict=True):
        assert g["parent"] == _plain_outline(d)[0] and g["run"] == _plain_outline(d)[4]
    parents = pa.array([g["parent"] for g in got], pa.list_(pa.int32()))
    for p, c in zip(parents.slice(5).to_pylist(), tr._chains(parents.slice(5)).to_pylist(), strict=True):
        assert all(x[-1] == i and x[:-1] == (c[p[i]] if p[i] >= 0 else []) for i, x in enumerate(c))


class _Shown(html.parser.HTMLParser):
    """The text a page shows from its first h1 on."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden, self.begun = [], 0, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style", "title")
        self.begun |= tag == "h1"

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style", "title")

    def handle_data(self, data):
        if self.begun and not self.hidden:
            self.out.append(data)


def test_all_text_of_pages_is_in_some_span(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("page_id % 5 = 0")
    shown = {}
    for r in pages.collect():
        p = _Shown()
        p.feed(r.html)
        p.close()
        shown[r.page_id] = re.sub(r"\s", "", "".join(p.out))
    rows = tr.documents(pages).select("doc", F.array_join("spans.text", "").alias("t")).collect()
    assert {r.doc: re.sub(r"\s", "", r.t) for r in rows} == shown and len(shown) >= 50


def _spans(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return [[(s.tag, s.text, s.bold) for s in r.spans] for r in tr.documents(df).orderBy("doc").collect()]


def test_span_rules(spark):
    got = _spans(
        spark,
        "<nav>menu</nav><h1 class='x'>Head <i>part</i> two</h1>after<p>one <a href='u'>link</a> goes<br>on</p>",
        "<p>plain <b>bold <i>both</i></b> plain again<div>x</div><strong>y</strong> z",
        "<h2><b>not apart</b></h2><p><b>open<p>closed by the block</p>",
        "a &lt;b&gt; &amp;lt; &#233;&#128512;&#1; &copy; &unknown; &nbsp; end",
        "<script>var a = '<p>no</p>'</script><!-- <p>no</p> --><style>p{}</style><p>yes</p><TITLE>no</TITLE>",
        "1 < 2 and <a <p>b > c", "", None, "  <p> </p> ", "<pre>p\u0001q\u0003</pre><H1>Shout</H1>text")
    assert got[0] == [("h1", "Head part two", 1), ("p", "after", 0), ("p", "one link goes on", 0)]
    assert got[1] == [("p", "plain", 0), ("b", "bold both", 1), ("p", "plain again", 0), ("div", "x", 0), ("b", "y", 1), ("p", "z", 0)]
    assert got[2] == [("h2", "not apart", 1), ("b", "open", 1), ("p", "closed by the block", 0)]
    assert got[3] == [("p", "a <b> &lt; é😀&#1; © &unknown; \xa0 end", 0)]
    assert got[4] == [("p", "yes", 0)]
    assert got[5] == [("p", "1 < 2 and <a", 0), ("p", "b > c", 0)]
    assert got[6:9] == [[], [], []]
    assert got[9] == [("h1", "Shout", 1), ("p", "text", 0)]


def test_runs_prefix_and_arrow_in_heading(spark):
    page = ("<h1>Root->Doc</h1><p>Short head</p><p>Body one is long enough to be a paragraph.</p>"
            "<p>Body two is long enough to be a paragraph too.</p><b>Bold head</b>"
            "<li>item a</li><li>item b</li>")
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    docs = tr.paths(tr.documents(pages))
    runs = tr.section_runs(docs).orderBy("run_start").collect()
    # 'Short head' (14, regular) takes the two paragraphs; 'Bold head' (14, bold) is its sibling
    assert [(r.root_idx, r.text) for r in runs] == [
        (1, "Body one is long enough to be a paragraph. Body two is long enough to be a paragraph too."),
        (4, "item a item b")]
    assert runs[0].section == "Root->Doc->Short head" and runs[0].path == "Root->Doc->Short head->"
    rows = tr.span_rows(docs)
    assert [(r.parent_idx, r.child_idx, r.flag) for r in tr.edges(rows).orderBy("child_idx").collect()] == [
        (0, 1, 1), (1, 2, 0), (1, 3, 0), (0, 4, 1), (4, 5, 0), (4, 6, 0)]
    assert tr.internal_paths(rows).count() == 0


def test_one_span_and_empty_page_give_no_chunks(spark):
    pages = spark.createDataFrame([(1, "<h1>Only</h1>"), (2, "<div></div>"), (3, None)], "page_id int, html string")
    assert tr.section_runs(tr.documents(pages)).count() == 0


def _seconds(spark, spans):
    body = "".join(f"<p>Paragraph {i} is as long as this.</p>" if i % 3 else f"<li>item {i}</li>" for i in range(spans))
    pages = spark.createDataFrame([(i, f"<h1>Head {i}</h1>{body}") for i in range(4)], "page_id int, html string").coalesce(1)
    runs = tr.section_runs(tr.documents(pages))
    best = []
    for _ in range(4):
        begun = time.perf_counter()
        runs.write.format("noop").mode("overwrite").save()
        best.append(time.perf_counter() - begun)
    return min(best)


def test_time_grows_with_the_spans(spark):
    _seconds(spark, 2000)
    assert _seconds(spark, 16000) <= 2.3 * _seconds(spark, 8000)
