"""Pages of many open elements, and passes that hold few rows."""

import random
import re

import pyarrow as pa

from evidentia.functions import dom
from evidentia.operators import chunk, corpus, inventory, sections, sizes

DEEP = "<p><b>" * 300
TOO_DEEP = "<li>" * 3000 + "<a href='/x'>Far</a>"


def test_links_of_pages_of_any_depth(spark):
    rows = [(1, "https://h/", f"{DEEP}<a href='/a'>A <i>b</i></a>{DEEP}<a href='/b'>B</a>"), (2, "https://h/", TOO_DEEP)]
    got = {(r.key, r.pos, r.url, r.title) for r in sections.links(spark.createDataFrame(rows, "key long, url string, html string")).collect()}
    assert got == {(1, 0, "https://h/a", "A b"), (1, 1, "https://h/b", "B"), (2, 0, "https://h/x", "Far")}


def test_pdfs_of_pages_of_any_depth(spark):
    rows = [(1, "https://h/", f"<main>{DEEP}<nav><a href='/f.PDF?v=1'>File</a></nav></main>"), (2, "https://h/", f"<main>{TOO_DEEP}</main>")]
    got = {(r.key, r.url, r.title, r.fault) for r in inventory.pdf_links(spark.createDataFrame(rows, "key long, url string, html string")).collect()}
    assert got == {(1, "https://h/f.PDF?v=1", "File", None), (2, None, None, "no link to a PDF")}


def test_pages_of_any_depth_can_be_cited(spark):
    rows = [("k", "T", "html", "text/html", bytearray(f"<article>{DEEP}{'word ' * 40}</article>", "utf-8"))]
    _, _, passages, rejects = corpus.prepare_catalog("c", spark.createDataFrame(rows, "key string, title string, format string, content_type string, content binary"), extract=lambda f: f.selectExpr("key", "1 as page", "'' as text"))
    assert rejects.count() == 0 and passages.count() == 1


def test_a_page_of_another_layout_or_broken_markup_stops_nothing(spark):
    """Marked sections, long numbers, missing pages and pages with two main elements used to end the job."""
    link = "<a href='/f.pdf'>F</a>"
    bodies = [f"<main><![foo[x]]>{link}</main>", f"<main>&#{'9' * 5000};&#{'0' * 5000}65;{link}</main>", f"<main><![ {link}", f"<main></main><main>{link}</main>", None, f"<main>{link}</main>"]
    rows = spark.createDataFrame([(i, "https://h/", body) for i, body in enumerate(bodies)], "key long, url string, html string")
    got = {r.key: (r.title, r.fault) for r in inventory.pdf_links(rows).collect()}
    layout = (None, "exactly one content element was expected")
    assert got == {0: ("F", None), 1: ("F", None), 2: (None, "no link to a PDF"), 3: layout, 4: layout, 5: ("F", None)}
    assert dom.tree(f"&#{'9' * 5000};&#{'0' * 5000}65;<p>&#66;").text() == "\ufffdAB\n"


def test_page_pdfs_of_a_page_without_html(spark, tmp_path):
    from evidentia.plans import queries

    spark.createDataFrame([(3, "https://h/", None), (4, "https://h/", "<p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {tuple(r) for r in queries.page_pdfs(spark, str(tmp_path)).collect()} == {(3, "/files/3.PDF?v=1", "File", None), (4, None, None, "no link to a PDF")}


def test_slices_hold_few_rows_of_long_texts_and_many_of_short_ones():
    """Lines as pages used to go through in slices of 64, each a batch of its own."""
    short, long = ["x" * 10] * 5000, ["y" * 20_000] * 200
    column, lists = pa.array([*short, *long, None]), pa.array([["a" * 100]] * 5000 + [None] * 201)
    for columns in ([column], [column.slice(4000)], [column, lists], [pa.array([], pa.string())]):
        cut = list(sizes.slices(columns))
        assert [i for a, b in cut for i in range(a, b)] == list(range(len(columns[0])))
        for a, b in cut:
            held = sum(c.slice(a, b - a).nbytes for c in columns)
            assert b - a <= sizes.SLICE_ROWS or held < 2 * sizes.SLICE_BYTES
    assert len(list(sizes.slices([pa.array(short)]))) == 1


def test_pages_of_both_kinds_are_cut_in_one_pass(spark):
    """Regulations and other files used to be cut apart, each for every use of their passages."""
    sources = spark.createDataFrame([("a", "A", "v", True), ("b", "B", "w", False)], "key string, title string, content_sha256 string, regulation boolean")
    body = "I. SPLOŠNO\n1. člen\n" + "beseda " * 400
    pages = spark.createDataFrame([(k, p, body if p == 1 else "word " * 30) for k in "ab" for p in (1, 2)], "key string, page int, text string")
    *_, passages, faults = corpus.paged("c", sources, pages)
    assert passages._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = passages.join(corpus.paged("c", sources, pages)[0].select("source_id", "key"), "source_id").collect()
    assert {(r.key, r.page, r.section, r.article) for r in rows} == {("a", 1, "I. SPLOŠNO", None), ("a", 1, "I. SPLOŠNO", "1"), ("a", 2, "I. SPLOŠNO", "1"), ("b", 1, None, None), ("b", 1, None, "1"), ("b", 2, None, "1")}
    assert faults.count() == 0


def test_cuts_look_for_the_last_white_space_past_the_middle():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab\u00e9 \n\u2003") if rng.random() < 0.5 else "w" * rng.randrange(30) for _ in range(60))
        start = 0
        for left, right in chunk.cuts(text, 0, len(text), 100, 20):
            assert text[left:right] == text[left:right].strip() != "" and right - left <= 100
        got, want, start = chunk.cuts(text, 0, len(text), 100, 20), [], 0
        while start < len(text):
            end = min(start + 100, len(text))
            gaps = [m.start() for m in re.finditer(r"\s+", text[start:end])] if end < len(text) else []
            end = start + gaps[-1] if gaps and gaps[-1] > 50 else end
            if piece := text[start:end].strip():
                left = start + len(text[start:end]) - len(text[start:end].lstrip())
                want.append((left, left + len(piece)))
            if end == len(text):
                break
            start = max(start + 1, end - 20)
        assert got == want
