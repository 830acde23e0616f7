"""Passages, corpora, sections, snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.functions.dom import LayoutError, tidy, tree
from evidentia.operators import chunk, corpus, refresh, sections
from evidentia.operators.snapshot import Snapshots

PAGES = "source_id string, version string, page int, text string"


def cut(spark, pages, **options):
    df = spark.createDataFrame([("s", "v", n, t) for n, t in pages], PAGES)
    return chunk.chunks(df, **options).orderBy("page", "start").collect()


def test_articles_are_carried_and_reset(spark):
    rows = cut(spark, [(1, "1. člen\nPrvo."), (2, "Se nadaljuje.\n2. člen\nDrugo.\nII. Drugi del\nUvod."), (4, "Po vrzeli.")], preserve_sections=True)
    assert [(r.page, r.article, r.section) for r in rows] == [(1, "1", None), (2, "1", None), (2, "2", None), (2, None, "II. Drugi del"), (4, None, None)]


def test_excluded_pages_reset(spark):
    df = spark.createDataFrame([("s", "v", 1, "1. člen\nA", False), ("s", "v", 2, "skip", True), ("s", "v", 3, "B", False)], PAGES + ", excluded boolean")
    assert [(r.page, r.article) for r in chunk.chunks(df).orderBy("page").collect()] == [(1, "1"), (3, None)]


def test_passages_are_bounded_and_cover_the_page(spark):
    text = "1. člen\n" + "Besedilo pravila. " * 50 + "x" * 210
    rows = cut(spark, [(1, text)], max_chars=100, overlap=20)
    assert all(len(r.text) <= 100 and text[r.start : r.end] == r.text for r in rows)
    seen = {i for r in rows for i in range(r.start, r.end)}
    assert all(i in seen or text[i].isspace() for i in range(len(text)))
    assert len({r.id for r in rows}) == len(rows)


def test_edge_lines(spark):
    df = spark.createDataFrame([("s", "v", 1, "Head  line\r\nbody\nHead line\nmore\n7", ["Head line", "7"])], PAGES + ", ignored_lines array<string>")
    assert chunk.chunks(df).first().text == "body\nHead line\nmore"


@pytest.mark.parametrize("options", [{"max_chars": 99}, {"overlap": 1400}, {"overlap": -1}])
def test_bad_options(spark, options):
    with pytest.raises(chunk.ChunkError):
        cut(spark, [(1, "x")], **options)


def test_blank_pages_stop_the_job(spark):
    with pytest.raises(Exception, match="no native text"):
        cut(spark, [(1, " \n ")])
    assert cut(spark, [(1, " \n ")], strict=False) == []


def test_markdown_splits_at_headings(spark):
    rows = [("k", "Title", "markdown", "﻿intro\r\n\r\n# One\r\nText\n## Two \nMore")]
    df = spark.createDataFrame(rows, "key string, title string, kind string, text string")
    documents, pages, passages = corpus.prepare_text("c", df)
    assert [(p.page, p.heading, p.text) for p in pages.orderBy("page").collect()] == [(1, "Title", "intro"), (2, "One", "# One\nText"), (3, "Two", "## Two\nMore")]
    assert corpus.violations(documents, pages, passages).count() == 0
    with pytest.raises(Exception, match="k: possible evaluation artefact"):
        corpus.prepare_text("c", df.withColumn("text", F.lit('{"expected_answer": 1}')))[2].collect()


def test_violations_are_found(spark):
    df = spark.createDataFrame([("k", "T", "txt", "Some text of a source.")], "key string, title string, kind string, text string")
    documents, pages, passages = corpus.prepare_text("c", df)
    bad = passages.withColumn("text", F.upper("text")).union(passages.withColumn("page", F.lit(9)))
    assert {r.rule for r in corpus.violations(documents, pages, bad).collect()} == {"duplicate_passage", "text_differs", "unknown_page"}


def test_captures_are_accepted_or_not(spark):
    rows = [("a", "pdf", "application/pdf; x=1", bytearray(b"1")), ("b", "pdf", "application/pdf", bytearray(b"1")), ("c", "html", "application/pdf", bytearray(b"2"))]
    got = {r.key: r.reject for r in corpus.accept_content(spark.createDataFrame(rows, "key string, format string, content_type string, content binary")).collect()}
    assert got == {"a": None, "b": "duplicate_content", "c": "content_type"}


HTML = """<nav>Menu</nav><div id="box"><p>Intro text that is long enough to be counted as evidence by the reader.</p><h2 id="h">First</h2><p>Body <a href="/a">A</a><br>next</p>
<ul><li>May I ask?</li></ul><p>Yes, you may.</p><script>no()</script><a href="/a">Again</a></div><footer>end</footer>"""


def test_sections(spark):
    df = spark.createDataFrame([("k", "Title", "https://e.org/x", HTML)], "key string, title string, url string, html string")
    rows = sections.sections(df, "box").orderBy("page").collect()
    assert [(r.heading, r.anchor) for r in rows] == [("Title", "box"), ("First", "h"), ("May I ask?", None)]
    assert rows[1].text == "First\nBody A\nnext" and rows[2].text.startswith("May I ask?\nYes, you may.")
    assert [tuple(r) for r in sections.links(df, "box").collect()] == [("k", 0, "https://e.org/a", "Again")]
    with pytest.raises(Exception, match="exactly one content element"):
        sections.sections(df, "absent").collect()
    with pytest.raises(Exception, match="too little text"):
        sections.sections(df.withColumn("html", F.lit('<div id="box">short</div>')), "box").collect()
    with pytest.raises(LayoutError):
        sections.chosen(tree(HTML), "absent")
    odd = df.withColumn("html", F.lit('<div id="box"><h1></h1><h2><a name="n">Only a heading?</a></h2><li>Is it so?<ul><li>yes</ul></li><table><tr><td>a<td>b</tr></table>' + "long text " * 12 + "</div>")).withColumn("title", F.lit(None).cast("string"))
    assert [(r.page, r.heading, r.anchor, r.text) for r in sections.sections(odd, "box").orderBy("page").collect()] == [(1, "Only a heading?", "n", "Only a heading?\nIs it so?yes\nab\n" + " ".join(["long text"] * 12))]
    assert sections.sections(df, "absent", strict=False).first().error


def test_tidied_lines_are_those_of_the_standard_library(spark):
    rng = random.Random(4)
    signs = ["a", "é", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "😀"]
    rows = [("".join(rng.choices(signs, k=rng.randint(0, 30))),) for _ in range(400)]
    got = spark.createDataFrame(rows, "t string").select("t", text.tidied(F.col("t")).alias("x")).collect()
    assert all(r.x == tidy(r.t) for r in got)


LANDING = """<div id="katedre-container"><h2>Pravilniki</h2><ul><li><a href="/p.pdf">Pravilnik o redu</a> Velja od 1. 2. 2024<ul><li><a href="/s.pdf">Sprememba pravilnika</a></li>
<li><a href="/obrazec_1.pdf">Pravilnik</a></li></ul></li><li><a href="/p.pdf">Pravilnik o redu</a></li><li><a href="https://evil.org/p.pdf">Pravilnik</a></li><li><a href="/n">Novice</a></li></ul>
<h3>Cenik</h3><a href="/c.pdf">Pravilnik o cenah</a></div>"""


def test_discovery(spark):
    df = spark.createDataFrame([("l", "https://fri.uni-lj.si/sl/x", "katedre-container", LANDING)], "key string, url string, selector string, html string")
    rows = sections.discover(df).orderBy("pos").collect()
    assert [(r.title, r.included, r.section) for r in rows] == [
        ("Pravilnik o redu", True, "general"), ("Sprememba pravilnika", True, "general"), ("Pravilnik", False, "general"), ("Pravilnik o redu", False, "general"),
        ("Pravilnik", False, "general"), ("Novice", False, "general"), ("Pravilnik o cenah", False, "excluded"),
    ]
    assert str(rows[0].effective_date) == "2024-02-01" and rows[1].is_amendment and rows[1].parent_key == rows[0].source_key
    assert rows[3].reason == "duplicate URL" and rows[4].reason.startswith("unsupported")


def test_parents_are_included_links_and_faults_are_told(spark):
    """A form between a regulation and its amendment is no parent; nor is what stands in another list."""
    page = """<div id="box"><h2>Pravilniki</h2><ul><li><a href="/a">Pravilnik A</a><a href="/f">Prošnja za pravilnik</a><ul><li><a href="/a1">Sprememba pravilnika A</a></li>
<li><span><a href="/b">Pravilnik B</a></span><a href="/b1">Sprememba pravilnika B</a></li></ul></li><li><a href="/c1">Sprememba pravilnika C</a></li></ul>
<h2>Prva stopnja</h2><a href="/d">Pravilnik D</a><a href="/d2">Pravilnik D</a><p><a href="/d1">Dopolnitev pravilnika D</a></p></div>"""
    df = spark.createDataFrame([("l", "https://fri.uni-lj.si/sl/x", "box", page)], "key string, url string, selector string, html string")
    found = sections.discover(df)
    rows = {r.url.rsplit("/", 1)[1]: r for r in found.collect()}
    assert not rows["f"].included and rows["a1"].parent_key == rows["a"].source_key
    assert rows["b1"].parent_key == rows["a"].source_key  # B stands in an element of its own
    assert rows["c1"].parent_key is None and rows["d1"].parent_key == rows["d2"].source_key and rows["b"].parent_key is None
    faults = sorted((r.fault, r.detail) for r in sections.discovery_faults(found).collect())
    assert faults == [("ambiguous title", "Pravilnik D"), ("required section missing", "doctoral"), ("required section missing", "master_thesis")]
    assert sections.discovery_faults(found, ("general",)).count() == 1


def test_portals(spark):
    page = '<main><h2>Veljavno</h2><a href="/a.pdf">Pravilnik o doktorskem študiju PDF 1,2 MB</a><a href="/x.pdf">Drugo</a><h2>Arhiv</h2><a href="/b.pdf">Pravilnik o doktorskem</a></main>'
    df = spark.createDataFrame([("k", "https://www.uni-lj.si/p", page)], "key string, url string, html string")
    assert [(r.url, r.title) for r in sections.portal_documents(df, "doctoral").collect()] == [("https://www.uni-lj.si/a.pdf", "Pravilnik o doktorskem študiju")]
    assert sections.single_link(df, "drugo").first().url == "https://www.uni-lj.si/x.pdf"


def test_refresh(spark):
    f = "key string, title string, captured_at string, is_web boolean, content_sha256 string"
    old = spark.createDataFrame([("a", "A", "1", True, "x"), ("b", "B", "1", False, "x"), ("c", "C", "1", False, "x")], f)
    new = spark.createDataFrame([("a", "A", "2", True, "y"), ("b", "B", "2", False, "y"), ("d", "D", "2", False, "x")], f)
    got = refresh.diff(refresh.comparable(old), refresh.comparable(new))
    assert {r.key: r.status for r in got.collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    assert refresh.report(got).first().index_update_required
    files = spark.createDataFrame([("k", "NPB 2", "u2"), ("k", "NPB 10", "u10"), ("k", "old", "u")], "key string, label string, url string")
    assert refresh.latest_version(files).first().url == "u10"
    hops = spark.createDataFrame([("https://e.org/a", "https://e.org/b"), ("https://e.org/b", "https://e.org/c"), ("https://e.org/x", "https://evil.org/")], "url string, target string")
    ends = refresh.redirects(spark.createDataFrame([("https://e.org/a",), ("https://e.org/x",)], "url string"), hops, ["e.org"])
    assert {r.url[-1]: (r.final, r.hops, r.error) for r in ends.collect()} == {"a": ("https://e.org/c", 2, None), "x": ("https://e.org/x", 0, "redirect not allowed")}


def test_snapshots(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(c):
        return F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))

    def prepared(texts):
        return corpus.prepare_text("c", spark.createDataFrame([(k, k, "txt", t) for k, t in texts], "key string, title string, kind string, text string"))

    held = Snapshots(spark, f"file://{tmp_path}", embed, {"model": "length", "dimensions": 2})
    first = [("a", "Text of a."), ("b", "Text of b, longer.")]
    one = held.index("c", *prepared(first))
    assert (one["status"], one["embedded"], one["passages"]) == ("published", 2, 2)
    assert held.index("c", *prepared(first))["status"] == "unchanged"
    two = held.index("c", *prepared([*first, ("d", "New text.")]))
    assert (two["embedded"], two["passages"]) == (1, 3) and held.active("c")["snapshot_id"] == two["snapshot_id"]
    assert all(r.n == 0 for r in held.audit("c", *prepared([*first, ("d", "New text.")])).collect())
    damaged = {r.finding: r.n for r in held.audit("c", *prepared(first)).collect()}
    assert damaged["source_unexpected"] == 1 and damaged["passage_unexpected"] == 1
    asked = spark.createDataFrame([(1, "Text of a.")], "query_id long, question string")
    assert held.search("c", asked, 1).first().text == "Text of a."
    broken = Snapshots(spark, f"file://{tmp_path}", lambda c: F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float")), {"model": "zero", "dimensions": 2})
    with pytest.raises(ValueError):
        broken.index("c", *prepared([("z", "Other.")]))
    assert held.active("c")["snapshot_id"] == two["snapshot_id"]  # a failed build leaves the old one
    assert calls.value == 0


def test_sources_of_every_kind(spark):
    from evidentia.operators import corpus, refresh

    page = "<html><nav>menu</nav><article><h2 id='a'>One</h2><p>First text of it, which is long enough to be taken for the content of a page, and then some more words.</p><h2>Two</h2><p>1. člen</p><p>Second text, which goes on for a while as well, so that nobody takes it for a heading alone.</p></article></html>"
    rows = [("h", "Page", "html", page), ("t", "Text", "txt", "Plain words."), ("m", "Mark", "markdown", "# A\nx\n# B\ny"), ("bad", "Bad", "html", "<p>no article</p>")]
    documents, pages, passages = corpus.prepare("c", spark.createDataFrame(rows, "key string, title string, kind string, text string"))
    assert {r.key: r.kind for r in documents.collect()} == {"h": "html", "t": "txt", "m": "markdown", "bad": "html"}
    ids = {r.key: r.source_id for r in documents.collect()}
    got = [r for r in passages.collect() if r.source_id == ids["h"]]
    assert len(got) >= 2 and all(r.article is None and r.section is None for r in got) and not [r for r in pages.collect() if r.source_id == ids["bad"]]
    assert corpus.violations(documents, pages, passages).count() == 0
    ruled = spark.createDataFrame([("h", "Page", page, True)], "key string, title string, text string, regulation boolean")
    found = corpus.prepare_html("c", ruled, "<article|main>")[2].collect()
    assert {r.section for r in found} >= {"One", "Two"} and "1" in {r.article for r in found} and not {r.id for r in found} & {r.id for r in got}
    for kind in ("doc", None):
        with pytest.raises(Exception, match="x: no way to prepare"):
            corpus.prepare("c", spark.createDataFrame([("x", "X", kind, "t")], "key string, title string, kind string, text string"))[0].collect()
    changes = spark.createDataFrame([("a", "added"), ("b", "unchanged")], "key string, status string")
    sizes = spark.createDataFrame([("a", 5), ("b", 7)], "key string, chars int")
    row = refresh.report(changes, sizes).first()
    assert (row.added, row.total_chars, row.new_chars, row.index_update_required) == (1, 12, 5, True)
