"""Corpora from files of pages, from manifests and catalogs; tables published by a pointer."""

import json

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidentia.operators import corpus
from evidentia.sources import sinks

SOURCES = "key string, title string, content_sha256 string, regulation boolean, excluded_pages array<int>, ignored_lines array<string>"


def fed(files):
    """Pages of a file: texts between form feeds."""
    rows = files.select("key", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page", "text"))
    return rows.select("key", (F.col("page") + 1).alias("page"), "text")


def blanks(files):
    return fed(files).where("trim(text) = ''").select("key", "page")


def prepared(spark, sources, pages, **options):
    return corpus.paged("c", spark.createDataFrame(sources, SOURCES), spark.createDataFrame(pages, "key string, page int, text string, blank boolean"), **options)


def told(faults, documents):
    keys = {r.source_id: r.key for r in documents.collect()}
    return sorted((keys[r.source_id], r.fault, r.page) for r in faults.collect())


def test_blank_pages_of_regulations_are_excluded(spark):
    pages = [(k, n, t, t == "") for k in "rp" for n, t in ((1, "II. Del\n1. člen\nPrvo."), (2, ""), (3, "Drugo."))]
    documents, kept, passages, faults = prepared(spark, [("r", "R", "v", True, [], []), ("p", "P", "v", False, None, None)], pages)
    told_of = {r.key: r for r in documents.collect()}
    assert told_of["r"].excluded_pages == [2] and told_of["r"].chunking_version.endswith(":sections-v1") and told_of["p"].excluded_pages == []
    assert told(faults, documents) == [("p", "no native text", 2)]
    by = {(r.source_id, r.page): r for r in passages.where("page = 1").orderBy("start").collect()}
    assert by[told_of["r"].source_id, 1].section == "II. Del" and by[told_of["p"].source_id, 1].section is None
    # An article doesn't reach over an excluded page.
    assert [r.article for r in passages.where(F.col("source_id") == told_of["r"].source_id).orderBy("page", "start").collect()][-1] is None
    assert corpus.violations(documents, kept, passages).count() == 0
    assert all(r.exact for r in corpus.coverage(kept, passages).collect())


def test_faults_of_pages(spark):
    sources = [("a", "A", "v", False, [1, 1, 9], []), ("b", "B", "v", False, [], ["Foot  note"]), ("c", "C", "v", False, [1], []), ("d", "D", "v", False, [], [])]
    pages = [("a", 1, "gone", False), ("a", 2, "kept", False), ("b", 1, "Foot note\n", False), ("b", 2, "Foot note\nbody", False), ("c", 1, "all", False)]
    documents, _, passages, faults = prepared(spark, sources, pages)
    assert told(faults, documents) == [("a", "excluded page doesn't exist", 9), ("b", "only ignored lines", 1), ("c", "no passage", None), ("d", "no passage", None)]
    assert sorted(r.text for r in passages.collect()) == ["body", "kept"]
    none = prepared(spark, [], [])
    assert [t.count() for t in none] == [0, 0, 0, 0]


def test_manifests_name_their_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.pdf").write_bytes("Ena.\f\fTri.".encode())
    (tmp_path / "b.pdf").write_bytes("II. Del\nBesedilo.\f ".encode())
    sources = [{"key": "a", "title": "A", "local_path": "./raw/a.pdf", "excluded_pages": [2]}, {"key": "b", "title": "B", "local_path": "b.pdf", "regulation": {"category": "x"}}, {"key": "c", "title": "C", "local_path": "c.pdf"}, {"key": "w", "title": "W", "web": {"format": "html"}}]
    (tmp_path / "m.json").write_text(json.dumps({"corpus_id": "c", "sources": sources}))
    documents, pages, passages, faults = corpus.prepare_manifest(spark, f"{tmp_path}/m.json", fed, blanks, store=f"{tmp_path}/pages")
    got = {r.key: r for r in documents.collect()}
    assert set(got) == {"a", "b"} and got["b"].excluded_pages == [2] and got["a"].excluded_pages == [2]
    assert sorted(r.text for r in passages.collect()) == ["Ena.", "II. Del\nBesedilo.", "Tri."] and pages.count() == 5
    assert sorted(r.fault for r in faults.collect()) == ["comes from a capture", "no such file"]


def test_catalogs_sort_and_reject(spark):
    page = "<html><nav>menu</nav><article><h2 id='a'>One</h2><p>First text of it, which is long enough to be taken for the content of a page, and then some more words.</p><h2>Two</h2><p>Second text, which goes on for a while as well.</p></article></html>"
    rows = [
        ("a", "A", "html", "text/html; charset=utf-8", page), ("b", "B", "txt", "text/plain", "Plain."), ("c", "C", "markdown", "text/markdown", "# H\nx"), ("d", "D", "pdf", "application/pdf", "One.\f"),
        ("e", "E", "txt", "text/html", "Other."), ("f", "F", "txt", "text/plain", "Plain."), ("g", "G", "txt", "text/plain", 'x "expected_answer"'), ("h", "H", "pdf", "application/pdf", 'y "reference_answer"'), ("i", "I", "exe", "text/plain", "z"), ("j", "J", "html", "text/html", "<p>no article</p>"),
    ]
    df = spark.createDataFrame(rows, "key string, title string, format string, content_type string, content string").withColumn("content", F.encode("content", "UTF-8"))
    documents, pages, passages, rejects = corpus.prepare_catalog("c", df, extract=fed)
    assert {r.key: r.kind for r in documents.collect()} == {"a": "html", "b": "txt", "c": "markdown", "d": "pdf", "j": "html"}
    assert sorted((r.key, r.reject) for r in rejects.collect()) == [("d", "no native text 2"), ("e", "content_type"), ("f", "duplicate_content"), ("g", "evaluation artefact"), ("h", "evaluation artefact"), ("i", "content_type"), ("j", "no passage")]
    assert {r.source_id for r in passages.collect()} == {r.source_id for r in documents.where("key <> 'j'").collect()} and corpus.violations(documents, pages, passages).count() == 0


def test_captures_without_content_are_rejected_too(spark):
    rows = [("a", "txt", "text/plain", None), ("b", "txt", "text/plain", None), ("c", "pdf", "application/pdf", None), ("d", "txt", "image/png", None), ("e", "txt", "text/plain", ""), ("f", "txt", "text/plain", "x"), ("g", "pdf", "application/pdf", "\x1c")]
    df = spark.createDataFrame(rows, "key string, format string, content_type string, content string").selectExpr("key", "key as title", "format", "content_type", "encode(content, 'UTF-8') as content")
    documents, _, passages, rejects = corpus.prepare_catalog("c", df, extract=fed)
    assert sorted((r.key, r.reject) for r in rejects.collect()) == [("a", "no content"), ("b", "duplicate_content"), ("c", "duplicate_content"), ("d", "content_type"), ("e", "no passage"), ("g", "no native text 1"), ("g", "no passage")]
    assert {r.key for r in documents.collect()} == {"e", "f", "g"} and [r.text for r in passages.collect()] == ["x"]


def test_catalog_query_lists_documents_without_text(spark, tmp_path):
    texts = [(i, None, "s") for i in (1, 2, 3, 10, 11, 13, 22)] + [(4, "Some text.", "s"), (5, "Some text.", "s"), (6, "", "s")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in entry.queries()["catalog_rejects"](spark, str(tmp_path)).select("key", "reject").collect())
    db = duckdb.connect()
    for name in ("documents", "pages"):
        db.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert got == sorted(db.execute(entry.oracle_sql()["catalog_rejects"]).fetchall())


def test_coverage_sees_what_is_lost(spark):
    pages = spark.createDataFrame([(i, 1, "abc def ghi") for i in range(6)] + [(6, 1, " "), (7, 1, None), (8, 1, "x")], "source_id int, page int, text string")
    cuts = [(0, 0, 7, "abc def"), (0, 4, 11, "def ghi"), (1, 0, 3, "abc"), (1, 4, 11, "def ghi"), (2, 0, 3, "abc"), (2, 8, 11, "ghi"), (3, 0, 7, "abc def"), (4, 4, 11, "def ghi"), (5, 0, 11, "abc dex ghi")]
    passages = spark.createDataFrame([(i, 1, s, e, t) for i, s, e, t in cuts], "source_id int, page int, start int, end int, text string")
    got = {r.source_id: (r.exact, r.covered) for r in corpus.coverage(pages, passages).collect()}
    assert got == {0: (True, True), 1: (True, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, True), 6: (True, True), 7: (True, True), 8: (True, False)}


def test_every_document_is_audited(spark, tmp_path):
    texts = ["Some text.", None, "", " \n\u00a0", "\x1c\n\x1d", "\ufeff", "\ufeff \n", "a\x1cb\n\x1e"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, "Another text, which has the same key.", "s"), (0, "Some text.", "s"), (None, "No key.", "s"), (None, "None either.", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in entry.queries()["passage_audit"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, True, True) for i, *_ in rows), key=str)


def test_a_source_without_pages_is_covered_only_if_it_shows_nothing(spark):
    sources = spark.createDataFrame([("a", "1", "x"), ("b", "1", " "), ("c", None, None), ("d", "1", "lost")], "source_id string, version string, text string")
    pages = spark.createDataFrame([("a", "1", 1, "x")], "source_id string, version string, page int, text string")
    passages = spark.createDataFrame([("a", "1", 1, 0, 1, "x")], "source_id string, version string, page int, start int, end int, text string")
    got = {r.source_id: (r.exact, r.covered) for r in corpus.source_coverage(sources, pages, passages).collect()}
    assert got == {"a": (True, True), "b": (True, True), "c": (True, True), "d": (True, False)}


def test_tables_are_published_by_a_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert [sinks.publish(spark.range(n), root) for n in (3, 4)] == ["v000000000001", "v000000000002"]
    before = sinks.published(spark, root)
    sinks.publish(spark.range(5), root)
    assert before.count() == 4 and sinks.published(spark, root).count() == 5
    assert sorted(p.name for p in (tmp_path / "t" / "versions").iterdir()) == ["v000000000002", "v000000000003"]
    # What fails on its way leaves the pointer as it was.
    try:
        sinks.publish(spark.range(1).select(F.raise_error(F.lit("x")).alias("x")), root)
    except Exception:
        pass
    assert sinks.published(spark, root).count() == 5
    sinks.publish(spark.range(7), root)
    assert sinks.published(spark, root).count() == 7
