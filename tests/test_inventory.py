"""Inventories of files, the state of a corpus, published answers."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import corpus, inventory


def test_pdfs_of_a_portal(spark):
    page = '<a href="/out.pdf">Out</a><main><nav><a href="/n.PDF#p">Cenik 2024</a></nav><a href="b.pdf?x=1">B</a><a href="b.pdf?x=1">B again</a><a href="/c.docx">C</a><a href="mailto:x@y.pdf">M</a></main>'
    df = spark.createDataFrame([("k", "https://h/p/", page), ("none", "https://h/", "<main>nothing</main>")], "key string, url string, html string")
    rows = sorted(((r.key, r.url, r.title, r.fault) for r in inventory.pdf_links(df).collect()), key=str)
    assert rows == [("k", "https://h/n.PDF#p", "Cenik 2024", None), ("k", "https://h/p/b.pdf?x=1", "B again", None), ("none", None, None, "no link to a PDF")]


def test_files_are_listed_once_and_reported(spark):
    d = spark.createDataFrame([("u1", "Rules", True), ("u2", "Form", False)], "url string, title string, included boolean")
    r = spark.createDataFrame([("u2", "As a rule"), ("u3", "Resolved")], "url string, title string")
    p = spark.createDataFrame([("u3", "Price"), ("u4", "Price list")], "url string, title string")
    files = inventory.candidates(d, r, p)
    assert {x.url: (x.title, x.kind) for x in files.collect()} == {
        "u1": ("Rules", "regulation_or_instruction"), "u2": ("Form", "form_template_or_pricing"), "u3": ("Resolved", "regulation_or_instruction"), "u4": ("Price list", "pricing"),
    }
    out = "url string, status string, extraction string"
    outcomes = spark.createDataFrame([("u1", "downloaded", "prepared"), ("u2", "downloaded", None), ("u3", "failed", "prepared"), ("zz", "downloaded", "prepared")], out)
    rows = inventory.synced(files, outcomes, spark.createDataFrame([("u2",), ("u2",), (None,)], "url string"))
    got = {x.url: (x.status, x.extraction, x.present_in_previous_corpus) for x in rows.collect()}
    assert got == {"u1": ("downloaded", "prepared", False), "u2": ("downloaded", "needs_review", True), "u3": ("failed", None, False), "u4": ("failed", None, False)}
    told = inventory.sync_report(rows).first()
    assert tuple(told) == (4, 2, 1, 3, False, False)
    fine = rows.withColumns({"status": F.lit("downloaded"), "extraction": F.lit("prepared")})
    assert tuple(inventory.sync_report(fine).first())[4:] == (True, True) and tuple(inventory.sync_report(fine, 1).first())[4:] == (False, False)
    with pytest.raises(Exception, match="more files"):
        inventory.sync_report(fine, most=3).collect()


def test_status_of_a_corpus(spark):
    docs = spark.createDataFrame([("a", None), ("b", "2024-05-01 10:00:00"), ("c", "2024-04-01 10:00:00")], "source_id string, captured_at string").withColumn("captured_at", F.to_timestamp("captured_at"))
    row = inventory.corpus_status(docs, docs.select("source_id")).first()
    assert (row.documents, row.website_sources, row.chunks) == (3, 2, 3) and str(row.website_capture_oldest) == "2024-04-01 10:00:00" and str(row.website_capture_newest) == "2024-05-01 10:00:00"
    none = inventory.corpus_status(docs.limit(0), docs.limit(0)).first()
    assert (none.documents, none.website_capture_oldest, none.chunks) == (0, None, 0)


def test_published_answers_are_as_captured(spark):
    held = spark.createDataFrame([("d", 1, "When?", "w", "When?\nToday.\nNazaj na vrh", "https://h/faq", "sha", 5)], "document_id string, page int, heading string, anchor string, text string, url string, sha256 string, captured_at int")
    proof = spark.createDataFrame([("p1", "d", 1), ("p2", "d", 1), ("p3", "d", 2)], "id string, document_id string, page int")
    good = ("0", "When?", "Today.", True, ["p2", "p1"], "d", 1, "https://h/faq", "sha", 5, "w")
    names = "id string, question string, expected_answer string, answerable boolean, source_ids array<string>, document_id string, section_index int, source_url string, snapshot_sha256 string, captured_at int, anchor string"
    bad = {1: "Why?", 2: "Now.", 3: False, 4: ["p1"], 5: "e", 6: 2, 7: None, 8: "old", 9: 6, 10: None}
    rows = [good] + [(str(i), *good[1:i], v, *good[i + 1 :]) for i, v in bad.items()]
    got = {r.id: r.fault for r in inventory.faq_faults(spark.createDataFrame(rows, names), held, proof, "https://h/faq").collect()}
    assert got == {"1": "question differs", "2": "answer differs", "3": "question differs", "4": "evidence differs", "5": "no such section", "6": "no such section", "7": "other address", "8": "other capture", "9": "other capture", "10": "other capture"}


def test_sources_without_passages_and_absent_pages(spark):
    sources = spark.createDataFrame([("a", [1]), ("b", [2, 2, 9]), ("c", None)], "source_id string, excluded_pages array<int>")
    pages = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1)], "source_id string, page int")
    got = corpus.preparation_faults(sources, pages, spark.createDataFrame([("b",), ("c",)], "source_id string")).collect()
    assert sorted(map(tuple, got)) == [("a", "no passage", None), ("b", "excluded page doesn't exist", 9)]
