"""Captures, refresh candidates and imported cases."""

import gzip
import json
import os
import sys
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from evidentia.operators import candidates, cases
from evidentia.sources import captures, readers

WEB = {
    "https://a.example/": (200, {"Content-Type": "text/html"}, b"home"),
    "https://a.example/1": (301, {"Location": "/2"}, b""),
    "https://a.example/2": (302, {"location": "https://b.example/3"}, b""),
    "https://b.example/3": (307, {"Location": "https://b.example/4"}, b""),
    "https://b.example/4": (200, {"Content-Encoding": "gzip"}, gzip.compress(b"zipped ") + gzip.compress(b"twice")),
    "https://a.example/0": (301, {"Location": "https://a.example/1"}, b""),
    "https://a.example/out": (301, {"Location": "https://evil.example/"}, b""),
    "https://a.example/plain": (301, {"Location": "http://a.example/"}, b""),
    "https://a.example/none": (301, {}, b""),
    "https://a.example/bomb": (200, {"Content-Encoding": "gzip"}, gzip.compress(bytes(50_000_000))),
    "https://a.example/cut": (200, {"Content-Encoding": "gzip"}, gzip.compress(b"x" * 999)[:-9]),
    "https://a.example/fake": (200, {"Content-Encoding": "gzip"}, b"no gzip"),
    "https://a.example/404": (404, {}, b"gone"),
}
WANT = {
    "https://a.example/": (b"home", 0, None), "https://a.example/1": (b"zipped twice", 3, None), "https://a.example/0": (None, 3, "too many redirects"),
    "https://a.example/out": (None, 1, "redirect not allowed"), "https://a.example/plain": (None, 1, "redirect not allowed"), "https://a.example/none": (None, 0, "redirect without a target"),
    "https://a.example/bomb": (None, 0, "too large"), "https://a.example/cut": (None, 0, "gzip cut off"), "https://a.example/fake": (None, 0, "not gzip"),
    "https://a.example/404": (None, 0, "status 404"), "https://evil.example/": (None, 0, "address not allowed"), "https://a.example/lost": (None, 0, "transport: KeyError"),
    "https://a.example:8443/": (None, 0, "address not allowed"), "https://u:p@a.example/": (None, 0, "address not allowed"), "nonsense": (None, 0, "address not allowed"),
}


def test_fetching_checks_every_step(spark):
    def transport(url):
        status, headers, content = web[url]
        return {"status": status, "headers": headers, "content": content, "url": url}

    web = WEB
    starts = spark.createDataFrame([(u,) for u in [*WANT, None, "https://a.example/"]], "url string")
    got = captures.fetch(starts, transport, ["a.example", "b.example"], cap=1_000_000).collect()
    assert {r.url: (None if r.content is None else bytes(r.content), r.hops, r.error) for r in got} == WANT and len(got) == len(WANT)


def test_a_bomb_is_not_expanded():
    body = zlib.compressobj(9, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    body = b"".join([body.compress(bytes(1 << 20)) for _ in range(300)]) + body.flush()
    tracemalloc.start()
    with pytest.raises(captures.Rejected, match="too large"):
        captures.expanded(body, 1 << 20)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    assert captures.expanded(gzip.compress(b"12345"), 5) == b"12345"


def test_a_source_that_is_read_by_address(spark, tmp_path, monkeypatch):
    (tmp_path / "own_transport.py").write_text(
        "asked = []\n"
        "def ask(url):\n"
        f"    open({str(tmp_path / 'log')!r}, 'a').write(url + '\\n')\n"
        "    return {'status': 200, 'headers': {'X': 'y'}, 'content': url.encode(), 'url': url}\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "own_transport.py"))
    monkeypatch.setattr(sys, "path", [str(tmp_path), *sys.path])
    captures.register(spark)
    loaded = spark.read.format("captures").option("transport", "own_transport:ask").option("hosts", "a.example,b.example")
    web = loaded.load()
    urls = [f"https://{h}.example/{i}" for h in "ab" for i in range(3)]
    rows = web.where(F.col("url").isin(*urls, "https://c.example/") & (F.length("url") > 5)).where("error is null").collect()
    assert sorted(bytes(r.content).decode() for r in rows) == urls
    assert sorted(set(open(tmp_path / "log").read().split())) == urls  # and no other address was asked for
    one = loaded.load().where("url = 'https://a.example/9'").select("status", "headers").first()
    assert one.status == 200 and one.headers == {"x": "y"}
    with pytest.raises(Exception, match="has to name url"):
        loaded.load().count()
    assert os.path.exists(tmp_path / "log")


def test_a_failing_source_leaves_the_old_candidate(spark, tmp_path):
    held = candidates.Candidates(spark, str(tmp_path))
    sources = spark.createDataFrame([("a", "https://h/a"), ("b", "https://h/b")], "key string, url string")
    docs = lambda *rows: spark.createDataFrame(rows, "key string, text string, retrieved_at string")
    said = lambda *rows: spark.createDataFrame(rows, "key string, error string")
    fine = said(("a", None), ("b", None))
    with pytest.raises(ValueError):
        held.table("c", "documents")
    one = held.stage("c", sources, fine, docs(("a", "x", "1"), ("b", "y", "1")), sources, sources)
    assert one["status"] == "candidate" and one["counts"] == {"added": 2}
    for outcomes, documents in ((said(("a", None), ("b", "status 500")), docs(("a", "new", "2"))), (said(("a", None)), docs(("a", "x", "2"), ("b", "y", "2"))), (fine, docs(("a", "x", "2")))):
        bad = held.stage("c", sources, outcomes, documents, sources, sources)
        assert bad["status"] == "failed" and held.current("c")["refresh"] == one["refresh"]
        assert held.report(bad["refresh"]).where("status = 'failed' and error is not null").count() == 1
    assert {r.key: r.text for r in held.table("c", "documents").collect()} == {"a": "x", "b": "y"}
    two = held.stage("c", sources, fine, docs(("a", "x", "3"), ("b", "z", "3")), sources, sources)
    assert two["counts"] == {"unchanged": 1, "changed": 1} and held.current("c")["refresh"] == two["refresh"]
    faulty = sources.union(sources.limit(1))
    with pytest.raises(ValueError, match="duplicate"):
        held.stage("c", faulty, fine, docs(("a", "x", "1")), sources, sources)
    many = spark.range(51).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("url"))
    assert [r.fault for r in candidates.inventory_faults(many).collect()] == ["too many sources"]
    base = sources.withColumns({"base": F.lit(True), "format": F.lit("html")})
    assert candidates.inventory_faults(base).count() == 2


CORPUS = (
    [("s1", "One", "https://h/1", False), ("s2", "Two", None, False)],
    [("s1", 1), ("s1", 2), ("s2", 1)],
    [("p1", "s1", "v", 1, None, None, "first"), ("p2", "s1", "v", 2, "5", None, "second"), ("p3", "s2", "v", 1, None, None, "third")],
)


def corpus(spark):
    return (
        spark.createDataFrame(CORPUS[0], "source_id string, title string, url string, is_web boolean"),
        spark.createDataFrame(CORPUS[1], "source_id string, page int"),
        spark.createDataFrame(CORPUS[2], "id string, source_id string, version string, page int, article string, section string, text string"),
    )


def test_cases_are_bound_to_an_audit(spark, tmp_path):
    audit = {"ok": True, "corpus_id": "c", "snapshot_id": "s", "mongo_chunks": 3, "sources": [{"document_id": "s1", "title": "One", "source_url": "https://h/1", "pages": 2, "chunks": 2}, {"document_id": "s2", "title": "Two", "source_url": None, "pages": 1, "chunks": 1}]}
    case = {"id": "k", "question": "q?", "original_response": "r", "reference_answer": "a", "source_ids": ["p3", "p1"], "required_source_groups": [["p3"], ["p1"]], "category": "x", "difficulty": "easy", "answerable": True, "expected_status": "evidence_found", "family_id": "f", "split": "test", "anonymized": True}
    (tmp_path / "cases.json").write_text("\ufeff" + json.dumps({"name": "n", "cases": [case, case | {"id": "open", "anonymized": False}]}))
    held = readers.office_cases(spark, str(tmp_path / "cases.json"))
    assert {r.id: r.fault for r in held.collect()} == {"k": None, "open": "not anonymized"}
    documents, pages, passages = corpus(spark)

    def faults(changed, some=held.where("fault is null")):
        (tmp_path / "audit.json").write_text(json.dumps(audit | changed))
        own, sources = readers.snapshot_report(spark, str(tmp_path / "audit.json"))
        return sorted(map(tuple, cases.import_faults(own, sources, "c", documents, pages, passages, some).collect()), key=str)

    one, two = audit["sources"]
    assert faults({}) == []
    assert faults({"ok": False}) == faults({"corpus_id": "d"}) == [("the audit doesn't confirm this corpus", None)]
    assert faults({"snapshot_id": " "}) == [("the audit names no snapshot", None)] and faults({"mongo_chunks": 4}) == [("the audit counts other passages", None)]
    assert faults({"sources": [one, two, two]}) == [("only in the audit", "s2")] and faults({"sources": [one]}) == [("only in the corpus", "s2")]
    assert faults({"sources": [one | {"pages": 9}, two]}) == [("only in the audit", "s1"), ("only in the corpus", "s1")]
    assert faults({}, held.withColumn("source_ids", F.array(F.lit("p9"), F.lit("p9"), F.lit("p1")))) == [("unknown evidence", "k:p9"), ("unknown evidence", "open:p9")]
    item = cases.imported(held.where("fault is null"), documents, passages, "s").first()
    assert [p.text for p in item.supporting_passages] == ["third", "first"] and item.expected_answer == "a" and item.original_response == "r"
    assert (item.generation_method, item.data_origin, item.review_status, item.corpus_snapshot_id) == ("student_office", "real", "unreviewed", "s")
