"""Drafted items, their review, and the files of evaluation sets and runs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import drafts, evaluate
from evidentia.sources import readers

PASSAGES = "id string, document_id string, title string, page int, section string, article string, url string, version string, text string"


def passages(spark, n=40):
    rows = [(f"p{i}", f"d{i % 3}", "Title", i % 4 + 1, "S" if i % 3 == 0 else None, str(i) if i % 3 == 1 else None, "https://h/", "v", (f"text {i % 30} " * 30)[: 2600 if i == 5 else 150] if i != 6 else "short") for i in range(n)]
    return spark.createDataFrame(rows, PASSAGES)


def test_drafts_come_in_the_seeds_order(spark):
    rows = passages(spark)
    got = drafts.silver(rows, 12, 7).collect()
    usable = [r for r in rows.collect() if 100 <= len(r.text) <= 2500]
    chosen = sorted(usable, key=lambda r: hashlib.sha256(f"7:{r.id}".encode()).hexdigest())[:12]
    asked, want = set(), []
    for r in chosen:
        place = r.section or (f"{r.article}. člen" if r.article else f"stran {r.page}")
        question = f"Kaj določa dokument »{r.title}«, {place}, v odlomku »{r.text[:70].strip()}«?"
        if question not in asked:
            asked.add(question)
            want.append((f"synthetic-{r.id}", question))
    assert sorted((r.id, r.question) for r in got) == sorted(want)
    assert all(r.groups == [r.source_ids] and r.supporting_passages[0].text == r.expected_answer for r in got)
    assert evaluate.item_violations(drafts.silver(rows, 12, 7)).count() == 0
    assert drafts.silver(rows.limit(0)).count() == 0


def pilot_file(path, **changes):
    ref = {"chunk_id": "p1", "source_key": "k", "version": "v", "page": 2, "article": "1", "url": "https://h/", "excerpt": ("text 1 " * 30)[:150]}
    item = {"id": "a", "family_id": "f", "split": "test", "question": "What is it?", "category": "direct", "reference_answer": "It.", "expected_status": "evidence_found", "evidence_groups": [["p1"]], "evidence": [ref], "review_notes": "n"}
    other = item | {"id": "b", "question": "Who?", "family_id": "g", "expected_status": "no_evidence", "evidence_groups": [], "evidence": []}
    two = item | {"id": "c", "question": "Both?", "evidence_groups": [["p2"], ["p1"]], "evidence": [ref | {"chunk_id": "p2", "page": 3, "article": None, "excerpt": ("text 2 " * 30)[:150]}, ref]}
    whole = {"schema_version": 1, "name": "set", "corpus_id": "c", "corpus_sha256": "s", "items": [item, other, two | changes]}
    path.write_text(json.dumps(whole))
    return str(path)


def test_pilot_sets_are_held_against_the_corpus(spark, tmp_path):
    have = passages(spark)
    now = have.select(F.col("id").alias("passage_id"), F.lit("k").alias("key"), "version", "page", "article", "url", "text")
    items, faults = readers.pilot(spark, pilot_file(tmp_path / "p.json"), "c", "s", now)
    assert faults.count() == 0
    got = {r.id: r for r in drafts.taken_over(items, have).collect()}
    assert got["a"].difficulty == "easy" and got["c"].difficulty == "hard" and got["c"].source_ids == ["p2", "p1"]
    assert not got["b"].answerable and got["b"].source_ids == [] and got["a"].supporting_passages[0].document_id == "d1"
    _, faults = readers.pilot(spark, pilot_file(tmp_path / "q.json", id="a", question="WHAT is it?", split="development"), "c", "other", now.withColumn("page", F.when(F.col("passage_id") == "p2", 9).otherwise(F.col("page"))))
    assert {(r.id, r.fault) for r in faults.collect()} == {("set", "made for another corpus"), ("a", "repeated id"), ("a", "repeated question"), ("a", "family in two splits"), ("a", "provenance differs")}


def test_reviews_are_signed_whole_and_of_this_content(spark):
    items = drafts.silver(passages(spark), 8)
    sheet = drafts.review_sheet(items)
    assert all(set(r.checks) == set(drafts.CHECKS) and not any(r.checks.values()) and r.origin == "Created from documents" for r in sheet.collect())
    assert drafts.review_faults(items, sheet).count() == 0  # nothing decided yet
    yes = F.transform_values("checks", lambda k, v: F.lit(True))
    first = sheet.orderBy("id").limit(1).withColumns({"review_status": F.lit("approved"), "reviewer_code": F.lit("R1"), "checks": yes})
    done = drafts.reviewed(items, first).collect()
    approved = [r for r in done if r.review_status == "approved"]
    assert len(done) == 8 and len(approved) == 1 and approved[0].reviewed_content_sha256 and all(approved[0].review_checks.values())
    # The sheet of what is reviewed shows its decision; its digest is the same.
    again = drafts.review_sheet(drafts.reviewed(items, first)).where("review_status = 'approved'").first()
    assert again.content_sha256 == approved[0].reviewed_content_sha256 and all(again.checks.values()) and again.reviewer_code == "R1"
    for fault, bad in {
        "unknown item": first.withColumn("id", F.lit("x")), "decided more than once": first.union(first), "other content": first.withColumn("content_sha256", F.lit("x")), "context edited": first.withColumn("question", F.lit("Edited?")),
        "no reviewer": first.withColumn("reviewer_code", F.lit(" ")), "checks missing": first.withColumn("checks", F.map_filter("checks", lambda k, v: k != "answer_correct")),
    }.items():
        assert [r.fault for r in drafts.review_faults(items, bad).collect()] == [fault]
        with pytest.raises(ValueError, match=fault):
            drafts.reviewed(items, bad)


def controlled_file(path):
    ref = {"source_id": "p1", "document_id": "d1", "title": "T", "page": 2, "section": None, "article": "1", "url": "https://h/", "version": "v", "text": ("text 1 " * 30)[:150]}
    base = {"question": "How many of them are there today?", "expected_answer": "text 1", "source_ids": ["p1"], "supporting_passages": [ref], "category": "direct", "answerable": True, "expected_status": "evidence_found", "generation_method": "synthetic", "review_status": "unreviewed", "review_notes": "note", "family_id": "f", "split": "test", "reviewer_code": "R7"}
    wrong = base | {"id": "b", "question": "Unlike the other one, is it?", "expected_answer": "text 99", "family_id": "g", "answerable": False}
    path.write_text(json.dumps({"schema_version": 2, "name": "n", "items": [base | {"id": "a"}, wrong]}))


def test_controlled_sets_are_audited(spark, tmp_path):
    controlled_file(tmp_path / "dataset.json")
    have = passages(spark)
    items, findings = readers.controlled(spark, str(tmp_path / "dataset.json"), have.select("id", "text"), have.select(F.col("id").alias("key"), "text"))
    assert {r.id: r.groups for r in items.collect()} == {"a": [["p1"]], "b": [["p1"]]}
    assert {(r.id, r.message) for r in findings.where("level = 'error'").collect()} == {("b", "answerable_contradicted")}


def test_saved_runs_take_what_their_log_lacks(spark, tmp_path):
    controlled_file(tmp_path / "dataset.json")
    kept = {"review_status": "unreviewed", "answerable": True, "generation_method": "synthetic"}
    one = {"id": "a", "question": "How many of them are there today?", "expected_answer": "text 1", "response": "r"} | kept
    (tmp_path / "attempts.jsonl").write_text(json.dumps(one) + "\n\n" + json.dumps(one | {"id": "b", "reviewer_code": None, "review_notes": "own"}) + "\n")
    (tmp_path / "summary.json").write_text(json.dumps({"metadata": {"selected_ids": ["a", "b", "c"]}, "unattempted_ids": ["c"]}))
    attempts, items, wanted = readers.saved_run(spark, str(tmp_path))
    got = {r.id: r for r in attempts.collect()}
    assert (got["a"].review_notes, got["a"].reviewer_code, got["a"].pos) == ("note", "R7", 0) and (got["b"].review_notes, got["b"].reviewer_code, got["b"].pos) == ("own", None, 1)
    assert {(r.id, r.fault) for r in evaluate.saved_run_faults(attempts, items, wanted).collect()} == {("b", "differs from its item")}
