"""Retrieval, answers, metrics, audits, readers."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import answers, evaluate, retrieve, sizes
from evidentia.sources import readers, sinks

ITEMS = "id string, required array<string>, groups array<array<string>>, ranked array<string>"


def test_retrieval_scores(spark):
    rows = [("x", ["a", "alternative", "b"], [["a", "alternative"], ["b"]], ["noise", "alternative", "other", "b"]), ("none", [], [], ["a"])]
    got = {r.id: r for r in evaluate.retrieval_scores(spark.createDataFrame(rows, ITEMS)).collect()}
    x = got["x"]
    assert (x.hit_rate_at_1, x.hit_rate_at_3, x.recall_at_3, x.recall_at_5, x.reciprocal_rank) == (0, 1, 0.5, 1, 0.5)
    assert got["none"].hit_rate_at_1 is None and got["none"].reciprocal_rank is None
    late = spark.createDataFrame([("y", ["z"], [["z"]], list("abcdefz"))], ITEMS)
    assert evaluate.retrieval_scores(late).first().reciprocal_rank == pytest.approx(1 / 7)
    assert evaluate.evidence_scores(late).first().reciprocal_rank_at_5 == 0


def test_answer_scores_and_summary(spark):
    schema = "id string, answerable boolean, expected_answer string, expected_status string, source_ids array<string>, groups array<array<string>>, response string, status string, cited array<string>, error string"
    rows = [
        ("1", True, "moder člen", "evidence_found", ["a", "b"], [["a"], ["b"]], "člen moder", "evidence_found", ["a", "q"], None),
        ("2", False, "", "no_evidence", [], [], "", "no_evidence", [], None),
        ("3", True, "x", "evidence_found", ["a"], [["a"]], "", None, [], "timeout"),
    ]
    scored = evaluate.answer_scores(spark.createDataFrame(rows, schema)).withColumn("origin", F.lit("synthetic"))
    got = {r.id: r for r in scored.collect()}
    assert (got["1"].token_f1, got["1"].cited_source_precision, got["1"].required_source_citation_recall) == (1, 0.5, 0.5)
    assert got["2"].unanswerable_detection == 1 and got["2"].token_f1 is None and got["3"].status_match == 0
    total = evaluate.summarize(scored, ["token_f1"]).first()
    assert (total.n, total.errors, total.token_f1_mean, total.token_f1_n) == (3, 1, 0.5, 2)
    grouped = evaluate.summarize(scored, ["token_f1"], [["origin"], ["answerable"], []])
    assert grouped.count() == 4
    assert "| all | 3 | 1 | 0.500 (2) |" in sinks.report(grouped, "Run", ["token_f1"])


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21])
def test_percentiles(spark, n):
    import math
    from statistics import median

    values = [float((i * 7) % n) for i in range(n)]
    r = evaluate.latencies(spark.createDataFrame([(v,) for v in values], "latency_seconds double")).first()
    assert (r.p50, r.p95) == (median(values), sorted(values)[math.ceil(0.95 * n) - 1])


def test_neighbours_take_one_slot_after_their_seed(spark):
    hits = spark.createDataFrame([(1, 1, "h1"), (1, 2, "h2"), (1, 3, "h3")], "query_id long, rank int, id string")
    held = spark.createDataFrame([("h1", None, True, None, "n0"), ("h2", "5", True, "short", "n2"), ("h3", "6", True, "n3", None), ("short", "5", False, None, None), ("n2", "5", True, None, None), ("n3", "6", True, None, None)], "id string, article string, substantive boolean, previous string, next string")
    rows = retrieve.with_neighbour(hits, held, 3).orderBy("rank").collect()
    assert [(r.id, r.origin) for r in rows] == [("h1", "ranked"), ("h2", "ranked"), ("n2", "article_neighbor")]


def test_slots(spark):
    s = "query_id long, rank int, id string"
    fresh = spark.createDataFrame([(1, i, f"f{i}") for i in range(1, 5)] + [(2, i, f"f{i}") for i in range(1, 5)], s)
    fixed = spark.createDataFrame([(1, 1, "x1")], s)
    got = {q: [r.id for r in retrieve.merged(fresh, fixed, 4).where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 2)}
    assert got == {1: ["f1", "f2", "x1", "f3"], 2: ["f1", "f2", "f3", "f4"]}


def test_fresh_ranking_minds_years_and_headings(spark):
    asked = spark.createDataFrame([(1, "uradne ure 2025")], "query_id long, question string")
    held = spark.createDataFrame([("a", "Uradne ure 2024", "Uradne ure 2024\nod 8"), ("b", "Uradne ure 2025", "Uradne ure 2025\nod 9"), ("c", "Uradne ure", "Uradne ure"), ("d", "Drugo", "uradne besede in ure")], "id string, heading string, text string")
    assert [r.id for r in retrieve.fresh_top(asked, held).orderBy("rank").collect()] == ["b", "d"]


def test_history_is_questions_only(spark):
    df = spark.createDataFrame([(1, i, f"q{i}") for i in range(7)], "conv_id long, turn int, question string")
    got = {r.turn: r.query for r in retrieve.retrieval_text(df).collect()}
    assert got[0] == "q0" and got[6].endswith("\nq2\nq3\nq4\nq5") and got[6].startswith("Aktualno vprašanje: q6\n")


def test_answers(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, 1, "c1", "one", "T", None, 1, None, "v", "reviewed"), (1, 2, "c2", "two", "T", None, 1, None, "v", "pending")], "query_id long, rank int, id string, text string, title string, url string, page int, article string, version string, review_status string")
    rows = {r.query_id: r for r in answers.assemble(asked, hits).collect()}
    assert rows[1].status == "evidence_found" and [c.id for c in rows[1].citations] == ["c1", "c2"] and len(rows[1].warnings) == 3
    assert rows[2].status == "no_evidence" and rows[2].message == answers.NO_EVIDENCE
    said = {r.query_id: r.response for r in answers.response_text(answers.assemble(asked, hits)).collect()}
    assert said[1] == "one\ntwo"
    part = spark.createDataFrame([(1, 1, "text", ["unknown"])], "query_id long, part int, text string, citation_ids array<string>")
    with pytest.raises(ValueError, match="outside"):
        answers.assemble(asked, hits, part)
    with pytest.raises(ValueError, match="twice"):
        answers.assemble(asked, hits.union(hits))


def test_audit_and_near_questions(spark):
    ref = "array<struct<id:string,text:string,article:string>>"
    rows = [
        ("1", "Kdaj je rok za prijavo na izpit letos", "rok je 5 dni", True, "f1", "test", [("p", "Rok je 5 dni.", None)]),
        ("2", "Kdaj je rok za prijavo na izpit", "rok je 7 dni", True, "f2", "test", [("p", "changed", None)]),
        ("3", "Čisto drugo vprašanje o knjižnici", "", False, "f3", "test", []),
    ]
    items = spark.createDataFrame(rows, f"id string, question string, expected_answer string, answerable boolean, family_id string, split string, references {ref}")
    passages = spark.createDataFrame([("p", "Rok je 5 dni.")], "id string, text string")
    pages = spark.createDataFrame([("k", "… čisto DRUGO vprašanje, o knjižnici!")], "key string, text string")
    found = {(r.id, r.level) for r in evaluate.audit(items, passages, pages).collect()}
    assert found == {("2", "error"), ("2", "warning"), ("3", "error"), ("1,2", "error")}
    pairs = evaluate.near_questions(items.select("id", F.col("question").alias("text")), ratio=None).collect()
    assert [(r.a, r.b) for r in pairs] == [("1", "2")]


def test_item_rules(spark):
    schema = "id string, question string, answerable boolean, expected_status string, source_ids array<string>, groups array<array<string>>, family_id string, split string"
    rows = [("1", "A?", True, "evidence_found", ["a"], [["a"]], "f", "x"), ("2", "a", True, "no_evidence", ["a", "b"], [["a"]], "f", "y")]
    got = {r.rule for r in evaluate.item_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"duplicate_question", "groups_not_a_partition", "answerable_contradicted", "family_in_two_splits"}


def test_reviews_are_bound_to_content(spark):
    items = spark.createDataFrame([("1", "h1", "unreviewed"), ("2", "h2", "unreviewed")], "id string, content_sha256 string, review_status string")
    d = "id string, content_sha256 string, review_status string, reviewer_code string, review_notes string"
    ok = evaluate.apply_reviews(items, spark.createDataFrame([("1", "h1", "approved", "R1", "")], d))
    assert {r.id: r.review_status for r in ok.collect()} == {"1": "approved", "2": "unreviewed"}
    for bad in (("9", "h1", "approved", "R1", ""), ("1", "old", "approved", "R1", ""), ("1", "h1", "approved", " ", "")):
        with pytest.raises(ValueError):
            evaluate.apply_reviews(items, spark.createDataFrame([bad], d))
    assert {r.review_status: r.n for r in evaluate.review_counts(ok).collect()} == {"unreviewed": 1, "approved": 1, "rejected": 0, "needs_revision": 0}


def test_public_sets(spark, tmp_path):
    data = {"version": "2", "data": [{"title": "t", "paragraphs": [{"context": "The blue sky.", "qas": [
        {"id": "1", "question": "What?", "is_impossible": False, "answers": [{"text": "blue", "answer_start": 4}, {"text": "blue", "answer_start": 4}, {"text": "blue sky", "answer_start": 4}]},
        {"id": "2", "question": "Why?", "is_impossible": True, "answers": []},
        {"id": "3", "question": "Bad?", "is_impossible": False, "answers": [{"text": "green", "answer_start": 0}]}]}]}]}
    (tmp_path / "s.json").write_text("﻿" + json.dumps(data))
    items = readers.squad(spark, str(tmp_path / "s.json"))
    got = {r.id: r for r in items.collect()}
    assert got["1"].answers == ["blue", "blue sky"] and not got["2"].answerable and got["3"].fault == "answer not in its context"
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(p) for p in [{"id": "1", "answer": "the blue sky", "refused": False}, {"id": "2", "answer": "", "refused": True}]))
    said = readers.predictions(spark, str(tmp_path / "p.jsonl"))
    scored = {r.id: r for r in readers.score_predictions(items.where("fault is null"), said).collect()}
    assert scored["1"].token_f1 == pytest.approx(0.8) and scored["2"].exact_match == 1
    with pytest.raises(ValueError):
        readers.score_predictions(items, said)
    (tmp_path / "q.csv").write_text('input,output,type,answerable\n"A, b?",yes,fact,true\nC?,,fact,false\n')
    rows = readers.qa_csv(spark, str(tmp_path / "q.csv")).collect()
    assert [(r.question, r.answers, r.answerable) for r in rows] == [("A, b?", ["yes"], True), ("C?", [], False)]


def test_faq(spark):
    rows = [("k", 1, "Uvod", "a0", "Uvod\nx"), ("k", 2, "Kdaj?", "a1", "Kdaj?\nJutri.\nNazaj na vrh"), ("k", 3, "Kje?", "a2", "Kje?\nNazaj na vrh")]
    df = spark.createDataFrame(rows, "key string, page int, heading string, anchor string, text string")
    assert [(r.section_index, r.question, r.expected_answer) for r in readers.faq_items(df).collect()][0] == (2, "Kdaj?", "Jutri.")
    toc = spark.createDataFrame([("a1",), ("zz",)], "anchor string")
    assert {(r.anchor, r.fault) for r in readers.toc_faults(toc, df).collect()} == {("zz", "listed, not found"), ("a0", "found, not listed"), ("a2", "found, not listed")}


def test_prepared_corpus_round_trip(spark, tmp_path):
    from evidentia.operators import corpus

    df = spark.createDataFrame([("k", "T", "txt", "Some text.")], "key string, title string, kind string, text string")
    documents, pages, passages = corpus.prepare_text("c", df)
    line = json.loads(sinks.corpus_json(documents, pages, passages, "c").first().value)
    whole = {"schema_version": 1, "corpus_id": "c", "documents": [{"source_id": line["source_id"], "source": {"key": "k", "title": "T"}, "content_sha256": line["content_sha256"], "pages": line["pages"], "chunks": line["chunks"]}]}
    (tmp_path / "c.json").write_text(json.dumps(whole))
    again = readers.prepared_corpus(spark, str(tmp_path / "c.json"))
    assert corpus.violations(*again).count() == 0 and again[2].count() == 1
    sinks.replace(pages, str(tmp_path / "out"))
    sinks.replace(pages, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    sinks.create(pages, str(tmp_path / "once"))
    with pytest.raises(Exception):
        sinks.create(pages, str(tmp_path / "once"))


def test_query_sets_of_any_size(spark, monkeypatch):
    """A set above the size of a broadcast gives the same rows, not an error."""
    asked = spark.createDataFrame([(i, f"red fox number{i} in 2024", [1.0, float(i)]) for i in range(6)], "query_id long, question string, embedding array<double>")
    held = spark.createDataFrame([(f"p{i}", i, "head", f"red fox number{i} runs", [1.0, float(i)]) for i in range(6)], "id string, pos long, heading string, text string, embedding array<double>")
    questions, pages = asked.selectExpr("query_id as id", "concat('number', query_id) as text"), held.selectExpr("id as key", "text")

    def rows():
        found = [f(asked, held, 2) for f in (retrieve.keyword_top, retrieve.lexical_top, retrieve.fresh_top, retrieve.vector_top)]
        return [sorted(map(tuple, x.collect())) for x in found]

    few = rows()
    monkeypatch.setattr(retrieve, "MAX_QUERIES", 2)
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == few and all(few)
        assert sorted(map(tuple, evaluate.leaked(questions, pages).collect())) == [(i, f"p{i}") for i in range(6)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_selection_of_items(spark):
    rows = [("a", 1, "test", "approved", "synthetic"), ("b", 2, "test", "unreviewed", "official_faq"), ("c", 3, "test", "rejected", "synthetic"), ("d", 4, "dev", "approved", "synthetic"), ("e", 5, "test", "needs_revision", "synthetic"), ("f", 6, "test", "approved", "student_office")]
    items = spark.createDataFrame(rows, "id string, pos int, split string, review_status string, generation_method string")
    ids = lambda *args, **more: [r.id for r in evaluate.selected(items, *args, **more).collect()]
    assert ids("test") == ["a", "b", "f"] and ids("test", limit=1) == ["a"]
    assert ids("test", True) == ["a", "f"] and ids("test", from_origin="real_student_office") == ["f"] and ids("test", of_tier="official_faq") == ["b"]
    with pytest.raises(ValueError):
        evaluate.selected(items, "test", limit=0)


def test_saved_runs(spark):
    fields = "id string, question string, expected_answer string, review_status string, answerable boolean, generation_method string"
    item = lambda i, q="q": (i, q, "a", "approved", True, "synthetic")
    items = spark.createDataFrame([item("1"), item("2"), item("3")], fields)
    run = lambda *rows: spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], fields + ", pos int")
    wanted = spark.createDataFrame([("1", 0, True), ("2", 1, True), ("3", 2, False)], "id string, pos int, attempted boolean")
    faults = lambda attempts: {tuple(r) for r in evaluate.saved_run_faults(attempts, items, wanted).collect()}
    assert faults(run(item("1"), item("2"))) == set()
    assert faults(run(item("1"), item("2", "other"))) == {("2", "differs from its item")}
    assert faults(run(item("2"), item("1"))) == {("1", "not as selected"), ("2", "not as selected")}
    assert ("1", "repeated") in faults(run(item("1"), item("1"))) and ("x", "unknown") in faults(run(item("1"), item("x")))


def test_provenance_and_smoke(spark):
    fields = "passage_id string, key string, version string, page int, article string, url string, text string"
    now = spark.createDataFrame([("p", "k", "v", 1, None, "u", "t"), ("q", "k", "v", 2, "3", "u", "t")], fields)
    then = spark.createDataFrame([("i", "p", "k", "v", 1, None, "u", "t"), ("i", "q", "k", "v", 2, None, "u", "t"), ("j", "gone", "k", "v", 1, None, "u", "t")], "id string, " + fields)
    got = {tuple(r) for r in evaluate.provenance_faults(then, now).collect()}
    assert got == {("i", "q", "provenance differs"), ("j", "gone", "unknown passage")}
    hits = spark.createDataFrame([(1, 1, "a", "rules", "x" * 600), (1, 2, "b", "fees", "y")], "query_id int, rank int, id string, family string, text string")
    asked = spark.createDataFrame([(1, "fees"), (2, "rules")], "query_id int, family string")
    rows = {r.query_id: r for r in evaluate.smoke(asked, hits).collect()}
    assert rows[1].family_found and len(rows[1].hits[0].preview) == 500 and not rows[2].family_found and rows[2].hits is None


def test_labels_of_sources(spark):
    kind = "array<struct<title:string,section:string,page:int,article:string,url:string>>"
    rows = [(1, [("T", None, 3, "7", "https://h/a"), ("T", None, 3, "7", "https://h/a"), ("W", "Head", None, None, None)]), (2, []), (3, [("T", "", 0, "", "")])]
    got = {r.i: r.s for r in spark.createDataFrame(rows, f"i int, p {kind}").select("i", answers.source_labels(F.col("p")).alias("s")).collect()}
    assert got == {1: ["[T — page 3, article 7](https://h/a)", "W — Head"], 2: [answers.NO_SOURCES], 3: ["T"]}
    docs = spark.createDataFrame([("d", "T", "https://h/a.pdf", False), ("w", "W", "https://h/w", True)], "source_id string, title string, url string, is_web boolean")
    held = spark.createDataFrame([("p1", "d", "v", 2, "4", None, "t"), ("p2", "w", "v", 1, None, "Head", "t")], "id string, source_id string, version string, page int, article string, section string, text string")
    got = {r.source_id: r for r in answers.supporting(docs, held).collect()}
    assert got["p1"].url == "https://h/a.pdf#page=2" and got["p1"].page == 2 and got["p2"].page is None and got["p2"].section == "Head"
    assert answers.fixed_only(docs).count() == 1


def test_vectors_match_brute_force_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    x, q = rng.integers(-3, 4, (700, 6)).astype(float), rng.integers(-3, 4, (10_000, 6)).astype(float)
    odd = [(9000, None), (9001, [0.0] * 6), (9002, [float("nan")] * 6), (9003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (9004, [1.0, 2.0]), (9005, [float("inf")] * 6)]
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(20_000 + i, v) for i, v in odd], "query_id long, embedding array<float>")
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 400_000)
    monkeypatch.setattr(retrieve, "STRIP", 100_000)
    found = retrieve.vector_top(asked, held, 4, digits=9)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1), 1e-300)[:, None]
    score = np.round(unit(q) @ unit(x).T, 9)
    usable = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
    for i in range(0, len(q), 97):
        want = [] if not q[i].any() else sorted(usable.tolist(), key=lambda j: (-score[i, j], j))[:4]
        assert [k for _, k in sorted(got.get(i, []))] == want
    assert got[29_004] == [(1, 9004)] and not set(got) & {29_000, 29_001, 29_002, 29_003, 29_005}
    assert retrieve.vector_top(asked.limit(0), held).count() == 0 and retrieve.vector_top(asked.limit(5), held.limit(0)).count() == 0


def test_rankings_return_few_rows_per_task(spark, monkeypatch):
    """What a window sorts is the best of each task, not every pair; ties go by place, over strips and tasks."""
    asked = spark.createDataFrame([(q, f"red fox {'2024' if q == 2 else ''} word{q}") for q in range(3)], "query_id int, question string")
    held = spark.range(300).selectExpr("concat('p', lpad(id, 3, '0')) as id", "300 - id as pos", "concat('head ', if(id % 2 = 0, '2024', '2023')) as heading", "concat('red fox runs ', if(id % 100 = 7, 'word1 word2', '')) as text").repartition(3)
    plain, seen = retrieve.best, []
    monkeypatch.setattr(retrieve, "best", lambda scored, *more: (seen.append(scored.count()), plain(scored, *more))[1])
    whole = [sorted(map(tuple, f(asked, held, 4).collect())) for f in (retrieve.keyword_top, retrieve.lexical_top, retrieve.fresh_top)]
    assert max(seen) <= 3 * 3 * 4
    assert [r[2] for r in whole[0] if r[0] == 1] == ["p207", "p107", "p007", "p299"] and [r[2] for r in whole[0] if r[0] == 0] == ["p299", "p298", "p297", "p296"]
    assert [r[2] for r in whole[1] if r[0] == 1] == ["p007", "p107", "p207", "p000"] and [r[2] for r in whole[2] if r[0] == 2] == ["p000", "p002", "p004", "p006"]
    monkeypatch.setattr(retrieve, "OVERLAPS", 21)
    monkeypatch.setattr(retrieve, "MEETINGS", 2)
    assert [sorted(map(tuple, f(asked, held, 4).collect())) for f in (retrieve.keyword_top, retrieve.lexical_top, retrieve.fresh_top)] == whole
    assert retrieve.fresh_top(asked.limit(0), held).count() == 0 and retrieve.keyword_top(asked, held.limit(0)).count() == 0
