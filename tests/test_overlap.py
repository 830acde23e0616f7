"""Contained and nearly equal texts, against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import evaluate, overlap


def words(rng, n, some):
    return [rng.choice(some) for _ in range(n)]


def contained(asked, pages):
    return sorted((i, k) for i, q in asked for k, p in pages if q and q in p)


def test_contained_texts_match_brute_force(spark):
    rng = random.Random(5)
    some = ["a", "ab", "abc", "the", "then", "other", "house", "žal", "in"]
    pages = [(k, " ".join(words(rng, rng.randint(0, 40), some))) for k in range(60)]
    asked = []
    for n in (1, 2, 3, 4, 5, 8, 12):
        for _ in range(12):
            p = rng.choice(pages)[1]
            at = rng.randrange(max(1, len(p)))
            piece = " ".join(p[at:].split()[:n])  # may begin inside of a word
            asked.append(piece[: len(piece) - rng.randint(0, 2)].strip() if rng.random() < 0.5 else " ".join(words(rng, n, some)))
    asked = list(enumerate(asked)) + [(900, ""), (901, None), (902, " .,! "), (903, "zzz")]
    got = overlap.contained(spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame([*pages, (70, None)], "key long, text string"))
    want = contained([(i, " ".join((q or "").replace(".,!", "").split())) for i, q in asked], pages)
    assert len(want) > 100 and sorted((r.id, r.key) for r in got.collect()) == want


def test_exempt_pages_and_signs(spark):
    asked = spark.createDataFrame([("1", "Kje JE knjižnica?", "k"), ("2", "je knjižnica", None)], "id string, text string, exempt string")
    pages = spark.createDataFrame([("k", "… kje, je -- Knjižnica"), ("m", "nekje je knjižnica!")], "key string, text string")
    assert sorted(map(tuple, overlap.contained(asked, pages).collect())) == [("1", "m"), ("2", "k"), ("2", "m")]
    assert overlap.contained(asked.limit(0), pages).count() == 0 and overlap.contained(asked, pages.limit(0)).count() == 0


def test_many_questions_need_no_nested_loop(spark):
    rng = random.Random(7)
    some = [f"w{i}" for i in range(3000)]
    pages = [(k, " ".join(words(rng, 200, some))) for k in range(300)]
    asked = [(i, " ".join(words(rng, 6, some))) for i in range(19_700)] + [(20_000 + k, " ".join(p.split()[50:56])) for k, p in pages]
    df = spark.createDataFrame(asked, "id long, text string")
    found = evaluate.leaked(df, spark.createDataFrame(pages, "key long, text string"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert sorted((r.id, r.key) for r in found.where("id >= 20000").collect()) == [(20_000 + k, k) for k in range(300)]


@pytest.mark.parametrize("block", [4, 1024])
def test_close_texts_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for i in range(30):
        text = " ".join("".join(rng.choices("abcdefž", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 12)))
        rows.append(text)
        for _ in range(rng.randint(0, 2)):  # signs changed, dropped and added: words in common may be none
            t = list(text)
            for _ in range(max(1, len(t) // rng.choice([6, 9, 14]))):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([["x"], [], [t[at], "y"]])
            rows.append("".join(t).strip() or "q")
    rows = [" ".join(r.split()) for r in rows]
    got = {(r.a, r.b): (r.overlap, r.ratio) for r in overlap.close(spark.createDataFrame(list(enumerate(rows)), "id long, text string"), 0.88).collect()}
    want = {}
    for j in range(len(rows)):
        for i in range(j):
            if (r := difflib.SequenceMatcher(None, rows[i], rows[j]).ratio()) >= 0.88:
                a, b = set(rows[i].split()), set(rows[j].split())
                want[i, j] = (len(a & b) / len(a | b), r)
    assert len(want) > 8 and got == want
    assert any(not v[0] for v in want.values())  # some have no word in common


def test_near_questions_by_either_measure(spark):
    rows = [(1, "where is the library of the faculty"), (2, "the faculty of the library is where"), (3, "wherever iss thee libraryy off thee facultyy"), (4, "where is the library of the faculties"), (5, "..."), (6, None)]
    items = spark.createDataFrame(rows, "id long, text string")
    got = {(r.a, r.b): (r.overlap, r.ratio) for r in evaluate.near_questions(items).collect()}
    assert set(got) == {(1, 2), (1, 4), (1, 3)} | {p for p in got if p == (3, 4)}
    assert got[1, 2][0] == 1 and got[1, 2][1] < 0.88 and got[1, 3][0] == 0 and got[1, 3][1] >= 0.88
    assert {(r.a, r.b) for r in evaluate.near_questions(items, ratio=None).collect()} == {(1, 2)}
    assert evaluate.near_questions(items.limit(0)).count() == 0


def test_alike_sets_match_brute_force(spark):
    rng = random.Random(2)
    sets = [sorted(set(words(rng, rng.randint(1, 14), "abcdefghijkl"))) for _ in range(120)]
    sets += [sorted({*s, "zz"}) for s in sets[:20]]
    got = {(r.a, r.b): r.overlap for r in overlap.alike(spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>"), 0.85).collect()}
    want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for j, y in enumerate(sets) for i, x in enumerate(sets[:j])}
    assert got == {k: v for k, v in want.items() if v >= 0.85} and len(got) > 5


def test_pages_are_looked_through_for_first_words_alone(spark, monkeypatch):
    """Only runs that start as an anchor does become rows; more first words than a set may have give the same."""
    questions = spark.createDataFrame([(1, "what red fox runs far"), (2, "the red owl sleeps"), (3, "one owl only")], "id long, text string")
    pages = spark.createDataFrame([(7, "Say: what red fox runs far, the red owl sleeps " + "deep green wood " * 50), (8, "one owl only"), (9, "the red owl sleep")], "key long, text string")
    plain, leads = overlap._grams, []
    monkeypatch.setattr(overlap, "_grams", lambda *args, **more: (leads.append(more.get("lead")), plain(*args, **more))[1])
    found = sorted(map(tuple, overlap.contained(questions, pages).collect()))
    assert found == [(1, 7), (2, 7), (3, 8)]
    assert any(leads) and {w for lead in leads if lead for w in lead} <= {"red", "owl"}
    monkeypatch.setattr(overlap, "MAX_LEADS", 0)
    assert sorted(map(tuple, overlap.contained(questions, pages).collect())) == found


def test_common_signs_of_many_texts_at_once():
    rng = random.Random(5)
    said = lambda n: "".join(rng.choice("ab cé😀") for _ in range(n))
    texts = [said(rng.randrange(200)) for _ in range(60)] + ["", "a", "a" * 7, "b" * 8, "c" * 64, "x" * 9]
    for b in ("", "a", "aaaaaaaaaa", "y", said(150)):
        assert T.longest_common_of([(len(t), T.sign_places(t)) for t in texts], b) == [T.longest_common(t, b) for t in texts]


def test_close_texts_of_all_lengths_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 16)
    monkeypatch.setattr(overlap, "LANES", 256)
    monkeypatch.setattr(overlap, "KEPT", 4096)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices(("en", "er", "ti", "on", "é", "😀"), k=rng.randint(1, 4))) for _ in range(n)) for n in (3, 10, 40, 45, 90, 95, 100) for _ in range(4)]
    for t in texts[:]:
        for share in (0.03, 0.1, 0.2):
            texts.append("".join(rng.choice("enr x") if rng.random() < share else s for s in t))
    got = {(r.a, r.b): r.ratio for r in overlap.close(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.88).collect()}
    want = {(i, j): r for j in range(len(texts)) for i in range(j) if (r := difflib.SequenceMatcher(None, texts[i], texts[j]).ratio()) >= 0.88}
    assert got == want and len(want) > 20
