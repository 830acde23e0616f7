"""What is read, embedded and compared no more often than needed."""

import difflib
import random

import pandas as pd
from pyspark.sql import functions as F

from evidentia.operators import overlap
from evidentia.operators.snapshot import Snapshots


def _corpus(spark):
    docs = spark.range(40).select(F.lpad(F.hex("id"), 4, "0").alias("source_id"), F.lit("v").alias("version"))
    pages = docs.select("source_id", F.lit(1).alias("page"), F.lit("text").alias("text"))
    gone = F.lit(None).cast("string")
    cut = docs.select(F.reverse("source_id").alias("id"), "source_id", "version", F.lit(1).alias("page"), F.lit(0).alias("start"), F.lit(4).alias("end"), gone.alias("article"), gone.alias("section"), F.lit("text").alias("text"))
    return docs, pages, cut


def test_every_passage_is_embedded_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        asked.add(len(text))
        return text.map(lambda t: [1.0, float(len(t))])

    held = Snapshots(spark, f"file://{tmp_path}", embed, {"dimensions": 2})
    assert held.index("c", *_corpus(spark))["embedded"] == 40 and asked.value == 40
    found = held.audit("c", *_corpus(spark))
    assert {r.n for r in found.collect()} == {0} and found.count() == 11
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4  # a pair of tables meets once


def test_texts_of_the_same_signs_are_told_apart_without_comparing(monkeypatch):
    rng, words = random.Random(5), [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    texts = [" ".join(rng.sample(words, 12)) for _ in range(80)] + [" ".join(sorted(words[:40])), " ".join(sorted(words[:40])) + " end"]
    rows = pd.DataFrame({"id": range(len(texts)), "text": texts, "side": 2})
    compared, plain = [], difflib.SequenceMatcher
    monkeypatch.setattr(overlap.difflib, "SequenceMatcher", lambda j, a, b: compared.append(1) or plain(j, a, b))
    got = overlap._close(0.88)(rows)
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if plain(None, texts[i], texts[j]).ratio() >= 0.88]
    assert list(zip(got["a"], got["b"], strict=True)) == want and (80, 81) in want and len(compared) <= 2


def test_what_is_used_more_than_once_is_made_once(spark):
    """Rules and pairs read stored rows: each use of passages or first lines used to cut or normalize all documents again."""
    from evidentia.plans import queries

    for query, n in ((queries.corpus_violations, 0), (queries.near_questions, None)):
        found = query(spark, "/root/testdata/sf0.001")
        assert found.inputFiles() and not [f for f in found.inputFiles() if "/root/testdata" in f]
        assert n is None or found.count() == n
