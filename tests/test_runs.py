"""Runs: stops at the first failure, exactly one attempt each, running sums without one partition."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import runs

ITEM = "id string, pos long, question string, review_status string, generation_method string, answerable boolean"


def items(spark, n, broken=()):
    rows = [(f"i{k:03}", k * 3, "bad" if k in broken else f"q{k}", "approved" if k % 2 else "unreviewed", "synthetic", k % 4 != 0) for k in range(n)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, ITEM)


def answer(calls):
    def told(some):
        calls.append(sorted(r.id for r in some.select("id").collect()))
        return some.select("id", "generation_method", "review_status", "answerable", F.length("question").alias("score"), F.when(F.col("question") == "bad", "ValidationError").alias("error"))

    return told


def test_stops_at_the_first_failure(spark, tmp_path):
    run, calls = runs.Run(spark, str(tmp_path / "r"), items(spark, 23, {9, 11, 20}), {"mode": "x"}, batch=4), []
    rows = sorted(run.go(answer(calls)).collect(), key=lambda r: r.at)
    assert [r.id for r in rows] == [f"i{k:03}" for k in range(10)]
    assert [r.error for r in rows] == [None] * 9 + ["ValidationError"]
    assert len(calls) == 3  # later batches were never asked
    assert sorted((r.id, r.at) for r in run.unattempted().collect()) == [(f"i{k:03}", k) for k in range(10, 23)]
    assert run.go(answer(calls)).count() == 10 and len(calls) == 3
    lines = [json.loads(x) for p in (tmp_path / "r/attempts").glob("*/*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 10 and all("error" in x for x in lines)
    total = {(r.origin, r.review, r.answerable): (r.n, r.errors) for r in run.summary(["score"]).collect()}
    assert total[None, None, None] == (10, 1) and total[None, "reviewed", None] == (5, 1)


def test_a_killed_run_resumes_to_the_same_rows(spark, tmp_path):
    whole = runs.Run(spark, str(tmp_path / "a"), items(spark, 17), batch=5)
    want = sorted(map(tuple, whole.go(answer([])).collect()))
    run, calls = runs.Run(spark, str(tmp_path / "b"), items(spark, 17), batch=5), []

    def dies(some):
        if len(calls) == 2:
            raise KeyboardInterrupt
        return answer(calls)(some)

    with pytest.raises(KeyboardInterrupt):
        run.go(dies)
    (tmp_path / "b/drafts/left").mkdir()  # what a killed run may leave
    again, more = runs.Run(spark, str(tmp_path / "b"), items(spark, 17), batch=99), []
    assert sorted(map(tuple, again.go(answer(more)).collect())) == want
    assert sorted(sum(calls + more, [])) == [f"i{k:03}" for k in range(17)]  # each was asked once


def test_two_runs_at_once_keep_one_batch_each(spark, tmp_path):
    one, two = (runs.Run(spark, str(tmp_path / "r"), items(spark, 6), batch=3) for _ in range(2))

    def races(some):
        if not one.files.names("attempts"):
            two.go(answer([]))
        return answer([])(some)

    assert one.go(races).count() == 6
    assert sorted(r.id for r in two.attempts().collect()) == [f"i{k:03}" for k in range(6)]


def test_refusals(spark, tmp_path):
    good = items(spark, 3)
    for bad in (good.limit(0), good.union(good), good.withColumn("review_status", F.lit("rejected")), good.withColumn("review_status", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            runs.Run(spark, str(tmp_path / "bad"), bad)
    run = runs.Run(spark, str(tmp_path / "r"), good)
    with pytest.raises(ValueError, match="other items"):
        runs.Run(spark, str(tmp_path / "r"), items(spark, 4))
    with pytest.raises(ValueError, match="yet"):
        run.attempts()
    with pytest.raises(ValueError, match="twice"):
        run.go(lambda some: answer([])(some).union(answer([])(some)))
    some = run.go(lambda asked: answer([])(asked).where("id <> 'i001'")).collect()
    assert [(r.id, r.error) for r in sorted(some, key=lambda r: r.at)] == [("i000", None), ("i001", "no answer")]


@pytest.mark.parametrize("ranges", [1, 8, 40])
def test_running_sums(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.randrange(50) if k % 11 else None, k, rng.choice([None, 1, 2, 30]), float(k % 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, v long, w double").repartition(7)
    out = runs.running(df, ["a", "b"], ["v", "w"], ranges)
    got = {r.b: (r.cumulative_v, r.cumulative_w) for r in out.collect()}
    v = w = 0
    for _, b, x, y in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        v, w = v + (x or 0), w + y
        assert got[b] == (v, w)
    if ranges == 8:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        over = [x for x in plan.splitlines() if "Window" in x and "_range" in x.split("]")[-2]]
        assert over  # rows are partitioned by their range; only the sums of ranges are not
    assert runs.running(df.limit(0), ["a"], ["v"], ranges).count() == 0


def test_until_failure(spark):
    df = spark.createDataFrame([(3, None), (1, None), (2, "x"), (5, "y")], "pos long, error string")
    assert sorted(r.pos for r in runs.until_failure(df).collect()) == [1, 2]
    assert runs.until_failure(df.where("error is null")).count() == 2
