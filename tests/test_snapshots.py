"""Readers of snapshots: pinned versions, finding, fetching, scrolling, damage."""

import uuid

import pytest
from pyspark.sql import functions as F

from evidentia.operators import runs
from evidentia.operators.snapshot import Snapshots, SnapshotMoved

PROFILE = {"model": "length", "dimensions": 2}


def embed(c):
    return F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))


def corpus(spark, n, mark=""):
    ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, str(i))) for i in range(n)]
    documents = spark.createDataFrame([(i, "t" + mark, "v") for i in ids], "source_id string, title string, version string")
    pages = spark.createDataFrame([(i, 1, f"text {'x' * k}{mark}") for k, i in enumerate(ids)], "source_id string, page int, text string")
    rows = [(i, i, "v", 1, 0, len(f"text {'x' * k}{mark}"), None if k % 2 else "5", None, f"text {'x' * k}{mark}") for k, i in enumerate(ids)]
    return documents, pages, spark.createDataFrame(rows, "id string, source_id string, version string, page int, start int, end int, article string, section string, text string"), ids


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}", embed, PROFILE)


def test_a_pinned_reader_notices_another_snapshot(spark, store):
    *one, ids = corpus(spark, 12)
    *two, _ = corpus(spark, 12, "!")
    store.index("c", *one)
    with store.pin("c") as reader:
        before = reader.find(id=ids[3]).first().text
        reader.check()
    with pytest.raises(SnapshotMoved), store.pin("c") as reader:
        store.index("c", *two)
        assert store.vacuum() == []  # the lease holds it
        assert reader.find(id=ids[3]).first().text == before and reader.count() == 12
    assert store.pin("c").find(id=ids[3]).first().text == before + "!"
    assert store.vacuum() == [reader.snapshot_id] and store.complete(store.active("c"))
    with pytest.raises(ValueError, match="no snapshot"):
        store.pin("other")


def test_a_run_stops_if_another_snapshot_is_published(spark, store, tmp_path):
    *one, _ = corpus(spark, 4)
    *two, _ = corpus(spark, 4, "!")
    store.index("c", *one)
    reader = store.pin("c")
    items = spark.createDataFrame([(f"i{k}", k, "approved") for k in range(4)], "id string, pos long, review_status string")
    run = runs.Run(spark, str(tmp_path / "run"), items, batch=2)

    def answer(some):
        if some.where("id = 'i0'").count():
            store.index("c", *two)
        return some.select("id", F.lit(None).cast("string").alias("error"))

    with pytest.raises(SnapshotMoved):
        run.go(reader.guarded(answer))
    assert run.attempts().count() == 2


def test_required_corpus(spark, store):
    documents, pages, passages, _ = corpus(spark, 3)
    with pytest.raises(ValueError):
        store.require_published("c", documents, passages)
    store.index("c", documents, pages, passages)
    assert store.require_published("c", documents, passages.orderBy(F.desc("id")))["passages"] == 3
    with pytest.raises(ValueError):
        store.require_published("c", documents, passages.where("article is null"))


def test_fetching_reads_few_files(spark, store):
    *one, ids = corpus(spark, 64)
    store.index("c", *one)
    reader = store.pin("c")
    found = reader.fetch(ids[:2])
    assert sorted(r.id for r in found.collect()) == sorted(ids[:2])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(id" in plan or "PushedFilters: [Or(" in plan
    assert len(found.inputFiles()) >= 1
    wanted = spark.createDataFrame([(i,) for i in ids[5:9] + ["unknown", None]], "id string")
    assert sorted(r.id for r in reader.fetch(wanted).collect()) == sorted(ids[5:9])
    plan = reader.fetch(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    points = [r.point_id for r in reader.find("vectors").collect()]
    assert reader.fetch(points[:3], "vectors").count() == 3 and reader.fetch([]).count() == 0
    assert reader.find(article=None).count() == 32 and reader.find(article="5", page=1).count() == 32
    assert reader.count("vectors") == reader.count("sources") == 64


@pytest.mark.parametrize("size", [1, 7, 32, 100])
def test_scrolling_meets_every_row_once(spark, store, size):
    *one, ids = corpus(spark, 32)
    store.index("c", *one)
    pages = list(store.pin("c").scroll(size=size)) if size > 1 else [next(store.pin("c").scroll(size=1, after=sorted(ids)[8]))]
    got = [r.id for p in pages for r in p]
    assert got == (sorted(ids) if size > 1 else [sorted(ids)[9]])


def test_hits_without_their_passage_are_an_error(spark, store):
    documents, pages, passages, _ = corpus(spark, 6)
    store.index("c", documents, pages, passages)
    asked = spark.createDataFrame([(1, "text xxx")], "query_id long, question string")
    assert store.search("c", asked, 3).count() == 3
    pointer = store.active("c")
    for name in ("sources", "pages", "vectors"):
        store.write("broken", name, store.table(pointer["snapshot_id"], name))
    store.write("broken", "passages", store.table(pointer["snapshot_id"], "passages").limit(0))
    store._publish("c", pointer | {"snapshot_id": "broken"})
    assert not store.complete(store.active("c"))
    with pytest.raises(Exception, match="missing or another"):
        store.search("c", asked, 3).collect()
    assert {r.finding: r.n for r in store.audit("c", documents, pages, passages).collect()}["passage_missing"] == 6
