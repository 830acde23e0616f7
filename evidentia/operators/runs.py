"""Evaluation runs: items asked in order up to the first failure, in a log that resumes exactly once.

A run is a folder.  Its items, numbered in order, are written first; answers are computed for a
batch of numbers at a time, as one Spark job each, and a batch becomes part of the log by one
rename that never overwrites.  A killed run leaves at most a draft that nobody reads, and the next
one goes on with the first batch that is missing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from evidentia.functions import text as T
from evidentia.operators import evaluate
from evidentia.sources.files import Files

#: Items of a batch of the log.
BATCH = 10_000
#: Review states of items that may be asked.
ELIGIBLE = ("unreviewed", "approved")


def until_failure(attempts: DataFrame, order: str = "pos", error: str = "error") -> DataFrame:
    """Attempts up to and with the first, by ``order``, that failed.

    The least failing place is one number, found map-side; no row is sorted or moved for it.
    """
    stop = attempts.where(F.col(error).isNotNull()).select(F.min(order)).scalar()
    return attempts.where(F.coalesce(F.col(order) <= stop, F.lit(True)))


def running(rows: DataFrame, order: list[str], columns: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``cumulative_<column>``: running sums in a global order, nulls as nothing.

    The order's first column, a number, is split into ``ranges`` of equal depth (as many as there
    are shuffle partitions); each range sums up within itself and adds what stands in those before
    it, a row per range.  Rows are moved once.  The order should be unique: equal rows follow each
    other in any order.
    """
    n = ranges or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lead = F.col(order[0])
    shares = [i / n for i in range(1, n)]
    edges = (rows.agg(F.percentile_approx(lead, F.array(*map(F.lit, shares)), 100 * n)).first()[0] if shares else []) or []
    edges = sorted(set(edges))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= lead)) if edges else F.lit(0)
    rows = rows.withColumn("_range", F.when(lead.isNull(), -1).otherwise(at))  # nulls come first, as Spark sorts
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = rows.groupBy("_range").agg(*(F.sum(value(c)).alias(f"_{c}") for c in columns))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    offsets = sums.select("_range", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({f"cumulative_{c}": F.sum(value(c)).over(within) for c in columns})
    joined = summed.join(F.broadcast(offsets), "_range")
    return joined.withColumns({f"cumulative_{c}": F.col(f"cumulative_{c}") + F.col(f"_{c}") for c in columns}).drop("_range", *(f"_{c}" for c in columns))


def attempted(items: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """A row per item with what was retrieved and answered, its scores and a digest of the answer.

    ``items(id, question, expected_answer, answerable, expected_status, source_ids, groups, ...)``,
    ``hits(id, rank, passage_id)``, ``answers(id, status, response, cited, error, ...)``.  An item
    without an answer has the error ``no answer``.
    """
    none = F.expr("cast(array() as array<string>)")
    found = hits.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))), lambda x: x["passage_id"].cast("string")).alias("ranked"))
    said = answers.withColumn("_said", F.lit(True))
    rows = items.join(found, "id", "left").join(said, "id", "left")
    rows = rows.withColumns(
        {
            "ranked": F.coalesce("ranked", none),
            "required": F.col("source_ids"),
            "cited": F.coalesce("cited", none),
            "response": F.coalesce("response", F.lit("")),
            "error": F.when(F.col("_said").isNull(), "no answer").otherwise(F.col("error")),
        }
    ).drop("_said")
    scored = evaluate.answer_scores(evaluate.retrieval_scores(rows)).drop("required")
    answer = F.to_json(F.struct("status", "response", "cited"), {"ignoreNullFields": "false"})
    return scored.withColumn("response_sha256", F.sha2(T.canonical_json(F.when(F.col("error").isNull(), answer).otherwise(F.lit("null"))), 256))


class Run:
    """A run under a folder: ``metadata.json``, ``items``, and ``attempts/<batch>`` in JSON lines.

    Opening a folder that holds a run resumes it, if it is of the same items; metadata stay those
    of the beginning.
    """

    def __init__(self, spark: SparkSession, root: str, items: DataFrame, metadata: dict | None = None, batch: int = BATCH):
        if batch < 1:
            raise ValueError("a batch holds an item at least")
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        digest = self._digest(items)
        if not self.files.exists("metadata.json"):
            self._check(items)
            draft = f"drafts/{uuid.uuid4().hex}"
            numbered = running(items.withColumn("at", F.lit(1).cast("long")), ["pos", "id"], ["at"])
            numbered = numbered.withColumn("at", F.col("cumulative_at") - 1).drop("cumulative_at")
            numbered.write.parquet(f"{self.root}/{draft}")
            if not self.files.move(draft, "items") and self._digest(self.items().drop("at")) != digest:
                raise ValueError("the folder was begun with other items")
            about = {"metadata": metadata or {}, "items_sha256": digest, "n_items": self.items().count(), "batch": batch}
            self.files.put("metadata.json", json.dumps(about, ensure_ascii=False), f"drafts/{uuid.uuid4().hex}")
        self.about = json.loads(self.files.text("metadata.json"))
        if self.about["items_sha256"] != digest:
            raise ValueError("the folder holds a run of other items")

    @staticmethod
    def _digest(items: DataFrame) -> str:
        """A digest of the items whatever their order: hashes summed up map-side."""
        line = F.sha2(F.to_json(F.struct(*sorted(items.columns))), 256)
        part = lambda i: F.conv(F.substring("h", 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")
        sums = items.select(line.alias("h")).agg(F.count(F.lit(1)), *(F.sum(part(i)) for i in range(4))).first()
        return hashlib.sha256(json.dumps([str(s) for s in sums]).encode()).hexdigest()

    @staticmethod
    def _check(items: DataFrame) -> None:
        if not items.limit(1).count():
            raise ValueError("a run asks one item at least")
        if items.where(~F.coalesce(F.col("review_status").isin(*ELIGIBLE), F.lit(False))).limit(1).count():
            raise ValueError("an item isn't eligible")
        if items.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("an item comes twice")

    def items(self) -> DataFrame:
        """The items with their numbers ``at``, from 0."""
        return self.spark.read.parquet(f"{self.root}/items")

    def _batches(self) -> list[str]:
        return self.files.names("attempts")

    def failed(self) -> bool:
        """Whether the log ends in a failure: only its last batch can hold one."""
        done = self._batches()
        return bool(done) and self._read(done[-1:]).where(F.col("error").isNotNull()).limit(1).count() > 0

    def _read(self, names: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.files.text("schema.json")))
        return self.spark.read.schema(schema).json([f"{self.root}/attempts/{n}" for n in names])

    def attempts(self) -> DataFrame:
        """The log: a row per item that was asked, each once."""
        done = self._batches()
        if not done:
            raise ValueError("nothing was attempted yet")
        return self._read(done)

    def go(self, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Ask what isn't in the log yet, batch by batch, until a failure; the whole log.

        ``answer`` turns items into rows with their ``id``, one each, and an ``error`` that is
        null unless the attempt failed.  Items it has no row for failed as well.
        """
        size, n = self.about["batch"], self.about["n_items"]
        for k in range(len(self._batches()), -(-n // size)):
            if self.failed():
                break
            asked = self.items().where((F.col("at") >= k * size) & (F.col("at") < (k + 1) * size))
            draft = f"drafts/{uuid.uuid4().hex}"
            told = answer(asked.drop("at")).withColumn("_told", F.lit(True))
            rows = asked.select("id", "at").join(told, "id", "left")
            rows = rows.withColumn("error", F.when(F.col("_told").isNull(), "no answer").otherwise(F.col("error"))).drop("_told")
            rows.write.parquet(f"{self.root}/{draft}/all")  # answers are asked for once, whatever is read of them below
            known = self.spark.read.parquet(f"{self.root}/{draft}/all")
            if known.count() != known.select("id").distinct().count():
                raise ValueError("an item was answered twice")
            if not self.files.exists("schema.json"):
                self.files.put("schema.json", known.schema.json(), f"{draft}/schema.json")
            until_failure(known, "at").sortWithinPartitions("at").write.option("ignoreNullFields", False).json(f"{self.root}/{draft}/kept")
            self.files.move(f"{draft}/kept", f"attempts/{k:08d}")  # if another run was faster, its batch is the log's
            self.files.delete(draft)
        return self.attempts()

    def unattempted(self) -> DataFrame:
        """Items that were not asked, in (id, at)."""
        return self.items().join(self.attempts().select("id"), "id", "left_anti").select("id", "at")

    def summary(self, metrics: list[str]) -> DataFrame:
        """Counts and means of all attempts, by origin, by review state and by answerability."""
        rows = self.attempts().withColumns({"origin": evaluate.origin(F.col("generation_method")), "review": evaluate.review_state(F.col("review_status"))})
        return evaluate.summarize(rows, metrics, [["origin"], ["review"], ["answerable"], []])
