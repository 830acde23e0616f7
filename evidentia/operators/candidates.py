"""Refreshed corpora as candidates: in force only if every source came through.

A refresh writes its tables and its report into a folder of its own.  Only if none of its sources
failed and none is missing does the corpus's pointer move there, by one atomic replacement; a
failed refresh leaves its report for diagnosis and the old candidate in force.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import refresh
from evidentia.sources.files import Files

#: Sources of a refresh at most (a fixed value of the manifest's format).
MOST_SOURCES = 50


def inventory_faults(sources: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """(fault, key) of a refresh's sources ``(key, url[, base, format])``: too many, repeated keys or addresses, base sources that aren't PDFs."""
    n = sources.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit("too many sources").alias("fault"), F.lit(None).cast("string").alias("key"))
    for column, fault in (("key", "duplicate key"), ("url", "duplicate address")):
        twice = sources.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).where("n > 1") if column != "key" else sources.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        n = n.unionByName(twice.select(F.lit(fault).alias("fault"), F.col("key").cast("string").alias("key")))
    if {"base", "format"} <= set(sources.columns):
        n = n.unionByName(sources.where("base and format <> 'pdf'").select(F.lit("base source is no PDF").alias("fault"), F.col("key").cast("string").alias("key")))
    return n


def outcome_rows(sources: DataFrame, outcomes: DataFrame, before: DataFrame | None, documents: DataFrame) -> DataFrame:
    """(key, status, error) of every source: failed, or added, changed or unchanged; and what was removed.

    ``outcomes(key, error)``; a source without an outcome failed as well.  Changes are those of
    ``refresh.comparable`` documents, so bookkeeping alone is none.
    """
    now = refresh.comparable(documents)
    old = refresh.comparable(before) if before is not None else now.limit(0)
    changes = refresh.diff(old, now)
    met = sources.select("key").join(outcomes.select("key", "error", F.lit(True).alias("_met")), "key", "left").join(changes.withColumnRenamed("status", "_change"), "key", "left")
    error = F.when(F.col("_met").isNull(), "no outcome").when(F.col("error").isNotNull(), F.col("error")).when(F.col("_change").isNull() | (F.col("_change") == "removed"), "no document")
    rows = met.select("key", F.when(error.isNotNull(), "failed").otherwise(F.col("_change")).alias("status"), error.alias("error"))
    gone = old.select("key").join(sources.select("key"), "key", "left_anti").select("key", F.lit("removed").alias("status"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(gone)


class Candidates:
    """Candidates under a folder: ``staged/<refresh>/<table>`` never changes, ``current/<corpus>`` points."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def current(self, corpus_id: str) -> dict | None:
        at = f"current/{corpus_id}"
        return json.loads(self.files.text(at)) if self.files.exists(at) else None

    def table(self, corpus_id: str, name: str) -> DataFrame:
        """``documents``, ``pages``, ``passages`` or ``report`` of the candidate in force."""
        pointer = self.current(corpus_id)
        if pointer is None:
            raise ValueError("no refresh of this corpus came through yet")
        return self.spark.read.parquet(f"{self.root}/staged/{pointer['refresh']}/{name}")

    def report(self, refresh_id: str) -> DataFrame:
        """(key, status, error) of any refresh, failed ones included."""
        return self.spark.read.parquet(f"{self.root}/staged/{refresh_id}/report")

    def stage(self, corpus_id: str, sources: DataFrame, outcomes: DataFrame, documents: DataFrame, pages: DataFrame, passages: DataFrame) -> dict:
        """Write a refresh and, if all of its sources came through, put it in force.

        ``sources(key, url, ...)``, ``outcomes(key, error)``, ``documents(key, ...)``.  Faulty
        source lists are refused before anything is written.
        """
        faults = inventory_faults(sources).limit(1).collect()
        if faults:
            raise ValueError(f"{faults[0].key}: {faults[0].fault}")
        refresh_id = uuid.uuid4().hex
        at = f"{self.root}/staged/{refresh_id}"
        documents.write.parquet(f"{at}/documents")
        kept = self.spark.read.parquet(f"{at}/documents")
        before = self.table(corpus_id, "documents") if self.current(corpus_id) else None
        outcome_rows(sources, outcomes, before, kept).write.parquet(f"{at}/report")
        counts = {r.status: r.n for r in self.report(refresh_id).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        told = {"corpus_id": corpus_id, "refresh": refresh_id, "counts": counts}
        if counts.get("failed"):
            return told | {"status": "failed"}
        pages.write.parquet(f"{at}/pages")
        passages.write.parquet(f"{at}/passages")
        self.files.put(f"current/{corpus_id}", json.dumps(told), f"current/.{corpus_id}-{uuid.uuid4().hex}", replace=True)
        return told | {"status": "candidate"}
