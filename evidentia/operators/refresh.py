"""What changed between two captures of a corpus, and reports on fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a document that don't count as a change.
BOOKKEEPING = ("prepared_at", "local_path", "review_status", "retrieved_at", "captured_at")


def comparable(documents: DataFrame, key: str = "key", ignored: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    """(key, digest) of what a document says, without bookkeeping.

    A web document's file hash doesn't count either: scripts around its text change by the hour.
    """
    columns = sorted(c for c in documents.columns if c != key and c not in ignored)
    if "is_web" in columns and "content_sha256" in columns:
        documents = documents.withColumn("content_sha256", F.when(~F.col("is_web"), F.col("content_sha256")))
    return documents.select(F.col(key).alias("key"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("digest"))


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(key, status) for (key, digest) tables: added, removed, changed or unchanged."""
    a, b = previous.select("key", F.col("digest").alias("_old")), current.select("key", F.col("digest").alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, "key", "full").select("key", status.alias("status"))


def report(changes: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """One row: counts by status and whether an index has to be rebuilt.

    ``statistics(key, ...)`` of the current capture, such as characters, pages and passages by
    key, are summed up as ``total_<name>``, and over what was added or changed as ``new_<name>``.
    """
    counts = changes.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "unchanged", "removed", "failed")), F.bool_or(F.col("status").isin("added", "changed", "removed")).alias("index_update_required"))
    counts = counts.withColumn("index_update_required", F.coalesce("index_update_required", F.lit(False)))
    if statistics is None:
        return counts
    names = [c for c in statistics.columns if c != "key"]
    fresh = F.col("status").isin("added", "changed")
    rows = statistics.join(changes.select("key", "status"), "key", "left")
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in names), *(F.coalesce(F.sum(F.when(fresh, F.col(c))), F.lit(0)).alias(f"new_{c}") for c in names))
    return counts.withColumn("_one", F.lit(1)).join(sums.withColumn("_one", F.lit(1)), "_one").drop("_one")


def first_of(*inventories: DataFrame, key: str = "url") -> DataFrame:
    """Union of inventories in which an address belongs to the first that lists it."""
    from pyspark.sql.window import Window

    rows = None
    for i, df in enumerate(inventories):
        one = df.withColumn("_source", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    order = [F.asc("_source"), *([F.asc("pos")] if "pos" in rows.columns else [])]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n", "_source")


def latest_version(files: DataFrame) -> DataFrame:
    """Per document the file of the highest number in ``NPB n``: ``files(key, label, url)``."""
    n = F.regexp_extract("label", r"NPB\s*([0-9]+)", 1)
    return files.where(n != "").groupBy("key").agg(F.max_by("url", n.cast("int")).alias("url"), F.max(n.cast("int")).alias("version"))


def redirects(starts: DataFrame, hops: DataFrame, hosts: list[str], most: int = 3) -> DataFrame:
    """Where addresses lead over a table of redirects ``hops(url, target)``, within ``most`` steps.

    Every step has to stay on an allowed host.  Returns ``url, final, hops, error``.
    """
    from evidentia.functions.identity import allowed_url

    rows = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"), F.when(~allowed_url(F.col("url"), hosts), "address not allowed").alias("error"))
    for _ in range(most + 1):
        step = hops.select(F.col("url").alias("_from"), F.col("target").alias("_to"))
        rows = rows.join(step, (rows["final"] == step["_from"]) & rows["error"].isNull(), "left")
        moved = F.col("_to").isNotNull()
        bad = F.when(F.col("hops") >= most, "too many redirects").when(~allowed_url(F.col("_to"), hosts), "redirect not allowed")
        rows = rows.select("url", F.when(moved & bad.isNull(), F.col("_to")).otherwise(F.col("final")).alias("final"), (F.col("hops") + (moved & bad.isNull()).cast("int")).alias("hops"), F.when(moved, F.coalesce("error", bad)).otherwise(F.col("error")).alias("error"))
    return rows
