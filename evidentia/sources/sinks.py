"""Writers: artefacts that appear whole or not at all, and small reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.files import Files


def _hadoop(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write beside ``path`` and move into place: readers see the old table, for a moment none, then the new one.

    A table that always has to be readable is published by a pointer: see ``publish``.
    """
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    df.write.format(form).save(draft)
    target, fs = _hadoop(df, path)
    new, _ = _hadoop(df, draft)
    old, _ = _hadoop(df, f"{draft}-old")
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def publish(df: DataFrame, root: str, form: str = "parquet", keep: int = 2) -> str:
    """Write a new version below ``root`` and point to it: readers always have a whole table.

    The pointer is one small file, replaced by one rename.  Of older versions the ``keep`` - 1
    newest stay for readers that have begun.  Returns the version's name.
    """
    files = Files(df.sparkSession, root)
    drafts = [int(n[1:]) for n in files.names("versions") if n[1:].isdigit()]
    name = f"v{max(drafts, default=0) + 1:012d}"
    df.write.format(form).mode("errorifexists").save(f"{root}/versions/{name}")  # two writers of one number: the later fails
    files.put("current", name, f"current.{uuid.uuid4().hex}", replace=True)
    for old in sorted(n for n in files.names("versions") if n < name)[: -(keep - 1) or None]:
        files.delete(f"versions/{old}")
    return name


def published(spark: SparkSession, root: str, form: str = "parquet") -> DataFrame:
    """The table that the pointer names."""
    return spark.read.format(form).load(f"{root}/versions/{Files(spark, root).text('current')}")


def create(df: DataFrame, path: str, form: str = "json") -> None:
    """Write a new artefact; an existing one is never touched."""
    df.write.mode("errorifexists").format(form).save(path)


def corpus_json(documents: DataFrame, pages: DataFrame, passages: DataFrame, corpus_id: str) -> DataFrame:
    """One JSON line per document of a corpus, pages and passages nested in order."""
    p = pages.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    c = passages.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page", "start", "end", "id", "source_id", "version","article", "section", "text"))).alias("chunks"))
    rows = documents.join(p, "source_id", "left").join(c, "source_id", "left").withColumn("corpus_id", F.lit(corpus_id))
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def captures(df: DataFrame, path: str) -> DataFrame:
    """Write ``df(key, content)`` once per distinct content, named by its SHA-256; (key, sha256)."""
    named = df.withColumn("sha256", F.sha2("content", 256))
    named.groupBy("sha256").agg(F.first("content").alias("content")).write.mode("overwrite").partitionBy().parquet(path)
    return named.select("key", "sha256")


def requests(items: DataFrame) -> DataFrame:
    """What a model may see of the items: id and question, nothing else."""
    return items.select("id", F.col("question").alias("input"))


def judge_inputs(attempts: DataFrame) -> DataFrame:
    return attempts.select(F.col("question").alias("user_input"), "response", F.col("expected_answer").alias("reference"), F.transform("retrieved", lambda r: r["text"]).alias("retrieved_contexts"))


def results_csv(scored: DataFrame, path: str) -> None:
    """A row per attempt; arrays as texts joined by spaces."""
    flat = [F.array_join(c, " ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in scored.dtypes if not t.startswith(("struct", "map", "array<struct"))]
    scored.select(*flat).write.option("header", True).csv(path)


def shown(value: float | None) -> str:
    return "N/A" if value is None else f"{value:.3f}"


def report(summary: DataFrame, title: str, metrics: list[str]) -> str:
    """Markdown of a summary table (a row per group, so small by nature)."""
    lines = [f"# {title}", "", "| group | n | errors | " + " | ".join(metrics) + " |", "|" + "---|" * (3 + len(metrics))]
    fixed = {"n", "errors", "grouping"} | {f"{m}{s}" for m in metrics for s in ("_mean", "_n")}
    for row in summary.toLocalIterator():
        name = ", ".join(f"{c}={row[c]}" for c in summary.columns if c not in fixed and row[c] is not None) or "all"
        lines.append(f"| {name} | {row.n} | {row.errors} | " + " | ".join(f"{shown(row[f'{m}_mean'])} ({row[f'{m}_n']})" for m in metrics) + " |")
    return "\n".join(lines) + "\n"
