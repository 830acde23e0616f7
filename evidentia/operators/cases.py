"""Anonymized real cases, bound to an audited snapshot and to the passages they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import answers

AUDITED = ["document_id", "title", "source_url", "pages", "chunks"]


def expected_sources(documents: DataFrame, pages: DataFrame, passages: DataFrame) -> DataFrame:
    """What an audit should say of a corpus: per document its title, address, and numbers of pages and passages."""
    n = lambda df, name: df.groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    rows = documents.join(n(pages, "pages"), "source_id", "left").join(n(passages, "chunks"), "source_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(F.col("source_id").alias("document_id"), "title", F.col("url").alias("source_url"), count("pages"), count("chunks"))


def source_differences(expected: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows that only one of two multisets has, with ``side`` and how often: ``n`` more than in the other.

    Repeated rows count, so an audit that lists a document twice differs.
    """
    a, b = expected.select(*AUDITED), audited.select(*AUDITED)
    only = lambda x, y, side: x.exceptAll(y).groupBy(*AUDITED).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return only(a, b, "corpus").unionByName(only(b, a, "audit"))


def missing_evidence(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, passage_id) that cases name and the corpus lacks; ``cases(id, source_ids)``, ``passages(id)``."""
    named = cases.select("id", F.explode(F.array_distinct("source_ids")).alias("passage_id"))
    return named.join(passages.select(F.col("id").alias("passage_id")), "passage_id", "left_anti").select("id", "passage_id")


def import_faults(audit: DataFrame, audited: DataFrame, corpus_id: str, documents: DataFrame, pages: DataFrame, passages: DataFrame, cases: DataFrame) -> DataFrame:
    """(fault, key) for which cases can't be taken over; none for an audit of this very corpus.

    ``audit``: one row (ok, corpus_id, snapshot_id, chunks); ``audited``: its sources.
    """
    fault = (
        F.when(~F.coalesce("ok", F.lit(False)) | ~F.col("corpus_id").eqNullSafe(F.lit(corpus_id)), "the audit doesn't confirm this corpus")
        .when(F.trim(F.coalesce("snapshot_id", F.lit(""))) == "", "the audit names no snapshot")
        .when(~F.col("chunks").eqNullSafe(F.col("_chunks")), "the audit counts other passages")
    )
    counted = audit.join(passages.agg(F.count(F.lit(1)).alias("_chunks")))  # a row each
    out = counted.select(fault.alias("fault"), F.lit(None).cast("string").alias("key")).where("fault is not null")
    differ = source_differences(expected_sources(documents, pages, passages), audited)
    out = out.unionByName(differ.select(F.concat(F.lit("only in the "), "side").alias("fault"), F.col("document_id").alias("key")))
    return out.unionByName(missing_evidence(cases, passages).select(F.lit("unknown evidence").alias("fault"), F.concat_ws(":", "id", "passage_id").alias("key")))


def imported(cases: DataFrame, documents: DataFrame, passages: DataFrame, snapshot_id: str) -> DataFrame:
    """Cases as items of an evaluation set: unreviewed, of real origin, with the passages they name in their order.

    ``cases(id, question, original_response, reference_answer, source_ids, required_source_groups,
    category, difficulty, answerable, expected_status, family_id, split)``; see ``answers.supporting``.
    """
    held = answers.supporting(documents, passages)
    about = F.struct(*held.columns)
    named = cases.select("id", F.posexplode("source_ids").alias("_pos", "source_id")).join(held, "source_id")
    quoted = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", about.alias("p")))), lambda x: x["p"]).alias("supporting_passages"))
    note = "Reference answer, answerability and source applicability require human review."
    fixed = {"generation_method": "student_office", "data_origin": "real", "review_status": "unreviewed", "corpus_snapshot_id": snapshot_id, "review_notes": note}
    rows = cases.join(quoted, "id", "left").withColumnRenamed("reference_answer", "expected_answer")
    return rows.withColumns({k: F.lit(v) for k, v in fixed.items()})
