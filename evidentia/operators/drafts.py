"""Evaluation items drafted from passages or taken over from a pilot set, and their review by people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T

#: What a reviewer confirms before an item is approved (fixed values).
CHECKS = ("question_clear", "answer_correct", "source_correct", "sufficient_evidence", "answerability_correct")
#: Columns that a review writes: they aren't content.
REVIEW = ("review_status", "review_notes", "reviewer_code", "review_checks", "reviewed_content_sha256")
#: Characters of a passage that an item is drafted from.
LEAST, MOST = 100, 2500
DRAFT_NOTE = "Drafted from the passage; the question quotes its source, so retrieval is biased. Rewrite and review."
_REF = ("source_id", "document_id", "title", "page", "section", "article", "url", "version", "text")


def _reference(passages: DataFrame) -> DataFrame:
    """``passages`` as (id, reference)."""
    return passages.select("id", F.struct(F.col("id").alias("source_id"), *_REF[1:]).alias("reference"))


def silver(passages: DataFrame, limit: int = 24, seed: int = 42) -> DataFrame:
    """Items drafted from the first ``limit`` passages of usable length, in an order hashed from the seed.

    ``passages(id, document_id, title, page, section, article, url, version, text)``.  Of
    passages whose questions are equal the first is kept.
    """
    from pyspark.sql.window import Window

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    some = passages.where(F.length("text").between(LEAST, MOST)).withColumn("_o", order).orderBy("_o", "id").limit(limit)
    place = F.coalesce("section", F.concat("article", F.lit(". člen")), F.concat(F.lit("stran "), F.col("page").cast("string")))
    question = F.concat(F.lit("Kaj določa dokument »"), "title", F.lit("«, "), place, F.lit(", v odlomku »"), F.regexp_replace(F.substring("text", 1, 70), r"(?U)^\s+|\s+$", ""), F.lit("«?"))
    asked = some.withColumn("question", question).withColumn("_n", F.row_number().over(Window.partitionBy(T.normalized(F.col("question"))).orderBy("_o", "id"))).where("_n = 1")
    own, lit = F.array("id"), F.lit
    return asked.select(
        F.concat(lit("synthetic-"), F.col("id").cast("string")).alias("id"), "question", F.col("text").alias("expected_answer"), own.alias("source_ids"), F.array(own).alias("groups"),
        F.array(F.struct(F.col("id").alias("source_id"), *_REF[1:])).alias("supporting_passages"), lit("direct").alias("category"), lit("easy").alias("difficulty"), lit(True).alias("answerable"),
        lit("evidence_found").alias("expected_status"), lit("synthetic").alias("generation_method"), F.col("id").cast("string").alias("family_id"), lit("development").alias("split"), lit("unreviewed").alias("review_status"),
        lit(DRAFT_NOTE).alias("review_notes"),
    )


def taken_over(pilot: DataFrame, passages: DataFrame) -> DataFrame:
    """Items of a pilot set, with the passages they cite as the corpus has them.

    ``pilot(id, question, reference_answer, evidence, evidence_groups, category, expected_status,
    review_notes, family_id, split)``, ``evidence`` ids in order.  Ids that the corpus lacks are
    left out: ``readers.pilot`` lists them.
    """
    cited = pilot.select("id", F.posexplode("evidence").alias("_pos", "_passage"))
    met = cited.join(_reference(passages).withColumnRenamed("id", "_passage"), "_passage")
    refs = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_pos", "reference"))).alias("_refs"))
    rows = pilot.join(refs, "id", "left").withColumn("supporting_passages", F.transform("_refs", lambda r: r["reference"]))
    rows = rows.withColumn("supporting_passages", F.coalesce("supporting_passages", F.slice(F.array(F.lit(None).cast(rows.schema["supporting_passages"].dataType.elementType)), 1, 0)))
    return rows.select(
        "id", "question", F.col("reference_answer").alias("expected_answer"), F.transform("supporting_passages", lambda r: r["source_id"]).alias("source_ids"), F.col("evidence_groups").alias("groups"),
        "supporting_passages", "category", F.when(F.size("evidence_groups") > 1, "hard").otherwise("easy").alias("difficulty"), (F.col("expected_status") == "evidence_found").alias("answerable"),
        "expected_status", F.lit("synthetic").alias("generation_method"), "family_id", "split", F.lit("unreviewed").alias("review_status"), "review_notes",
    )


def content_sha256(items: DataFrame) -> Column:
    """Digest of all that isn't a review: approvals are bound to it."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(set(items.columns) - set(REVIEW) - {"content_sha256"})))), 256)


def shown_origin(items: DataFrame) -> Column:
    """How a review sheet names where an item is from."""
    real = (F.col("data_origin") == "real") if "data_origin" in items.columns else F.lit(False)
    return F.when(F.col("generation_method") == "official_faq", "Official FAQ").when(real, "Real student-office enquiry").otherwise("Created from documents")


def _context(items: DataFrame) -> list[Column]:
    """What a sheet shows of an item and a reviewer must not edit."""
    more = [F.col("original_response")] if "original_response" in items.columns else []
    return [F.col("question"), F.col("expected_answer"), *more, shown_origin(items).alias("origin"), F.col("answerable"), F.col("supporting_passages")]


def review_sheet(items: DataFrame) -> DataFrame:
    """A row per item for reviewers: its content, what was decided so far, and each check, unconfirmed unless it was."""
    held = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    checks = held("review_checks", "map<string,boolean>")
    asked = F.create_map(*(x for c in CHECKS for x in (F.lit(c), F.coalesce(F.try_element_at(checks, F.lit(c)), F.lit(False)))))
    return items.select(
        "id", *_context(items), content_sha256(items).alias("content_sha256"), "review_status", F.coalesce(held("reviewer_code", "string"), F.lit("")).alias("reviewer_code"),
        F.coalesce(held("review_notes", "string"), F.lit("")).alias("review_notes"), asked.alias("checks"),
    )


def review_faults(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, fault), the first fault of each decision that can't be applied; none of sound ones.

    ``decisions``: rows of ``review_sheet``, filled in.  They have to name an item once, show it
    as it is, and be signed; an approval confirms every check.
    """
    shown = [c for c in items.select(*_context(items)).columns if c in decisions.columns]
    now = items.select("id", content_sha256(items).alias("_sha"), *(c.alias(f"_{n}") for c, n in zip(_context(items), items.select(*_context(items)).columns, strict=True) if n in shown))
    twice = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
    met = decisions.join(twice, "id").join(now, "id", "left")
    edited = F.lit(False)
    for c in shown:
        edited |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    confirmed = F.lit(True)
    for c in CHECKS:
        confirmed &= F.coalesce(F.try_element_at("checks", F.lit(c)), F.lit(False))
    unsigned = F.trim(F.coalesce("reviewer_code", F.lit(""))) == ""
    fault = (
        F.when(F.col("_sha").isNull(), "unknown item")
        .when(F.col("_times") > 1, "decided more than once")
        .when(F.col("content_sha256") != F.col("_sha"), "other content")
        .when(edited, "context edited")
        .when((F.col("review_status") != "unreviewed") & unsigned, "no reviewer")
        .when((F.col("review_status") == "approved") & ~confirmed, "checks missing")
    )
    return met.select("id", fault.alias("fault")).where("fault is not null").distinct()


def reviewed(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """``items`` with their decisions, rejected ones kept; raises if a decision is faulty."""
    bad = review_faults(items, decisions).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].id}: {bad[0].fault}")
    new = decisions.select("id", F.struct("review_status", F.coalesce("review_notes", F.lit("")).alias("review_notes"), "reviewer_code", F.col("checks").alias("review_checks"), F.when(F.col("review_status") == "approved", F.col("content_sha256")).alias("reviewed_content_sha256")).alias("_new"))
    kinds = {"review_checks": "map<string,boolean>"}
    held = lambda c: F.col(c) if c in items.columns else F.lit(None).cast(kinds.get(c, "string"))
    rest = [c for c in items.columns if c not in REVIEW]
    return items.join(new, "id", "left").select(*rest, *(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(held(c)).alias(c) for c in REVIEW))
