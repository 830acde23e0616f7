"""Inventories of files behind a landing page, what became of each, and the state of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import evaluate, refresh, sections

#: Files that an inventory lists at most (a fixed value).
MOST_FILES = 80


def pdf_links(captures: DataFrame) -> DataFrame:
    """(key, pos, url, title, fault) of the PDFs inside the main element of ``captures(key, url, html)``.

    Years and places stay in the titles.  A page without such a link, or without one main element,
    has a fault and nothing else.
    """
    found = sections.links(captures, "<main>", hidden=True, strict=False)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    pdfs = found.where(F.endswith(F.lower(path), F.lit(".pdf")) | F.col("fault").isNotNull())
    rows = captures.select("key").distinct().join(pdfs, "key", "left")
    return rows.withColumn("fault", F.when(F.col("url").isNull(), F.coalesce("fault", F.lit("no link to a PDF"))))


def candidates(direct: DataFrame, resolved: DataFrame, pricing: DataFrame) -> DataFrame:
    """(url, title, kind) of all files, each once: as linked, else as resolved, else from price lists.

    ``direct(url, title, included)``, the others ``(url, title)``; a column ``pos`` orders those
    of one inventory.
    """
    regulation, other = F.lit("regulation_or_instruction"), F.lit("form_template_or_pricing")
    rows = refresh.first_of(
        direct.withColumn("kind", F.when(F.col("included"), regulation).otherwise(other)).drop("included"),
        resolved.withColumn("kind", regulation),
        pricing.withColumn("kind", F.lit("pricing")),
    )
    return rows.select("url", "title", "kind")


def synced(files: DataFrame, outcomes: DataFrame, previous: DataFrame) -> DataFrame:
    """``files(url, ...)`` with ``present_in_previous_corpus``, ``status`` and ``extraction``.

    ``outcomes(url, status, extraction)``: downloaded or failed, prepared or needs_review; a file
    without one failed.  ``previous(url)``: addresses of the previous corpus.
    """
    known = previous.select("url").where("url is not null").distinct().withColumn("_known", F.lit(True))
    rows = files.join(outcomes.select("url", "status", "extraction"), "url", "left").join(known, "url", "left")
    status = F.coalesce("status", F.lit("failed"))
    return rows.withColumns({"present_in_previous_corpus": F.coalesce("_known", F.lit(False)), "status": status, "extraction": F.when(status == "downloaded", F.coalesce("extraction", F.lit("needs_review")))}).drop("_known")


def sync_report(rows: DataFrame, discovery_errors: int = 0, most: int = MOST_FILES) -> DataFrame:
    """One row about ``synced`` files: counts, and whether downloads and the corpus are complete.

    More than ``most`` files raise an error when the row is read: the sources have changed.
    """
    done = F.count_if(F.col("status") == "downloaded")
    counts = rows.agg(
        F.count(F.lit(1)).alias("expected_pdfs"),
        done.alias("downloaded"),
        F.count_if((F.col("status") == "downloaded") & (F.col("extraction") == "prepared")).alias("prepared"),
        F.count_if(~F.col("present_in_previous_corpus")).alias("new_to_previous_corpus"),
    )
    bounded = F.when(F.col("expected_pdfs") > most, F.raise_error(F.lit("more files than an inventory may have"))).otherwise(F.col("expected_pdfs"))
    counts = counts.withColumn("expected_pdfs", bounded).withColumn("download_complete", F.lit(discovery_errors == 0) & (F.col("downloaded") == F.col("expected_pdfs")))
    return counts.withColumn("corpus_complete", F.col("download_complete") & (F.col("prepared") == F.col("expected_pdfs")))


def corpus_status(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: documents, web documents, their oldest and newest capture, and passages.

    ``documents(source_id, captured_at)``: the time is null for what isn't from the web.
    """
    about = documents.agg(
        F.count(F.lit(1)).alias("documents"), F.count("captured_at").alias("website_sources"), F.min("captured_at").alias("website_capture_oldest"), F.max("captured_at").alias("website_capture_newest")
    )
    return about.join(passages.agg(F.count(F.lit(1)).alias("chunks")))  # a row each


def faq_faults(items: DataFrame, sections_: DataFrame, passages: DataFrame, address: str) -> DataFrame:
    """(id, fault) of items that claim to be published questions and answers but aren't as captured.

    ``items(id, question, expected_answer, answerable, source_ids, document_id, section_index,
    source_url, snapshot_sha256, captured_at, anchor)``; ``sections_(document_id, page, heading,
    anchor, text, url, sha256, captured_at)``; ``passages(id, document_id, page)``.  All passages
    of the section, and no others, have to be the item's evidence.
    """
    held = sections_.select(*(F.col(c).alias(f"_{c}") for c in ("document_id", "page", "heading", "anchor", "text", "url", "sha256", "captured_at")))
    proof = passages.groupBy(F.col("document_id").alias("_pd"), F.col("page").alias("_pp")).agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    rows = items.join(held, (F.col("document_id") == F.col("_document_id")) & (F.col("section_index") == F.col("_page")), "left")
    rows = rows.join(proof, (F.col("_document_id") == F.col("_pd")) & (F.col("_page") == F.col("_pp")), "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    fault = (
        F.when(F.col("_document_id").isNull(), "no such section")
        .when(~F.col("source_url").eqNullSafe(F.lit(address)) | ~F.col("_url").eqNullSafe(F.lit(address)), "other address")
        .when(~same("snapshot_sha256", "_sha256") | ~same("captured_at", "_captured_at") | ~same("anchor", "_anchor"), "other capture")
        .when(~same("question", "_heading") | ~F.coalesce("answerable", F.lit(False)), "question differs")
        .when(~F.col("expected_answer").eqNullSafe(evaluate.faq_answer(F.col("_text"), F.col("_heading"))), "answer differs")
        .when(F.col("_ids").isNull() | ~F.array_sort(F.array_distinct("source_ids")).eqNullSafe(F.col("_ids")), "evidence differs")
    )
    return rows.select("id", fault.alias("fault")).where("fault is not null")
