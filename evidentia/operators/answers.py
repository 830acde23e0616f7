"""Answers with validated citations, assembled for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.identity import citation_url

# Messages of the interface (fixed texts).
NO_EVIDENCE = "Ni ujemajočih se odlomkov. Poskusite z izrazi iz pravilnika ali se obrnite na referat."
ABSTAINED = "V razpoložljivih odlomkih ni dovolj podatkov za zanesljiv odgovor. Za pojasnilo se obrnite na referat."
FOUND = "Najdeni odlomki za pregled"
GENERATED = "Odgovor na podlagi virov"
NOT_RECONCILED = "Spremembe pravilnikov niso samodejno usklajene. Odgovor preverite v navedenih virih."
SIMULATED = "Simulacija prikazuje izvirne odlomke, ne odgovora jezikovnega modela."
NOT_REVIEWED = "Uporabnost in veljavnost teh virov še nista pregledani."


def excerpts(hits: DataFrame) -> DataFrame:
    """Parts that quote the hits: ``hits(query_id, rank, id, text)`` -> ``query_id, part, text, citation_ids``."""
    return hits.select("query_id", F.col("rank").alias("part"), "text", F.array("id").alias("citation_ids"))


def unknown_citations(parts: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, id) cited but not retrieved; must be empty."""
    return parts.select("query_id", F.explode("citation_ids").alias("id")).distinct().join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")


def citations(parts: DataFrame, hits: DataFrame) -> DataFrame:
    """The retrieved hits that parts cite, in the order of retrieval."""
    used = parts.select("query_id", F.explode("citation_ids").alias("id")).distinct()
    return hits.join(used, ["query_id", "id"], "left_semi")


def assemble(queries: DataFrame, hits: DataFrame, parts: DataFrame | None = None, mode: str = "simulated") -> DataFrame:
    """One answer per query: ``query_id, status, message, parts, citations, warnings``.

    ``hits(query_id, rank, id, text, title, url, page, article, version, review_status)``.
    Without ``parts`` the hits are quoted.  A question without hits is abstained from; a part
    that cites what was not retrieved, or a hit that comes twice, is refused.
    """
    parts = excerpts(hits) if parts is None else parts
    if unknown_citations(parts, hits).limit(1).count():
        raise ValueError("a part cites evidence outside the retrieved set")
    if hits.groupBy("query_id", "id").count().where("count > 1").limit(1).count():
        raise ValueError("a hit was retrieved twice")
    said = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "text", "citation_ids"))).alias("parts"))
    cited = citations(parts, hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "url", "page", "article", "version", "review_status", "text"))).alias("citations"))
    rows = queries.select("query_id").join(said, "query_id", "left").join(cited, "query_id", "left")
    found = F.size(F.coalesce("parts", F.expr("array()"))) > 0
    open_ = F.exists("citations", lambda c: c["review_status"] != "reviewed")
    warnings = F.filter(F.array(F.lit(SIMULATED) if mode == "simulated" else F.lit(None), F.lit(NOT_RECONCILED), F.when(open_, NOT_REVIEWED)), lambda w: w.isNotNull())
    return rows.select(
        "query_id",
        F.when(found, "evidence_found").otherwise("no_evidence").alias("status"),
        F.when(found, FOUND if mode == "simulated" else GENERATED).otherwise(NO_EVIDENCE).alias("message"),
        "parts",
        "citations",
        F.when(found, warnings).otherwise(F.expr("cast(array() as array<string>)")).alias("warnings"),
    )


def response_text(answers: DataFrame) -> DataFrame:
    """(query_id, response): the parts' texts on lines of their own, else the message."""
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return answers.select("query_id", F.coalesce(F.nullif(joined, F.lit("")), F.col("message")).alias("response"))


#: What stands for the sources of an answer that needs none (fixed text).
NO_SOURCES = "No supporting passage is expected for this question."


def source_labels(passages: Column) -> Column:
    """Titles and places of an array of ``struct<title,section,page,article,url>``, each once, in order."""

    def label(p: Column) -> Column:
        place = F.coalesce(F.nullif(p["section"], F.lit("")), F.when(p["page"] != 0, F.concat(F.lit("page "), p["page"].cast("string"))))
        title = F.concat(p["title"], F.coalesce(F.concat(F.lit(" — "), place), F.lit("")), F.coalesce(F.concat(F.lit(", article "), F.nullif(p["article"], F.lit(""))), F.lit("")))
        return F.when(F.coalesce(p["url"], F.lit("")) != "", F.concat(F.lit("["), title, F.lit("]("), p["url"], F.lit(")"))).otherwise(title)

    found = F.array_distinct(F.transform(passages, label))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_SOURCES)))


def supporting(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages as evaluation sets quote them: with title, place and address of their document.

    ``documents(source_id, title, url, is_web)``, ``passages(id, source_id, version, page,
    article, section, text)``; a web section's heading stands for its page.
    """
    rows = passages.join(documents.select("source_id", "title", "url", "is_web"), "source_id")
    web = F.coalesce("is_web", F.lit(False))
    return rows.select(
        F.col("id").alias("source_id"), F.col("source_id").alias("document_id"), "title", F.when(~web, F.col("page")).alias("page"), F.when(web, F.col("section")).alias("section"),
        "article", citation_url(F.col("url"), F.col("page"), web, F.lit(None).cast("string")).alias("url"), "version", "text",
    )


def fixed_only(hits: DataFrame) -> DataFrame:
    """Hits of a fixed index without its web documents: what was captured before is never shown as current."""
    return hits.where(~F.coalesce("is_web", F.lit(False)))
