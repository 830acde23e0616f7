"""Retrieval and answer metrics, their summaries, and the audit of evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators.overlap import alike, close, contained

#: Cutoffs of the ranked metrics; review states and thresholds of near-duplicate questions.
CUTOFFS = (1, 3, 5)
REVIEW_STATES = ("unreviewed", "approved", "rejected", "needs_revision")
RATIO, OVERLAP = 0.88, 0.85
FAQ_RETURN_LINE = "Nazaj na vrh"


def _covered(groups: Column, found: Column) -> Column:
    return F.size(F.filter(groups, lambda g: F.arrays_overlap(g, found)))


def first_rank(ranked: Column, wanted: Column) -> Column:
    """Place of the first wanted id, from 1; null if there is none."""
    places = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(wanted, x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(places) > 0, places[0])


def retrieval_scores(items: DataFrame) -> DataFrame:
    """``items(id, required, groups, ranked)`` with hit rate and group recall at each cutoff.

    Hit rate asks for any required id, recall for the share of groups met; the reciprocal rank
    looks at the whole list.  Where nothing is required every score is null.
    """
    some = F.size("required") > 0
    score = {}
    for k in CUTOFFS:
        top = F.slice("ranked", 1, k)
        score[f"hit_rate_at_{k}"] = F.when(some, F.arrays_overlap("required", top).cast("double"))
        score[f"recall_at_{k}"] = F.when(F.size("groups") > 0, _covered(F.col("groups"), F.array_intersect("required", top)) / F.size("groups"))
    rank = first_rank(F.col("ranked"), F.col("required"))
    score["reciprocal_rank"] = F.when(some, F.coalesce(1.0 / rank, F.lit(0.0)))
    score["any_correct_source"] = F.when(some, F.arrays_overlap("required", "ranked").cast("double"))
    return items.withColumns(score)


def evidence_scores(items: DataFrame) -> DataFrame:
    """``items(id, groups, ranked)`` with evidence recall, all evidence, and the rank cut at five."""
    some = F.size("groups") > 0
    score = {}
    for k in CUTOFFS:
        n = _covered(F.col("groups"), F.slice("ranked", 1, k))
        score[f"evidence_recall_at_{k}"] = F.when(some, n / F.size("groups"))
        score[f"all_evidence_at_{k}"] = F.when(some, (n == F.size("groups")).cast("double"))
    rank = first_rank(F.slice("ranked", 1, 5), F.flatten("groups"))
    score["reciprocal_rank_at_5"] = F.when(some, F.coalesce(1.0 / rank, F.lit(0.0)))
    return items.withColumns(score)


def answer_scores(items: DataFrame) -> DataFrame:
    """``items(answerable, expected_answer, expected_status, source_ids, groups, response, status, cited)``
    with overlap metrics and status and citation scores; null where a score has no meaning.
    """
    m = T.overlap_metrics("response", "expected_answer")
    correct = F.array_intersect("cited", "source_ids")
    ok = F.col("answerable")
    df = items.withColumn("_m", F.when(ok, m))
    return df.withColumns(
        {
            **{k: F.col(f"_m.{k}") for k in ("exact_match", "token_f1", "rouge_l")},
            "status_match": F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False)).cast("double"),
            "unanswerable_detection": F.when(~ok & (F.col("expected_status") == "no_evidence"), F.coalesce(F.col("status") == "no_evidence", F.lit(False)).cast("double")),
            "false_refusal": F.when(ok, F.coalesce(F.col("status") == "no_evidence", F.lit(False)).cast("double")),
            "answer_with_correct_source": F.when(ok, (F.size(correct) > 0).cast("double")),
            "cited_source_precision": F.when(ok & (F.size("cited") > 0), F.size(correct) / F.size(F.array_distinct("cited"))),
            "required_source_citation_recall": F.when(ok, _covered(F.col("groups"), correct) / F.size("groups")),
        }
    ).drop("_m")


def citation_validity(cited: Column, retrieved: Column) -> Column:
    """Share of the cited ids that were retrieved; null if nothing is cited."""
    return F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, retrieved)) / F.size(F.array_distinct(cited)))


def summarize(attempts: DataFrame, metrics: list[str], by: list[list[str]] | None = None) -> DataFrame:
    """Per group: rows, errors, and mean and defined count of each metric.

    ``by``: grouping sets, by default everything as one group; a column outside a row's set is
    null.  Undefined scores are left out of means, not taken as 0.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.count("error").alias("errors")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.count(m).alias(f"{m}_n")]
    if not by:
        return attempts.agg(*aggs)
    columns = list(dict.fromkeys(c for s in by for c in s))
    return attempts.groupingSets([[F.col(c) for c in s] for s in by], *columns).agg(F.grouping_id().alias("grouping"), *aggs)


def latencies(attempts: DataFrame, column: str = "latency_seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """Interpolated median and nearest-rank 95th percentile."""
    return attempts.groupBy(*by).agg(F.median(column).alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {column})").alias("p95"), F.count(column).alias("n"))


def best_of(predictions: DataFrame) -> DataFrame:
    """Each metric's best over the reference answers: ``predictions(id, answer, answers)``."""
    rows = predictions.select("id", F.explode("answers").alias("reference"), "answer").withColumn("m", T.overlap_metrics("answer", "reference"))
    return rows.groupBy("id").agg(*(F.max(f"m.{k}").alias(k) for k in ("exact_match", "token_f1", "rouge_l")))


def worst(scored: DataFrame, limit: int = 10) -> DataFrame:
    """The cases with the lowest exact match, then token F1."""
    return scored.orderBy("exact_match", "token_f1", "id").limit(limit)


def to_inspect(scored: DataFrame, limit: int = 5) -> DataFrame:
    """Errors first, then wrong statuses, then low overlap."""
    return scored.orderBy(F.col("error").isNull(), F.coalesce("status_match", F.lit(0.0)), F.coalesce("token_f1", F.lit(0.0)), "id").limit(limit)


def tier(review_status: Column, method: Column) -> Column:
    return F.when(review_status == "approved", "gold").when(method == "official_faq", "official_faq").otherwise("silver")


def origin(method: Column) -> Column:
    return F.when(method == "official_faq", "official_faq").when(method == "student_office", "real_student_office").otherwise("document_derived")


def review_state(status: Column) -> Column:
    return F.when(status == "approved", "reviewed").when(status == "unreviewed", "needs_review").otherwise(status)


def review_counts(items: DataFrame) -> DataFrame:
    """Items by review status, all states named."""
    states = items.sparkSession.createDataFrame([(s,) for s in REVIEW_STATES], "review_status string")
    counts = items.groupBy("review_status").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counts, "review_status", "left").select("review_status", F.coalesce("n", F.lit(0)).alias("n"))


def leaked(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, key) where a normalized question stands in a normalized page; see ``overlap.contained``."""
    return contained(questions, pages)


def near_questions(items: DataFrame, overlap: float = OVERLAP, ratio: float | None = RATIO) -> DataFrame:
    """Pairs (a, b) of ``items(id, text)``, a < b, that are near duplicates, with ``overlap`` and ``ratio``.

    Their word sets overlap enough, or, unless ``ratio`` is None, their matching-block similarity
    is high enough.  Texts without words are near nothing.
    """
    rows = items.select("id", T.words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    pairs = alike(rows.select("id", F.array_distinct("_w").alias("words")), overlap)
    if ratio is None:
        return pairs
    texts = rows.select("id", F.array_join("_w", " ").alias("text"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("_b")), "b")
    return both.select("a", "b", "overlap", T.sequence_ratio("_a", "_b").alias("ratio")).unionByName(close(texts, ratio).where(F.col("overlap") < overlap))


def audit(items: DataFrame, passages: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, level, message) about an evaluation set.

    ``items(id, question, expected_answer, answerable, family_id, split, references)`` with
    references ``array<struct<id,text,article>>``; ``passages(id, text)``, ``pages(key, text)``.
    """
    out = []

    def say(df: DataFrame, level: str, message: str) -> None:
        out.append(df.select(F.col("id").cast("string").alias("id"), F.lit(level).alias("level"), F.lit(message).alias("message")))

    refs = items.select("id", F.explode("references").alias("r"))
    known = passages.select(F.col("id").alias("_p"), F.col("text").alias("_t"))
    say(refs.join(known, F.col("r.id") == F.col("_p"), "left").where("not (_t <=> r.text)").select("id").distinct(), "error", "missing source or altered supporting passage")
    evidence = F.array_join(F.transform("references", lambda r: r["text"]), " ")
    provenance = F.concat(evidence, F.lit(" "), F.array_join(F.transform("references", lambda r: F.coalesce(r["article"], F.lit(""))), " "))
    usable = items.where("answerable")
    say(usable.where(F.size(F.array_except(T.numbers(F.col("expected_answer")), T.numbers(provenance))) > 0), "error", "reference contains numbers absent from evidence")
    say(usable.where(~F.contains(T.normalized(evidence), T.normalized(F.col("expected_answer")))), "warning", "non-extractive answer needs human entailment/completeness review")
    say(leaked(items.select("id", F.col("question").alias("text")), pages).select("id").distinct(), "error", "question appears in knowledge base (possible leakage or copied FAQ; review and rephrase)")
    pairs = near_questions(items.select("id", F.col("question").alias("text")))
    a, b = items.select(F.col("id").alias("a"), F.struct("family_id", "split").alias("_fa")), items.select(F.col("id").alias("b"), F.struct("family_id", "split").alias("_fb"))
    pairs = pairs.join(a, "a").join(b, "b").withColumn("id", F.concat_ws(",", "a", "b"))
    same = F.col("_fa").eqNullSafe(F.col("_fb"))
    say(pairs.where(~same), "error", "near-duplicate questions; assign the same family and split")
    say(pairs.where(same), "warning", "near-duplicate questions; correlated examples, not independent samples")
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def item_violations(items: DataFrame) -> DataFrame:
    """(id, rule) of evaluation items whose fields contradict each other.

    ``items(id, question, answerable, expected_status, source_ids, groups, family_id, split)``.
    """
    out = []

    def rule(df: DataFrame, name: str) -> None:
        out.append(df.select(F.col("id").cast("string").alias("id"), F.lit(name).alias("rule")))

    flat = F.flatten("groups")
    rule(items.groupBy("id").count().where("count > 1"), "duplicate_id")
    rule(items.groupBy(T.normalized(F.col("question")).alias("_q")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_question")
    rule(items.where((F.size(flat) != F.size(F.array_distinct(flat))) | (F.array_sort(flat) != F.array_sort("source_ids"))), "groups_not_a_partition")
    rule(items.where((F.col("answerable") != (F.size("source_ids") > 0)) | (F.col("answerable") != (F.col("expected_status") == "evidence_found"))), "answerable_contradicted")
    rule(items.groupBy("family_id").agg(F.count_distinct("split").alias("n"), F.min("id").alias("id")).where("n > 1"), "family_in_two_splits")
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def apply_reviews(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with their review decisions; refuses unknown, repeated, stale or unsigned ones.

    ``items(id, content_sha256, review_status, ...)``, ``decisions(id, content_sha256,
    review_status, reviewer_code, review_notes)``.
    """
    known = items.select("id", F.col("content_sha256").alias("_now"))
    checked = decisions.join(known, "id", "left")
    twice = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
    checked = checked.join(twice, "id")
    fault = (
        F.when(F.col("_now").isNull(), "unknown review id")
        .when(F.col("_times") > 1, "duplicate review id")
        .when(F.col("content_sha256") != F.col("_now"), "review of other content")
        .when((F.col("review_status") != "unreviewed") & (F.trim(F.coalesce("reviewer_code", F.lit(""))) == ""), "a reviewer code is required")
    )
    bad = checked.withColumn("fault", fault).where("fault is not null").select("id", "fault").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].id}: {bad[0].fault}")
    new = decisions.select("id", *(F.col(c).alias(f"_{c}") for c in ("review_status", "reviewer_code", "review_notes")))
    old = [c for c in items.columns if c not in ("review_status", "reviewer_code", "review_notes")]
    held = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    return items.join(new, "id", "left").select(*old, *(F.coalesce(f"_{c}", held(c)).alias(c) for c in ("review_status", "reviewer_code", "review_notes")))


def ratings(reviews: DataFrame, attempts: DataFrame, fields: list[str], tags: list[str]) -> tuple[DataFrame, DataFrame]:
    """(means by question origin, counts of every tag) of ratings bound to their responses.

    A rating counts only for the response whose hash it names.
    """
    bound = reviews.join(attempts.select("id", "response_sha256", "origin"), ["id", "response_sha256"])
    means = bound.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in fields))
    names = reviews.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    used = bound.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return means, names.join(used, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def faq_answer(section: Column, heading: Column, return_line: str = FAQ_RETURN_LINE) -> Column:
    """A section's text without its heading and the line that leads back; null without an answer."""
    rest = F.when(F.startswith(section, F.concat(heading, F.lit("\n"))), F.substring(section, F.length(heading) + 2, F.length(section)))
    tail = F.lit("\n" + return_line)
    rest = F.when(F.endswith(rest, tail), F.substring(rest, F.lit(1), F.length(rest) - F.length(tail))).otherwise(rest)
    return F.nullif(F.trim(rest), F.lit(""))


def selected(items: DataFrame, split: str, reviewed_only: bool = False, from_origin: str = "all", of_tier: str = "all", limit: int = 100) -> DataFrame:
    """The first ``limit`` items, by ``pos``, that an evaluation run asks.

    ``items(id, pos, split, review_status, generation_method)``; rejected ones and those that
    need revision are never asked.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a run asks 1 to 100 items")
    ok = (F.col("split") == split) & F.col("review_status").isin("approved", *([] if reviewed_only else ["unreviewed"]))
    if from_origin != "all":
        ok &= origin(F.col("generation_method")) == from_origin
    if of_tier != "all":
        ok &= tier(F.col("review_status"), F.col("generation_method")) == of_tier
    return items.where(ok).orderBy("pos").limit(limit)


#: Fields that an attempt repeats of its item.
REPEATED = ("question", "expected_answer", "review_status", "answerable", "generation_method")


def saved_run_faults(attempts: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, fault) of a saved run that differs from its set or its selection; none of a sound one.

    ``attempts(id, pos, <REPEATED>)``, ``items(id, <REPEATED>)``, ``wanted(id, pos, attempted)``:
    the selection in order, with what the run says it left out.
    """
    twice = attempts.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("fault"))
    known = items.select("id", *(F.col(c).alias(f"_{c}") for c in REPEATED), F.lit(True).alias("_known"))
    met = attempts.join(known, "id", "left")
    differs = F.lit(False)
    for c in REPEATED:
        differs |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    faults = twice.unionByName(met.where("_known is null").select("id", F.lit("unknown").alias("fault")))
    faults = faults.unionByName(met.where(F.col("_known") & differs).select("id", F.lit("differs from its item").alias("fault")))
    due = wanted.select("id", F.col("pos").alias("_due"), "attempted")
    placed = attempts.select("id", "pos").join(due, "id", "full")
    off = placed.where((F.col("attempted") != F.col("pos").isNotNull()) | F.col("_due").isNull() | (F.col("pos") != F.col("_due")))
    return faults.unionByName(off.select("id", F.lit("not as selected").alias("fault")))


def provenance_faults(evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, passage_id, fault) of references that are no longer what the corpus has.

    ``evidence(id, passage_id, key, version, page, article, url, text)``, ``passages`` the same
    but ``id``.
    """
    fields = ["key", "version", "page", "article", "url", "text"]
    now = passages.select("passage_id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_known"))
    met = evidence.join(now, "passage_id", "left")
    same = F.lit(True)
    for c in fields:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    fault = F.when(F.col("_known").isNull(), "unknown passage").when(~same, "provenance differs")
    return met.select("id", "passage_id", fault.alias("fault")).where("fault is not null")


def smoke(expected: DataFrame, hits: DataFrame, preview: int = 500) -> DataFrame:
    """Per question: whether a hit of the expected family is among its hits, and what they are.

    ``expected(query_id, family)``, ``hits(query_id, rank, id, family, text)``; no score of correctness.
    """
    found = hits.groupBy("query_id").agg(F.collect_set("family").alias("_families"), F.array_sort(F.collect_list(F.struct("rank", "id", F.substring("text", 1, preview).alias("preview")))).alias("hits"))
    rows = expected.join(found, "query_id", "left")
    return rows.select("query_id", "family", F.coalesce(F.array_contains("_families", F.col("family")), F.lit(False)).alias("family_found"), "hits")
