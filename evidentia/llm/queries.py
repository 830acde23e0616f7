"""The operators' queries, over the whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, centroids, embedding_dedup, html_extract, jaccard_join, lexical_search, mixing, packing, pii, quality_rules, sharding, toxicity, warc
from evidentia.llm.sql import oracle

#: Batches in which op4's documents arrive.
ARRIVALS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, classes and kept vectors of all ``embeddings``; those that link with nothing are a class each."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` dropped or repeated to the square roots of their sources' sizes, with copy number and order key."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; null and empty texts score the prior."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in batches, are compacted after each, and are read back."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.store(spark, "documents")
    for i in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == i))
    store.compact()
    store.vacuum(0)  # no one else writes to it
    return store.read()


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` with their sequence and offset; null and empty texts are one token. ``slot_gap`` over 0 says that a slot isn't certified."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``; null and empty ones have an empty text."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all ``documents``; null and empty texts have none."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all ``documents``; texts without words link with nothing."""
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are archived, and the result is read back from the archives."""
    pages = table(spark, sf_dir, "pages")
    root, _ = warc.archive(pages)
    records = warc.read(spark, root, dict(pages.dtypes)["page_id"])
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``; null and empty texts have no words and fail."""
    judged = quality_rules.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all sound ``embeddings`` after ten rounds, with distances and inertia; others have no row."""
    return centroids.report(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all ``documents`` and their texts decoded again, as digests; null and empty texts have no ids."""
    tokens = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = bpe.decode(tokens)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``documents`` for each ``benchmark`` item; items without a match have no row."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = (op1_embedding_dedup, op2_poisson_mixing, op3_toxicity, op4_sharding, op5_best_fit_packing, op6_html_extract, op7_pii, op8_jaccard_join, op9_warc, op10_quality_rules, op11_centroid_clustering, op12_bpe, op13_lexical_search)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {k: v for k, v in oracle().items() if k in known}
