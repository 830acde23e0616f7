"""Readers: corpora, manifests, public question sets, predictions and files, as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.identity import without_bom
from evidentia.operators import evaluate

# Schemas of the JSON formats.
SECTION = "struct<heading:string,anchor:string>"
WEB = f"struct<captured_at:timestamp,selector_id:string,sections:array<{SECTION}>,format:string>"
REGULATION = (
    "struct<landing_page:string,linked_url:string,category:string,subcategory:string,document_type:string,publication_date:date,effective_date:date,"
    "version_label:string,is_amendment:boolean,parent_regulation:string,retrieved_at:timestamp,discovery_path:array<string>>"
)
SOURCE = (
    "struct<key:string,title:string,url:string,local_path:string,language:string,issuer:string,excluded_pages:array<int>,excluded_edge_lines:array<string>,"
    f"review_status:string,notes:string,web:{WEB},regulation:{REGULATION}>"
)
PAGE = "struct<page:int,text:string>"
PASSAGE = "struct<id:string,source_id:string,version:string,page:int,start:int,end:int,article:string,section:string,text:string>"
DOCUMENT = f"struct<source_id:string,source:{SOURCE},content_sha256:string,extraction_version:string,chunking_version:string,prepared_at:timestamp,pages:array<{PAGE}>,chunks:array<{PASSAGE}>>"
CORPUS = f"schema_version int, corpus_id string, documents array<{DOCUMENT}>"
MANIFEST = f"corpus_id string, sources array<{SOURCE}>"
SQUAD = "version string, data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>>>>>>>"
PREDICTION = "id string, answer string, refused boolean"

CASES = (
    "name string, cases array<struct<id:string,question:string,original_response:string,reference_answer:string,source_ids:array<string>,required_source_groups:array<array<string>>,"
    "category:string,difficulty:string,answerable:boolean,expected_status:string,family_id:string,split:string,anonymized:boolean>>"
)
AUDIT = "ok boolean, corpus_id string, snapshot_id string, mongo_chunks long, sources array<struct<document_id:string,title:string,source_url:string,pages:long,chunks:long>>"

PILOT = (
    "name string, corpus_id string, corpus_sha256 string, items array<struct<id:string,family_id:string,split:string,question:string,category:string,reference_answer:string,expected_status:string,"
    "evidence_groups:array<array<string>>,evidence:array<struct<chunk_id:string,source_key:string,version:string,page:int,article:string,url:string,excerpt:string>>,review_status:string,reviewer_code:string,review_notes:string>>"
)
REFERENCE = "struct<source_id:string,document_id:string,title:string,page:int,section:string,article:string,url:string,version:string,text:string>"
CONTROLLED = (
    "schema_version int, name string, corpus_id string, corpus_sha256 string, seed int, items array<struct<id:string,question:string,expected_answer:string,source_ids:array<string>,required_source_groups:array<array<string>>,"
    f"supporting_passages:array<{REFERENCE}>,category:string,difficulty:string,answerable:boolean,expected_status:string,generation_method:string,data_origin:string,original_response:string,"
    "review_status:string,review_notes:string,family_id:string,split:string,reviewer_code:string,review_checks:map<string,boolean>,reviewed_content_sha256:string>>"
)
ATTEMPT = "id string, question string, expected_answer string, review_status string, answerable boolean, generation_method string, response string, error string, review_notes string, reviewer_code string"


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, a file each, with or without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.from_json(without_bom(F.col("value")), schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def prepared_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, passages) of a prepared corpus file."""
    docs = json_file(spark, path, CORPUS).select("corpus_id", F.explode("documents").alias("d"))
    documents = docs.select("corpus_id", "d.source_id", F.col("d.source.key").alias("key"), F.col("d.source").alias("source"), "d.content_sha256", "d.extraction_version", "d.chunking_version", "d.prepared_at")
    excluded = F.coalesce("d.source.excluded_pages", F.expr("cast(array() as array<int>)"))
    pages = docs.select("corpus_id", "d.source_id", excluded.alias("_x"), F.inline("d.pages")).select("corpus_id", "source_id", "page", "text", F.array_contains("_x", F.col("page")).alias("excluded"))
    return documents, pages, docs.select(F.inline("d.chunks"))


def office_cases(spark: SparkSession, path: str) -> DataFrame:
    """Anonymized cases of a file, a row each; cases that aren't marked as anonymized have a ``fault``."""
    rows = json_file(spark, path, CASES).select(F.explode("cases").alias("c")).select("c.*")
    return rows.withColumn("fault", F.when(~F.coalesce("anonymized", F.lit(False)), "not anonymized")).drop("anonymized")


def snapshot_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(the audit's own row, its sources) of a verification file."""
    rows = json_file(spark, path, AUDIT)
    return rows.select("ok", "corpus_id", "snapshot_id", F.col("mongo_chunks").alias("chunks")), rows.select(F.inline("sources"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a manifest, with their corpus."""
    return json_file(spark, path, MANIFEST).select("corpus_id", F.explode("sources").alias("s")).select("corpus_id", "s.*")


def files(spark: SparkSession, path: str, pattern: str | None = None, nested: bool = False) -> DataFrame:
    """(path, content) of binary files, those of inner folders too if ``nested``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", nested)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def pilot(spark: SparkSession, path: str, corpus_id: str, corpus_sha256: str, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, faults) of a pilot set over a corpus.

    Items as ``drafts.taken_over`` takes them.  ``faults(id, passage_id, fault)``: another corpus,
    repeated ids and questions, families in two splits, and evidence that isn't what
    ``passages(passage_id, key, version, page, article, url, text)`` has.
    """
    whole = json_file(spark, path, PILOT)
    rows = whole.select(F.explode("items").alias("i")).select("i.*")
    none = F.lit(None).cast("string")
    say = lambda df, what: df.select(F.col("id"), none.alias("passage_id"), F.lit(what).alias("fault"))
    other = whole.where(~(F.col("corpus_id").eqNullSafe(F.lit(corpus_id)) & F.col("corpus_sha256").eqNullSafe(F.lit(corpus_sha256)))).select(F.col("name").alias("id"))
    least = F.min("id").alias("id")
    faults = say(other, "made for another corpus")
    faults = faults.unionByName(say(rows.groupBy("id").count().where("count > 1"), "repeated id"))
    faults = faults.unionByName(say(rows.groupBy(T.folded(F.col("question")).alias("_q")).agg(least, F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated question"))
    faults = faults.unionByName(say(rows.groupBy("family_id").agg(least, F.count_distinct("split").alias("n")).where("n > 1"), "family in two splits"))
    cited = rows.select("id", F.inline("evidence")).select("id", F.col("chunk_id").alias("passage_id"), F.col("source_key").alias("key"), "version", "page", "article", "url", F.col("excerpt").alias("text"))
    return rows.withColumn("evidence", F.transform("evidence", lambda e: e["chunk_id"])), faults.unionByName(evaluate.provenance_faults(cited, passages))


def controlled(spark: SparkSession, path: str, passages: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, findings) of a controlled set: what its fields contradict, as errors, and what ``evaluate.audit`` finds.

    ``passages(id, text)``, ``pages(key, text)``; ``findings(id, level, message)``.  A set with
    an error isn't to be run.
    """
    rows = json_file(spark, path, CONTROLLED).select(F.explode("items").alias("i")).select("i.*")
    own = F.transform("source_ids", lambda x: F.array(x))
    groups = F.when(F.size(F.coalesce("required_source_groups", F.expr("cast(array() as array<array<string>>)"))) > 0, F.col("required_source_groups")).otherwise(own)
    items = rows.withColumn("groups", groups).drop("required_source_groups")
    refs = F.transform("supporting_passages", lambda r: F.struct(r["source_id"].alias("id"), r["text"].alias("text"), r["article"].alias("article")))
    broken = evaluate.item_violations(items).select("id", F.lit("error").alias("level"), F.col("rule").alias("message"))
    return items, broken.unionByName(evaluate.audit(items.withColumn("references", refs), passages, pages))


def saved_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(attempts, items, wanted) of a saved run's folder, as ``evaluate.saved_run_faults`` takes them.

    Attempts are numbered in the order of their log, and take notes and reviewer from their item
    where the log has neither.  A run asks 100 items at most, so its log is one row here.
    """
    items = json_file(spark, f"{folder}/dataset.json", CONTROLLED).select(F.explode("items").alias("i")).select("i.*")
    lines = spark.read.text(f"{folder}/attempts.jsonl", wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    said = lines.select("pos", F.from_json("line", ATTEMPT, {"mode": "FAILFAST"}).alias("a"), "line").select("pos", "a.*", "line")
    known = items.select("id", F.coalesce("review_notes", F.lit("")).alias("_notes"), F.col("reviewer_code").alias("_code"))
    # A field that is there and null stays so.
    absent = lambda c: ~F.array_contains(F.json_object_keys("line"), F.lit(c))
    attempts = said.join(known, "id", "left").withColumns({"review_notes": F.when(absent("review_notes"), F.col("_notes")).otherwise(F.col("review_notes")), "reviewer_code": F.when(absent("reviewer_code"), F.col("_code")).otherwise(F.col("reviewer_code"))})
    whole = json_file(spark, f"{folder}/summary.json", "metadata struct<selected_ids:array<string>>, unattempted_ids array<string>")
    wanted = whole.select(F.posexplode("metadata.selected_ids").alias("pos", "id"), "unattempted_ids").select("id", "pos", (~F.array_contains("unattempted_ids", F.col("id"))).alias("attempted"))
    return attempts.drop("line", "_notes", "_code"), items, wanted


def pdf_pages(captures: DataFrame) -> DataFrame:
    """``captures(key, content)`` -> ``key, page, text`` with the native text of PDF pages.

    Needs the optional package pypdf on the workers; encrypted or broken files stop the job.
    """

    def read(batches):
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pypdf") from e
        import io

        for batch in batches:
            rows = []
            for key, content in zip(batch["key"], batch["content"], strict=True):
                reader = PdfReader(io.BytesIO(content))
                if reader.is_encrypted:
                    raise ValueError(f"{key}: the file is encrypted")
                rows += [(key, n, page.extract_text() or "") for n, page in enumerate(reader.pages, 1)]
            yield pd.DataFrame(rows, columns=["key", "page", "text"])

    return captures.select("key", "content").mapInPandas(read, "key string, page int, text string")


#: Operators of a page's content that draw nothing by themselves (fixed values).
HARMLESS = frozenset(b"q Q cm gs BT ET Tf Td TD Tm Tc Tw Tz TL Ts Tr T* rg RG g G k K cs CS w J j M d ri i n W W* BMC BDC EMC MP DP".split())


def blank_pages(captures: DataFrame) -> DataFrame:
    """(key, page) of PDF pages that provably show nothing: no text, notes or drawing operators."""

    def read(batches):
        try:
            from pypdf import PdfReader
            from pypdf.generic import ContentStream
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pypdf") from e
        import io

        for batch in batches:
            rows = []
            for key, content in zip(batch["key"], batch["content"], strict=True):
                reader = PdfReader(io.BytesIO(content))
                for n, page in enumerate(reader.pages, 1):
                    if (page.extract_text() or "").strip() or page.get("/Annots"):
                        continue
                    body = page.get_contents()
                    steps = [] if body is None else ContentStream(body, reader).operations
                    if all(operator in HARMLESS for _, operator in steps):
                        rows.append((key, n))
            yield pd.DataFrame(rows, columns=["key", "page"])

    return captures.select("key", "content").mapInPandas(read, "key string, page int")


def squad(spark: SparkSession, path: str) -> DataFrame:
    """Items of a SQuAD 2 file: ``id, question, answers, answerable, category, context``.

    Answers keep their first order once each.  ``fault`` names items that contradict themselves.
    """
    rows = json_file(spark, path, SQUAD).select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select("p.context", F.explode("p.qas").alias("q"))
    answers = F.when(F.coalesce("q.is_impossible", F.lit(False)), F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.transform("q.answers", lambda a: a["text"])))
    rows = rows.select("q.id", "q.question", answers.alias("answers"), (~F.coalesce("q.is_impossible", F.lit(False))).alias("answerable"), "context")
    missing = F.exists("answers", lambda a: ~F.contains(F.col("context"), a))
    fault = F.when(F.col("answerable") != (F.size("answers") > 0), "answers contradict answerable").when(missing, "answer not in its context")
    return rows.withColumns({"category": F.when(F.col("answerable"), "answerable").otherwise("unanswerable"), "fault": fault})


def qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """Items of a question CSV with columns input and output, optionally id, type, answerable."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    given = F.lower(F.trim(has("answerable")))
    answerable = F.when(given.isin("false", "0", "no"), False).when(given.isin("true", "1", "yes"), True).otherwise(F.trim(F.coalesce(has("output"), F.lit(""))) != "")
    ident = F.coalesce(has("id"), F.concat(F.lit("row-"), F.substring(F.sha2(F.col("input"), 256), 1, 16)))
    return rows.select(ident.alias("id"), F.col("input").alias("question"), F.when(answerable, F.array("output")).otherwise(F.expr("cast(array() as array<string>)")).alias("answers"), answerable.alias("answerable"), F.coalesce(has("type"), F.lit("qa")).alias("category"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def bijection(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(key, fault) where two tables do not match one to one; no rows if they do."""
    a = left.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("_b"))
    fault = F.when(F.col("_a").isNull(), "unexpected").when(F.col("_b").isNull(), "missing").when((F.col("_a") > 1) | (F.col("_b") > 1), "duplicate")
    return a.join(b, "key", "full").select("key", fault.alias("fault")).where("fault is not null")


def score_predictions(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Public items with their predictions scored: best of the references, refusals as such.

    An unanswerable item is right if it was refused or left empty, and wrong in every metric
    otherwise; a refused answerable item scores 0.
    """
    bad = bijection(items, answers).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].key}: {bad[0].fault} prediction")
    from evidentia.operators.evaluate import best_of

    rows = items.join(answers, "id").withColumn("_said", F.when(F.coalesce("refused", F.lit(False)), "").otherwise(F.coalesce("answer", F.lit(""))))
    scored = best_of(rows.where("answerable").select("id", F.col("_said").alias("answer"), "answers"))
    silent = (F.trim("_said") == "").cast("double")
    out = rows.join(scored, "id", "left").withColumn("refusal_match", F.when(~F.col("answerable"), silent).otherwise(1 - silent))
    return out.select("id", "category", "answerable", "refusal_match", *(F.when(F.col("answerable"), F.col(k)).otherwise(silent).alias(k) for k in ("exact_match", "token_f1", "rouge_l")))


def faq_items(sections: DataFrame) -> DataFrame:
    """Lookup items of FAQ sections ``(key, page, heading, anchor, text)``; toc anchors are checked by ``toc_faults``."""
    from evidentia.operators.evaluate import faq_answer

    rows = sections.where(F.endswith("heading", F.lit("?"))).withColumn("expected_answer", faq_answer(F.col("text"), F.col("heading")))
    return rows.where("expected_answer is not null").select("key", F.col("page").alias("section_index"), "anchor", F.col("heading").alias("question"), "expected_answer")


def toc_faults(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, fault) where a table of contents and the sections disagree; an empty list says nothing."""
    any_listed = listed.limit(1).count() > 0
    a, b = listed.select("anchor").distinct(), found.select("anchor").where("anchor is not null").distinct()
    out = a.join(b, "anchor", "left_anti").withColumn("fault", F.lit("listed, not found"))
    return out.unionByName(b.join(a, "anchor", "left_anti").withColumn("fault", F.lit("found, not listed"))) if any_listed else out.limit(0)


def variants(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Question variants ``(base_id, id, question, category)`` as items: the rest comes from the base, unreviewed."""
    base = items.select(F.col("id").alias("base_id"), *(c for c in items.columns if c not in ("id", "question", "category", "review_status")))
    new = rows.join(base, "base_id").withColumn("review_status", F.lit("unreviewed")).drop("base_id")
    return items.unionByName(new.select(*items.columns))


def tokens_of(texts: DataFrame) -> DataFrame:
    """``texts(id, text)`` -> ``id, words`` by the exact tokenization."""
    return texts.select("id", T.exact_words("text").alias("words"))
