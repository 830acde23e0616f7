"""Corpora: from text, Markdown and HTML sources to documents, pages and passages, and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.identity import mime, stable_id, without_bom
from evidentia.operators import chunk
from evidentia.operators.sizes import by_slices

#: Bytes of a source file, and content types by format (fixed values).
MAX_BYTES = 20_000_000
CONTENT_TYPES = {
    "pdf": ("application/pdf", "application/octet-stream"),
    "html": ("text/html", "application/xhtml+xml"),
    "txt": ("text/plain",),
    "markdown": ("text/markdown", "text/plain", "text/x-markdown"),
}


def text_pages(sources: DataFrame) -> DataFrame:
    """Pages of text and Markdown sources.

    ``sources(source_id, version, title, kind, text[, ignored_lines])`` -> ``source_id, version,
    page, heading, text``: Markdown splits before its headings, other text is one page.
    """
    return _pages_of_texts(sources).drop("kind")


def _pages_of_texts(sources: DataFrame) -> DataFrame:
    """``text_pages`` with their ``kind``, numbered in their source before they are rows: no window, no shuffle."""
    body = without_bom(F.col("text"))
    parts = F.when(F.col("kind") == "markdown", F.split(body, r"(?m)(?=^#{1,6}\s+)")).otherwise(F.array(body))
    strip, all_of = T.stripped, lambda x: x
    if "ignored_lines" in sources.columns:
        ignored = F.coalesce("ignored_lines", F.expr(_NO_LINES))
        all_of = lambda lines: F.filter(lines, lambda x: ~F.array_contains(ignored, strip(x)))
    lines = lambda part: F.transform(all_of(F.split(strip(part), "\n")), T.right_stripped)
    found = F.transform(F.transform(parts, lines), lambda x: F.struct(F.get(x, F.lit(0)).alias("first"), strip(F.array_join(x, "\n")).alias("text")))
    rows = sources.select("source_id", "version", "title", "kind", F.posexplode(F.filter(found, lambda x: x["text"] != "")).alias("pos", "part"))
    first = F.col("part.first")
    heading = F.when((F.col("kind") == "markdown") & first.startswith("#"), strip(F.regexp_replace(first, r"^#{1,6}\s+", ""))).otherwise(F.col("title"))
    return rows.select("source_id", "version", (F.col("pos") + 1).alias("page"), heading.alias("heading"), F.col("part.text").alias("text"), "kind")


def _unmarked(text: str) -> Column:
    """The text of a source, checked in the plan: no pass of its own."""
    said = F.raise_error(F.concat("key", F.lit(": possible evaluation artefact among the sources")))
    return F.when(T.leaks(F.col(text)), said).otherwise(F.col(text))


def prepare_text(corpus_id: str, sources: DataFrame, max_chars: int = chunk.MAX_CHARS, overlap: int = chunk.OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, passages) of ``sources(key, title, kind, text)``.

    A source that holds an evaluation artefact stops the job that reads its text.
    """
    return _texts(corpus_id, sources.withColumn("text", _unmarked("text")), max_chars, overlap)


def _texts(corpus_id: str, sources: DataFrame, max_chars: int, overlap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = sources.select("key", "title", "kind", "text", stable_id(F.lit(corpus_id), F.col("key")).alias("source_id"), F.sha2("text", 256).alias("version"))
    documents = named.select("source_id", "key", "title", "kind", F.col("version").alias("content_sha256"), F.lit("utf8-text-v1").alias("extraction_version"), F.lit(f"text-section-v1:{max_chars}:{overlap}").alias("chunking_version"))
    pages = _pages_of_texts(named)
    passages = chunk.chunks(pages.select("source_id", "version", "page", "text", "kind"), max_chars, overlap, carry=("kind",))
    passages = passages.withColumn("id", stable_id(F.lit("text-section-v1"), F.col("kind"), F.col("id"))).withColumn("article", F.lit(None).cast("string")).drop("kind")
    return documents, pages.drop("kind"), passages


def prepare_html(corpus_id: str, sources: DataFrame, selector: str, max_chars: int = chunk.MAX_CHARS, overlap: int = chunk.OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, passages) of captures ``sources(key, title, text[, regulation])``, ``text`` their HTML.

    Sections of the content element are the pages; passages get identifiers of their own kind,
    and keep article and section only where ``regulation`` says so.  Captures whose layout isn't
    as expected have no pages.
    """
    from evidentia.operators.sections import sections

    regulation = F.coalesce("regulation", F.lit(False)) if "regulation" in sources.columns else F.lit(False)
    named = sources.select("key", "title", F.col("text").alias("html"), stable_id(F.lit(corpus_id), F.col("key")).alias("source_id"), F.sha2("text", 256).alias("version"), regulation.alias("regulation"))
    recipe = F.lit(f"html-section-v1:{max_chars}:{overlap}")
    documents = named.select("source_id", "key", "title", F.lit("html").alias("kind"), F.col("version").alias("content_sha256"), F.lit("stdlib-html-v2").alias("extraction_version"), recipe.alias("chunking_version"))
    pages = sections(named.select(F.col("source_id").alias("key"), "title", "html", "version", "regulation"), selector, strict=False, carry=("version", "regulation")).where("error is null")
    pages = pages.select(F.col("key").alias("source_id"), "version", "page", "heading", "text", "regulation")
    found = chunk.chunks(pages, max_chars, overlap, strict=False, carry=("heading", "regulation"))
    kind = F.when(F.col("regulation"), "html-regulation-v1").otherwise("html-section-v1")
    passages = found.select(stable_id(kind, F.col("id")).alias("id"), "source_id", "version", "page", "start", "end", F.when(F.col("regulation"), F.col("article")).alias("article"), F.when(F.col("regulation"), F.col("heading")).alias("section"), "text")
    return documents, pages.drop("regulation"), passages


def prepare(corpus_id: str, sources: DataFrame, selector: str = "<article|main>", max_chars: int = chunk.MAX_CHARS, overlap: int = chunk.OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, passages) of ``sources(key, title, kind, text)`` of every kind, each prepared in its way."""
    known = F.col("kind").isin("html", "txt", "markdown")
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat("key", F.lit(": no way to prepare "), F.coalesce("kind", F.lit("null")))))
    text = F.when(F.col("kind") == "html", F.col("text")).otherwise(_unmarked("text"))
    return _of_kinds(corpus_id, sources.withColumns({"kind": kind, "text": text}), selector, max_chars, overlap)


def _of_kinds(corpus_id: str, sources: DataFrame, selector: str, max_chars: int, overlap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    web = prepare_html(corpus_id, sources.where("kind = 'html'").select("key", "title", "text"), selector, max_chars, overlap)
    plain = _texts(corpus_id, sources.where("kind <> 'html'"), max_chars, overlap)
    return tuple(a.unionByName(b.select(*a.columns)) for a, b in zip(web, plain, strict=True))


_NO_PAGES = "cast(array() as array<int>)"
_NO_LINES = "cast(array() as array<string>)"


def paged(corpus_id: str, sources: DataFrame, pages: DataFrame, max_chars: int = chunk.MAX_CHARS, overlap: int = chunk.OVERLAP, library: str = "pypdf") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, pages, passages, faults) of sources that come as pages, such as PDF files.

    ``sources(key, title, content_sha256[, regulation][, excluded_pages][, ignored_lines])``,
    ``pages(key, page, text[, blank])``.  A regulation keeps its section headings, and those of
    its pages that provably show nothing (``blank``) are excluded too.  Pages keep their raw text.

    ``faults(source_id, fault, page)``: pages to be excluded that there aren't, other pages that
    nothing can be cited from, and sources without a passage.
    """
    held = lambda df, c, default: F.coalesce(c, F.expr(default)) if c in df.columns else F.expr(default)
    regulation, excluded, ignored = held(sources, "regulation", "false"), held(sources, "excluded_pages", _NO_PAGES), held(sources, "ignored_lines", _NO_LINES)
    named = sources.select("key", "title", stable_id(F.lit(corpus_id), F.col("key")).alias("source_id"), F.col("content_sha256").alias("version"), regulation.alias("regulation"), excluded.alias("excluded_pages"), ignored.alias("ignored_lines"))
    text = F.coalesce("text", F.lit(""))
    shown = pages.select("key", "page", text.alias("text"), held(pages, "blank", "false").alias("_blank"), (T.stripped(text) != "").alias("_shown"))
    found = shown.join(named.drop("title"), "key")
    unseen = F.col("regulation") & F.col("_blank") & ~F.col("_shown")
    found = found.withColumn("excluded", F.array_contains("excluded_pages", F.col("page")) | unseen)
    also = found.where(unseen).groupBy("source_id").agg(F.collect_set("page").alias("_also"))
    recipe = F.concat(F.lit(f"{chunk.RECIPE}:{max_chars}:{overlap}"), F.when(F.col("regulation"), ":sections-v1").otherwise(""))
    documents = named.join(also, "source_id", "left").select(
        "source_id", "key", "title", F.lit("pdf").alias("kind"), F.col("version").alias("content_sha256"), F.lit(library).alias("extraction_version"), recipe.alias("chunking_version"),
        F.array_sort(F.array_union("excluded_pages", F.coalesce("_also", F.expr(_NO_PAGES)))).alias("excluded_pages"),
    )
    cuttable = found.select("source_id", "version", "page", "text", "excluded", "ignored_lines", "regulation")
    passages = chunk.chunks(cuttable, max_chars, overlap, F.col("regulation"), library, strict=False, carry=("regulation",)).drop("regulation")
    cited = passages.select("source_id", "page").distinct()
    mute = found.where("not excluded").join(cited, ["source_id", "page"], "left_anti")
    why = F.when(F.col("_shown"), "only ignored lines").otherwise("no native text")
    faults = preparation_faults(named, found, cited).unionByName(mute.select("source_id", why.alias("fault"), "page"))
    return documents, found.select("source_id", "version", "page", "text", "excluded"), passages, faults


def _stored(rows: DataFrame, path: str | None) -> DataFrame:
    if path is None:
        return rows
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def prepare_manifest(spark: SparkSession, path: str, extract=None, blanks=None, pattern: str = "*.pdf", store: str | None = None, max_chars: int = chunk.MAX_CHARS, overlap: int = chunk.OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``paged`` for the files that a manifest names, by paths from its own folder.

    ``extract`` and ``blanks`` read (key, content) into pages and blank pages; by default those
    of ``readers``, which need pypdf.  Their pages are used more than once: with ``store`` they are written there
    and reread.  Sources without a file are faults, and so are sources of the web, which come from captures.
    """
    from evidentia.sources import readers

    folder = path.rsplit("/", 1)[0]
    listed = readers.manifest(spark, path)
    corpus_id = F.col("corpus_id")
    name = F.element_at(F.split("path", rf"\Q{folder.split(':', 1)[-1].rstrip('/')}/\E"), -1)
    files = readers.files(spark, folder, pattern, nested=True).select(name.alias("_name"), "content")
    rows = listed.select(corpus_id, "key", "title", F.col("regulation").isNotNull().alias("regulation"), "excluded_pages", F.col("excluded_edge_lines").alias("ignored_lines"), F.col("web").isNotNull().alias("_web"), F.regexp_replace("local_path", r"^\./", "").alias("_name"))
    met = rows.join(files, "_name", "left")
    held = met.where("content is not null and not _web").withColumn("content_sha256", F.sha2("content", 256))
    shown = _stored((extract or readers.pdf_pages)(held.select("key", "content")), store)
    mute = (blanks or readers.blank_pages)(held.select("key", "content")).select("key", "page", F.lit(True).alias("blank"))
    first = listed.select("corpus_id").first()
    identity = first[0] if first else ""
    documents, pages, passages, faults = paged(identity, held.drop("content", "_web", "_name", "corpus_id"), shown.join(mute, ["key", "page"], "left"), max_chars, overlap)
    absent = met.where("_web or content is null").select(stable_id(F.lit(identity), F.col("key")).alias("source_id"), F.when(F.col("_web"), "comes from a capture").otherwise("no such file").alias("fault"), F.lit(None).cast("int").alias("page"))
    return documents, pages, passages, faults.unionByName(absent)


def prepare_catalog(corpus_id: str, captures: DataFrame, selector: str = "<article|main>", extract=None, store: str | None = None, max_chars: int = chunk.MAX_CHARS, overlap: int = chunk.OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, pages, passages, rejects) of captures of every format, each prepared in its way.

    ``captures(key, title, format, content_type, content[, excluded_pages][, ignored_lines])``.
    ``rejects(key, reject)``: what ``accept_content`` turns down, captures without content, texts that
    hold an evaluation artefact, and pages that can't be cited.  Lines are ignored in files made of pages alone.
    Pages of PDF files are written to ``store``, if given, and reread.
    """
    from evidentia.sources import readers

    judged = accept_content(captures)
    body = F.decode("content", "UTF-8")
    plain = F.col("format") != "pdf"
    reject = F.coalesce("reject", F.when(F.col("content").isNull(), "no content"), F.when(plain & T.leaks(body), "evaluation artefact"))
    judged = judged.withColumn("reject", reject)
    kept = judged.where("reject is null")
    texts = kept.where(plain).select("key", "title", F.col("format").alias("kind"), body.alias("text"))
    files = kept.where(~plain).withColumn("content_sha256", F.col("sha256"))
    shown = _stored((extract or readers.pdf_pages)(files.select("key", "content")), store)
    marked = shown.where(T.leaks(F.col("text"))).select("key").distinct()
    some = [c for c in ("excluded_pages", "ignored_lines") if c in captures.columns]
    sound = files.select("key", "title", "content_sha256", *some).join(marked, "key", "left_anti")
    *pdf, faults = paged(corpus_id, sound, shown, max_chars, overlap)
    # Unchecked: filters are pushed below checks that raise, and what they would stop is rejected here.
    other = _of_kinds(corpus_id, texts, selector, max_chars, overlap)
    documents, pages, passages = (a.unionByName(b, allowMissingColumns=True) for a, b in zip(other, pdf, strict=True))
    told = faults.join(pdf[0].select("source_id", "key"), "source_id").select("key", F.concat_ws(" ", "fault", "page").alias("reject"))
    told = told.unionByName(other[0].join(other[2].select("source_id"), "source_id", "left_anti").select("key", F.lit("no passage").alias("reject")))
    rejects = judged.where("reject is not null").select("key", "reject").unionByName(marked.select("key", F.lit("evaluation artefact").alias("reject"))).unionByName(told)
    return documents, pages, passages, rejects


def coverage(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """(source_id[, version], page, exact, covered) of every page.

    ``exact``: its passages are its text between their offsets; ``covered``: every visible
    character stands in one.  A page's passages meet as one row, which the page bounds; where both
    name a version, those of another one are none of its.
    """
    on = ["source_id", *(c for c in ("version",) if c in pages.columns and c in passages.columns), "page"]
    spans = passages.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("spans"))
    own = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]

    def faithful(text: list, spans: list) -> list[tuple]:
        out = []
        for body, found in zip(text, spans, strict=True):
            body = body or ""
            exact, covered, reach = True, True, 0
            for s in found or ():
                exact &= body[s["start"] : s["end"]] == s["text"]
                covered &= s["start"] <= reach or not body[reach : s["start"]].strip()
                reach = max(reach, s["end"])
            out.append((exact, covered and not body[reach:].strip()))
        return out

    rows = pages.join(spans.withColumnsRenamed({c: f"_{c}" for c in on}), own, "left").select(*on, "text", "spans")
    return by_slices(rows, ["text", "spans"], "exact boolean, covered boolean", faithful)


def source_coverage(sources: DataFrame, pages: DataFrame, passages: DataFrame) -> DataFrame:
    """``sources(source_id, version, text)`` without their text, with (exact, covered) over all their pages.

    A source without pages has no passage that could be wrong; it is covered if its text shows nothing.
    """
    per = coverage(pages, passages).groupBy(F.col("source_id").alias("_source"), F.col("version").alias("_version")).agg(F.bool_and("exact").alias("exact"), F.bool_and("covered").alias("covered"))
    blank = T.stripped(without_bom(F.coalesce("text", F.lit("")))) == ""
    rows = sources.withColumn("_blank", blank).drop("text").join(per, [F.col("source_id") == F.col("_source"), F.col("version") == F.col("_version")], "left")
    return rows.withColumns({"exact": F.coalesce("exact", F.lit(True)), "covered": F.coalesce("covered", "_blank")}).drop("_source", "_version", "_blank")


def violations(documents: DataFrame, pages: DataFrame, passages: DataFrame) -> DataFrame:
    """(rule, key, detail) of every broken rule; no rows for a sound corpus.

    Unique sources, pages and passages; a passage names its document's version and a page that
    exists and is not excluded, and is that page's text between its offsets.
    """
    found = []

    def add(rule: str, df: DataFrame, key, detail=None) -> None:
        found.append(df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")))

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    add("duplicate_source", repeated(documents, "source_id"), F.col("source_id"), F.col("n"))
    add("duplicate_page", repeated(pages, "source_id", "page"), F.concat_ws(":", "source_id", "page"), F.col("n"))
    add("duplicate_passage", repeated(passages, "id"), F.col("id"), F.col("n"))
    doc = documents.select(F.col("source_id").alias("_source"), F.col("content_sha256").alias("_sha"))
    page = pages.select(F.col("source_id").alias("_ps"), F.col("page").alias("_pp"), F.col("text").alias("_text"), *([F.col("excluded").alias("_excluded")] if "excluded" in pages.columns else [F.lit(False).alias("_excluded")]))
    joined = passages.join(doc, passages["source_id"] == doc["_source"], "left").join(page, (passages["source_id"] == page["_ps"]) & (passages["page"] == page["_pp"]), "left")
    bounds = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("_text"))
    same = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    met, known = F.col("_pp").isNotNull(), F.col("_sha").isNotNull()
    # One pass: all rules that a passage breaks.
    rules = {
        "unknown_source": F.col("_source").isNull(), "wrong_version": known & ~F.col("version").eqNullSafe(F.col("_sha")), "unknown_page": ~met,
        "excluded_page": F.col("_excluded"), "bad_offsets": met & ~bounds, "text_differs": met & bounds & ~same,
    }
    told = F.array(*(F.when(broken, F.struct(F.lit(rule).alias("rule"), F.col("page" if rule in ("unknown_page", "excluded_page") else "_none").cast("string").alias("detail"))) for rule, broken in rules.items()))
    broken = joined.withColumn("_none", F.lit(None).cast("string")).select(F.col("id").cast("string").alias("key"), F.inline(F.array_compact(told)))
    found.append(broken.select("rule", "key", "detail"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def preparation_faults(sources: DataFrame, pages: DataFrame, passages: DataFrame) -> DataFrame:
    """(source_id, fault, page) of sources that can't be prepared as asked.

    ``sources(source_id, excluded_pages)``, ``pages(source_id, page)``, ``passages(source_id)``: a
    page to be excluded has to exist, and something has to be left to be cited.
    """
    asked = sources.select("source_id", F.explode(F.array_distinct("excluded_pages")).alias("page"))
    absent = asked.join(pages.select("source_id", "page").distinct(), ["source_id", "page"], "left_anti").select("source_id", F.lit("excluded page doesn't exist").alias("fault"), "page")
    empty = sources.join(passages.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("no passage").alias("fault"), F.lit(None).cast("int").alias("page"))
    return absent.unionByName(empty)


def manifest_violations(sources: DataFrame) -> DataFrame:
    """(rule, key) for source lists: unique keys, excluded pages unique and from 1, an address."""
    twice = sources.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_key").alias("rule"), "key")
    out = twice
    if "excluded_pages" in sources.columns:
        bad = F.exists("excluded_pages", lambda p: p < 1) | (F.size(F.array_distinct("excluded_pages")) != F.size("excluded_pages"))
        out = out.unionByName(sources.where(bad).select(F.lit("excluded_pages").alias("rule"), "key"))
    if {"url", "local_path"} <= set(sources.columns):
        out = out.unionByName(sources.where("url is null and local_path is null").select(F.lit("no_address").alias("rule"), "key"))
    return out


def accept_content(captures: DataFrame) -> DataFrame:
    """``captures(key, format, content_type, content)`` with ``reject``: why not, or null.

    Too large, a content type that is not the format's, or bytes (or none) seen under a smaller key.
    """
    known = F.lit(False)
    for name, kinds in CONTENT_TYPES.items():
        known = known | ((F.col("format") == name) & mime(F.col("content_type")).isin(*kinds))
    digest = captures.withColumn("sha256", F.sha2("content", 256))
    first = digest.groupBy(F.col("sha256").alias("_sha256")).agg(F.min("key").alias("_first"))
    reject = F.when(F.octet_length("content") > MAX_BYTES, "too_large").when(~F.coalesce(known, F.lit(False)), "content_type").when(F.col("_first") != F.col("key"), "duplicate_content")
    return digest.join(first, F.col("sha256").eqNullSafe(F.col("_sha256"))).withColumn("reject", reject).drop("_first", "_sha256")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
