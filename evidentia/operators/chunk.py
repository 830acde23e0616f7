"""Pages to passages with exact offsets.

Each page is read once, where it comes from (Arrow, in slices of few rows): its headings, its body
and the cuts of every segment, with the article and section that the page itself says.  What a page
takes over from the pages before it is a window over pages; each carries its cuts, so no text is
repeated and the source, sorted, is never one group in memory.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.identity import chunk_id
from evidentia.operators.sizes import by_slices

MAX_CHARS, OVERLAP = 1400, 180
RECIPE = "page-article-v1"

# Headings of the sources (fixed patterns).
ARTICLE = re.compile(r"^[ \t]*(\d+[a-z]?)\.[ \t]*člen[ \t\r]*$", re.M | re.I)
SECTION = re.compile(r"^[ \t]*(?:[IVXLCDM]+\.[ \t]+\S.*|Končne določbe[ \t\r]*)$", re.M)

_CUTS = "cuts array<struct<start:int,end:int,text:string,known:boolean,article:string,section:string>>, headed boolean, last_article string, last_section string"


class ChunkError(ValueError):
    """Pages that can't be cut faithfully."""


def page_segments(text: str, ignored: frozenset[str]) -> list[tuple] | None:
    """(n, start, stop, kind, label) between headings; None if only ignored lines are left.

    The body runs from the first line kept to the last one; ignored lines inside it stay.
    """
    kept = lambda line: (line := " ".join(line.split())) and line not in ignored
    top = next((m for m in re.finditer(r"[^\n]+", text) if kept(m[0])), None)
    if top is None:
        return None
    first, last = top.start(), len(text)
    while not kept(text[(start := text.rfind("\n", 0, last) + 1) : last]):
        last = start - 1
    heads = [(m.start(), "article", m[1]) for m in ARTICLE.finditer(text)] + [(m.start(), "section", m[0].strip()) for m in SECTION.finditer(text)]
    marks = [(first, "body", None), *sorted(h for h in heads if first <= h[0] < last)]
    stops = [m[0] for m in marks[1:]] + [last]
    return [(n, start, stop, kind, label) for n, ((start, kind, label), stop) in enumerate(zip(marks, stops, strict=True))]


def cuts(text: str, start: int, stop: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters, cut at the last white space past the middle if any."""
    out = []
    while start < stop:
        end = min(start + most, stop)
        if end < stop:
            least, gap = start + most // 2, end
            while gap > least and not text[gap - 1].isspace():
                gap -= 1
            while gap > least and text[gap - 1].isspace():
                gap -= 1
            if gap > least:
                end = gap
        piece = text[start:end]
        left, right = start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip())
        if left < right:
            out.append((left, right))
        if end == stop:
            break
        start = max(start + 1, end - overlap)
    return out


def chunks(
    pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, preserve_sections: bool | Column = False, library: str = "text", strict: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Passages of ``pages(source_id, version, page, text[, excluded][, ignored_lines])``.

    Returns ``id, source_id, version, page, start, end, article, section, text`` and the pages' columns to ``carry``.  Excluded
    pages, and gaps in the page numbers, reset article and section.  ``strict`` stops on pages
    without usable text; otherwise such pages have no passages.  ``preserve_sections`` may be a
    condition on the columns to ``carry``.
    """
    if max_chars < 100 or not 0 <= overlap < max_chars:
        raise ChunkError("passages need at least 100 characters and an overlap below that")
    if "excluded" not in pages.columns:
        pages = pages.withColumn("excluded", F.lit(False))
    read_of = ["text", *(c for c in pages.columns if c == "ignored_lines")]  # no column of nulls goes through Arrow

    def read(text: list, ignored: list | None = None) -> list[tuple]:
        out = []
        for body, lines in zip(text, ignored or itertools.repeat(None, len(text)), strict=True):
            body = body or ""
            found = page_segments(body, frozenset(" ".join(x.split()) for x in lines) if lines is not None else frozenset())
            if found is None and strict:
                raise ChunkError("a page has no native text or only ignored lines; review or exclude it")
            rows, headed, article, section = [], False, None, None
            for _, start, stop, kind, label in found or []:
                if kind == "article":
                    headed, article = True, label
                elif kind == "section":
                    headed, article, section = True, None, label
                rows += [{"start": a, "end": b, "text": body[a:b], "known": headed, "article": article, "section": section} for a, b in cuts(body, start, stop, max_chars, overlap)]
            out.append((rows, headed, article, section))
        return out

    recipe = F.lit(f"{RECIPE}:{library}:{max_chars}:{overlap}")
    if isinstance(preserve_sections, Column):
        recipe = F.concat(recipe, F.when(preserve_sections, ":sections-v1").otherwise(""))
    elif preserve_sections:
        recipe = F.concat(recipe, F.lit(":sections-v1"))
    source = Window.partitionBy("source_id", "version").orderBy("page")
    live = pages.where(~F.coalesce("excluded", F.lit(False))).select("source_id", "version", "page", *carry, *read_of)
    # A gap, an excluded page among them, starts a new island of pages.
    islands = by_slices(live, read_of, _CUTS, read).withColumn("_new", (F.col("page") != F.coalesce(F.lag("page").over(source) + 1, F.lit(1))).cast("int"))
    pages = islands.withColumn("_island", F.sum("_new").over(source))
    before = Window.partitionBy("source_id", "version", "_island").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("headed"), F.struct(F.col("last_article").alias("article")))
    pages = pages.withColumns({"_article": F.last(mark, ignorenulls=True).over(before)["article"], "_section": F.last("last_section", ignorenulls=True).over(before)})
    cut = pages.select("source_id", "version", "page", *carry, "_article", "_section", F.inline("cuts"))
    article = F.when(F.col("known"), F.col("article")).otherwise(F.col("_article"))
    if isinstance(preserve_sections, bool):
        preserve_sections = F.lit(preserve_sections)
    section = F.when(preserve_sections, F.coalesce("section", "_section"))
    ident = chunk_id(F.col("source_id"), F.col("version"), recipe, F.col("page"), F.col("start"), F.col("end"), F.col("text"))
    return cut.select(ident.alias("id"), "source_id", "version", "page", "start", "end", article.alias("article"), section.alias("section"), "text", *carry)
