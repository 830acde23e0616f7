"""Deterministic identifiers, addresses and labels, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of URLs, from the UUID standard (fixed value).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
#: Hosts, kinds and markers that sources are judged by (fixed values).
DOCUMENT_SUFFIXES = ("pdf", "doc", "docx")
FAMILIES = [
    ("študijsk", "study_rules"),
    ("statut", "statute"),
    ("višji letnik", "student_status"),
    ("disciplinsk", "disciplinary"),
    ("tutor", "tutoring"),
    ("izmenjav", "international_exchange"),
    ("prešern", "preseren_awards"),
]
RESERVED_NAMESPACES = ("admin", "local", "config", "system")


def json_string(c: Column) -> Column:
    """A text as a JSON string literal, non-ASCII kept.  It is looked through once, and written anew only if it has to be."""
    escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    for sign, code in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\b", r"\\b"), ("\f", r"\\f")):
        escaped = F.regexp_replace(escaped, sign if sign != "\b" else r"\x08", code)
    return _quoted(F.when(c.rlike(r'[\\"\n\r\t\x08\f]'), escaped).otherwise(c))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def stable_id(*parts: Column) -> Column:
    """Name-based UUID (version 5) of the JSON list of the parts."""
    return _uuid(*(json_string(p) for p in parts))


def _uuid(*literals: Column) -> Column:
    name = F.concat(F.lit("["), F.concat_ws(", ", *literals), F.lit("]"))
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(source_id: Column, version: Column, recipe: Column, page: Column, start: Column, end: Column, text: Column) -> Column:
    """Identity of a passage: where it is, how it was cut, and what it says."""
    plain = (page.cast("string"), start.cast("string"), end.cast("string"), F.sha2(text, 256))  # nothing to escape
    return _uuid(*map(json_string, (source_id, version, recipe)), *map(_quoted, plain))


def document_type(url: Column) -> Column:
    """Kind of a document by the suffix of its path."""
    path = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(.*)$", 1)
    suffix = F.lower(F.regexp_extract(path, r"([^.]*)$", 1))
    return F.when(suffix.isin(*DOCUMENT_SUFFIXES), suffix).otherwise("html")


def citation_url(url: Column, page: Column, is_web: Column, anchor: Column) -> Column:
    """Address of a passage: a section's anchor on the web, else a page of the file."""
    base = F.regexp_replace(url, "#.*$", "")
    marked = F.when(anchor.isNotNull() & (anchor != ""), F.concat(base, F.lit("#"), F.replace(F.url_encode(anchor), F.lit("+"), F.lit("%20")))).otherwise(base)
    return F.when(url.isNull(), "").when(is_web, marked).otherwise(F.concat(base, F.lit("#page="), page.cast("string")))


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """HTTPS, a known host, the usual port, and no user in it."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#@]*)(?::443)?(?=[/?#]|$)", 1))
    return F.coalesce(host.isin(*hosts), F.lit(False))


def mime(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def labelled_date(text: Column, label: str) -> Column:
    """The date after a label, written as day. month. year; null if none or no such day."""
    pattern = rf"(?i){label}\s*:?\s*([0-9]{{1,2}})\s*\.\s*([0-9]{{1,2}})\s*\.\s*([0-9]{{4}})"
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws(".", *parts), "d.M.yyyy"))


def subcategory(title: Column, section: Column) -> Column:
    """Family of a rule by markers in its (normalized) title, else its section."""
    out = section
    for marker, name in reversed(FAMILIES):
        hit = F.contains(title, F.lit(marker))
        if marker == FAMILIES[0][0]:
            hit = hit & F.contains(title, F.lit("red"))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def source_key(title: Column, section: Column) -> Column:
    """Key of a source from its (normalized) section and title, whatever its address."""
    return F.concat(F.lit("fri-"), F.substring(F.sha2(F.concat(section, F.lit("\n"), title), 256), 1, 24))


def failure_category(status: Column) -> Column:
    """Category of an HTTP failure."""
    named = F.when(status == 401, "authentication").when(status == 403, "permission").when(status == 429, "rate_limit")
    return named.when(status >= 500, "provider_server").otherwise("provider_request")


def request_id(c: Column) -> Column:
    """A request id, if it has the shape of a UUID."""
    return F.when(c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(c))


def valid_namespace(c: Column) -> Column:
    return c.rlike(r"^[a-z][a-z0-9_]{2,47}$") & ~c.isin(*RESERVED_NAMESPACES)


def without_bom(c: Column) -> Column:
    """Text without a byte order mark, line ends as \\n."""
    unmarked = F.when(F.startswith(c, F.lit("\ufeff")), F.substring(c, 2, 2**31 - 1)).otherwise(c)
    ended = F.replace(F.replace(unmarked, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.contains(c, F.lit("\r")), ended).otherwise(unmarked)
