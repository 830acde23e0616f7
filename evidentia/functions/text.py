"""Text functions: words, prefix terms, overlap metrics and their parts.

Everything here stays in the JVM, except the functions marked "Arrow", which need Unicode
tables or algorithms that Spark SQL lacks and work on whole batches.
"""

from __future__ import annotations

import difflib
import functools
import itertools
import json
import operator
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Words that carry no topic in the lexical ranking (fixed values).
STOP_WORDS = (
    "a ali ampak bi bil bila bilo biti bo bodo bom da do in is iz je jih jo kaj kako kam kdaj ki ko kot lahko me mi na naj ne ni o ob od od pa po pri "
    "s se sem si so ta te ter the to v ve za z že what when how can i my"
).split()
#: Markers of evaluation artefacts, which must not be among the sources (fixed values).
LEAK_MARKERS = ('"expected_answer"', '"supporting_passages"', '"reference_answer"')
#: Least length and words of a passage that counts as an answer.
SUBSTANTIVE_CHARS, SUBSTANTIVE_WORDS = 80, 12

WORD = r"[\p{L}\p{N}_]+"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"


#: White space and ends of lines, as the standard library's ``split`` and ``splitlines`` take them (fixed values).
_BLANK = "\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_LINE_END = "\\r\\n|[\\n-\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"


#: White space as the standard library's ``strip`` takes it (fixed values).
_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _signs(c: Column, *places: int) -> Column:
    """Whether the bytes at some places, from 1 or from -1 at the end, are visible ASCII signs: of the text no more is read."""
    signs = [F.substring(c.cast("binary"), at, 1) for at in places]
    return functools.reduce(operator.and_, ((b > F.lit(b" ")) & (b < F.lit(b"\x7f")) for b in signs))


def stripped(c: Column) -> Column:
    """Text without white space at its ends, which alone are looked at first: Spark's trim reads all of the text."""
    return F.when(_signs(c, 1, -1), c).otherwise(F.btrim(c, F.lit(_SPACES)))


def right_stripped(c: Column) -> Column:
    return F.when(_signs(c, -1), c).otherwise(F.rtrim(c, F.lit(_SPACES)))


def tidied(c: Column) -> Column:
    """Lines with single spaces, empty ones dropped."""
    lines = F.transform(F.split(c, _LINE_END), lambda x: F.trim(F.regexp_replace(x, f"[{_BLANK}]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def folded(c: Column) -> Column:
    """Case-folded text: lower case, with sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def words(c: Column) -> Column:
    """Words of the folded text, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(folded(c), F.lit(WORD), F.lit(0)), F.expr("cast(array() as array<string>)"))


def normalized(c: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(c), " ")


def terms(c: Column) -> Column:
    """Distinct five-letter prefixes of words over two letters that are no stop words."""
    found = F.coalesce(F.regexp_extract_all(folded(c), F.lit(LETTERS), F.lit(0)), F.expr("cast(array() as array<string>)"))
    stop = list(dict.fromkeys(STOP_WORDS))
    return F.array_distinct(F.transform(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop)), lambda w: F.substring(w, 1, 5)))


def years(c: Column) -> Column:
    """Distinct years of this century that a text names."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])20[0-9]{2}(?![\p{L}\p{N}_])"), F.lit(0)))


def numbers(c: Column) -> Column:
    """Distinct numbers of a text, decimals with point or comma."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0)))


def substantive(c: Column) -> Column:
    """Long enough, in characters and words, to be an answer and no heading."""
    return (F.length(F.trim(c)) >= SUBSTANTIVE_CHARS) & (F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))) >= SUBSTANTIVE_WORDS)


def leaks(c: Column) -> Column:
    """Whether a source text holds a marker of an evaluation artefact."""
    found = F.lit(False)
    for marker in LEAK_MARKERS:
        found = found | F.contains(c, F.lit(marker))
    return found


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def lexical_cosine(a: Column, b: Column) -> Column:
    """Cosine of two term sets as 0/1 vectors: overlap over the root of the sizes' product."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b))).otherwise(F.lit(0.0))


def exact_match(prediction: Column, reference: Column) -> Column:
    """1 if the normalized texts are equal; null for a reference without words."""
    a, b = normalized(prediction), normalized(reference)
    return F.when(b != "", (a == b).cast("double"))


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the words as multisets; 0 for an empty prediction, null for an empty reference.

    The words of both are sorted together once, those of one counted up and those of the other
    down: what is left of a word isn't common.
    """

    def score(found: Column) -> Column:
        a, b = found["a"], found["b"]
        sign = lambda words_, by: F.transform(words_, lambda w: F.struct(w.alias("w"), F.lit(by).alias("by")))
        state = lambda w, by, rest: F.struct(w.alias("w"), by.alias("by"), rest.alias("rest"))
        step = lambda s, x: F.when(s["w"] == x["w"], state(s["w"], s["by"] + x["by"], s["rest"])).otherwise(state(x["w"], x["by"], s["rest"] + F.abs(s["by"])))
        rest = F.aggregate(F.sort_array(F.concat(sign(a, 1), sign(b, -1))), state(F.lit(""), F.lit(0), F.lit(0)), step, lambda s: s["rest"] + F.abs(s["by"]))
        n = F.size(a) + F.size(b)
        return F.when(F.size(b) == 0, F.lit(None).cast("double")).when(F.size(a) == 0, F.lit(0.0)).otherwise((n - rest) / n)

    both = F.array(F.struct(words(prediction).alias("a"), words(reference).alias("b")))  # the words once, not for each use
    return F.get(F.transform(both, score), F.lit(0))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def sign_places(text: str) -> dict[str, bytes]:
    """Where each sign of a text stands: a bit per place, lowest first, in bytes with a bit to spare."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    signs, width = np.unique(codes), len(text) // 8 + 1
    return {chr(c): np.packbits(codes == c, bitorder="little").tobytes().ljust(width, b"\0") for c in signs.tolist()}


def longest_common_of(texts: list[tuple[int, dict[str, bytes]]], b: str) -> list[int]:
    """``longest_common`` of each of many texts, given by length and ``sign_places``, with ``b``.

    They stand in one number, a lane each, whose spare bit takes what is carried out of it: a step
    for a sign of ``b`` costs little more for all of them than for one.
    """
    widths = [n // 8 + 1 for n, _ in texts]
    joined = lambda lanes: int.from_bytes(b"".join(lanes), "little")
    none = [bytes(w) for w in widths]
    at = {s: joined(p.get(s, z) for (_, p), z in zip(texts, none, strict=True)) for s in set(b)}
    full = row = joined(((1 << n) - 1).to_bytes(w, "little") for (n, _), w in zip(texts, widths, strict=True))
    for s in b:
        hit = row & at[s]
        row = ((row + hit) | (row - hit)) & full
    left, ends = row.to_bytes(sum(widths), "little"), list(itertools.accumulate(widths))
    return [n - int.from_bytes(left[e - w : e], "little").bit_count() for (n, _), w, e in zip(texts, widths, ends, strict=True)]


def plain_words(text: str | None) -> list[str]:
    """Words after compatibility normalization and full case folding."""
    import regex

    return regex.findall(r"[\p{L}\p{N}_]+", unicodedata.normalize("NFKC", text or "").casefold())


@F.pandas_udf(DoubleType())
def rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words. Arrow."""
    out = []
    for p, r in zip(prediction, reference, strict=True):
        a, b = plain_words(p), plain_words(r)
        common = longest_common(a, b) if a and b else 0
        out.append(None if not b else 2 * common / (len(a) + len(b)) if common else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(StructType([StructField(m, DoubleType()) for m in ("exact_match", "token_f1", "rouge_l")]))
def overlap_metrics(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """The three overlap metrics over fully normalized words. Arrow."""
    rows = []
    for p, r in zip(prediction, reference, strict=True):
        a, b = plain_words(p), plain_words(r)
        if not b:
            rows.append((None, None, None))
            continue
        shared = sum((Counter(a) & Counter(b)).values())
        lcs = longest_common(a, b) if a else 0
        size = len(a) + len(b)
        rows.append((float(a == b), 2 * shared / size if a else 0.0, 2 * lcs / size if a else 0.0))
    return pd.DataFrame(rows, columns=["exact_match", "token_f1", "rouge_l"], dtype="float64")


@F.pandas_udf(ArrayType(StringType()))
def exact_words(text: pd.Series) -> pd.Series:
    """Words after compatibility normalization and full case folding. Arrow."""
    return text.map(plain_words)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by matching blocks (the standard library's ratio). Arrow."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def normalized_title(text: pd.Series) -> pd.Series:
    """Composed, case-folded text with single spaces. Arrow."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))


#: Scheme, authority, path and query of any address (RFC 3986, appendix B).
_ADDRESS = re.compile(r"(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?")
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")
# Bytes that stand for themselves in a path and in a query (fixed values).
_UNRESERVED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
_PATH_BYTES, _QUERY_BYTES = frozenset(_UNRESERVED + b"/!$&'()*+,;=:@"), frozenset(_UNRESERVED + b"=&?/:;+,%@")


def _escaped(part: str, plain: frozenset[int]) -> str:
    """Escapes read, then written anew for every byte that isn't plain; bytes that are no text become U+FFFD."""
    raw = _ESCAPE.sub(lambda m: bytes.fromhex(m[1].decode()), part.encode("utf-8", "surrogatepass"))
    return "".join(chr(b) if b in plain else f"%{b:02X}" for b in raw.decode("utf-8", "replace").encode())


def clean_url(url: str | None) -> str | None:
    """An address without fragment and outer or line-breaking white space, escaped once; see ``canonical_url``."""
    if url is None:
        return None
    scheme, host, path, query = _ADDRESS.match(re.sub(r"[\t\r\n]", "", url.lstrip("".join(map(chr, range(33)))))).groups()
    start = f"{scheme.lower()}:" if scheme else ""
    start += f"//{host.lower()}" if host else ""
    return start + _escaped(path, _PATH_BYTES) + (f"?{_escaped(query, _QUERY_BYTES)}" if query else "")


@F.pandas_udf(StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    """A URL without fragment, its host in lower case, path and query quoted once. Arrow."""
    return url.map(clean_url)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """A JSON value written anew with sorted keys and non-ASCII kept. Arrow."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True))
