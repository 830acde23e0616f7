"""Text, identity and vector functions against hand values."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from evidentia.functions import dom, identity, vectors
from evidentia.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "prediction,reference,em,f1,rouge",
    [("ČLEN, MODER!", "člen moder", 1, 1, 1), ("a a b", "a b b", 0, 2 / 3, 2 / 3), ("a b", "b a", 0, 1, 0.5), ("", "moder", 0, 0, 0), ("Straße", "STRASSE", 1, 1, 1)],
)
def test_overlap_metrics(spark, prediction, reference, em, f1, rouge):
    m = one(spark, T.overlap_metrics("p", "r"), p=prediction, r=reference)
    assert (m.exact_match, m.token_f1, m.rouge_l) == pytest.approx((em, f1, rouge))
    assert one(spark, T.exact_match(F.col("p"), F.col("r")), p=prediction, r=reference) == em
    assert one(spark, T.token_f1(F.col("p"), F.col("r")), p=prediction, r=reference) == pytest.approx(f1)
    assert one(spark, T.rouge_l("p", "r"), p=prediction, r=reference) == pytest.approx(rouge)


def test_a_reference_without_words_has_no_score(spark):
    assert one(spark, T.token_f1(F.col("p"), F.col("r")), p="answer", r="!!!") is None
    assert one(spark, T.overlap_metrics("p", "r"), p="answer", r="!!!").exact_match is None


def test_longest_common():
    assert T.longest_common(list("abcbdab"), list("bdcaba")) == 4
    assert T.longest_common([], ["a"]) == 0


def test_terms_and_years(spark):
    assert sorted(one(spark, T.terms(F.col("t")), t="Kako se prijavim na izpit? Izpitni roki 2024, ab")) == ["izpit", "prija", "roki"]
    assert one(spark, T.years(F.col("t")), t="od 2024/2025, x2024, 12024 in 2024") == ["2024", "2025"]
    assert one(spark, T.numbers(F.col("t")), t="3,5 od 10 in 3,5") == ["3,5", "10"]
    assert one(spark, T.terms(F.col("t")), t=None) == []


def test_jaccard_of_nothing_is_one(spark):
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)


@pytest.mark.parametrize("parts", [("a", "b"), ('quo"te', "back\\slash"), ("čšž\n", "\ttab"), ("", "1")])
def test_stable_id(spark, parts):
    want = str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(list(parts), ensure_ascii=False)))
    assert one(spark, identity.stable_id(F.col("a"), F.col("b")), a=parts[0], b=parts[1]) == want


def test_addresses(spark):
    u = F.col("u")
    assert one(spark, T.canonical_url("u"), u="HTTPS://Fri.uni-lj.si/a b/č%20d?x=1 2#frag") == "https://fri.uni-lj.si/a%20b/%C4%8D%20d?x=1%202"
    assert one(spark, identity.document_type(u), u="https://e.org/a.b/File.PDF?x=.doc") == "pdf"
    assert one(spark, identity.document_type(u), u="https://e.org/page") == "html"
    hosts = ["e.org"]
    assert [one(spark, identity.allowed_url(u, hosts), u=x) for x in ("https://e.org/a", "https://E.org:443", "http://e.org", "https://e.org:8443/", "https://me@e.org/", "https://x.org/", None)] == [True, True, False, False, False, False, False]
    assert one(spark, identity.citation_url(u, F.lit(3), F.lit(False), F.lit(None).cast("string")), u="https://e.org/f.pdf#old") == "https://e.org/f.pdf#page=3"
    assert one(spark, identity.citation_url(u, F.lit(3), F.lit(True), F.lit("a b")), u="https://e.org/") == "https://e.org/#a%20b"
    assert one(spark, identity.citation_url(u, F.lit(3), F.lit(True), F.lit("a")), u=None) == ""


def test_labels_and_categories(spark):
    t = F.col("t")
    assert str(one(spark, identity.labelled_date(t, "velja(?:jo)? od"), t="Velja od: 3. 10. 2024")) == "2024-10-03"
    assert one(spark, identity.labelled_date(t, "velja(?:jo)? od"), t="velja od 31. 2. 2024") is None
    assert one(spark, identity.subcategory(t, F.lit("general")), t="študijski red") == "study_rules"
    assert one(spark, identity.subcategory(t, F.lit("general")), t="študijska pravila") == "general"
    codes = spark.createDataFrame([(401,), (403,), (429,), (500,), (404,)], "s int")
    assert [r.c for r in codes.select(identity.failure_category(F.col("s")).alias("c")).collect()] == ["authentication", "permission", "rate_limit", "provider_server", "provider_request"]
    assert one(spark, identity.valid_namespace(t), t="mag_rag") and not one(spark, identity.valid_namespace(t), t="admin")
    assert one(spark, T.normalized_title("t"), t=" Člen\n A ") == "člen a"
    assert one(spark, T.canonical_json("t"), t='{"b": 1, "a": "č"}') == '{"a": "č", "b": 1}'


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.x for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None
    rows = [(None,), ([1.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([1.0, 2.0],)]
    bad = spark.createDataFrame(rows, "a array<float>").select(vectors.problem(F.col("a"), 2).alias("x")).collect()
    assert [r.x for r in bad] == ["missing", "dimension", "not_finite", "zero", None]


def test_tables():
    table = dom.tree("<table><tr><td colspan=2>Title</td></tr><tr><td>a</td><td>b</td></tr></table>").find("table")[0]
    assert dom.table_text(table) == "Title\na | b"
    merged = dom.tree("<table><tr><td>x</td><td>y</td></tr><tr><td colspan=2>a</td></tr></table>").find("table")[0]
    with pytest.raises(dom.LayoutError):
        dom.table_text(merged)


def test_token_f1_reads_long_texts_once(spark):
    """Work grows with the words, not with their square: each word used to read both texts again."""
    import time

    words = [f"w{i}" for i in range(8000)]
    a, b = " ".join([*words, "w1", "w1"]), " ".join([*words[::2], "w1", "w1", "w1"])
    began = time.monotonic()
    assert one(spark, T.token_f1(F.col("p"), F.col("r")), p=a, r=b) == pytest.approx(2 * 4003 / (8002 + 4003))
    assert time.monotonic() - began < 15
