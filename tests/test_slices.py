"""What a task holds and reads of a text: no more than a slice, and no more often than needed."""

import json
import random
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.functions import dom, identity
from evidentia.functions import text as T
from evidentia.operators import chunk, sections, sizes


def test_long_texts_go_through_one_at_a_time():
    """A slice used to hold 64 rows at least, of any length."""
    assert list(sizes.slices([pa.array(["x" * 300_000] * 20)])) == [(i, i + 1) for i in range(20)]


def test_passages_without_ignored_lines_send_texts_alone(spark):
    pages = spark.createDataFrame([("s", "v", 1, "1. člen\nbeta")], "source_id string, version string, page int, text string")
    found = chunk.chunks(pages)
    assert "ignored_lines" not in found._jdf.queryExecution().analyzed().toString() and found.first().text == "1. člen\nbeta"


def test_parts_of_identifiers_are_escaped_only_if_they_have_to_be(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice('\\"\n\r\t\b\fab/é😀') for _ in range(rng.randrange(6))), i, f"{i} ab") for i in range(300)]
    df = spark.createDataFrame(rows, "s string, i int, t string")
    one = F.lit("r")
    found = df.select("*", identity.stable_id(F.col("s"), F.lit("k")).alias("a"), identity.chunk_id(F.col("s"), one, one, F.col("i"), F.col("i"), F.col("i"), F.col("t")).alias("b"))
    name = lambda *parts: str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts, ensure_ascii=False)))
    for r in found.withColumn("h", F.sha2("t", 256)).collect():
        n = str(r.i)
        assert (r.a, r.b) == (name(r.s, "k"), name(r.s, "r", "r", n, n, n, r.h))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 6 * 5 * 7  # in six places of a name; 6 * 9 * 7 before


def test_line_ends_and_order_marks(spark):
    rng = random.Random(5)
    rows = [("\ufeff" * rng.randrange(3) + "".join(rng.choice("ab\n\r\ufeff") for _ in range(rng.randrange(7))),) for _ in range(300)]
    plain = identity.without_bom(F.col("t"))
    for r in spark.createDataFrame([*rows, (None,)], "t string").select("t", plain.alias("got")).collect():
        assert r.got == (None if r.t is None else r.t.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
    assert "regexp_replace" not in str(plain)


def test_text_between_two_starts_is_one_mark():
    """Each piece of text used to be a mark, a row of an array for every element of a page."""
    root = dom.tree("<main>a<p>b <b>c</b></p><p>d</p><table><tr><td>e</td><td>f</td></tr></table><h2 id=h>T</h2>g<br>h</main>")
    marks = sections.content_marks(sections.chosen(root, "<main>"))
    assert marks == [(True, "", None), (False, "ab c\nd\n\ne | f\n", None), (True, "T", "h"), (False, "g\nh", None)]


def test_texts_in_lists_of_structs_count():
    """They used to count 8 bytes each, so that 64 pages' passages were held at a time."""
    spans = pa.array([[{"start": 0, "end": 1, "text": "x" * 200_000}] * 2] * 5 + [None, []])
    assert list(sizes.slices([spans])) == [(i, i + 1) for i in range(4)] + [(4, 5), (5, 7)]


def test_ends_of_texts_are_looked_at_before_they_are_trimmed(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice([*T._SPACES, *"  \na~!é\x00\x1c\x7f\u200b😀"]) for _ in range(rng.randrange(9))),) for _ in range(2000)]
    both, right = T.stripped(F.col("t")), T.right_stripped(F.col("t"))
    for r in spark.createDataFrame([*rows, (None,)], "t string").select("t", both.alias("both"), right.alias("right")).collect():
        assert (r.both, r.right) == ((None, None) if r.t is None else (r.t.strip(T._SPACES), r.t.rstrip(T._SPACES)))
    assert str(both).startswith("Column<'CASE WHEN") and str(right).startswith("Column<'CASE WHEN")
