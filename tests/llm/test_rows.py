"""Operators on single rows and whole tables: quality, PII, mixing, packing, sharding, WARC, HTML, toxicity."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import bpe, common, html_extract, mixing, packing, pii, quality_rules, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# quality rules


def counted(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = ["", None, " \n\t ", "a b c d e a b c d e", "x\nx\ny\n x\n\n", "w " * 3000, "é # 日本\x0b😀 |<a>&"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))).replace("c a", "c\na") for _ in range(60)]
    got = {r.doc_id: r for r in quality_rules.assess(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = counted(t or "")
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == want
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i].base_failed and got[i].kept)


def plain_texts(n, rng, marks):
    """Texts of 60 words of which about the given share ends in a comma."""
    return [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) + ("," if rng.random() < marks else "") for _ in range(60)) for _ in range(n)]


def test_quality_cutoffs_are_learned(spark):
    """The same text passes in one group and fails in another: no constant could tell."""
    rng = random.Random(3)
    rows = [("en", f"prose{i % 4}", t) for i, t in enumerate(plain_texts(300, rng, 0.1))] + [("en", "lists", t) for t in plain_texts(60, rng, 0.9)]
    probe = plain_texts(1, rng, 0.95)[0]
    rows += [("en", "prose0", probe), ("en", "lists", probe)]
    df = spark.createDataFrame([(i, t, lang, source, 0) for i, (lang, source, t) in enumerate(rows)], DOCS)
    got = {r.doc_id: r for r in quality_rules.assess(df).collect()}
    assert not got[360].kept and got[361].kept and sum(not r.kept for r in got.values()) == 1
    cutoffs = {(r.lang, r.source): r for r in quality_rules.thresholds(quality_rules.measures(df)).collect()}
    assert cutoffs["en", "lists"].high_mark_ratio > 3 * cutoffs["en", "prose0"].high_mark_ratio
    assert len({round(r.high_mark_ratio + r.by_mark_ratio, 9) for r in cutoffs.values()}) == 5


def test_quality_small_groups_follow_wider_ones(spark):
    rng = random.Random(4)
    rows = [("en", "a", t) for t in plain_texts(100, rng, 0.1)]
    signs = plain_texts(1, rng, 0)[0].replace(" ", "### ")
    rows += [("en", "b", signs), ("en", "c", rows[0][2]), (None, None, rows[1][2])]
    df = spark.createDataFrame([(i, t, lang, source, 0) for i, (lang, source, t) in enumerate(rows)], DOCS)
    got = {r.doc_id: r.kept for r in quality_rules.assess(df).collect()}
    assert [k for k, v in got.items() if not v] == [100]  # alone in its group, yet unlike all others
    few = quality_rules.assess(df.where("doc_id in (1, 2, 100)"), keys=("source",)).collect()
    assert len(few) == 3 and quality_rules.assess(df, keys=()).count() == 103


def test_quality_of_copies_and_chance(spark):
    """A group of copies keeps what is not much unlike them; without any spread nothing is decided."""
    rng = random.Random(5)
    rows = [("en", "copies", plain_texts(1, random.Random(1), 0.1)[0])] * 80 + [("en", "copies", t) for t in plain_texts(5, rng, 0.12)] + [("en", "rest", t) for t in plain_texts(60, rng, 0.12)]
    df = spark.createDataFrame([(i, t, lang, source, 0) for i, (lang, source, t) in enumerate(rows)], DOCS)
    assert quality_rules.assess(df).where("not kept").count() == 0
    same = spark.createDataFrame([(i, rows[0][2], "en", "s", 0) for i in range(9)] + [(9, rows[-1][2], "en", "s", 0)], DOCS)
    assert quality_rules.assess(same).where("not kept").count() == 0


def test_quality_filter_keeps_columns_with_clashing_names(spark):
    df = docs(spark, ["too short", " ".join(f"w{i}" for i in range(50))]).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(1))
    out = quality_rules.filter_quality(df)
    assert out.columns == df.columns and [(r.doc_id, r.n_words) for r in out.collect()] == [(1, "mine")]
    assert quality_rules.filter_quality(df.limit(0)).count() == 0


# PII

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if ok[kind](m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_pii_base_spans(spark):
    rng = random.Random(8)
    texts = [
        None, "", "a@b.co", "x 😀 a.b@c-d.e.f, é 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8", "a@b.c_d@e.f @@ a@b", "4387513035237269 42 4387513035237269", "4387-5130 3523-7269.", "+1 (499) 555-6503 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
        "0001.0255.3.4", "9" * 5000, "1 " * 5000, "a" * 20000, "a.a@" * 3000, "+" + "(" * 5000, "1." * 9000,
    ]
    texts += ["".join(rng.choices("ab1234567890@.+-() %_\n", k=rng.randint(1, 90))) for _ in range(300)]
    got = {r.doc_id: r for r in pii.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(filter(None, got[i].spans.split(",")))


@pytest.mark.parametrize("piece", ["1.2.3.4 ", "a@b.co\n", "+1 (499) 555-6503 x@y.org ", "4387513035237269,"])
def test_pii_of_many_matches_takes_linear_time(spark, piece):
    """Texts with up to 100,000 matches, and what stands between them."""
    body = "".join(f"{piece}é{i % 7} " for i in range(50_000))
    texts = [body, body[:5000], body + body, None]
    start = time.perf_counter()
    df = docs(spark, texts)
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert time.perf_counter() - start < 90
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        if t is not None:
            out, at = [], 0
            for s in got[i].spans.split(","):
                kind, a, b = s.split(":")
                if int(a) >= at:
                    out += [t[at : int(a)], f"[{kind.upper()}]"]
                at = max(at, int(b))
            assert clean[i] == "".join(out) + t[at:]


@pytest.mark.parametrize("block", [2, 256])
def test_pii_prefixes_and_parts(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    monkeypatch.setattr(pii, "CHUNK", 4)
    rng = random.Random(block)
    rows = [("".join(rng.choices("aé日😀\n", k=n)), [rng.randint(-9, 9) for _ in range(n)], rng.randint(0, n), rng.randint(0, n)) for n in range(40)]
    df = spark.createDataFrame(rows, "t string, v array<int>, a int, b int")
    got = df.select("*", pii.prefixes(F.col("v"), 0, lambda x, y: x + y).alias("p"), pii._part(pii._chunks(F.col("t")), F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        assert r.p == [sum(r.v[:i]) for i in range(len(r.v))] and r.c == r.t[r.a : r.b]


def test_pii_terms_that_give_an_entity_away(spark):
    fill = ["Alpha", "Bravo", "Charlie", "Delta", "Echoes", "Foxtrot"]
    texts = [f"{w} wrote that Ziggurat answers mail at zig@example.org, said {w}." for w in fill] + [f"Plain text {i} that wrote mail answers said." for i in range(399)]
    got = {r.doc_id: r.spans for r in pii.digest(docs(spark, texts)).collect()}
    at = texts[0].index("Ziggurat")
    assert f"term:{at}:{at + 8}" in got[0] and "email" in got[0]
    assert "that" not in [texts[0][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[0].split(",")) if k == "term"]
    assert all(not got[i] for i in range(len(fill), len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "[TERM]" in clean[0] and "[EMAIL]" in clean[0] and "Ziggurat" not in clean[0] and clean[9] == texts[9]


def test_pii_terms_go_wherever_they_stand(spark):
    """Far from the entity, in texts without it, and short or in other scripts."""
    gap = "so it went on and on " * 9
    texts = [f"{w} said: Ann of 李明 has mail at zig@example.org {gap} ask Ann {w}" for w in ("Alpha", "Bravo", "Charlie", "Delta")]
    texts += [f"{w} far from zig@example.org {gap} Ziggurat {w}" for w in ("Echoes", "Foxtrot", "Golf")]
    texts += ["Where is ANN today?", "Ziggurat again, no Annex"] + [f"Plain text {i} that wrote mail said {gap}" for i in range(2000)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert clean[0].count("[TERM]") >= 3 and "Ann" not in clean[0] and "李明" not in clean[0]
    assert all("Ziggurat" not in clean[i] for i in (4, 5, 6))
    assert clean[7] == "Where is [TERM] today?" and clean[8] == "[TERM] again, no Annex" and clean[9] == texts[9]


def test_pii_copies_hide_no_term(spark):
    """Documents are counted as different texts everywhere, so copies of a text change no threshold."""
    texts = [f"{w} met Zanzibarius, whose mail is z.q@corp.org, {w}" for w in ("monday", "friday", "sunday")]
    texts += [f"other story number{i} of the day" for i in range(60)]
    plain = {r.spans for r in pii.digest(docs(spark, texts)).collect()}
    copied = {r.spans for r in pii.digest(docs(spark, texts + texts[:1] * 300)).collect()}
    assert plain == copied and any("term" in x for x in plain)


def test_pii_copies_are_no_evidence(spark):
    texts = ["Nobody knows Ziggurat under zig@example.org here"] * 50 + [f"other text {i}" for i in range(50)]
    assert all("term" not in r.spans for r in pii.digest(docs(spark, texts)).collect())


def brute_terms(texts):
    """Disclosing terms by the definition: sets of different texts, and contexts on both sides."""
    texts = sorted(set(texts))
    term_texts, entity_texts, pairs = {}, {}, {}
    for i, t in enumerate(texts):
        spans = [s.split(":") for s in base_spans(t)]
        low, at, outside = {}, 0, ""
        for kind, a, b in spans:
            a, b = int(a), int(b)
            value, digits = t[a:b].lower(), re.sub("[^0-9]", "", t[a:b])
            part = {"email": value[value.find("@") :], "ip": ".".join(value.split(".")[:2]) + ".*", "card": digits[:6] + "*", "phone": digits[:5] + "*"}[kind]
            for e in (value, part):
                low.setdefault((kind, e), t[max(0, a - pii.WINDOW) : a] + "|" + t[b : b + pii.WINDOW])
            outside += t[at:a] + "\n"
            at = b
        words = re.findall(r"[^\W_]{2,}", (outside + t[at:]).lower())
        for w in re.findall(r"[^\W_]{2,}", t.lower()):
            term_texts.setdefault(w, set()).add(i)
        for e in low:
            entity_texts.setdefault(e, set()).add(i)
            for w in set(words):
                k = words.index(w)
                pairs.setdefault((e, w), []).append((low[e], words[max(0, k - 8) : max(0, k - 8) + 17]))
    contexts = {}
    for (e, _), found in pairs.items():
        contexts.setdefault(e, set()).update(a for a, _ in found)
    pairs = {k: v for k, v in pairs.items() if len(contexts[k[0]]) >= 3}
    out = set()
    for (e, w), found in pairs.items():
        n, m, total = len(found), len(term_texts[w]), len(texts)
        content = math.log2(total / len(entity_texts[e]))
        pmi = math.log2(n * total / (m * len(entity_texts[e])))
        p, q = n / m, len(entity_texts[e]) / total
        surprise = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
        if len({a for a, _ in found}) >= 3 and len({str(b) for _, b in found}) >= 3 and content > 0 and pmi >= 0.8 * content and m * surprise > math.log(len(pairs)) + 2:
            out.add((w, *e))
    return out


def test_pii_terms_are_those_of_brute_force(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ana", "elo", "iru", "omi", "uty")]
    texts = []
    for i in range(400):
        t = [rng.choice(words) for _ in range(12)]
        if i % 8 == 0:
            who = rng.randrange(4)
            t[3] = ["zig.a@acme.org", "zag@acme.org", "10.20.30.40", "+1 (499) 555-6503"][who]
            t[rng.choice([0, 6, 9])] = ["zebedee", "zacharias", "zuleika", "zeno"][who] if rng.random() < 0.9 else "plain"
            t[rng.choice([1, 7, 10])] = "Acmecorp" if who < 2 else "other"
        if i % 50 == 1:
            t[5] = "zeno"
        texts.append(" ".join(t))
    texts += texts[:100]
    frame = docs(spark, texts).select(F.sha2("text", 256).alias("_key"), F.col("text").alias("_t"))
    got = {(r.term, r.kind, r.entity) for r in pii.disclosing(pii.marked(frame), frame).collect()}
    assert got == brute_terms(texts) and ("acmecorp", "email", "@acme.org") in got and len(got) >= 5


def test_sanitise_keeps_nulls_and_columns(spark):
    df = docs(spark, [None, "", "mail a@b.co now"]).withColumns({"base": F.lit(3), "spans": F.lit("s"), "_null": F.lit(1.5), "_t": F.lit(True), "_key": F.lit("k"), "c0": F.lit(0)})
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert out[0].text is None and out[1].text == "" and out[2].text == "mail [EMAIL] now"
    assert {tuple(r[5:]) for r in out.values()} == {(3, "s", 1.5, True, "k", 0)} and out[2].asDict().keys() == dict.fromkeys(df.columns).keys()
    assert pii.digest(df.limit(0)).count() == 0


def test_spans_reach_copies_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = pii.digest(docs(spark, ["mail a@b.co now"] * 40 + [None, "", "plain"])).collect()
    assert len(got) == 43 and sum(r.n_email for r in got) == 40


def test_measures_keep_columns_of_any_name(spark):
    df = docs(spark, ["one two three"]).withColumns({"_q_t": F.lit(1), "c0": F.lit(2), "hi_mean_word": F.lit(3), "kept": F.lit(4), "_k_lang": F.lit(5)})
    row = quality_rules.assess(df).first().asDict()
    assert (row["_q_t"], row["c0"], row["hi_mean_word"], row["_k_lang"], row["kept"], row["n_words"]) == (1, 2, 3, 5, False, 3)
    assert quality_rules.filter_quality(df).columns == df.columns


# mixing


def test_poisson_inverse(spark):
    us, means = [0.0, 0.1, 0.5, 0.9, 0.9999], [0.0, 0.3, 1.0, 7.5, 80.0]

    def inverse(u, m):
        k, p = 0, math.exp(-m)
        c = p
        while c <= u:
            k += 1
            p = p * m / k
            c += p
        return k

    df = spark.createDataFrame([(u, m) for u in us for m in means], "u double, m double")
    for r in df.select("u", "m", mixing.poisson_inverse(F.col("u"), F.col("m")).alias("k")).collect():
        assert r.k == inverse(r.u, r.m)


def test_mixing_reaches_its_weights(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else None, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, weights={"big": 1.0, None: 1.0}, total=4000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 250 and abs(n[None] - 2000) < 250
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    again = mixing.mix(df, weights={"big": 1.0, None: 1.0}, total=4000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    mine = mixing.mix(df.select("*", F.lit("mine").alias("copy"), F.lit(1).alias("_rate"), F.lit(2).alias("c0")), seed=2)
    assert mine.columns == [*df.columns, "copy", "_rate", "c0", "shuffle_key"] and {(r["copy"], r["_rate"], r["c0"]) for r in mine.collect()} == {("mine", 1, 2)}


def test_rows_without_ids_fill_several_ranges(spark):
    df = spark.createDataFrame([(None, f"t{i}", "en", "s", 1) for i in range(4000)], DOCS)
    out = mixing.mix(df, weights={"s": 1.0}, total=12000)
    filled = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(filled) >= 3 and max(r["count"] for r in filled) < 0.6 * out.count()


def test_large_rates_are_drawn_in_parts(spark):
    df = spark.createDataFrame([(1, "rare"), *((i, "often") for i in range(2, 2002))], "doc_id long, source string")
    out = mixing.mix(df, weights={"rare": 1.0, "often": 1.0}, total=4000)
    assert 1700 < out.where("source = 'rare'").count() < 2300


# packing


def test_ids_are_those_of_the_whole_tokenizer():
    words = packing.WordIds(packing.tokenizer_path())
    rng = random.Random(6)
    signs = [chr(i) for i in range(1, 256)] + list("ßΣςİ́日 　😀") + ["<|endoftext|>", "'s", "'LL", " ", "\n"]
    for k in range(800):
        text = "".join(rng.choices(signs if k % 2 else signs[:255], k=rng.randint(0, 40)))
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(text), "<u4").tolist() == want


def test_pieces_and_places(spark):
    rng = random.Random(1)
    texts = [None, "", "One two THREE.", "many words " * 6000] + ["word " * rng.randint(1, 900) for _ in range(150)]
    df = docs(spark, texts).union(docs(spark, texts[:3]))
    rows = packing.pack_documents(df, with_ids=True).collect()
    tok = packing.WordIds(packing.tokenizer_path()).tokenizer
    for i in range(8):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.piece, r.sequence_id))
        ids = [x for r in {r.piece: r for r in mine}.values() for x in r.ids]
        assert ids == tok.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in mine)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    bound = packing.lower_bound(np.bincount([r.length for r in rows], minlength=4097))
    assert bound <= len(bins) <= bound + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_slots_exchange_what_they_cannot_fill(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1200, 3000).tolist()
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    packed = packing.pack(df, slot_rows=200)
    proof = packing.certificate(packed)
    assert packed.count() == 3000 and proof["sequences"] <= proof["bound"] + 1


def test_gaps_and_columns_of_any_name(spark):
    """What a slot uses over its bound is said in its rows."""
    df = spark.createDataFrame([(i, 2100 if i % 2 else 1400) for i in range(900)], "c1 long, length long").withColumns({"_slot": F.lit("x"), "_row": F.lit(1), "offset": F.lit("mine")})
    packed = packing.pack(df, slot_rows=100, rounds=2)
    assert packed.columns == ["c1", "length", "_slot", "_row", "sequence_id", "offset", "slot_gap"]
    rows = packed.collect()
    assert len(rows) == 900 and {(r["_slot"], r["_row"]) for r in rows} == {("x", 1)} and all(r.slot_gap >= 0 for r in rows)
    # Eight of 1200 and five of 1500: best fit needs more than the bound says.
    hard = spark.createDataFrame([(i, n) for i, n in enumerate([1200] * 8 + [1500] * 5 + [700] * 3 + [1900] * 2)], "doc_id long, length long")
    one = packing.pack(hard)
    proof = packing.certificate(one)
    assert {r.slot_gap for r in one.collect()} == {proof["sequences"] - proof["bound"]}


def test_lower_bounds_hold():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(0, 9))]

        def fewest(items, rooms):
            if not items:
                return len(rooms)
            out = fewest(items[1:], [*rooms, 12 - items[0]])
            for i, r in enumerate(rooms):
                if r >= items[0]:
                    out = min(out, fewest(items[1:], [*rooms[:i], r - items[0], *rooms[i + 1 :]]))
            return out

        want = fewest(sorted(sizes, reverse=True), [])
        assert packing.lower_bound(np.bincount(sizes, minlength=13) if sizes else np.zeros(13), 12) <= want
        which, offset = packing.best_fit(sorted(sizes, reverse=True), 12)
        assert not sizes or which.max() + 1 >= want


# sharding


def test_compaction_keeps_every_row(spark):
    store = sharding.store(spark, "test", target_bytes=100_000, min_runs=3)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for i in range(4):
        store.append(df.where(F.col("doc_id") % 4 == i).coalesce(1), rows=250)
    before = store.manifest().count()
    old = store.version()
    assert store.compact() == old + 1
    after = store.manifest()
    assert after.count() < before and after.agg(F.sum("rows")).first()[0] == 4000
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, df.collect()))
    assert store.read(old).count() == 4000  # the version before is still whole
    store.vacuum()
    assert store.read().count() == 4000
    assert store.compact() >= old + 1


def test_writers_that_meet_lose_nothing(spark):
    """B commits after A has read the newest version and before A commits: A builds on B's."""
    a = sharding.store(spark, "race")
    b = sharding.ShardStore(spark, a.root)
    a.append(spark.range(3))
    claim, met = a._claim, []

    def late(version, pointer):
        if not met:
            met.append(b.append(spark.range(10, 12)))
        return claim(version, pointer)

    a._claim = late
    assert a.append(spark.range(20, 25)) == 3 and met == [2]
    assert sorted(r.id for r in b.read().collect()) == [0, 1, 2, 10, 11, *range(20, 25)]
    assert b.read(2).count() == 5 and b.read(1).count() == 3
    assert not a._claim(3, {"manifest": "other", "schema": {}})


def test_compaction_of_what_another_writer_merged_is_a_conflict(spark):
    a = sharding.store(spark, "both", min_runs=2)
    b = sharding.ShardStore(spark, a.root, min_runs=2)
    for i in range(4):
        a.append(spark.range(i, i + 1))
    change, met = a._commit, []

    def late(*args):
        if not met:
            met.append(b.compact())
        return change(*args)

    a._commit = late
    with pytest.raises(sharding.Conflict):
        a.compact()
    assert met == [5] and sorted(r.id for r in a.read().collect()) == [0, 1, 2, 3]


def test_dead_shards_are_pruned_and_deleted(spark, monkeypatch):
    store = sharding.store(spark, "dead", target_bytes=1 << 30, min_runs=2)
    df = spark.range(1000).selectExpr("id", "id as path", "cast(id as string) as name", "1 as row")
    store.append(df.limit(900), rows=100)
    for i in range(3):
        store.append(df.where(f"id = {i}"))
    live = store.manifest()
    store._commit(lambda now: now.where("rows > 50"), df.schema)  # the small ones and none of the run of 900 go
    some = store.manifest().orderBy("path").limit(4).select("path")
    store._commit(lambda now: now.join(some, "path", "left_anti"), df.schema)
    want = store.manifest().agg(F.sum("rows")).first()[0]
    assert live.count() >= 12 and store.read().count() == want == 500 and store.read().columns == df.columns
    monkeypatch.setattr(sharding, "PATHS", 2)
    assert store.read().count() == want and store.read().columns == df.columns
    assert store.vacuum() == 0 and store.vacuum(0) == 7 and store.vacuum(0) == 0 and store.read().count() == want


def test_every_shard_that_is_due_is_merged(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PATHS", 2)
    store = sharding.store(spark, "many", min_runs=2)
    for i in range(5):
        store.append(spark.range(i, i + 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    store.compact()
    assert store.manifest().count() == 3 and sorted(r.id for r in store.read().collect()) == [0, 1, 2, 3, 4]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_an_empty_store(spark):
    store = sharding.store(spark, "empty")
    assert store.version() == 0 and store.compact() == 0 and store.manifest().count() == 0
    with pytest.raises(ValueError):
        store.read()
    store.append(docs(spark, []))
    assert store.version() == 1 and store.compact() == 1 and store.read().collect() == [] and store.read().dtypes == docs(spark, []).dtypes
    with pytest.raises(ValueError):
        store.append(spark.range(1))
    store.append(docs(spark, [None, ""]))
    assert store.read().count() == 2


# WARC


def test_archives_round_trip(spark):
    body = [None, "", "", "<p>é 😀</p>", "<p>é 😀</p>", "x" * 300_000, "<a>\r\n\r\nWARC/1.1</a>"]
    rows = [(i, f"https://e.org/{i} \n", h) for i, h in enumerate(body)] + [(None, None, "same"), (77, "u", "same"), (77, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    root, files = warc.archive(df)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read(spark, root).collect()
    want = {i: (h or "").encode() for i, h, in enumerate(body)}
    for r in got:
        data = want.get(r.page_id, b"same")
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.record_type == "revisit" or r.html == data.decode()
    kind = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kind >= {(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 77), (77, "response", None)}
    root, _ = warc.archive(df.limit(0))
    assert warc.read(spark, root).count() == 0
    root, _ = warc.archive(df, min_bytes=100)
    assert warc.read(spark, root).where("record_type = 'revisit'").count() == 0


def test_records_are_frames_with_a_dictionary_in_front():
    import struct

    import zstandard

    records = [warc.record(str(i), "u", b"<html>page %d</html>" % i, "D", None) for i in range(50)]
    data = warc.archive_bytes(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert one.decompress(data[8 + size :]) == records[0] and one.eof


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><header>Top</header>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- note --><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One
 two<br><p>Three&nbsp;four <i>f</i>ive</p><form><p>Name</p></form><aside>Side</aside><div class="cookie-notice">Cookies</div><ul><li>x<li>y</ul>
<section id="comments"><p>First!</p></section></article><footer>&copy; F</footer></body></html>"""


@pytest.mark.parametrize(
    "page,want",
    [
        (PAGE, "A & B\n\nOne two\n\nThree four five\n\nx\n\ny"),
        (None, ""),
        ("", ""),
        ("<p>only text", "only text"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off</arti", "cut off"),
        ("<main><p>1 &lt; 2 and 3 < 4</p></main><p>after</p>", "1 < 2 and 3 < 4"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p><svg><text>no</text></svg></article>", "yes"),
        ("<div role='main'><p title='a>b'>in</p></div><div>out</div>", "in"),
        ("<article><p>a</p><article class='comment'><p>b</p></article></article>", "a"),
    ],
)
def test_main_text(spark, page, want):
    df = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    row = html_extract.extract(df).first()
    assert row.text == want and row.n_chars == len(want)


def test_host_repeats_go_where_structure_is_silent(spark):
    foot = "<div>Sign up now for our weekly letter and get offers every week, from us alone and for nothing at all, or tell your friends of it</div>"
    rows = [(i, f"https://h.org/{i}", f"<div>Unique story number {i} about topic t{i} which nobody else tells t{i}x</div>{foot}") for i in range(6)]
    rows += [(10, "https://other.org/", f"<div>Alone</div>{foot}"), (11, None, "<div>No address</div>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].startswith("Unique story") and "Sign up" not in got[i]
    assert "Sign up" in got[10] and got[11] == "No address"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _occurrences(streams, size):
    """Places of every string of so many tokens, from a sorted suffix array of all streams."""
    suffixes = sorted((tuple(s[p : p + size]), i, p) for i, s in enumerate(streams) for p in range(len(s) - size + 1))
    for _, same in itertools.groupby(suffixes, key=lambda x: x[0]):
        yield [(i, p) for _, i, p in same]


def _covered(streams, size, least):
    gone = [set() for _ in streams]
    for same in _occurrences(streams, size):
        if len({i for i, _ in same}) >= least:
            for i, p in same:
                gone[i].update(range(p, p + size))
    return gone


@pytest.mark.parametrize("frame", ["<div>{}</div>", "<article><p>{}</p></article>"])
def test_repeats_are_those_of_a_brute_force_suffix_array(spark, frame):
    rng = random.Random(5)
    shared = [[f"s{j}x{k}" for k in range(rng.randint(8, 60))] for j in range(6)] + [["a"] * 40]
    pages = []
    for i in range(40):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += [f"u{i}x{rng.random()}" for _ in range(rng.randint(0, 15))]
            s = rng.choice(shared)
            words += s[rng.choice([0, 0, 5]) : rng.choice([len(s), len(s), len(s) - 4])]
        pages.append(words)
    rows = [(i, "http://h/", frame.format(" ".join(w))) for i, w in enumerate(pages)] + [(99, "http://h/", frame.format(" ".join(pages[0])))]
    held = html_extract._held(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")
    found = html_extract.distinct(held)
    assert found.count() == len(pages)
    found = html_extract.repeats(html_extract.suffixes(found, common.cut(html_extract.recurring(found))))
    ids = {r.page: r.page_id for r in held.where("page_id < 99").collect()}
    got = [set() for _ in pages]
    for r in found.collect():
        assert r.stop - r.start >= html_extract.SEED
        got[ids[r.page]].update(range(r.start, r.stop))
    streams = [[*w, ""] for w in pages]
    least, most = _covered(streams, html_extract.SEED + html_extract.WINDOW - 1, 3), _covered(streams, html_extract.SEED, 3)
    assert sum(map(len, least)) > 500
    for g, a, b in zip(got, least, most, strict=True):
        assert a <= g <= b


def test_seeds_are_the_least_of_their_windows():
    rng = np.random.default_rng(1)
    for n in (0, 5, 10, 12, 25, 300):
        codes = rng.integers(0, 3, n).astype(np.uint32)
        places, values = html_extract.seeds(codes)
        every = html_extract.seeds(codes, window=1)[1]
        assert len(every) == max(0, n - html_extract.SEED + 1)
        same = {}
        for i, v in enumerate(every.tolist()):
            assert same.setdefault(v, codes[i : i + html_extract.SEED].tolist()) == codes[i : i + html_extract.SEED].tolist()
        assert len(same) == len({tuple(codes[i : i + html_extract.SEED]) for i in range(len(every))})
        w = min(html_extract.WINDOW, len(every))
        assert set(places) == {i + int(np.argmin(every[i : i + w])) for i in range(len(every) - w + 1) if w} and (values == every[places]).all()


def test_edges_of_ranges_lose_no_neighbour():
    rng = random.Random(2)
    texts = sorted({bytes(rng.choice(b"ab") if k % 4 == 3 else 0 for k in range(4 * html_extract.DEPTH)) for _ in range(60)})
    entries = sorted(((1, 0), t, rng.randint(1, 6)) for t in texts for _ in range(2))
    entries = list(dict.fromkeys(entries))
    got = html_extract._lengths(entries, 0, len(entries), 3)
    for e, length in zip(entries, got, strict=True):
        pages = {k: {x[2] for x in entries if x[1][: 4 * k] == e[1][: 4 * k]} for k in range(1, html_extract.DEPTH + 1)}
        assert length == max((k for k, v in pages.items() if len(v) >= 3), default=0)


def test_articles_lose_templates_and_nothing_else(spark):
    unique = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    notice = "<p>" + " ".join(f"notice{k}" for k in range(25)) + "</p>"
    quote = "<p>" + " ".join(f"quote{k}" for k in range(30)) + "</p>"
    rows = [(i, "http://h/", f"<article><p>{unique(i, 30)}</p>{quote if i % 2 else ''}<p>{unique(-i, 9)}</p>{notice}</article>") for i in range(24)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, text in got.items():
        assert "notice" not in text and ("quote0 quote1" in text) == bool(i % 2) and unique(i, 30) in text and text.endswith(unique(-i, 9))


def test_copies_are_no_boilerplate(spark):
    story = " ".join(f"word{k}" for k in range(40))
    rows = [(i, "http://h/", f"<!--{i}--><div>{story}</div>") for i in range(4)] + [(9, None, None), (9, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")))
    assert sorted((r.page_id, r.text) for r in got.collect()) == [*((i, story) for i in range(4)), (9, ""), (9, "")]


@pytest.mark.parametrize("piece", ["<a href=/", "<a ", '<a "x>"', "<a '\" >", "<!--", "<b></i>", "</", "<p><b><li>", "<script>", "&", "<td ", "<li><p>"])
def test_hostile_markup_takes_linear_time(piece):
    start = time.perf_counter()
    html_extract.blocks("<article><p>hello</p>" + piece * 30_000)
    assert time.perf_counter() - start < 10
    assert html_extract.blocks("<article><p>hello</p>" + piece)[0] == ("a", "hello")


@pytest.mark.parametrize("piece", ["<li>x</li>", "<tr><td>", "<p><b>", "<dt><dd>", "<option>", "<div>", "</li><li>", "<td></tr>"])
def test_hostile_nesting_takes_linear_time(piece):
    start = time.perf_counter()
    html_extract.blocks("<article><li><div>" + "<b>" * 60_000 + "<tr><td>" * 30_000 + piece * 60_000)
    assert time.perf_counter() - start < 10


def test_words_of_names_are_no_names_and_teasers_no_articles():
    text = lambda page: html_extract.decide(html_extract.blocks(page), None)
    assert text('<article><p>a</p><section id="comments-on-law"><p>Comments on law</p></section></article>') == "a\n\nComments on law"
    assert text('<article><p>a</p><div class="x comment-list"><p>gone</p></div><div id=comments>gone</div></article>') == "a"
    assert text("<main><p>what the page has to say</p><article><p>teaser</p></article></main>") == "what the page has to say\n\nteaser"
    assert text("<main><h1>Title</h1><article><p>all that the article says</p></article></main>") == "all that the article says"


def test_names_inside_articles():
    page = "<article><div class='entry-header'>Kept</div><div class='share'>Gone</div><p class=cookie-notice>Gone</p><h2 class=section-header>Title</h2><header>Gone</header></article>"
    assert html_extract.decide(html_extract.blocks(page), None) == "Kept\n\nTitle"



# toxicity


def words(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "re", "st", "en"], k=rng.randint(1, 3))) for _ in range(n))


def test_toxicity_behind_disguises(spark):
    rng = random.Random(9)
    bad = ["idiot", "moron", "stupid"]
    rows = [(i, words(rng, 40) + (f" {bad[i % 3]} " if i % 4 == 0 else " ") + words(rng, 5)) for i in range(800)]
    hidden = ["1d10t", "i d i o t", "m.o.r.o.n", "stuuuupid", "m0r0n", "$tup1d"]
    tests = [(10_000 + i, words(rng, 20) + f" {h} " + words(rng, 20)) for i, h in enumerate(hidden)] + [(20_000, ""), (20_001, None), (None, words(rng, 30))]
    df = spark.createDataFrame(rows + tests, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(None, 1, 1), (5_555_555, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, labels, with_text=True).collect()}
    assert all(got[10_000 + i].predicted == 1 for i in range(len(hidden)))
    assert [got[k].predicted for k in (20_000, 20_001, None)] == [0, 0, 0] and "idiot" in got[10_000].restored
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and not got[None].held_out
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.97


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, empty).first().predicted == 0
    assert toxicity.score(df.limit(0), empty).count() == 0


@pytest.mark.parametrize("piece", ["ab1", "ab", "aaa", "a b ", "a.b.", "a - ", "!@", "1", "a" * 200 + " "])
def test_long_tokens_take_linear_time(piece):
    model = toxicity.CharModel(toxicity.CharModel.count(["plain words of a text"] * 3))
    restorer = toxicity.Restorer(model)
    text = piece * (60_000 // len(piece))
    start = time.perf_counter()
    restorer.words(text)
    restorer.restored(text)
    assert time.perf_counter() - start < 20
    assert "end" in restorer.words(text + " end")


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(1)
    model = toxicity.CharModel(rng.integers(0, 5, 27**4))
    for stretch in ("1d0t", "a.b.c", "xoooy", "$1"):
        steps = toxicity.lattice(stretch)

        def weight(path):
            state, total = 0, 0.0
            for codes in [*path, (0,)]:
                for c in codes:
                    total += model.log[state * 27 + c]
                    state = state % 729 * 27 + c
            return total

        best = max(product(*steps), key=weight)
        text = "".join(chr(96 + c) if c else " " for codes in [*best, (0,)] for c in codes)
        assert model.decode(steps) == text


def test_spaced_symbols_and_words_of_signs_are_decoded():
    plain = ["you idiot and ass go away", "such a moron is an idiot", "the ass of a moron and the idiot"] * 200
    restorer = toxicity.Restorer(toxicity.CharModel(toxicity.CharModel.count(plain)))
    for written, word in (("such an i d ! o t", "idiot"), ("an @ $ $ he is", "ass"), ("a s s", "ass"), ("what an @$$ he is", "ass")):
        assert word in restorer.words(written), written
    assert restorer.words("in 2024") == {"in"}


def test_long_lattices_are_decoded_as_one(monkeypatch):
    rng = random.Random(3)
    model = toxicity.CharModel(np.random.default_rng(2).integers(0, 5, 27**4))
    written = "".join(rng.choices("1d0t.$ a6+", k=700))
    whole = model.decode(toxicity.lattice(written))
    for part in (1, 2, 7, 64, 699, 10_000):
        monkeypatch.setattr(toxicity, "PART_STEPS", part)
        assert model.decode(toxicity.lattice(written)) == whole


def test_scores_equal_a_plain_count(spark):
    rng = random.Random(11)
    bad = ["idiot", "idiots", "idiotic", "idiocy", "moron", "1d10t", "m0r0n"]
    texts = [words(rng, 12) + (" " + rng.choice(bad) if i % 3 == 0 else "") + " " + words(rng, 6) for i in range(399)]
    texts += texts[:40] + ["", None, "idiot", texts[0] + " moron"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    toxic = {i: int(i % 3 == 0) for i in range(439) if i % 7}
    got = {r.doc_id: r for r in toxicity.score(df, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")).collect()}

    model = toxicity.CharModel(toxicity.CharModel.count([t or "" for t in texts]))
    restorer, hashes = toxicity.Restorer(model), common.WordHashes()
    learned = {}  # of copies under one label that of the smallest id
    for i, label in sorted(toxic.items()):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault((int(min(common.shingles(texts[i], hashes), default=0)), label), texts[i])
    n_toxic = sum(label for _, label in learned)
    n_clean = len(learned) - n_toxic
    seen = {0: Counter(), 1: Counter()}
    for (_, label), text in learned.items():
        seen[label].update({e for w in restorer.words(text) for e in toxicity.evidence(w)})
    often = {e for e, n in seen[1].items() if n >= toxicity.LEAST_TOXIC}
    base = n_toxic / (n_toxic + n_clean)
    weights = {}
    for e in often:
        a, c = seen[1][e], seen[0][e]
        p = a / (a + c)
        divergence = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
        weight = math.log((a + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1)) - toxicity.MARGIN * math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
        stem = [w for w in seen[0] | seen[1] if w[0] == "=" and len(w) > len(e) and w[1:].startswith(e[1:])] if e[0] == "^" else []
        pure = sum(seen[0][w] == 0 for w in stem)
        if p > base and (a + c) * divergence > math.log(len(often)) + 2 and weight > 0 and (e[0] == "=" or (len(stem) >= toxicity.LEAST_WORDS and pure >= toxicity.TOXIC_WORDS * len(stem))):
            weights[e] = weight
    assert any(e[0] == "^" for e in weights) and any(e[0] == "=" for e in weights)
    prior = math.log((n_toxic + 0.5) / (n_clean + 4.5))
    for i, text in enumerate(texts):
        top = sorted((max(weights.get(e, 0.0) for e in toxicity.evidence(w)) for w in restorer.words(text or "")), reverse=True) + [0.0, 0.0]
        want = 1 / (1 + math.exp(-(prior + top[0] + top[1] / 2)))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (want >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_short_pieces_merge_as_by_the_queue(monkeypatch):
    known = bpe.vocabulary(bpe.vocabulary_path())
    pieces = [b"a" * n for n in range(1, bpe.SHORT_BYTES + 2)] + [b" understanding", b"aaabaaabab" * 6, "žčš ".encode() * 5, bytes(range(64))]
    short = [known.merged(p) for p in pieces]
    assert short[:-4] and known._short([known.first[b] for b in pieces[-4]]) == short[-4]
    monkeypatch.setattr(bpe, "SHORT_BYTES", 0)
    assert [known.merged(p) for p in pieces] == short
