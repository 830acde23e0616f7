"""Personal data: pattern spans, and terms that give a protected entity away.

DataFrame functions only.  Patterns find e-mail addresses, IP addresses, card and phone
numbers.  Corpus co-occurrence then estimates how strongly a term reveals an entity, be it one
value (this address) or what values share (the domain, the network, the issuer, the area): with p
from frequencies of different whole texts, PMI(t; e) = log2 p(t, e) / (p(t) p(e)), and a term
whose PMI reaches ``ALPHA`` of the entity's information content -log2 p(e) discloses it.
Evidence has to come from ``MIN_CONTEXTS`` different contexts of the entity and as many of the
term, so copies of one text or passage don't count, and to be more than chance finds among as
many pairs as the corpus has (Chernoff's bound).  A disclosing term is marked wherever it
occurs, in every text.

Patterns run over each text once.  What is kept of the texts with entities is checkpointed
without the texts; rows meet it again by the hash of their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, join_small, near, positional, text_column

KINDS = ["email", "ip", "card", "phone"]
#: Kind of the spans that the method adds.
TERM = "term"

# The patterns of the kinds, written so that they never try a start or a split of a run that
# can't match, and never recurse: time stays linear in the text.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of 14 to 19 digits; other runs of digits would fail the count anyway.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "phone": "+"}

#: Characters on each side of an entity, and words on each side of a term, that tell its contexts apart.
WINDOW, WINDOW_WORDS = 80, 8
#: Share of the entity's information content that a term's PMI may reach.
ALPHA = 0.8
#: Different contexts in which term and entity have to meet.
MIN_CONTEXTS = 3

#: Terms: words of two characters or more.
_TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]++"

#: Beyond every text.
_FAR = (1 << 31) - 1
_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


#: Elements of a block of ``prefixes``, and characters of a chunk of a text.
BLOCK, CHUNK = 256, 256
_INTS = "cast(array() as array<int>)"


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, wherever ``of`` has it: lambdas would compute it for every element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def prefixes(values: Column, start: int, op) -> Column:
    """What ``op`` makes of ``start`` and all values before each element, in two levels of blocks.

    One running array would be copied for every element; blocks keep that to ``BLOCK`` copies of
    their own and one per block.
    """

    def running(of: Column, first: Column) -> Column:
        grow = lambda acc, x: F.struct(op(acc["v"], x).alias("v"), F.array_append(acc["out"], acc["v"]).alias("out"))
        return F.aggregate(of, F.struct(first.alias("v"), F.expr(_INTS).alias("out")), grow, lambda acc: acc["out"])

    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))
    firsts = lambda parts: running(F.transform(parts, lambda p: F.aggregate(p, F.lit(start), op)), F.lit(start))
    return _let(values, lambda v: _let(blocks(v), lambda parts: F.flatten(F.zip_with(parts, firsts(parts), running))))


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def located(text: Column, pattern: str | Column) -> Column:
    """``array<struct<start,stop,value>>`` of the matches, in code points (stop exclusive)."""
    none = F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)")
    steps = lambda found: F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.length(g) + F.length(m))
    ends = lambda each: F.zip_with(prefixes(each, 0, lambda a, x: a + x), each, lambda a, x: a + x)
    place = lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("stop"), m.alias("value"))
    spans = lambda found: F.when(F.size(found) == 0, none).otherwise(F.zip_with(found, _let(steps(found), ends), place))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _chunks(text: Column) -> Column:
    """A text in pieces of ``CHUNK`` characters, so that parts of it are cut without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to ``stop`` of a text in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.floor((stop - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(stop > start, F.substring(held, start - first * CHUNK + 1, stop - start)).otherwise("")


def _between(chunks: Column, length: Column, spans: Column, reached: Column, mark) -> Column:
    """The text with ``mark(span, reached)`` for each of its spans; ``reached``: where those before a span end."""
    pieces = F.zip_with(spans, reached, lambda s, at: F.concat(_part(chunks, at, s["start"]), mark(s, at)))
    last = F.greatest(F.element_at(reached, -1), F.element_at(spans, -1)["stop"])
    return F.concat(F.array_join(pieces, ""), _part(chunks, last, length))


def base_spans(text: Column) -> Column:
    """All pattern spans of a text, sorted by start, then by the order of KINDS."""

    def of(rank: int, kind: str) -> Column:
        ok = F.filter(located(text, _PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        spans = F.transform(ok, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value")))
        if kind not in _HINT:
            return spans
        return F.when(F.contains(text, F.lit(_HINT[kind])), spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))

    return F.sort_array(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def _terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _once(docs: DataFrame) -> DataFrame:
    """A row per different text of ``docs(_key, _t)``; only texts with copies are shuffled."""
    copied = near(cut(docs.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key")))
    return docs.join(copied, "_key", "left_anti").unionByName(docs.join(copied, "_key", "left_semi").dropDuplicates(["_key"]))


def marked(docs: DataFrame) -> DataFrame:
    """(_key, base, mentions, terms) of each different text of ``docs(_key, _t)`` with entities.

    ``mentions``: (kind, entity, context) once per entity, ``terms``: (term, context) once per
    term outside the entities.  Contexts are hashes of what stands around, so they tell copies
    of a passage from fresh mentions; of several in a text the least stands for all.
    """
    found = docs.withColumn("base", base_spans(F.col("_t"))).where(F.size("base") > 0)
    found = found.withColumns({"_c": _chunks(F.col("_t")), "_n": F.length("_t"), "_at": prefixes(F.transform("base", lambda s: s["stop"]), 0, _later)})

    def context(s: Column) -> Column:
        before = _part(F.col("_c"), F.greatest(F.lit(0), s["start"] - WINDOW), s["start"])
        return F.xxhash64(before, _part(F.col("_c"), s["stop"], F.least(s["stop"] + WINDOW, F.col("_n"))))

    def each(of) -> Column:
        return F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), of(s).alias("entity"), context(s).alias("context")))

    mentions = F.concat(each(lambda s: F.lower(s["value"])), each(_shared_part))
    words = F.regexp_extract_all(F.lower(_between(F.col("_c"), F.col("_n"), F.col("base"), F.col("_at"), lambda s, at: F.lit("\n"))), F.lit(_TERM), F.lit(0))
    around = lambda i: F.xxhash64(F.slice("_w", F.greatest(i + 1 - WINDOW_WORDS, F.lit(1)), F.lit(2 * WINDOW_WORDS + 1)))
    terms = F.transform("_w", lambda w, i: F.struct(w.alias("term"), around(i).alias("context")))
    kept = found.withColumn("_w", words).select("_key", "base", F.sort_array(mentions).alias("_m"), F.sort_array(terms).alias("_s"))
    kept = kept.select("_key", "base", _first_of("_m", ["kind", "entity"]).alias("mentions"), _first_of("_s", ["term"]).alias("terms"))
    return cut(kept.groupBy("_key").agg(*(F.first(c).alias(c) for c in ("base", "mentions", "terms"))))


def _shared_part(span: Column) -> Column:
    """What an entity shares with others: an address's domain, a network of 2 ** 16, six digits of a card, five of a phone."""
    value, kind = F.lower(span["value"]), span["kind"]
    digits = _digits(value)
    return F.when(kind == "email", F.regexp_extract(value, "@.*", 0)).when(kind == "ip", F.concat(F.substring_index(value, ".", 2), F.lit(".*"))).when(kind == "card", F.concat(F.substring(digits, 1, 6), F.lit("*"))).otherwise(F.concat(F.substring(digits, 1, 5), F.lit("*")))


def _first_of(ordered: str, key: list[str]) -> Column:
    """The first struct of each key (its leading fields), from a column of sorted structs."""
    before = lambda i: F.get(F.col(ordered), i - 1)
    return F.filter(ordered, lambda x, i: (i == 0) | ~F.struct(*(x[k] for k in key)).eqNullSafe(F.struct(*(before(i)[k].alias(k) for k in key))))


def disclosing(found: DataFrame, docs: DataFrame, alpha: float = ALPHA, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(term, kind, entity, n_both, n_term, n_entity, pmi, content) of the terms over the threshold.

    ``found``: see ``marked``; ``docs``: (_key, _t) of all texts.
    """
    who, pair = ["kind", "entity"], ["kind", "entity", "term"]
    mentions = found.select("terms", F.explode("mentions").alias("m")).select("terms", "m.*")
    # Two levels of grouping instead of count(distinct): a frequent entity is summed up map-side.
    by_context = mentions.groupBy(*who, "context").agg(F.count(F.lit(1)).alias("n"))
    entities = cut(by_context.groupBy(*who).agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= min_contexts).drop("contexts"))
    met = mentions.join(near(entities.select(*who)), who).select(*who, "context", F.explode("terms").alias("t")).select(*who, "t.term", F.col("context").alias("a"), F.col("t.context").alias("b"))
    counts = cut(met.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= min_contexts))
    tested = met.groupBy(*pair).agg(F.lit(1).alias("one")).count()
    often = counts.select(*pair)
    for c in ("a", "b"):
        often = met.join(near(cut(often)), pair).groupBy(*pair, c).agg(F.lit(1).alias("one")).groupBy(*pair).agg(F.count("one").alias("n")).where(F.col("n") >= min_contexts).drop("n")
    pairs = counts.join(often, pair)
    pairs = cut(pairs.join(near(entities), who))
    # Copies count once, as above: all four counts are of different texts.
    texts = _once(docs)
    # Texts of every term of the corpus, by 64-bit hash, summed up map-side before any join.
    words = texts.select(F.explode(_terms(F.col("_t"))).alias("term"))
    frequency = words.groupBy(F.xxhash64("term").alias("_term")).agg(F.count(F.lit(1)).alias("n_term"))
    total = float(texts.count())
    pmi = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_term") * F.col("n_entity")))
    content = F.log2(F.lit(total) / F.col("n_entity"))
    share, rate = F.col("n_both") / F.col("n_term"), F.col("n_entity") / F.lit(total)
    surprise = share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    chance = float(math.log(max(1, tested)) + 2)
    judged = pairs.join(frequency, F.xxhash64("term") == F.col("_term")).withColumns({"pmi": pmi, "content": content}).where((F.col("content") > 0) & (F.col("pmi") >= alpha * F.col("content")))
    return judged.where(F.col("n_term") * surprise > chance).select("term", "kind", "entity", "n_both", "n_term", "n_entity", "pmi", "content")


def _added(docs: DataFrame, reveal: DataFrame) -> DataFrame:
    """(_key, _found): a pattern of the disclosing terms that a text holds."""
    held = docs.select("_key", F.explode(_terms(F.col("_t"))).alias("term")).join(near(reveal), "term")
    return held.groupBy("_key").agg(F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(F.collect_set("term"), "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])")).alias("_found"))


def find(docs: DataFrame, text: str = "text", alpha: float = ALPHA, min_contexts: int = MIN_CONTEXTS) -> tuple[DataFrame, dict[str, str]]:
    """Rows of ``docs`` with ``base`` and ``spans``, and the names that their columns have there.

    Spans are arrays of (start, rank, stop, kind, value); ``_t`` is the text.  Null texts are
    empty and have no spans.  Texts that are equal share their spans, so rows need no identifier
    and may repeat, and columns of any name are carried.
    """
    held, at = positional(docs)
    held = held.withColumn("_t", text_column(at[text])).withColumn("_key", F.sha2("_t", 256))
    texts = held.select("_key", "_t")
    found = marked(texts)
    reveal = cut(disclosing(found, texts, alpha, min_contexts).select("term").distinct())
    known = found.select("_key", "base")
    if reveal.limit(1).count():
        known = known.join(_added(texts, reveal), "_key", "full")
    else:
        known = known.withColumn("_found", F.lit(None).cast("string"))
    out = join_small(held, cut(known), ["_key"])
    out = out.withColumn("base", F.coalesce("base", F.expr(f"cast(array() as {_SPANS})")))
    # In the order of starts a word is clear if what began before it has ended and nothing begins in it.
    words = F.transform(located(F.col("_t"), F.col("_found")), lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), w["stop"].alias("stop"), F.lit(TERM).alias("kind"), F.lower(w["value"]).alias("value")))
    out = out.withColumn("_all", F.when(F.col("_found").isNotNull(), F.sort_array(F.concat("base", words.cast(_SPANS)))))
    own = lambda f, other: F.transform("_all", lambda s: F.when(s["rank"] < len(KINDS), f(s)).otherwise(other))
    ended = prefixes(own(lambda s: s["stop"], F.lit(0)), 0, _later)
    begins = F.reverse(prefixes(F.reverse(own(lambda s: s["start"], F.lit(_FAR))), _FAR, lambda a, x: F.least(a, x)))
    around = F.zip_with(ended, begins, lambda e, b: F.struct(e.alias("e"), b.alias("b")))
    kept = F.filter(F.zip_with("_all", around, lambda s, a: F.struct(s.alias("s"), a.alias("a"))), lambda x: (x["s"]["rank"] < len(KINDS)) | (x["a"]["e"] <= x["s"]["start"]) & (x["a"]["b"] >= x["s"]["stop"]))
    return out.withColumn("spans", F.when(F.col("_found").isNull(), F.col("base")).otherwise(F.transform(kept, lambda x: x["s"]))).drop("_all"), at


def described(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the kinds, SHA-256 of the base spans, all spans.

    Null and empty texts have counts of 0 and no spans; repeated rows give repeated rows.
    """
    found, at = find(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col(at["doc_id"]).alias("doc_id"), *(count(k) for k in KINDS), F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span of the text generalised to its kind, as ``[EMAIL]`` or ``[TERM]``.

    Spans that overlap become one, named after the first.  Other columns, of any name, stay as
    they are; a null text stays null.
    """
    found, at = find(docs, text, **options)
    found = found.withColumns({"_c": _chunks(F.col("_t")), "_n": F.length("_t"), "_at": prefixes(F.transform("spans", lambda s: s["stop"]), 0, _later)})
    label = lambda s, at: F.when(s["start"] < at, "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    clean = F.when(F.size("spans") == 0, F.col(at[text])).otherwise(_between(F.col("_c"), F.col("_n"), F.col("spans"), F.col("_at"), label))
    return found.select(*((clean if c == text else F.col(n)).alias(c) for c, n in at.items()))
