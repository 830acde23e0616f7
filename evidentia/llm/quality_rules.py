"""Quality rules whose cutoffs are learned per language and source from quantile sketches.

DataFrame functions only.  Measures are computed row by row (no shuffle of text); the sketches
are ``percentile_approx`` states, merged map-side, so a source with a third of all rows costs
one state per task; the thresholds are joined back to the measures.

The measures are ones that nearly every text has some of, so their quartiles say where a group
lies and how far it spreads.  A group's quartiles are drawn towards those of the next wider group
with a weight of ``PRIOR_ROWS`` rows, so few rows say little, and its spread is taken for half of
that one's at least, so a group of copies doesn't reject whatever differs from them.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import WS, cut, near, positional, text_column

#: Distance of a cutoff from the quartile, in interquartile ranges.
FENCE = 4.0
#: Deviations of chance that a short text is granted besides.
CHANCE = 3.0
#: Rows that the wider group counts for, and the share of its spread that is taken at least.
PRIOR_ROWS, POOL_SHARE = 20, 0.5
#: measure: side of the cutoff
RULES = {"mark_ratio": "high", "upper_ratio": "high", "mean_word": "both"}
SKETCH_ACCURACY = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _shifted(name: str, gap) -> Column:
    """``gap`` of each element and its successor."""
    c = F.col(name)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), gap)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of COUNTS, ``base_failed`` and the ratios of RULES.

    Null and empty texts have no words: all counts 0, ratios 0, ``base_failed`` true.  Other
    columns are carried, but for those that have a name of the new ones.
    """
    docs, at = positional(docs)
    keep = {c: n for c, n in at.items() if c not in {*COUNTS, *RULES, "base_failed"}}
    df = docs.select(*keep.values(), text_column(at[text]).alias("_q_t"))
    df = df.withColumn("_q_w", F.array_remove(F.split("_q_t", WS), ""))
    df = df.withColumn("_q_l", F.filter(F.split("_q_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    last = F.size("_q_w") - 4
    df = df.withColumn(
        "_q_h",
        F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice("_q_w", i, 5)))).otherwise(F.expr("array()").cast("array<bigint>")),
    )
    # Windows sorted by hash, then place; neighbours of equal hash are repeats.  Few texts have any.
    repeats = F.size("_q_h") > F.size(F.array_distinct("_q_h"))
    df = df.withColumn("_q_s", F.when(repeats, F.sort_array(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = _shifted("_q_s", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.expr("array()").cast("array<int>")))
    df = df.withColumn("_q_p", F.when(F.col("_q_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(pairs)))))
    covered = F.aggregate(_shifted("_q_p", lambda a, b: F.least(b - a, F.lit(5))), F.lit(5), lambda x, y: x + y)
    long = lambda c: c.cast("long")
    df = df.withColumns(
        {
            "n_words": long(F.size("_q_w")),
            "word_chars": long(F.length(F.translate("_q_t", " \t\n\x0b\f\r", ""))),
            "n_symbols": long(F.length("_q_t") - F.length(F.translate("_q_t", "#*$%&|<>", ""))),
            "n_dup_lines": long(F.size("_q_l") - F.size(F.array_distinct("_q_l"))),
            "n_repeat_words": long(F.when(F.size("_q_p") > 0, covered).otherwise(0)),
            "_q_marks": F.length(F.regexp_replace("_q_t", r"[\p{L}\p{N}\p{M}\x20\x09-\x0D]+", "")),
            "_q_upper": F.length("_q_t") - F.length(F.regexp_replace("_q_t", r"\p{Lu}", "")),
        }
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double")).otherwise(F.lit(0.0))
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "mark_ratio": ratio("_q_marks", "word_chars"),
            "upper_ratio": ratio("_q_upper", "word_chars"),
            "mean_word": ratio("word_chars", "n_words"),
        }
    )
    return df.select(*(F.col(n).alias(c) for c, n in keep.items()), *COUNTS, "base_failed", *RULES)


def thresholds(measured: DataFrame, keys: tuple[str, ...] = ("lang", "source"), fence: float = FENCE, prior: float = PRIOR_ROWS, share: float = POOL_SHARE) -> DataFrame:
    """Per key ``low_<measure>`` and ``high_<measure>``, its quartiles, and ``by_<measure>``, what a cutoff lies beyond them.

    From sketches of all rows, of the rows that share the first key, and so on to the group's
    own.  A measure without any spread over all rows has a null ``by``: it decides nothing.
    """
    levels = [list(keys[:n]) for n in range(len(keys) + 1)]
    stats = (F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), SKETCH_ACCURACY).alias(m) for m in RULES)
    sets = measured.groupingSets([[F.col(k) for k in level] for level in levels], *(F.col(k) for k in keys))
    sketches = cut(sets.agg(F.grouping_id().cast("int").alias("_level"), F.count(F.lit(1)).alias("_n"), *stats))
    rows = lambda n: sketches.where(F.col("_level") == 2 ** (len(keys) - n) - 1)
    whole = [c for m in RULES for c in (F.col(m)[0].alias(f"low_{m}"), F.col(m)[1].alias(f"high_{m}"), (F.col(m)[1] - F.col(m)[0]).alias(f"s_{m}"))]
    out, names = rows(0).select(*whole, *(F.when(F.col(m)[1] > F.col(m)[0], F.lit(fence)).alias(f"f_{m}") for m in RULES)), []
    for n, level in enumerate(levels[1:], 1):
        wider = near(cut(out.select(*(F.col(k).alias(f"_w_{k}") for k in names), *(c for c in out.columns if c not in names))))
        same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in names), F.lit(True))
        drawn = []
        for m in RULES:
            low, high = ((F.col("_n") * F.col(m)[i] + prior * F.col(f"{side}_{m}")) / (F.col("_n") + prior) for i, side in enumerate(("low", "high")))
            drawn += [low.alias(f"low_{m}"), high.alias(f"high_{m}"), F.greatest(high - low, share * F.col(f"s_{m}")).alias(f"s_{m}"), F.col(f"f_{m}")]
        out, names = rows(n).join(wider, same).select(*level, *drawn), level
    return out.select(*names, *(c for m in RULES for c in (f"low_{m}", f"high_{m}", (F.col(f"f_{m}") * F.col(f"s_{m}")).alias(f"by_{m}"))))


def judge(measured: DataFrame, cutoffs: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``measured`` with ``kept``: not failed by the base rules and within its group's cutoffs.

    Null keys form a group of their own (null-safe join).
    """
    limits = cutoffs.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in cutoffs.columns if c not in keys))
    same = None
    for k in keys:
        one = measured[k].eqNullSafe(limits[f"_k_{k}"])
        same = one if same is None else same & one
    ok = ~F.col("base_failed")
    for m, side in RULES.items():
        # Counts of marks vary with their root, lengths of words by about half their mean.
        each = F.greatest(F.col("n_words" if m == "mean_word" else "word_chars"), F.lit(1)).cast("double")
        chance = CHANCE * (F.col(f"high_{m}") / 2 / F.sqrt(each) if m == "mean_word" else F.sqrt(F.col(f"high_{m}") / each))
        within = F.col(m) <= F.col(f"high_{m}") + F.col(f"by_{m}") + chance
        if side == "both":
            within = within & (F.col(m) >= F.col(f"low_{m}") - F.col(f"by_{m}") - chance)
        ok = ok & (within | F.col(f"by_{m}").isNull())
    return measured.join(limits, same, "left").withColumn("kept", F.coalesce(ok, F.lit(False))).drop(*limits.columns)


def assess(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("lang", "source"), fence: float = FENCE) -> DataFrame:
    """One row per document, without its text: other columns, counts, ``base_failed``, ``kept``.

    Texts are read once; the measures (numbers only) are checkpointed and read twice.  Empty
    tables give empty results; repeated rows are judged each on its own.
    """
    names = [c for c in docs.columns if c != text and c not in {*COUNTS, *RULES, "base_failed", "kept"}]
    hold, at = positional(docs)
    inner = tuple(at[k] for k in keys)
    measured = cut(measures(hold, at[text]).drop(at[text]))
    judged = judge(measured, thresholds(measured, inner, fence), inner)
    return judged.select(*(F.col(at[c]).alias(c) for c in names), *COUNTS, "base_failed", *RULES, "kept")


def filter_quality(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("lang", "source"), fence: float = FENCE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with.

    Needs no row identifier: the cutoffs are learned in a first pass and a second pass applies
    them, so repeated or null ids are no matter.
    """
    hold, at = positional(docs)
    inner = tuple(at[k] for k in keys)
    measured = measures(hold, at[text])
    cutoffs = near(cut(thresholds(measured.select(*inner, *RULES), inner, fence)))
    kept = judge(measured, cutoffs, inner).where("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in at.items()))
