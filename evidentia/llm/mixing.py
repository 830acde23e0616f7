"""Mixing sources to target weights by Poisson replication.

The repetition rate of a source is the mean of a Poisson distribution; each document's count is
the inverse of that distribution at a uniform number hashed from its id and the seed, so a
rerun, or a retry after a lost executor, repeats the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, near, positional, width

#: Weight of a source: its documents to this power (1: as they are, 0: all alike).
TEMPERATURE = 0.5
#: Means above this are drawn as a sum of equal parts, since exp(-mean) would vanish.
PART = 256.0


def uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of a SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("double") / float(16**13)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """Smallest k whose cumulative probability exceeds ``u``."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(s["c"] > u, s).otherwise(
        F.struct((s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), i.cast("int").alias("k"))
    )
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: dict | None = None, total: float | None = None, source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """Mean repetitions per source: ``total * weight / documents of the source``.

    ``weights`` maps sources to shares (missing sources get none); by default a share follows
    the source's documents to the power ``temperature``.  ``total``: rows wanted, by default as
    many as there are.  Null is a source like any other.
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    if weights is None:
        share = F.pow("_n", F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for k, v in weights.items():
            share = F.when(F.col("_source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(share)
    shares = cut(counts.withColumn("_w", share))
    rows, weight = shares.agg(F.sum("_n"), F.sum("_w")).first()  # two numbers
    wanted = float(rows or 0.0) if total is None else float(total)
    rate = F.lit(wanted) * F.col("_w") / F.lit(weight) / F.col("_n") if weight else F.lit(0.0)
    return near(shares).select("_source", rate.alias("_rate"))


def mix(
    docs: DataFrame, weights: dict | None = None, total: float | None = None, seed: int = 0, doc_id: str = "doc_id", source: str = "source", temperature: float = TEMPERATURE
) -> DataFrame:
    """``docs`` with rows dropped or repeated to the target weights, in a hashed global order.

    Adds ``copy`` (from 0) and ``shuffle_key``, except where ``docs`` has a column of that name,
    which is carried like all others; rows come range-partitioned and sorted by the key.  Equal
    ids get equal counts and keys; rows with a null id count as id ''.  Rows of one key, however
    many, are dealt to several ranges.  Empty tables stay empty.
    """
    names = docs.columns
    held, at = positional(docs)
    by = rates(held, weights, total, at[source], temperature)
    key = F.coalesce(F.col(at[doc_id]).cast("string"), F.lit(""))
    df = held.join(by, held[at[source]].eqNullSafe(by["_source"])).drop("_source")
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("_rate") / PART)).cast("int")
    count = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda n, j: n + poisson_inverse(uniform(F.lit(str(seed)), key, j.cast("string")), F.col("_rate") / parts),
    )
    df = df.withColumn("_count", count).where("_count > 0").withColumn("_row", F.monotonically_increasing_id())
    df = df.select(*held.columns, "_row", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("copy"))
    df = df.withColumn("shuffle_key", F.sha2(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("copy").cast("string")), 256))
    df = df.repartitionByRange(width(docs.sparkSession), "shuffle_key", "_row").sortWithinPartitions("shuffle_key", "_row")
    return df.select(*(F.col(n).alias(c) for c, n in at.items()), *(c for c in ("copy", "shuffle_key") if c not in names))
