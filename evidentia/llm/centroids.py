"""Clustering of integer vectors around centroids, with partial-distance search.

A vector's components are scaled and floored to integers, so distances and means are exact.  For
each centroid the squared differences are added up over the dimensions of highest variance first;
a vector abandons a centroid as soon as its partial sum is strictly above the best distance it
has, and survivors finish all dimensions.  Means are sums and counts that combine map-side: a
round moves a row per cluster and task.  Only the centroids, a fixed number, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Dimensions that are added up between two looks at the best distance.
STEP = 8
#: Largest integer of a component: squared distances then fit into 64 bits.
LARGEST = 1 << 27


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec array<long>) of the vectors that are kept.

    Those are of ``dimensions`` components, none null or non-finite, and none whose integer is
    beyond ``LARGEST``, where squared distances would leave 64 bits.
    """
    whole = F.col(f"`{embedding}`").cast("array<double>")
    sound = (F.size(whole) == dimensions) & F.forall(whole, lambda x: x.isNotNull() & (F.abs(x) * scale < float(LARGEST)))  # false for NaN as well: it sorts above all numbers
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), whole.alias("vec")).where(sound)
    return rows.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale)).alias("vec"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The kept vectors whose ids have the smallest hashes, in that order; ties by their components."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(named.alias("h"), "vec").orderBy("h", "vec").limit(clusters).collect()  # as many as clusters
    return np.array([r.vec for r in rows], np.int64)


def dimension_order(rows: DataFrame, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Dimensions by falling variance over all rows of ``packed``; the order decides no result."""

    def moments(batches):
        total, square, n = np.zeros(dimensions), np.zeros(dimensions), 0
        for batch in batches:
            x = _stacked(batch).astype(np.float64)
            total, square, n = total + x.sum(axis=0), square + np.square(x).sum(axis=0), n + len(x)
        yield pd.DataFrame({"d": np.arange(dimensions), "n": n, "s": total, "q": square})

    spread = (F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("v")
    found = rows.mapInPandas(moments, "d int, n long, s double, q double").where("n > 0").groupBy("d").agg(spread).collect()  # a row per dimension
    variance = {r.d: r.v or 0.0 for r in found}
    return np.argsort([-variance.get(d, 0.0) for d in range(dimensions)], kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of ``x``, and how many differences were added up.

    Ties go to the smaller number.  Centroids are tried in order of number, so a later one only
    wins by being strictly nearer.
    """
    best, label, work = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32), 0
    columns = np.ascontiguousarray(x[:, order].T)
    for number, centre in enumerate(centroids[:, order]):
        rows, total, held = np.arange(len(x)), np.zeros(len(x), np.int64), columns
        for at in range(0, len(centre), step):
            gap = held[at : at + step] - centre[at : at + step, None]
            work += gap.size
            total += np.einsum("ij,ij->j", gap, gap)
            going = total <= best[rows]
            if not going.all():
                rows, total, held = rows[going], total[going], held[:, going]
        nearer = total < best[rows]
        best[rows[nearer]], label[rows[nearer]] = total[nearer], number
    return label, best, work


def _stacked(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["packed"]), np.int32).reshape(len(batch), -1).astype(np.int64)


def packed(kept: DataFrame) -> DataFrame:
    """The kept vectors with their components as 32-bit bytes, for the rounds."""

    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "packed": [np.asarray(v, np.int32).tobytes() for v in batch["vec"]]})

    return kept.mapInPandas(pack, f"vec_id {dict(kept.dtypes)['vec_id']}, packed binary")


def moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Centroids after a round: exact floors of their vectors' means; empty ones stay."""

    def sums(batches):
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _stacked(batch)
            label, _, _ = nearest(x, centroids, order)
            for c in np.unique(label):
                total[c] += x[label == c].sum(axis=0)
                count[c] += (label == c).sum()
        k, d = np.indices(total.shape)
        yield pd.DataFrame({"cluster": k.ravel(), "d": d.ravel(), "s": total.ravel(), "n": np.repeat(count, total.shape[1])})

    # Sums of all tasks in decimals: they can't leave their range.
    sums_of = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("s", "n")]
    added = rows.mapInPandas(sums, "cluster int, d int, s long, n long").where("n > 0").groupBy("cluster", "d").agg(*sums_of).collect()  # a row per number of the centroids
    out = centroids.copy()
    for r in added:
        out[r.cluster, r.d] = int(r.s) // int(r.n)
    return out


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of the kept vectors, final centroids).

    See ``integers`` for which vectors are kept.  Fewer kept vectors than ``clusters`` give as
    many centroids; of an empty table the result is empty.  Repeated rows count each.
    """
    kept = integers(vectors, vec_id, embedding, dimensions, scale)
    rows = cut(packed(kept))
    centroids, order = first_centroids(kept, clusters, seed), dimension_order(rows, dimensions)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
    for _ in range(rounds):
        centroids = moved(rows, centroids, order)
    final = centroids

    def assigned(batches):
        for batch in batches:
            label, distance, _ = nearest(_stacked(batch), final, order)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": label, "distance": distance})

    return rows.mapInPandas(assigned, f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long"), final


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of ``cluster`` with the inertia of their cluster and of all, and a digest of their centroid."""
    held = cut(assigned)
    wide = "decimal(38,0)"
    sums = held.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide)).alias("i")).collect()  # a row per cluster
    whole = sum(int(r.i) for r in sums)
    known = [(r.cluster, int(r.i), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    about = assigned.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, centroid_sha256 string")
    return held.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")
