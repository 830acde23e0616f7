"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random directions and each projection is sorted.  Two
vectors collide on a projection if one lies in the window of half width w around the other; a
pair that collides often enough is verified by its cosine.  Width and count are calibrated: a
pair at the threshold passes the count with probability ``TARGET_RECALL``.

A pair may miss at most ``GROUPS - 1`` of the projections.  So, with the projections split into
``GROUPS`` groups, it collides on all of some group: it is enough to walk the windows of one
sorted projection per group, and a pair is counted for the first group it collides in all
through.  Vectors are dealt to blocks by hash, and two blocks meet in one cell, where the windows
of all groups are walked; a cell returns link counts and a spanning forest, never pairs.

On isotropic vectors a window holds a fixed share of them (about half, for a cosine of 0.9), so
the comparisons grow with the square of the distinct vectors.  A vector moves once per block, in
the precision it came in, and a block has as many as a task can hold.
"""

from __future__ import annotations

import hashlib
from math import comb, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Unions, cut, width
from evidentia.llm.components import components

THRESHOLD = 0.9
PROJECTIONS, GROUPS = 24, 4
TARGET_RECALL = 0.9999
#: Bytes of a block, of which a task holds two, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 24 << 20, 12
#: Vectors of a strip and of what it is compared with at a time, and pairs whose collisions are counted at a time.
STRIP, SPAN, PAIRS = 64, 2048, 50_000


def half_width(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> float:
    """Window half width at which a pair at the threshold passes the count as often as wanted.

    The difference of two projections is normal with the distance of the vectors as deviation.
    """
    n, most = PROJECTIONS, GROUPS - 1
    low, high = 0.5, 1.0 - 1e-12
    for _ in range(200):
        p = (low + high) / 2
        passes = sum(comb(n, k) * (1 - p) ** k * p ** (n - k) for k in range(most + 1))
        low, high = (p, high) if passes < target else (low, p)
    return sqrt(2 - 2 * threshold) * NormalDist().inv_cdf((1 + high) / 2)


def directions(dimension: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((PROJECTIONS, dimension))


def components_type(vectors: DataFrame, embedding: str) -> str:
    """Numpy's name of the type that holds every component exactly."""
    return "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"


def projected(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, digest, dim, norm, vec, proj): bytes of the components, as they came, and of float32 projections.

    ``digest`` is null for vectors that link with nothing: null, empty or zero ones and those
    with a null or non-finite component.
    """
    kind, made = dict(vectors.dtypes)[vec_id], components_type(vectors, embedding)

    def project(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for row, key, v in zip(batch["row"], batch["vec_id"], batch["vec"], strict=True):
                x = None if v is None else np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", None) == object else v, dtype=np.float64)
                norm = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.sqrt(np.square(x / np.abs(x).max()).sum()) * np.abs(x).max()) if x.any() else 0.0
                if not norm or not np.isfinite(norm):
                    out.append((row, key, None, 0, None, None, None))
                    continue
                if len(x) not in known:
                    known[len(x)] = directions(len(x))
                unit = x / norm
                out.append((row, key, hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(x), norm, x.astype(made).tobytes(), (known[len(x)] @ unit).astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["row", "vec_id", "digest", "dim", "norm", "vec", "proj"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("vec"))
    return cut(rows.mapInPandas(project, f"row long, vec_id {kind}, digest binary, dim int, norm double, vec binary, proj binary"))


def deal(reps: DataFrame) -> DataFrame:
    """(cell, side, node, copies, dim, norm, vec, proj): each vector in the cells of its block, one with every block.

    ``side`` is 2 in the cell of a block with itself, else 0 and 1 for its two blocks.
    """
    size = reps.agg(F.sum(F.octet_length("vec") + F.octet_length("proj") + 32)).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks))
    dealt = reps.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    cell = F.least("_own", "_other") * blocks + F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") > F.col("_other"), 1).otherwise(0)
    return dealt.select(cell.alias("cell"), side.alias("side"), "node", "copies", "dim", "norm", "vec", "proj")


def _ones(tests: np.ndarray) -> np.ndarray:
    """How many of each row of ``PROJECTIONS`` tests hold: its bytes are added eight at a time."""
    eights = tests.view(np.uint64)
    return eights.sum(axis=1) * np.uint64(0x0101010101010101) >> np.uint64(56)


def compare(w: float, threshold: float, made: str = "<f8"):
    """The work of a cell: window collisions of each group, their count per pair, and the cosines of those that pass."""
    per = PROJECTIONS // GROUPS
    need = PROJECTIONS - GROUPS + 1

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        proj = np.frombuffer(b"".join(rows["proj"]), np.float32).reshape(n, PROJECTIONS)
        vec = np.frombuffer(b"".join(rows["vec"]), made).reshape(n, -1)
        node, copies, side, norm = (rows[c].to_numpy() for c in ("node", "copies", "side", "norm"))
        unit = lambda at: vec[at].astype(np.float64) / norm[at, None]
        whole = side[0] == 2
        links, found = np.zeros(n, np.int64), Unions(n)
        # One place for all differences and one for their tests: an array made anew for each costs more than its numbers.
        gaps, hits, tests = np.empty(STRIP * SPAN, np.float32), np.empty(STRIP * SPAN, bool), np.empty(STRIP * SPAN, bool)

        def collide(mine: np.ndarray, theirs: np.ndarray, out: np.ndarray) -> np.ndarray:
            gap = gaps[: out.size].reshape(out.shape)
            np.subtract(mine[:, None], theirs[None, :], out=gap)
            return np.less_equal(np.abs(gap, out=gap), w, out=out)

        for g in range(GROUPS):
            order = np.argsort(proj[:, g * per], kind="stable")
            left, right = (order, order) if whole else (order[side[order] == 0], order[side[order] == 1])
            columns = np.ascontiguousarray(proj[right, g * per : (g + 1) * per].T)
            for at in range(0, len(left), STRIP):
                strip = left[at : at + STRIP]
                mine = np.ascontiguousarray(proj[strip, g * per : (g + 1) * per].T)
                low, high = np.searchsorted(columns[0], [mine[0].min() - w, mine[0].max() + w], side="left")
                for c in range(max(int(low), at) if whole else int(low), int(high) + 1, SPAN):
                    d = min(c + SPAN, int(high) + 1, len(right))
                    if d <= c:
                        break
                    inside, test = (a[: len(strip) * (d - c)].reshape(len(strip), d - c) for a in (hits, tests))
                    collide(mine[0], columns[0, c:d], inside)
                    for k in range(1, per):
                        inside &= collide(mine[k], columns[k, c:d], test)
                    if whole:  # each pair once, and none with itself
                        inside &= np.arange(at, at + len(strip))[:, None] < np.arange(c, d)[None, :]
                    x, y = np.divmod(np.flatnonzero(inside), d - c)
                    for i in range(0, len(x), PAIRS):
                        s, t = strip[x[i : i + PAIRS]], right[c + y[i : i + PAIRS]]
                        near = np.abs(np.take(proj, s, 0) - np.take(proj, t, 0)) <= w
                        passed = _ones(near) >= need
                        s, t, near = s[passed], t[passed], near[passed]
                        # A pair all through an earlier group is that group's.
                        own = ~near[:, : g * per].reshape(len(s), g, per).all(axis=2).any(axis=1)
                        s, t = s[own], t[own]
                        cosine = np.einsum("ij,ij->i", unit(s), unit(t))
                        s, t = s[cosine >= threshold], t[cosine >= threshold]
                        np.add.at(links, s, copies[t])
                        np.add.at(links, t, copies[s])
                        found.absorb(s, t)
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[found.label[some]]})

    return one


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors``.

    Vectors link if their cosine is at least ``threshold``; equal ones are collapsed first and
    count as linked.  Vectors of different lengths never link; those that link with nothing
    (see ``projected``) are a component each.  Ids may repeat or be null.
    """
    w = half_width(threshold)
    rows = projected(vectors, vec_id, embedding)
    classes = cut(rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")))
    reps = cut(rows.join(classes.select("node", "copies"), rows["row"] == F.col("node")).select("node", "copies", "dim", "norm", "vec", "proj"))
    cells = deal(reps).repartition(4 * width(vectors.sparkSession), "cell", "dim")
    links = cut(cells.groupBy("cell", "dim").applyInPandas(compare(w, threshold, components_type(vectors, embedding)), "node long, links long, root long"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = groups.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = classes.join(counts, "node", "left").join(groups, "node", "left").join(named, "component", "left")
    of_vec = of_node.select("digest", F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = rows.select("vec_id", "digest").join(of_vec, "digest", "left")
    full = full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return full.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
