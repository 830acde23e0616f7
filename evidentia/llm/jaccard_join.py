"""Similarity join of texts by the Jaccard index of their five-word shingles.

A MinHash LSH forest proposes: each tree sorts the texts by a label of MinHash values, a trie of
its prefixes.  Texts that share the whole label are compared first; then the prefix is shortened
value by value, and subtrees that meet are compared where they aren't connected yet, down to the
prefix with which a link of that text is found with the target probability.  That prefix depends
on the text: its number of shingles says how dissimilar its links can be.  Comparing is done
inside tasks, in subtrees of bounded size; a task returns the edges of a spanning forest and
never pairs.  What the forest connects is then verified exactly, block against block.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Unions, WordHashes, cut, grouped, near, positional, runs, shingles, text_column, width
from evidentia.llm.components import components

THRESHOLD = 0.8
#: Trees, MinHash values of a full label, and the least probability that a linked pair meets.
TREES, LABEL = 16, 8
TARGET_RECALL = 0.999
#: Standard deviations that a sketch's estimate may lie below the threshold.
SLACK = 4.0
#: Texts of a block: in the forest's buckets and in verification.
BUCKET_BLOCK, VERIFY_BLOCK = 512, 256
#: Shingles that count as a text when groups are cut into blocks, and shingles intersected at a time.
ROW_SHINGLES, RANGE_SHINGLES = 4096, 1_000_000


def depth(similarity: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Prefix length, shortened from the label until pairs so similar meet with the target probability."""
    d = LABEL
    while d > 1 and 1 - (1 - similarity**d) ** TREES < target:
        d -= 1
    return d


@functools.lru_cache(100_000)
def least_similarity(items: int, threshold: float = THRESHOLD) -> float:
    """Smallest Jaccard index, of the threshold or more, that a set of ``items`` can have with any set.

    With c elements in common, the other set has c to c / t - items + c of them.
    """
    least = 1.0
    for c in range(max(1, int(threshold * items) - 1), items + 1):
        other = int(c / threshold + 1e-9) - items + c
        if other >= c:
            least = min(least, max(threshold, c / (items + other - c)))
    return least


@functools.lru_cache(100_000)
def floor(items: int, threshold: float = THRESHOLD) -> int:
    """Shortest prefix that a text of so many shingles is looked up with."""
    return depth(least_similarity(items, threshold) if items < 1000 else threshold)


class Signer:
    """MinHash values of shingle sets: prefixes of the trees' labels, and a sketch of one byte a value."""

    def __init__(self, prefix: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = TREES * LABEL
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.mix = rng.integers(1, 2**63, (TREES, LABEL), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.prefix = prefix

    def __call__(self, items: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = np.full(len(self.a), np.iinfo(np.uint64).max)
        with np.errstate(over="ignore"):
            for at in range(0, len(items), 4096):
                part = items[at : at + 4096]
                np.minimum(low, ((part[None, :] ^ self.b[:, None]) * self.a[:, None]).min(axis=1), out=low)
            values = (low >> np.uint64(24)).reshape(TREES, LABEL)
            keys = ((values[:, : self.prefix] + np.uint64(1)) * self.mix[:, : self.prefix]).sum(axis=1)
            keys ^= keys >> np.uint64(31)
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(TREES, dtype=np.uint64)
        return keys.view(np.int64), (values.ravel() & np.uint64(255)).astype(np.uint8).tobytes()


def signed(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """(row, doc_id, digest, keys, sketch, items) of every row, ``items`` shingles; no keys for texts without words."""
    kind = dict(docs.dtypes)[doc_id]
    prefix = depth(threshold)

    def sign(batches):
        hashes, signer = WordHashes(), Signer(prefix)
        for batch in batches:
            keys, sketches, sizes = [], [], []
            for body in batch["text"]:
                items = shingles(body, hashes)
                sizes.append(len(items))
                k, s = signer(items) if len(items) else (None, None)
                keys.append(k)
                sketches.append(s)
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "digest": batch["digest"], "keys": keys, "sketch": sketches, "items": sizes})

    body = text_column(text)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text"))
    return cut(rows.mapInPandas(sign, f"row long, doc_id {kind}, digest binary, keys array<long>, sketch binary, items int"))


def _blocks(df: DataFrame, size: int, key: str, count: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: ``cell`` (one task's unit) and ``side``.

    A group of up to ``size`` rows is one cell (side 2: both); of larger ones each pair of
    blocks is a cell, so no cell holds more than about twice ``size`` rows.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(count) / size)).cast("int")
    df = df.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64("node", key), F.col("_n")).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_o") == F.col("_b"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    cell = F.struct(F.col(key), F.least("_b", "_o"), F.greatest("_b", "_o"))
    return df.withColumns({"cell": F.xxhash64(cell, F.lit(11)), "side": side.cast("int")}).drop("_n", "_b", "_o", count)


def _sketches(cell: pa.Table, column: str = "sketch", size: int = TREES * LABEL) -> np.ndarray:
    return np.frombuffer(b"".join(cell[column].to_pylist()), np.uint8).reshape(cell.num_rows, size)


def climb(label: np.ndarray, lowest: np.ndarray, sketch: np.ndarray, least: int, top: int) -> Unions:
    """Connect the rows of a trie whose sketches agree in ``least`` values, from the leaves up.

    Rows are sorted by ``label``.  At each prefix length, down to ``top``, the subtrees of a
    common prefix are compared, except rows whose own prefix may not be that short (``lowest``)
    and subtrees that are connected already.
    """
    n = len(label)
    found = Unions(n)
    common = (label[1:] == label[:-1]).cumprod(axis=1).sum(axis=1) if n > 1 else np.empty(0, np.int64)
    for d in range(LABEL, top - 1, -1):
        edges = np.flatnonzero(common < d) + 1
        for a, b in zip([0, *edges], [*edges, n], strict=True):
            if b - a < 2:
                continue
            rows = np.arange(a, b)[lowest[a:b] <= d]
            if len(rows) < 2 or (found.label[rows] == found.label[rows[0]]).all():
                continue
            inner = np.searchsorted(np.flatnonzero(common[a : b - 1] <= d) + a + 1, rows, side="right") if d < LABEL else np.arange(len(rows))
            for i in range(0, len(rows), 64):
                part = rows[i : i + 64]
                other = rows[i:][inner[i:] != inner[i]] if inner[i] == inner[min(i + 63, len(rows) - 1)] else rows[i:]
                if len(other) and not (found.label[other] == found.label[part[0]]).all() or len(set(found.label[part])) > 1:
                    x, y = np.nonzero((sketch[part][:, None, :] == sketch[other][None, :, :]).sum(axis=2) >= least)
                    found.absorb(part[x], other[y])
    return found


def _forest(node: np.ndarray, found: Unions) -> pa.RecordBatch:
    """Edges to the smallest node of each set: sets that recur in other cells give the same edges."""
    root = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(root, found.label, node)
    root = root[found.label]
    moved = node != root
    return pa.RecordBatch.from_pydict({"a": node[moved], "b": root[moved]})


def _joined(parts, rows: int = 20_000):
    """Record batches put together to about ``rows`` rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= rows or len(held) >= 2000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def meet(reps: DataFrame, threshold: float) -> DataFrame:
    """(node, component) over nodes whose sketches agree, among those that meet in a tree.

    Texts are dealt by tree and by the shortest prefix that any of them is looked up with, and
    sorted by their labels: a cell is a subtree, or a block of it if it is large.  In subtrees of
    several blocks whose texts are not all connected by now, texts of different components are
    compared across blocks.
    """
    n = TREES * LABEL
    least = int(np.floor(n * threshold - SLACK * np.sqrt(n * threshold * (1 - threshold))))
    top = depth(threshold)
    keys = reps.select("node", F.posexplode("keys").alias("tree", "key"))
    crowded = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = keys.join(crowded, "key").join(reps.select("node", "items", "sketch"), "node")

    def inside(batches):
        def edges():
            for cell in grouped(batches, "cell"):
                lowest = np.array([floor(i, threshold) for i in cell["items"].to_pylist()])
                found = climb(_sketches(cell, "label", LABEL), lowest, _sketches(cell), least, top)
                yield _forest(cell["node"].to_numpy(), found)

        return _joined(edges())

    def across(batches):
        def edges():
            for cell in grouped(batches, "cell"):
                node, side, group = (cell[c].to_numpy() for c in ("node", "side", "group"))
                sketch, found = _sketches(cell), Unions(len(node))
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                left = left[np.argsort(group[left], kind="stable")]
                for a, b in runs(group[left]):
                    other = right[group[right] != group[left[a]]]
                    for i in range(a, b if len(other) else a, 64):
                        part = left[i : min(i + 64, b)]
                        x, y = np.nonzero((sketch[part][:, None, :] == sketch[other][None, :, :]).sum(axis=2) >= least)
                        found.absorb(part[x], other[y])
                yield _forest(node, found)

        return _joined(edges())

    def compared(dealt: DataFrame, work, *order: str) -> DataFrame:
        dealt = dealt.repartition(width(reps.sparkSession), "cell").sortWithinPartitions("cell", *order)
        return cut(dealt.mapInArrow(work, "a long, b long"))

    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("node", "key"), blocks)).otherwise(F.lit(0)).cast("int")
    label = F.substring(F.col("sketch"), F.col("tree") * LABEL + 1, F.lit(LABEL))
    first = members.select(F.xxhash64("key", own).alias("cell"), "node", "items", label.alias("label"), "sketch")
    near_ones = compared(first, inside, "label", "node")
    groups = components(near_ones)
    large = members.where(F.col("n") > BUCKET_BLOCK)
    if not crowded.where(F.col("n") > BUCKET_BLOCK).limit(1).count():
        return groups
    large = large.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    mixed = large.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    rest = _blocks(large.join(mixed, "key", "left_semi"), BUCKET_BLOCK, "key", "n").where("side <> 2")
    more = compared(rest.select("cell", "side", "group", "node", "sketch"), across, "node")
    return components(near_ones.union(more))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of every left set with every right (or left) set."""
    other = left if right is None else right
    if len(left) * len(other) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in other] for x in left], dtype=np.int64)
    sets = left if right is None else [*left, *right]
    total = np.zeros((len(left), len(other)), np.float64)
    # Shingles are hashes: ranges of their values bound what is sorted at a time.
    parts = max(1, -(-sum(map(len, sets)) // RANGE_SHINGLES))
    edges = np.array([i * 2**64 // parts for i in range(1, parts)], np.uint64)
    bounds = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    columns = 4096
    for part in range(parts):
        some = [s[at[part] : at[part + 1]] for s, at in zip(sets, bounds, strict=True)]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in some])
        _, code, times = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        shared = times > 1
        rank = np.cumsum(shared) - 1
        use = shared[code]
        owner, code = owner[use], rank[code[use]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for at in range(0, int(shared.sum()), columns):
            a, b = np.searchsorted(code, [at, at + columns])
            grid = np.zeros((len(sets), columns), np.float32)
            grid[owner[a:b], code[a:b] - at] = 1
            total += grid[: len(left)] @ (grid if right is None else grid[len(left) :]).T
    return total.astype(np.int64)


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from ``members(node, component, size, copies, text)``, exactly.

    ``links`` counts the documents of the linked texts that a cell saw; ``root`` is a node
    connected to this one, so that (node, root) over all cells spans the links.
    """
    dealt = _blocks(members, VERIFY_BLOCK, "component", "size").select("cell", "side", "node", "copies", "text")
    dealt = dealt.repartition(width(members.sparkSession), "cell").sortWithinPartitions("cell", "node")

    def cells(batches):
        hashes = WordHashes()
        for cell in grouped(batches, "cell"):
            cell = cell.take(np.unique(cell["node"].to_numpy(), return_index=True)[1])  # rows of one id and text
            sets = [shingles(t.as_py(), hashes) for t in cell["text"]]
            node, copies, side = (cell[c].to_numpy() for c in ("node", "copies", "side"))
            size = np.array([len(s) for s in sets])
            local = np.arange(len(sets))
            left, right = (local, None) if side[0] == 2 else (local[side == 0], local[side == 1])
            common = overlaps([sets[i] for i in left], None if right is None else [sets[i] for i in right])
            right = left if right is None else right
            linked = common / np.maximum(1, size[left][:, None] + size[right][None, :] - common) >= threshold
            linked &= left[:, None] != right[None, :]
            count = np.zeros(len(sets), np.int64)
            count[left] += (linked * copies[right][None, :]).sum(axis=1)
            if side[0] != 2:
                count[right] += (linked * copies[left][:, None]).sum(axis=0)
            found = Unions(len(sets))
            x, y = np.nonzero(linked)
            found.absorb(left[x], right[y])
            roots = found.label
            some = count > 0
            yield pa.RecordBatch.from_pydict({"node": node[some], "links": count[some], "root": node[roots[some]]})

    return dealt.mapInArrow(lambda batches: _joined(cells(batches)), "node long, links long, root long")


def join(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, class_id, class_node, n_links, n_same), a row per row of ``docs``.

    Documents link if the Jaccard index of their shingle sets is at least ``threshold``; equal
    texts are one class from the start.  ``n_links``: other documents linked directly;
    ``class_id``: smallest ``doc_id`` reachable by links.  Texts without words (null, empty)
    link with nothing and are a class each.  Ids may repeat or be null, so classes can share a
    ``class_id``; ``class_node``, a row number, is their own.  ``n_same`` counts rows of the same
    id and text.
    """
    rows = signed(docs, doc_id, text, threshold)
    classes = cut(rows.where("keys is not null").groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), F.max("items").alias("items")))
    reps = rows.join(classes.select("node"), rows["row"] == F.col("node")).select("node", "items", "keys", "sketch")
    clusters = meet(reps, threshold)
    weight = F.ceil(F.sum("items") / ROW_SHINGLES).cast("long")
    sizes = clusters.join(classes.select("node", "items"), "node").groupBy("component").agg(F.greatest(F.count(F.lit(1)), weight).alias("size"))
    chosen = cut(clusters.join(sizes, "component").join(classes, "node").select("node", "component", "size", "copies", F.col("digest").alias("_digest"), F.col("first").alias("_first")))
    body = text_column(text)
    texts = docs.select(F.col(f"`{doc_id}`").alias("_id"), body.alias("text")).withColumn("_hash", F.unhex(F.sha2("text", 256)))
    members = texts.join(near(chosen), (texts["_hash"] == F.col("_digest")) & texts["_id"].eqNullSafe(F.col("_first"))).select("node", "component", "size", "copies", "text")
    links = cut(verify(members, threshold))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = groups.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("class_id"))
    of_node = classes.join(counts, "node", "left").join(groups, "node", "left").join(named, "component", "left")
    of_text = of_node.select("digest", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("component", "node").alias("class_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    same = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n_same"))
    full = rows.select("row", "doc_id", "digest").join(of_text, "digest", "left")
    full = full.withColumns({"class_id": F.coalesce("class_id", "doc_id"), "class_node": F.coalesce("class_node", "row"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")})
    again = same.where("n_same > 1").withColumnsRenamed({"doc_id": "_id", "digest": "_hash"})
    full = full.join(again, full["doc_id"].eqNullSafe(again["_id"]) & (full["digest"] == again["_hash"]), "left")
    return full.select("doc_id", "digest", "class_id", "class_node", "n_links", F.coalesce("n_same", F.lit(1)).alias("n_same"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row of the smallest id stays.

    Texts without words have no copies and stay.  Of rows with the same id and text one stays.
    Columns of any name are carried as they are.
    """
    names = docs.columns
    docs, at = positional(docs)
    doc_id, text = at[doc_id], at[text]
    found = cut(join(docs, threshold, doc_id, text))
    pair = (F.col("doc_id").alias("_i"), F.col("digest").alias("_h"))
    linked = found.where("n_links > 0")
    # Classes are told apart by their node: ids may repeat or be null, so class_id doesn't.
    keeper = linked.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")).alias("k"))
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("digest") == F.col("k.digest"))
    gone = near(cut(linked.join(keeper, "class_node").where(~stays).select(*pair).distinct()))
    again = near(cut(found.where("n_same > 1").select(*pair).distinct()))
    kept = docs.withColumn("_digest", F.unhex(F.sha2(text_column(text), 256)))
    same = F.col(doc_id).eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_h"))
    kept = kept.join(gone, same, "left_anti")
    once = kept.join(again, same, "left_anti").drop("_digest")
    twice = kept.join(again, same, "left_semi").dropDuplicates([doc_id, "_digest"]).drop("_digest")
    return once.unionByName(twice).toDF(*names)
