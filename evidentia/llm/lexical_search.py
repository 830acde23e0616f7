"""Ranked lexical search by best-first branch and bound over hierarchical max trees.

Documents are read once into profiles: their length and how often they hold each term that is
asked for.  Consecutive documents form segments of bounded size, and each segment gets a tree over
its document ranges: leaves are documents with the impact of each of their terms, and a node holds
for every term the largest impact below it.  What a query's terms sum up to at a node bounds the
score of every document below.

A search opens the node of the highest bound first and ends once that bound is below the score
that the last wanted document has; nodes whose bound equals it are opened as well, so documents of
equal score are ranked by id.  Segments are the upper nodes: each query first searches the segment
of its highest bound, what it finds there is the floor for all others, and a segment whose bound is
below the floor is not opened.  Trees stay where they are; a task returns its best rows per query.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from evidentia.llm.common import BROADCAST_BYTES, cut, near

TOP = 20
#: Children of a node, and the most documents and entries of a segment (a longer document is one by itself).
FANOUT, SEGMENT_DOCS, SEGMENT_ENTRIES = 16, 4096, 250_000
#: Rows that are profiled at a time.
ROWS = 512
#: A term, in UTF-8 (fixed): signs past ASCII, digits and letters.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, A to Z lower-cased."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def profiles(rows: DataFrame, key: str, text: str, asked: frozenset[bytes] | None = None) -> DataFrame:
    """(seg, key, n, terms, counts): the length of each text in terms, and how often it holds each.

    Only terms of ``asked`` are listed, or all without it.  ``seg`` numbers runs of rows that are
    read one after another.  Null texts have no terms.
    """
    kind = rows.schema[key].dataType.simpleString()

    def profiled(batches):
        seg, docs, entries = TaskContext.get().partitionId() << 32, 0, 0
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n, segs, words, counts = [], [], [], []
                for t in batch.column(1).to_pylist():
                    found = terms(t)
                    held = Counter(found)
                    if asked is not None:
                        held = {w: held[w] for w in (held.keys() & asked if len(held) < len(asked) else asked & held.keys())}
                    if docs and (docs == SEGMENT_DOCS or entries + len(held) > SEGMENT_ENTRIES):
                        seg, docs, entries = seg + 1, 0, 0
                    docs, entries = docs + 1, entries + len(held)
                    n.append(len(found))
                    segs.append(seg)
                    words.append(list(held))
                    counts.append(list(held.values()))
                columns = [pa.array(segs, pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["seg", "key", "n", "terms", "counts"])

    pairs = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return pairs.mapInArrow(profiled, f"seg long, key {kind}, n long, terms array<binary>, counts array<long>")


class Tree:
    """The max tree of a segment: per level the entries (term, impact) of its nodes, lowest level first."""

    def __init__(self, offsets: list[np.ndarray], term: list[np.ndarray], impact: list[np.ndarray]):
        self.offsets, self.term, self.impact = offsets, term, impact

    @classmethod
    def over(cls, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, fanout: int = FANOUT) -> Tree:
        """``sizes``: entries of each document; the root comes to be the only node of the last level."""
        levels = [(np.r_[0, np.cumsum(sizes)], term, impact)]
        node, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        width = int(term.max(initial=0)) + 1
        while n > 1:
            node, n = node // fanout, -(-n // fanout)
            key = node * width + term
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            impact = np.maximum.reduceat(impact[order], starts) if len(key) else impact
            node, term = key[starts] // width, key[starts] % width
            levels.append((np.searchsorted(node, np.arange(n + 1)), term, impact))
        return cls(*map(list, zip(*levels, strict=True)))

    def sums(self, level: int, low: int, high: int, weight: np.ndarray) -> np.ndarray:
        """What the weighted impacts of nodes ``low`` to ``high`` of a level sum up to."""
        at = self.offsets[level][low : high + 1]
        total = np.r_[0, np.cumsum(weight[self.term[level][at[0] : at[-1]]] * self.impact[level][at[0] : at[-1]])]
        return np.diff(total[at - at[0]])

    def best(self, weight: np.ndarray, floor: int, most: int = TOP) -> tuple[list[tuple[int, int]], int]:
        """((score, document) of all that may be among the ``most`` best and reach ``floor``, nodes opened)."""
        top, n = len(self.offsets) - 1, len(self.offsets[0]) - 1
        bound = int(self.sums(top, 0, len(self.offsets[top]) - 1, weight)[0])
        if top == 0:
            return ([(bound, 0)] if bound >= max(floor, 1) else []), 0
        queue, scores, found, opened = [(-bound, top, 0)], [], [], 0
        while queue and -queue[0][0] >= max(floor, 1):
            _, level, node = heapq.heappop(queue)
            opened += 1
            low = node * self.fanout
            high = min(low + self.fanout, len(self.offsets[level - 1]) - 1, n)
            bounds = self.sums(level - 1, low, high, weight)
            for i in np.flatnonzero(bounds >= max(floor, 1)).tolist():
                s = int(bounds[i])
                if level > 1:
                    heapq.heappush(queue, (-s, level - 1, low + i))
                    continue
                found.append((s, low + i))
                heapq.heappush(scores, s)
                if len(scores) > most:
                    heapq.heappop(scores)
                if len(scores) == most:
                    floor = max(floor, scores[0])
        return [f for f in found if f[0] >= floor], opened

    fanout = FANOUT


def trees(held: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row per segment of ``profiles``: its ids, terms, and the levels of its tree as bytes."""
    kind = held.schema["key"].dataType.simpleString()

    def built(rows: list[dict]) -> dict:
        sizes = np.array([len(r["terms"]) for r in rows], np.int64)
        words = [w for r in rows for w in r["terms"]]
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        term = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        tf = np.array([c for r in rows for c in r["counts"]], np.int64)
        m = 75 + (25 * np.array([r["n"] for r in rows], np.int64) * n_docs) // max(n_terms, 1)
        tree = Tree.over(sizes, term, (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
        flat = lambda parts, dtype: [p.astype(dtype).tobytes() for p in parts]
        return {"seg": rows[0]["seg"], "ids": [r["key"] for r in rows], "terms": list(known), "offsets": flat(tree.offsets, np.int32), "term": flat(tree.term, np.int32), "impact": flat(tree.impact, np.int64)}

    schema = f"seg long, ids array<{kind}>, terms array<binary>, offsets array<binary>, term array<binary>, impact array<binary>"

    def grown(batches):
        rows: list[dict] = []
        for r in (r for b in batches for start in range(0, b.num_rows, ROWS) for r in b.slice(start, ROWS).to_pylist()):
            if rows and rows[0]["seg"] != r["seg"]:
                yield one(built(rows))
                rows = []
            rows.append(r)
        if rows:
            yield one(built(rows))

    ids = to_arrow_type(held.schema["key"].dataType)

    def one(row: dict) -> pa.RecordBatch:
        blob = pa.list_(pa.binary())
        types = {"seg": pa.int64(), "ids": pa.list_(ids), "terms": blob, "offsets": blob, "term": blob, "impact": blob}
        return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in types.items()], list(types))

    return held.mapInArrow(grown, schema)


class Block:
    """Some queries: per query the numbers and weights of its terms."""

    def __init__(self, rows: list):
        self.number: dict[bytes, int] = {}
        self.weights: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        of: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            of.setdefault(r.q, []).append((self.number.setdefault(bytes(r.term), len(self.number)), r.weight))
        for q, pairs in of.items():
            self.weights[q] = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)

    def onto(self, row: dict):
        """A segment's tree, and each query's weights by the segment's own terms."""
        parts = lambda c, dtype: [np.frombuffer(b, dtype) for b in row[c]]
        tree = Tree(parts("offsets", np.int32), parts("term", np.int32), parts("impact", np.int64))
        place = np.full(len(self.number) + 1, -1, np.int64)
        for i, w in enumerate(row["terms"]):
            place[self.number.get(w, -1)] = i
        place[-1] = -1

        def weight(q: int) -> np.ndarray:
            number, w = self.weights[q]
            at = place[number]
            out = np.zeros(max(len(row["terms"]), 1), np.int64)
            out[at[at >= 0]] = w[at >= 0]
            return out

        return tree, weight


def _segments(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def highest(forest: DataFrame, block: Block) -> dict[int, int]:
    """The segment of the highest bound of each query of a block."""

    def bounds(batches):
        met: dict[int, tuple[int, int]] = {}
        for row in _segments(batches):
            tree, weight = block.onto(row)
            for q in block.weights:
                met[q] = max(met.get(q, (0, -1)), (int(tree.sums(len(tree.offsets) - 1, 0, 1, weight(q))[0]), row["seg"]))
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(q, b, s) for q, (b, s) in met.items() if b > 0], columns=["q", "bound", "seg"]).astype("int64"))

    rows = forest.mapInArrow(bounds, "q long, bound long, seg long").groupBy("q").agg(F.max_by("seg", F.struct("bound", "seg")).alias("seg"))
    return {r.q: r.seg for r in rows.collect()}  # a row per query of the block


def found(forest: DataFrame, block: Block, kind: str, floors: dict[int, int], most: int, only: dict[int, int] | None = None) -> DataFrame:
    """(q, key, score): what may be among the best of each query, at most ``most`` rows per query and task.

    With ``only``, a query searches that segment alone.
    """
    wanted = None if only is None else frozenset(only.values())

    def searched(batches):
        floor, kept, types = dict(floors), {}, None
        for batch in batches:
            types = batch.schema.field("ids").type.value_type
            for row in _segments([batch]):
                if wanted is not None and row["seg"] not in wanted:
                    continue
                tree, weight = block.onto(row)
                for q in block.weights:
                    if only is not None and only.get(q) != row["seg"]:
                        continue
                    hits, _ = tree.best(weight(q), floor.get(q, 1), most)
                    if hits:
                        mine = kept.get(q, []) + [(-s, row["ids"][d] is None, row["ids"][d], row["seg"], d) for s, d in hits]
                        kept[q] = mine = sorted(mine, key=lambda x: (x[0], x[1], *(() if x[1] else (x[2],)), x[3], x[4]))[:most]
                        if len(mine) == most:
                            floor[q] = max(floor.get(q, 1), -mine[-1][0])
        if types is not None:
            rows = [(q, k, -s) for q, mine in kept.items() for s, _, k, _, _ in mine]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], types), pa.array([r[2] for r in rows], pa.int64())], ["q", "key", "score"])

    return forest.mapInArrow(searched, f"q long, key {kind}, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each row of ``items``.

    Equal scores rank by ascending id, null ids last; documents without any term of an item aren't
    listed, nor items without terms.  Repeated rows of either table count each.  Queries are taken
    in blocks of bounded bytes; each block meets all documents.
    """
    named = items.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    named = cut(named)
    asked = profiles(named, "q", "text").select(F.col("key").alias("q"), F.explode(F.map_from_arrays("terms", "counts")).alias("term", "times"))
    asked = cut(asked)
    words = cut(asked.select("term").distinct())
    size = words.agg(F.sum(F.octet_length("term") + 100)).first()[0] or 0
    only = frozenset(bytes(r.term) for r in words.collect()) if size <= BROADCAST_BYTES else None
    held = cut(profiles(docs, doc_id, text, only))
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    lexicon = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    forest = cut(trees(held, n_docs, n_terms))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = cut(asked.join(lexicon, "term").select("q", "term", (F.col("times") * weight).cast("long").alias("weight")).where("weight > 0"))
    blocks = max(1, -(-(weighed.agg(F.sum(F.octet_length("term") + 150)).first()[0] or 0) // BROADCAST_BYTES))
    kind = docs.schema[doc_id].dataType.simpleString()
    out = None
    for b in range(blocks):
        block = Block(weighed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect())  # bounded bytes
        first = highest(forest, block)
        floors = found(forest, block, kind, {}, top, first).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= top)
        hits = found(forest, block, kind, {r.q: r.s for r in floors.collect()}, top)  # a row per query of the block
        out = hits if out is None else out.unionByName(hits)
    place = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(near(named.select("q", "item_id")), "q").select("item_id", "rank", F.col("key").alias("doc_id"), "score")
