"""Helpers shared by the operators: lineage cuts, shuffle sizing, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this subpackage (ASCII only).
WS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (tests, local mode) a folder of our own is set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages reread it from shared storage if executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a checkpointed table up to which a join broadcasts it; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def near(small: DataFrame) -> DataFrame:
    """A checkpointed table, with a hint to broadcast it if its measured bytes allow."""
    size = F.lit(16 * len(small.columns))
    for f in small.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array":
            size = size + 16 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return F.broadcast(small) if (small.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else small


#: Tasks that rows of one key are dealt to where the other side can't be broadcast.
SALTS = 32


def join_small(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a checkpointed table that has a row per key, for keys that many rows may share.

    Broadcast if its measured bytes allow; else rows of one key are dealt to SALTS tasks.
    """
    if (hinted := near(small)) is not small:
        return rows.join(hinted, on, "left")
    salted = rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return salted.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], "left").drop("_salt")


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns ``c0``, ``c1`` and so on, and the new name of each old one: no name can clash with an operator's own."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in at.items())), at


def text_column(name: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session: cluster operators size them with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to ``limit`` words at a time."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Odd multipliers of the five words of a shingle.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the ``size``-word shingles of a text, sorted.

    A text of fewer words has one shingle, of all its words; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(size, len(values))
    total = np.zeros(len(values) - span + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(span):
            total += (values[i : len(values) - span + 1 + i] ^ np.uint64(i + span)) * _MIX[i % 5]
            total ^= total >> np.uint64(29)
    return np.unique(total)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values in a sorted array."""
    if not len(keys):
        return []
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *edges], [*edges, len(keys)], strict=True))


def grouped(batches, column: str):
    """Arrow tables of the rows of each key, from record batches sorted by an integer ``column``.

    Only one group is held at a time; callers bound the size of groups.
    """
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        keys = batch.column(column).to_numpy()
        for a, b in runs(keys):
            if held and keys[a] != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            key = keys[a]
    if held:
        yield pa.Table.from_batches(held)


class Unions:
    """Union-find over 0..n-1 whose labels are the smallest index of each set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def absorb(self, x: np.ndarray, y: np.ndarray) -> None:
        """Union x[k] and y[k] for every k, without a Python step per pair."""
        while True:
            a, b = self.label[x], self.label[y]
            open_ = a != b
            if not open_.any():
                return
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]
