"""Byte-level BPE over Arrow batches: encoding by a queue of merges, decoding by vocabulary strings.

A text is cut at the vocabulary's added tokens and then into pieces by its pattern.  The bytes of
a piece are a doubly linked list of symbols; a priority queue holds the merges of neighbours by
rank, leftmost first among equals, and an entry whose symbols have changed since is skipped when it
comes up.  In short pieces the lowest rank is looked for in a list, which takes less time there.  A worker remembers the ids of short pieces.  Rows are encoded where they are read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidentia.llm.common import positional, text_column

#: Pieces that a worker remembers, and their longest length in bytes.
CACHE_PIECES, CACHE_BYTES = 400_000, 64
#: Longest piece, in bytes, whose next merge is looked for in a plain list, and what stands there for no merge.
SHORT_BYTES, NO_MERGE = 64, 1 << 62
#: Rows that are encoded at a time.
ROWS = 512
#: The pattern of byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: itself if visible, else one past 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (chr(256 + i) for i in range(256))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


class Vocabulary(dict):
    """A vocabulary file; as a dict, little-endian 32-bit ids of the pieces met so far."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and not spec.get("post_processor") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        extra = [a for a in spec.get("added_tokens", ()) if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]]
        if not plain or extra or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        ids, signs = model["vocab"], byte_signs()
        self.first = [ids[s] for s in signs]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[left] << 32 | ids[right]] = i
            self.made.append(ids[left + right])
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        byte = {s: b for b, s in enumerate(signs)}
        whole = {**ids, **self.added}
        self.strings = [b""] * (max(whole.values()) + 1)
        for token, i in whole.items():
            self.strings[i] = bytes(byte[s] for s in token) if all(s in byte for s in token) else token.encode()

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece: the merge of lowest rank first, the leftmost of equals."""
        symbol = [self.first[b] for b in piece]
        rank, made, n = self.rank, self.made, len(symbol)
        if n <= SHORT_BYTES:
            return self._short(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if symbol[i] < 0 or j >= n or rank.get(symbol[i] << 32 | symbol[j]) != r:
                continue  # one of the two has merged otherwise meanwhile
            symbol[i], symbol[j] = made[r], -1
            after[i] = k = after[j]
            before[k] = i
            if k < n and (r := rank.get(symbol[i] << 32 | symbol[k])) is not None:
                heapq.heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank.get(symbol[h] << 32 | symbol[i])) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [s for s in symbol if s >= 0]

    def _short(self, symbol: list[int]) -> list[int]:
        """``merged`` for few symbols: the ranks of neighbours in a list, searched anew for each merge."""
        get, made = self.rank.get, self.made
        ranks = [get(a << 32 | b, NO_MERGE) for a, b in zip(symbol, symbol[1:])]
        while ranks and (r := min(ranks)) != NO_MERGE:
            i = ranks.index(r)
            symbol[i] = made[r]
            del symbol[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(symbol[i - 1] << 32 | symbol[i], NO_MERGE)
            if i < len(ranks):
                ranks[i] = get(symbol[i] << 32 | symbol[i + 1], NO_MERGE)
        return symbol

    def __missing__(self, piece: str) -> bytes:
        value = array("I", self.merged(raw := piece.encode())).tobytes()
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = value
        return value

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += map(self.__getitem__, self.pieces(text[at : m.start()]))
            out.append(array("I", [self.added[m[0]]]).tobytes())
            at = m.end()
        out += map(self.__getitem__, self.pieces(text[at:] if at else text))
        return b"".join(out)

    def decode(self, lists: pa.ListArray | list[int]) -> list[str] | str:
        """The strings of each list's ids, joined; null lists, null ids and ids that the vocabulary lacks say nothing.  A plain list of ids is one text."""
        if isinstance(lists, list):
            return self.decode(pa.array([lists], pa.list_(pa.int64())))[0]
        ends = lists.offsets.to_numpy()
        ids = lists.values.slice(ends[0], ends[-1] - ends[0]).fill_null(-1).to_numpy(zero_copy_only=False)
        ends, known = ends - ends[0], (ids >= 0) & (ids < len(self.strings))
        if not known.all():
            ends, ids = np.concatenate([[0], np.cumsum(known)])[ends], ids[known]
        string, held = self.strings.__getitem__, lists.is_valid().to_numpy(zero_copy_only=False)
        return [b"".join(map(string, ids[a:b].tolist())).decode("utf-8", "replace") if some else "" for a, b, some in zip(ends[:-1], ends[1:], held, strict=True)]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """A worker's vocabulary, with what it remembers."""
    return Vocabulary(path)


def _others(df: DataFrame, *gone: str) -> list[str]:
    return [c for c in df.columns if c not in gone]


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, an array of token ids, in place of the text.

    Null and empty texts have no ids; added tokens that stand in a text are encoded as such.
    Rows may repeat; an ``ids`` column that was there before is replaced.
    """
    path = path or vocabulary_path()
    keep = _others(docs, text, "ids")
    inner, at = positional(docs)
    rows = inner.select(*(at[c] for c in keep), text_column(at[text]).alias("_text"))

    def encoded(batches):
        known = vocabulary(path)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = [known.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                values = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])

    schema = ", ".join([*(f"{at[c]} {inner.schema[at[c]].dataType.simpleString()}" for c in keep), "ids array<int>"])
    return rows.mapInArrow(encoded, schema).select(*(F.col(at[c]).alias(c) for c in keep), "ids")


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the text of its ids; null ids are an empty text.

    Bytes that aren't UTF-8 become replacement signs; a ``decoded`` column is replaced.
    """
    path = path or vocabulary_path()
    keep = _others(tokens, "decoded")
    inner, at = positional(tokens)
    rows = inner.select(*(at[c] for c in keep))
    place = keep.index(ids)

    def decoded(batches):
        known = vocabulary(path)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = known.decode(batch.column(place))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = ", ".join([*(f"{at[c]} {inner.schema[at[c]].dataType.simpleString()}" for c in keep), "decoded string"])
    return rows.mapInArrow(decoded, schema).select(*(F.col(at[c]).alias(c) for c in keep), "decoded")


@F.arrow_udf(StringType())
def ids_sha256(ids: pa.Array) -> pa.Array:
    """Hexadecimal digest of ids as little-endian unsigned 32-bit integers."""
    ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
    return pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
