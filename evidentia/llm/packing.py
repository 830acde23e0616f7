"""Best-fit packing of documents into token sequences, certified by lower bounds.

Texts are tokenized where they are read; only (id, piece, length) travel on.  Pieces are dealt
to slots of a bounded number of rows, each slot is packed best-fit decreasing, and dual-feasible
functions bound from below how many sequences its lengths need.  A slot that used more gives up
its emptiest sequences; what was given up is dealt anew, to other company, and packed again.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, positional

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs at a time, and rounds of exchange.
SLOT_ROWS = 8192
ROUNDS = 6
#: Pieces whose ids a worker remembers.
CACHE_PIECES = 300_000

_PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Letters, numbers and white space among the first 256 code points (fixed values).
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself if visible, else one past 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Token ids of whole texts as little-endian bytes; the dict maps pieces of text to theirs.

    Tokens of the vocabulary never span white space or pieces, so the ids of a text are those of
    its pieces in order, and each distinct piece is encoded once while it is remembered.  Texts
    of Latin-1 letters are cut here and go to the merges directly; others are cut at white space
    and go through the whole tokenizer, special tokens included.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.signs = _byte_signs()

    def __missing__(self, piece: str | bytes) -> bytes:
        if isinstance(piece, bytes):
            ids = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.signs))]
        if len(self) >= CACHE_PIECES:
            self.clear()
        value = self[piece] = array("I", ids).tobytes()
        return value

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = "<|" not in text
        except UnicodeEncodeError:
            plain = False
        found = _PIECE.findall(text.lower()) if plain else text.encode("utf-8", "replace").split()
        return b"".join(map(self.__getitem__, found))


def pieces(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``, if asked for).

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone.  Only
    documents longer than ``capacity`` are cut.  Repeated rows give repeated pieces.
    """
    path = path or tokenizer_path()
    kind = dict(docs.dtypes)[doc_id]
    end = array("I", [end_id]).tobytes()

    def cut_up(batches):
        words = WordIds(path)
        for batch in batches:
            out: list[tuple] = []
            for key, body in zip(batch["doc_id"], batch["text"], strict=True):
                ids = words.ids(body or "") + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (key, n, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype("i4")) if with_ids else row)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"doc_id {kind}, {_PIECES}" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInPandas(cut_up, schema)


def best_fit(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, which come in decreasing order.

    Sequences are kept by their room; the rooms in use are bits of one integer, so the tightest
    room that fits is the lowest bit above the length.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, n = 0, 0
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths):
        fits = used >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        which[i], offset[i] = b, capacity - room
        room -= length
        if room:
            rooms[room].append(b)
            used |= 1 << room
    return which, offset


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that pieces need at least; ``counts[x]``: pieces of length x.

    The largest of the volume bound, the bounds of the functions f_e (lengths over C - e count
    as C, those under e as nothing) for each e, and of the rounding functions u_k.
    """
    x = np.arange(capacity + 1)
    counts = np.asarray(counts, dtype=np.int64)
    volume = int((x * counts).sum())
    best = -(-volume // capacity)
    below_n, below_v = np.cumsum(counts), np.cumsum(counts * x)
    e = np.arange(1, capacity // 2 + 1)
    large = below_n[-1] - below_n[capacity - e]
    middle = below_v[capacity - e] - below_v[e - 1]
    best = max(best, int((-(-(large * capacity + middle) // capacity)).max(initial=0)))
    for k in range(1, 21):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)  # times k
        total = int((value * counts).sum())
        best = max(best, -(-total // (capacity * k)))
    return best


def pack(table: DataFrame, capacity: int = CAPACITY, slot_rows: int = SLOT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``table`` (with ``length``, 1 to ``capacity``) plus ``sequence_id``, ``offset`` and ``slot_gap``, all long.

    ``slot_gap``: sequences that the row's slot has over its lower bound; 0 is certified, and
    only slots of the last of ``rounds`` exchanges may have more.  Rows that are alike may change
    places.  An empty table stays empty.  Columns of any name are carried, but for those three.
    """
    added = ["sequence_id", "offset", "slot_gap"]
    table = table.drop(*added)
    names = table.columns
    inner, at = positional(table)
    length = at["length"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema) + ", _row long, sequence_id long, offset long, slot_gap long, _settled boolean"

    def packer(turn: int, last: bool):
        def one(key, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values([length, "_row"], ascending=[False, True], kind="stable").drop(columns="_slot")
            sizes = rows[length].to_numpy()
            which, offset = best_fit(sizes.tolist(), capacity)
            settled = np.ones(len(rows), bool)
            fill = np.bincount(which, weights=sizes, minlength=1).astype(np.int64)
            bound = lambda some: lower_bound(np.bincount(sizes[some], minlength=capacity + 1), capacity)
            gap = len(fill) - bound(settled)
            if not last:
                # A certified slot still has its one unfilled sequence; those can meet as well.
                room = np.sort(capacity - fill)[::-1]
                need = int(np.searchsorted(np.cumsum(room), (gap + 1) * capacity)) + 1 if gap > 0 else 1
                open_ = np.argsort(fill, kind="stable")[: need if gap > 0 else int(fill.min() < capacity)]
                settled = ~np.isin(which, open_)
                gap = len(fill) - len(open_) - bound(settled) if gap > 0 else 0
            base = (turn << 56) + (int(key[0]) << 28)
            return rows.assign(sequence_id=base + which, offset=offset, slot_gap=gap, _settled=settled)

        return one

    todo = cut(inner.withColumn("_row", F.monotonically_increasing_id()))
    left = todo.count()
    done = None
    for turn in range(rounds):
        slots = max(1, -(-left // slot_rows))
        last = slots == 1 or turn == rounds - 1
        slot = F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(slots))
        dealt = cut(todo.withColumn("_slot", slot).groupBy("_slot").applyInPandas(packer(turn, last), schema))
        done = dealt.where("_settled") if done is None else done.union(dealt.where("_settled"))
        if last:
            break
        todo = dealt.where("not _settled").select(*inner.columns, "_row")
        left = todo.count()
    return done.select(*inner.columns, *added).toDF(*names, *added)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their place: sequence and offset, gapless from 0; see ``pieces`` and ``pack``."""
    return pack(pieces(docs, path, doc_id, text, capacity, with_ids=with_ids), capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict:
    """Sequences used, and the lower bound over all pieces (from at most ``capacity`` counts)."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": lower_bound(counts, capacity)}
