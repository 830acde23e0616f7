"""Broadcasts by measured bytes, and Python work in slices of bounded rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a table up to which a join may broadcast it.
BROADCAST_BYTES = 32 << 20
#: Least rows, and bytes, whose values and results a task holds as Python objects at a time: one long row, or many short ones.
SLICE_ROWS, SLICE_BYTES = 1, 256 << 10


def measured(df: DataFrame) -> int:
    """Bytes of a table, about: texts and arrays by their length, other columns 16 each."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            size = size + F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df``, hinted to be broadcast if its measured bytes allow: ``BROADCAST_BYTES`` unless a limit is given."""
    return F.broadcast(df) if measured(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def _lengths(column) -> np.ndarray:
    """Bytes of each value of an Arrow column, about."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_list(column.type):
        return np.diff(np.concatenate([[0], np.cumsum(_lengths(column.values))])[column.offsets.to_numpy()])
    if pa.types.is_struct(column.type):
        return sum(map(_lengths, column.flatten()), np.zeros(len(column), int))
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.full(len(column), 8)


def slices(columns: list) -> Iterator[tuple[int, int]]:
    """(start, stop) of slices of Arrow columns: as many rows as have ``SLICE_BYTES`` at most, but ``SLICE_ROWS`` at least."""
    ends, start = np.cumsum(sum(_lengths(c) + 8 for c in columns)), 0
    while start < len(ends):
        most = (ends[start - 1] if start else 0) + SLICE_BYTES
        stop = min(max(start + SLICE_ROWS, int(np.searchsorted(ends, most, "right"))), len(ends))
        yield start, stop
        start = stop


def by_slices(rows: DataFrame, columns: list[str], made: str, work: Callable[..., list[tuple]]) -> DataFrame:
    """``rows`` with the columns of the DDL ``made`` in place of ``columns``.

    ``work`` gets the values of ``columns``, a list each, and returns a tuple per row.  It is asked
    for a slice at a time (``slices``), so a worker's memory doesn't grow with Spark's batches.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    keep = [c for c in rows.columns if c not in columns]
    fields = StructType.fromDDL(made).fields
    schema = StructType([rows.schema[c] for c in keep] + fields)
    kinds, names, n = [to_arrow_type(f.dataType) for f in fields], schema.names, len(keep)

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.columns[n:]):
                part = batch.slice(start, stop - start)
                out = work(*(c.to_pylist() for c in part.columns[n:]))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], names)

    return rows.select(*keep, *columns).mapInArrow(run, schema)
