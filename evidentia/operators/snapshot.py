"""Immutable snapshots of passages and vectors, published by one pointer, and their audit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.functions import vectors as V
from evidentia.functions.identity import stable_id
from evidentia.operators.sizes import small
from evidentia.sources.files import Files

#: Leading signs of an id that name the folder of its rows.
BUCKET_SIGNS = 1
#: Tables of a snapshot, with the column they are sorted and found by.
TABLES = {"sources": "source_id", "pages": "source_id", "passages": "id", "vectors": "point_id"}
PASSAGE = ["id", "source_id", "version", "page", "start", "end", "article", "section", "text"]


def _bucket(key: str) -> Column:
    """The folder of a key; its letter keeps it from being read as a number."""
    return F.concat(F.lit("b"), F.substring(key, 1, BUCKET_SIGNS))


def fingerprint(documents: DataFrame, passages: DataFrame, profile: dict) -> str:
    """SHA-256 of a corpus and an embedding profile, whatever the order of its rows.

    Every row is hashed on its own and the hashes are summed up, thirteen hexadecimal digits at a
    time: map-side, in one row of six numbers.
    """
    ignored = {"prepared_at"}
    line = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in ignored))), 256)
    rows = documents.select(line(documents).alias("h")).unionByName(passages.select(line(passages).alias("h")))
    digits = lambda i: F.conv(F.substring("h", 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")
    found = [str(x) for x in rows.agg(F.count(F.lit(1)), *(F.sum(digits(i)) for i in range(5))).first()]
    import hashlib

    return hashlib.sha256(json.dumps([profile, found], sort_keys=True).encode()).hexdigest()


class SnapshotMoved(RuntimeError):
    """The active snapshot changed while a reader held another."""


class Reader:
    """A snapshot as it was when the reader was opened, whatever is published meanwhile.

    Its lease keeps the snapshot from being vacuumed; ``check`` tells whether the corpus still
    points to it.  As a context it checks at its end and gives the lease back.
    """

    def __init__(self, store: Snapshots, corpus_id: str, lease: bool = True):
        self.store, self.corpus_id = store, corpus_id
        while True:  # a snapshot may be replaced and vacuumed before its lease is written
            self.pointer = store.active(corpus_id)
            if self.pointer is None:
                raise ValueError("no snapshot is published for this corpus")
            self.snapshot_id = self.pointer["snapshot_id"]
            self._lease = f"leases/{self.snapshot_id}/{uuid.uuid4().hex}"
            if not lease:
                break
            store.files.put(self._lease, corpus_id, f"{self._lease}.draft")
            if store.files.exists(f"data/{self.snapshot_id}"):
                break
            self.close()

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, kind, error, trace) -> None:
        try:
            if kind is None:
                self.check()
        finally:
            self.close()

    def close(self) -> None:
        self.store.files.delete(self._lease)

    def check(self) -> None:
        now = self.store.active(self.corpus_id)
        if now is None or now["snapshot_id"] != self.snapshot_id:
            raise SnapshotMoved(f"{self.corpus_id}: another snapshot was published meanwhile")

    def guarded(self, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        """``work``, refused if the pointer has moved: for the batches of a run."""

        def checked(rows: DataFrame) -> DataFrame:
            self.check()
            return work(rows)

        return checked

    def find(self, table: str = "passages", **equal) -> DataFrame:
        """Rows whose columns equal what is named (null-safe); the scan gets the conditions."""
        rows = self.store.table(self.snapshot_id, table)
        for name, value in equal.items():
            rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        return rows

    def fetch(self, ids: list[str] | DataFrame, table: str = "passages") -> DataFrame:
        """Rows by their ids: a list, or a table with a column of the same name as the key.

        Only folders of the ids' leading signs are read, and in them only what their sorted
        files may hold.
        """
        key = TABLES[table]
        rows = self.store._stored(self.snapshot_id, table)
        if isinstance(ids, list):
            folders = sorted({f"b{i[:BUCKET_SIGNS]}" for i in ids})
            return rows.where(F.col("bucket").isin(folders) & F.col(key).isin(ids)).drop("bucket")
        asked = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("bucket", _bucket(key))
        folders = [r.bucket for r in asked.select("bucket").distinct().collect()]  # no more than there are folders
        return rows.where(F.col("bucket").isin(folders)).join(small(asked), ["bucket", key]).drop("bucket")

    def scroll(self, table: str = "passages", size: int = 1000, after: str | None = None) -> Iterator[list[Row]]:
        """Pages of ``size`` rows in the order of their key; ``after`` goes on behind a key.

        A page reads from the folder of the last key on.  For keys that name one row each.
        """
        key = TABLES[table]
        while True:
            rows = self.store._stored(self.snapshot_id, table)
            if after is not None:
                rows = rows.where((F.col("bucket") >= f"b{after[:BUCKET_SIGNS]}") & (F.col(key) > after))
            page = rows.drop("bucket").orderBy(key).limit(size).collect()
            if page:
                yield page
            if len(page) < size:
                return
            after = page[-1][key]

    def count(self, table: str = "passages") -> int:
        return self.store.table(self.snapshot_id, table).count()

    def search(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """Hits of ``queries(query_id, question)`` with their passages.

        Reading a hit whose passage is missing, or is another than the vector names, is an error.
        """
        from evidentia.operators import retrieve

        if self.pointer["profile"] != self.store.profile:
            raise ValueError("the snapshot was embedded with another profile")
        if not 1 <= limit <= 100:
            raise ValueError("between 1 and 100 hits")
        asked = queries.select("query_id", self.store.embed(F.col("question")).alias("embedding"))
        vectors = self.find("vectors")
        hits = retrieve.vector_top(asked, vectors.select(F.col("point_id").alias("id"), "embedding"), limit).withColumnRenamed("id", "point_id")
        named = hits.join(vectors.select("point_id", F.col("passage_id").alias("_named")), "point_id", "left")
        found = named.join(self.find("passages"), "point_id", "left")
        sound = F.when(F.col("_named").eqNullSafe(F.col("id")) & F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("a hit's passage is missing or another")))
        return found.withColumn("id", sound).drop("_named")


class Snapshots:
    """Snapshots under a folder: ``data/<snapshot>/...`` never changes, ``active/<corpus>`` points.

    Every table is sorted by its key and lies in folders of its keys' leading signs, so what is
    fetched by keys reads few files.  ``embed`` turns a column of texts into vectors (a Column to Column function), so that only
    passages without a reusable vector are embedded.
    """

    def __init__(self, spark: SparkSession, root: str, embed, profile: dict):
        self.spark, self.root, self.embed, self.profile = spark, root.rstrip("/"), embed, profile
        self.files = Files(spark, root)

    def active(self, corpus_id: str) -> dict | None:
        at = f"active/{corpus_id}"
        return json.loads(self.files.text(at)) if self.files.exists(at) else None

    def _publish(self, corpus_id: str, pointer: dict) -> None:
        """Write the pointer beside the old one and rename it into place."""
        self.files.put(f"active/{corpus_id}", json.dumps(pointer), f"active/.{corpus_id}-{uuid.uuid4().hex}", replace=True)

    def _stored(self, snapshot: str, name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.files.text(f"data/{snapshot}/{name}.schema")))
        return self.spark.read.schema(schema).parquet(f"{self.root}/data/{snapshot}/{name}")  # empty tables have no file that tells it

    def table(self, snapshot: str, name: str) -> DataFrame:
        return self._stored(snapshot, name).drop("bucket")

    def write(self, snapshot: str, name: str, rows: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda placed: placed, mode: str = "errorifexists") -> None:
        """Write a table, or append to it; ``finish`` works on the placed rows, since placing them reads them twice."""
        key = TABLES[name]
        placed = finish(rows.withColumn("bucket", _bucket(key)).repartitionByRange(key).sortWithinPartitions("bucket", key))
        placed.write.mode(mode).partitionBy("bucket").parquet(f"{self.root}/data/{snapshot}/{name}")
        self.files.put(f"data/{snapshot}/{name}.schema", placed.schema.json(), f"data/{snapshot}/.{name}.schema", replace=mode == "append")

    def pin(self, corpus_id: str) -> Reader:
        """A reader of the active snapshot."""
        return Reader(self, corpus_id)

    def require_published(self, corpus_id: str, documents: DataFrame, passages: DataFrame) -> dict:
        """The pointer of a corpus whose published snapshot is just this; an error otherwise."""
        pointer = self.active(corpus_id)
        if pointer is None or pointer["fingerprint"] != fingerprint(documents, passages, self.profile):
            raise ValueError("the corpus isn't what is published")
        return pointer

    def vacuum(self) -> list[str]:
        """Remove snapshots that no corpus points to and no reader holds; their names."""
        held = {self.active(c)["snapshot_id"] for c in self.files.names("active") if not c.startswith(".")}
        gone = [s for s in self.files.names("data") if s not in held and not [x for x in self.files.names(f"leases/{s}") if not x.endswith(".crc")]]
        for s in gone:
            self.files.delete(f"data/{s}")
        return gone

    def index(self, corpus_id: str, documents: DataFrame, pages: DataFrame, passages: DataFrame) -> dict:
        """Stage and publish a corpus; an unchanged one is left as it is.

        Vectors of passages that are equal in every field are taken over from the active
        snapshot.  Readers see the old snapshot until everything is written.
        """
        digest = fingerprint(documents, passages, self.profile)
        before = self.active(corpus_id)
        if before and before["fingerprint"] == digest and self.complete(before):
            return before | {"status": "unchanged", "embedded": 0}
        snapshot = uuid.uuid4().hex
        self.write(snapshot, "sources", documents)
        self.write(snapshot, "pages", pages)
        point = stable_id(F.lit(snapshot), F.col("id"))
        self.write(snapshot, "passages", passages.select(*PASSAGE, point.alias("point_id"), F.lit(corpus_id).alias("corpus_id"), F.lit(snapshot).alias("snapshot_id")))
        staged = self.table(snapshot, "passages")
        keep = ["point_id", "corpus_id", "snapshot_id", F.col("id").alias("passage_id"), "source_id", "version", "page", "article"]
        fresh = staged
        if before and before["profile"] == self.profile:
            known = self.table(before["snapshot_id"], "vectors").select("passage_id", "embedding")
            old = self.table(before["snapshot_id"], "passages").select(*(F.col(c).alias(f"_{c}") for c in PASSAGE)).join(known, F.col("_id") == F.col("passage_id"))
            same = staged["id"] == F.col("_id")
            for c in PASSAGE[1:]:
                same = same & staged[c].eqNullSafe(F.col(f"_{c}"))
            met = staged.join(old, same, "left").select(*staged.columns, "embedding")
            self.write(snapshot, "vectors", met.where("embedding is not null").select(*keep, "embedding", F.lit(True).alias("reused")))
            fresh = met.where("embedding is null")
        embedded = lambda placed: placed.select(*(c for c in placed.columns if c not in ("text", "bucket")), self.embed(F.col("text")).alias("embedding"), F.lit(False).alias("reused"), "bucket")
        self.write(snapshot, "vectors", fresh.select(*keep, "text"), embedded, "append")
        written = self.table(snapshot, "vectors")
        bad = written.where(V.problem(F.col("embedding"), self.profile["dimensions"]).isNotNull()).limit(1).count()
        if bad:
            raise ValueError("an embedding is missing, not finite, zero or of another dimension")
        n = written.agg(F.count(F.lit(1)), F.count_if(~F.col("reused"))).first()
        pointer = {"corpus_id": corpus_id, "snapshot_id": snapshot, "fingerprint": digest, "profile": self.profile, "passages": n[0], "sources": self.table(snapshot, "sources").count(), "pages": self.table(snapshot, "pages").count()}
        self._publish(corpus_id, pointer)
        return pointer | {"status": "published", "embedded": n[1]}

    def complete(self, pointer: dict) -> bool:
        """Whether all that the pointer promises is there."""
        try:
            counts = {t: self.table(pointer["snapshot_id"], t).count() for t in TABLES}
        except Exception:  # a missing table is an incomplete snapshot
            return False
        return counts == {t: pointer[t if t != "vectors" else "passages"] for t in TABLES}

    def search(self, corpus_id: str, queries: DataFrame, limit: int = 5) -> DataFrame:
        """Hits of ``queries(query_id, question)`` in the active snapshot, with their passages; holds no lease."""
        return Reader(self, corpus_id, lease=False).search(queries, limit)

    def audit(self, corpus_id: str, documents: DataFrame, pages: DataFrame, passages: DataFrame) -> DataFrame:
        """(finding, n) of the active snapshot against the corpus it should hold; all 0 if sound."""
        pointer = self.active(corpus_id)
        if pointer is None:
            raise ValueError("no snapshot is published")
        s = {t: self.table(pointer["snapshot_id"], t) for t in ("sources", "pages", "passages", "vectors")}
        found: list[DataFrame] = []

        def add(df: DataFrame, **wrong: Column) -> None:
            counts = df.agg(*(F.count_if(c).alias(name) for name, c in wrong.items()))
            found.append(counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("finding"), F.col(name).alias("n")) for name in wrong)))))

        def both(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
            """All rows of both as ``a`` and ``b``; ``a._in`` and ``b._in`` are null where there is none."""
            a, b = a.withColumn("_in", F.lit(1)).alias("a"), b.withColumn("_in", F.lit(1)).alias("b")
            return a.join(b, F.col(f"a.{on[0]}") == F.col(f"b.{on[-1]}"), "full")

        # Every pair of tables meets once, whatever is asked of it.
        no_a, no_b = F.col("a._in").isNull(), F.col("b._in").isNull()

        def differ(*columns: str) -> Column:
            differs: Column = F.lit(False)
            for c in columns:
                differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            return ~no_a & ~no_b & differs

        add(both(documents, s["sources"], "source_id"), source_missing=no_b, source_unexpected=no_a, source_differs=differ(*(c for c in documents.columns if c != "source_id")))
        add(both(passages.select("id"), s["passages"].select("id"), "id"), passage_missing=no_b, passage_unexpected=no_a)
        page = s["pages"].select("source_id", "page", F.col("text").alias("_text"))
        on_page = s["passages"].join(page, ["source_id", "page"], "left")
        said = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
        add(on_page, page_missing=F.col("_text").isNull(), offsets_differ=said != F.col("text"))
        payload = ("point_id", "source_id", "version", "page", "article")
        pairs = both(s["vectors"].select("passage_id", *payload), s["passages"].select("id", *payload), "passage_id", "id")
        add(pairs, vector_orphan=no_b, vector_missing=no_a, payload_differs=differ(*payload))
        add(s["vectors"].groupBy("point_id").count(), vector_repeated=F.col("count") > 1)
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out
