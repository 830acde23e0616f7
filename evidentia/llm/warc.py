"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive file starts with a skippable frame that holds the dictionary, trained on a sample of
the file's records; each record is a frame of its own, so it can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import cut, join_small, shared_dir

#: Magic number of the leading frame.
DICT_FRAME = 0x184D2A5D
#: Raw bytes of an archive file, size of its dictionary, bound on the bytes it is trained on.
FILE_BYTES = 32 << 20
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 response record, or a revisit record if it refers to another."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{quote(key)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{quote(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A dictionary from evenly spaced records, at most SAMPLE_BYTES of them in all."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, total // SAMPLE_BYTES)
    sample, size = [], 0
    for r in records[::step]:
        if size + len(r) <= SAMPLE_BYTES:
            sample.append(r)
            size += len(r)
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, size // 8)), sample, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small to train on: their bytes themselves
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICT_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    import zstandard

    words = dictionary(records)
    raw = words.as_bytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
    return b"".join([struct.pack("<II", DICT_FRAME, len(raw)), raw, *map(packer.compress, records)])


def read_records(data: bytes):
    """(headers, block) of the records of an archive, one at a time."""
    import io

    import zstandard

    words = None
    at = 0
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == DICT_FRAME:
            words, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(reader.stream_reader(memoryview(data)[at:], read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            headers[name.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(key, url, payload, refers_to): of equal payloads the largest key keeps its payload.

    Payloads under ``min_bytes`` are never revisits.  A null payload is empty.  Null keys are
    smaller than others; if all keys of a group are null, or the largest is repeated, each of
    those rows is a response.  Only digests that repeat are joined back; payloads stay where they
    are read, or are dealt to several tasks each.
    """
    body = F.encode(F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")), "UTF-8")
    held = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = held.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    return join_small(held, cut(groups), ["digest"]).select(F.col("key").cast("string").alias("key"), "url", "payload", refers.alias("refers_to"))


def write(planned: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives under ``root``; a row per file: path, records, raw and written bytes.

    File names follow from the task, and a file appears under its name only when it is whole,
    so a task that is retried or doubled replaces its own files with the same ones.
    """

    def writer(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(root)
        where.create_dir(base, recursive=True)
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = f"part-{task:06d}-{n:04d}.warc.zst"
            data = archive_bytes(held)
            draft = f"{base}/.{name}.{uuid.uuid4().hex}"
            with where.open_output_stream(draft) as out:
                out.write(data)
            where.move(draft, f"{base}/{name}")
            return pd.DataFrame([(f"{root}/{name}", len(held), size, len(data))], columns=["path", "records", "raw_bytes", "bytes"])

        for batch in batches:
            for key, url, payload, refers in zip(batch["key"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                payload = bytes(payload)
                held.append(record("" if key is None else key, url, payload, sha1_base32(payload), refers))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    return cut(planned.mapInPandas(writer, "path string, records long, raw_bytes long, bytes long"))


def read(spark: SparkSession, root: str, key_type: str = "long") -> DataFrame:
    """One row per record of the archives under ``root``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    ``html`` is null for revisits; length and digest are those of the full payload.  A response
    whose payload does not have the digest of its header stops the job.
    """

    def parse(batches):
        from urllib.parse import unquote

        page = lambda v: unquote(v[len("<urn:page:") : -1]) or None
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        for batch in batches:
            for data in batch["content"]:
                out = []
                for h, block in read_records(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    kind = h["warc-type"]
                    if kind == "response" and (sha1_base32(payload) != digest or len(payload) != length):
                        raise ValueError(f"damaged payload of {h['warc-record-id']}")
                    refers = h.get("warc-refers-to")
                    out.append((page(h["warc-record-id"]), h.get("warc-target-uri"), length, digest, kind, refers and page(refers), payload.decode() if kind == "response" else None))
                    if len(out) >= 2000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").load(root).select("content")
    rows = files.mapInPandas(parse, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string")
    return rows.withColumns({"page_id": F.col("page_id").cast(key_type), "refers_to": F.col("refers_to").cast(key_type)})


def archive(pages: DataFrame, root: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write the archives of ``pages``; returns the folder and the table of files."""
    spark = pages.sparkSession
    root = root or f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # no pages, no files: still a folder
    return root, write(plan(pages, key, url, payload, min_bytes), root)
