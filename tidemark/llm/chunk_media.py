"""Media columns as content-defined chunks.

A payload (the text's UTF-8 bytes, padded with bytes 255 to a positive multiple
of ``FRAME``) is cut where a rolling gear hash of the last 32 bytes has its top
bits zero, between a least and a greatest chunk size.  Chunks are told apart by 128 bits of
SHA-256; the first payload, by name and position, that uses a chunk owns it.

The store has each distinct chunk once, beside the other chunks of its owner.  It is
written as a table bucketed by owner, so that owners meet their chunk lists without
another shuffle.  A payload is put together from what it reads back from the store by its ordered chunk
list, its own chunks like those of others, and each chunk and the whole are verified by digest: a
chunk that the store lacks fails every payload that uses it.

The stored form of a payload is its container: ``CDC1``, the number of chunks,
then for each chunk its length and digest, then the chunks' bytes.  Chunks travel and lie
deflated.

Edge cases.  Null text: as empty.  Equal texts share one chunk list, so repeated
rows and very large groups of copies are stored and rebuilt once; each row gets
its own result row, null ids too.  Other columns are passed by; an empty table
gives an empty result.  A payload is rebuilt in one task, as it is one value.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, written
from tidemark.llm.textops import constants

FRAME = 576
_GEAR = (constants(256, 71) >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (FRAME - len(raw) if len(raw) < FRAME else -len(raw) % FRAME)


def cuts(data: bytes, least: int = 512, bits: int = 11, most: int = 8192) -> list[int]:
    """Ends of the chunks of data; the same bytes around a cut give the same cut wherever they stand."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8, 16):  # h[i] sums the last 2 * span bytes
        later = h.copy()
        later[span:] += h[:-span] << np.uint32(span)
        h = later
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, start, n = [], 0, len(data)
    while start < n:
        i = int(np.searchsorted(marks, start + least))
        end = min(int(marks[i]) if i < len(marks) else n, start + most, n)
        out.append(end)
        start = end
    return out


def container(chunks: list[bytes]) -> bytes:
    head = b"CDC1" + struct.pack("<I", len(chunks))
    return head + b"".join(struct.pack("<I", len(c)) + hashlib.sha256(c).digest() for c in chunks) + b"".join(chunks)


def read_container(stored: bytes) -> bytes:
    """The payload of a container; raises where a chunk's bytes don't match its digest."""
    if stored[:4] != b"CDC1":
        raise ValueError("not a chunk container")
    (count,) = struct.unpack_from("<I", stored, 4)
    at, parts = 8 + 36 * count, []
    for i in range(count):
        (size,) = struct.unpack_from("<I", stored, 8 + 36 * i)
        part = stored[at : at + size]
        if hashlib.sha256(part).digest() != stored[12 + 36 * i : 44 + 36 * i]:
            raise ValueError(f"chunk {i} is damaged")
        parts.append(part)
        at += size
    return b"".join(parts)


def name_of(data: bytes) -> bytes:
    """The digest that names a payload or chunk between tasks: 128 bits of its SHA-256."""
    return hashlib.sha256(data).digest()[:16]


def split_chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def payload_names(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_id) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([name_of(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "payload_id"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_id binary")


def payloads(docs: DataFrame) -> DataFrame:
    """(payload_id, packed): each distinct payload once, deflated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, bytes] = {}
            size = 0
            seen: set[bytes] = set()
            for text in batch.column(0):
                data = payload(text.as_py())
                if (key := name_of(data)) in seen:
                    continue
                seen.add(key)
                found[key] = zlib.compress(data, 6)
                size += len(found[key])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["payload_id", "packed"])
                    found, size = {}, 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["payload_id", "packed"])

    return docs.select("text").mapInArrow(run, "payload_id binary, packed binary").repartition("payload_id").dropDuplicates(["payload_id"])


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(payload_id, size, digests): the ordered chunk list of each distinct payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[bytes, tuple[int, list[bytes]]] = {}
            for text in batch.column(0):
                data = payload(text.as_py())
                if (key := name_of(data)) not in rows:
                    rows[key] = len(data), [name_of(part) for part in split_chunks(data)]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([n for n, _ in rows.values()], pa.int64()), pa.array([x for _, x in rows.values()], pa.list_(pa.binary()))], ["payload_id", "size", "digests"])

    return docs.select("text").mapInArrow(run, "payload_id binary, size long, digests array<binary>").dropDuplicates(["payload_id"])


def borrowed(lists: DataFrame) -> DataFrame:
    """(payload_id, pos, digest, owner): the uses of chunks that an earlier payload or position owns."""
    uses = lists.select("payload_id", F.posexplode("digests").alias("pos", "digest"))
    shared = uses.groupBy("digest").agg(F.min(F.struct("payload_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return uses.join(shared, "digest").where(F.struct("payload_id", "pos") != F.col("first")).select("payload_id", "pos", "digest", F.col("first.payload_id").alias("owner"))


_STORE = "payload_id binary, digests array<binary>, sizes array<int>, body binary"


def chunk_store(docs: DataFrame, lists: DataFrame, foreign: DataFrame) -> DataFrame:
    """(payload_id, digests, sizes, body): the chunks that each payload owns, deflated as one; written, bucketed by payload_id."""
    spark = docs.sparkSession
    skipped = foreign.groupBy("payload_id").agg(F.collect_list("pos").alias("skipped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pid, packed, skip in zip(*(batch.column(c).to_pylist() for c in ("payload_id", "packed", "skipped"))):
                parts = split_chunks(zlib.decompress(packed))
                if skip:
                    parts = [part for pos, part in enumerate(parts) if pos not in set(skip)]
                    packed = zlib.compress(b"".join(parts), 6)
                if parts:
                    rows.append((pid, [name_of(x) for x in parts], [len(x) for x in parts], packed))
            if rows:
                kinds = (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["payload_id", "digests", "sizes", "body"])

    size = lists.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    name = f"tidemark_chunks_{uuid.uuid4().hex}"
    owned = payloads(docs).join(skipped, "payload_id", "left").select("payload_id", "packed", "skipped").mapInArrow(run, _STORE)
    here = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = bucket_count(size, here, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    if buckets != here:  # a task then writes one bucket, not a file in each
        owned = owned.repartition(buckets, "payload_id")
    owned.write.bucketBy(buckets, "payload_id").option("path", f"{shared_dir(spark)}/{name}").option("compression", "uncompressed").saveAsTable(name)
    store = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it; its files stay until the intermediates go
    return store


def bucket_count(size: int, partitions: int, most: int) -> int:
    """Buckets of about 64 MB; with fewer than the session's partitions joins would shuffle the store again, and Spark refuses more than ``most``."""
    return min(max(partitions, size >> 26), most)


def _chunks(digests: list[bytes], sizes: list[int], body: bytes) -> dict[bytes, bytes]:
    """The chunks of a row of the store by digest."""
    whole, ends = zlib.decompress(body), np.cumsum(sizes)
    return {d: whole[e - n : e] for d, n, e in zip(digests, sizes, ends.tolist())}


def rebuilt(store: DataFrame, lists: DataFrame, foreign: DataFrame) -> DataFrame:
    """(payload_id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each payload,
    put together from the store by its chunk list."""

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[bytes, bytes] = {}
            for digests, sizes, body, lent in zip(*(batch.column(c).to_pylist() for c in ("digests", "sizes", "body", "lent"))):
                own = _chunks(digests, sizes, body)
                out |= {d: zlib.compress(own[d], 6) for d in lent if d in own}
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "body"])

    lenders = foreign.groupBy(F.col("owner").alias("payload_id")).agg(F.collect_set("digest").alias("lent"))
    lent = store.join(lenders, "payload_id").select("digests", "sizes", "body", "lent").mapInArrow(lend, "digest binary, body binary")
    brought = foreign.select("payload_id", "digest").distinct().join(lent, "digest").groupBy("payload_id").agg(F.collect_list(F.struct("digest", "body")).alias("brought"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pid, wanted, digests, sizes, body, extra in zip(*(batch.column(c).to_pylist() for c in ("payload_id", "wanted", "digests", "sizes", "body", "brought"))):
                held = _chunks(digests, sizes, body) if body is not None else {}
                held |= {x["digest"]: zlib.decompress(x["body"]) for x in extra or ()}
                parts = []
                for pos, digest in enumerate(wanted):
                    if digest not in held or name_of(held[digest]) != digest:
                        raise ValueError(f"payload {pid.hex()}: chunk {pos} is missing or damaged")
                    parts.append(held[digest])
                out.append(features(pid, parts))
            if out:
                yield pa.RecordBatch.from_pylist(out)

    joined = lists.select("payload_id", F.col("digests").alias("wanted")).join(store, "payload_id", "left").join(brought, "payload_id", "left")
    joined = joined.select("payload_id", "wanted", "digests", "sizes", "body", "brought")
    return joined.mapInArrow(assemble, "payload_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def features(pid: bytes, parts: list[bytes]) -> dict:
    media = container(parts)
    data = read_container(media)
    if name_of(data) != pid:
        raise ValueError(f"payload {pid.hex()} was not restored")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = seen[seen > 0] / len(data)
    return {
        "payload_id": pid,
        "payload_bytes": len(data),
        "payload_sha256": hashlib.sha256(data).hexdigest(),
        "tail_crc32": zlib.crc32(data[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"chunks={len(parts)};longest={max(map(len, parts))};mean={np.dot(seen, np.arange(256)) / len(data):.3f};entropy={-np.sum(share * np.log2(share)):.3f}",
    }


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, and what its payload gives when it is rebuilt from the chunk store."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lists = written(chunk_lists(docs))
    foreign = written(borrowed(lists))
    return payload_names(docs).join(rebuilt(chunk_store(docs, lists, foreign), lists, foreign), "payload_id").drop("payload_id")
