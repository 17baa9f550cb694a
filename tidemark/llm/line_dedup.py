"""Line dedup by range-partitioned line hashes.

Lines split at ``\\n``.  A line's key is the line without ``[\\x20\\x09-\\x0D]`` at
both ends and with A-Z lower-cased.  A key of at least ``min_chars`` code points
found in at least ``min_docs`` documents loses all its lines except those in the
first document of the order (the largest doc_id by default).

Rows (hash, document, position) are range-partitioned on all three and sorted
inside the partitions, so a line that a third of all documents share is spread
over many partitions.  Each partition is streamed: the first document of a hash
keeps its lines, the next ones wait until ``min_docs`` are seen.  A hash that
crosses a partition's edge is settled from one summary row per partition.  The
result is a zlib-compressed bitmap per document, not text.

Edge cases.  Null or empty text is one empty line, which stays.  Documents are
told apart by id: rows that repeat a doc_id count as one document, and each of
them gets the lines of its own text judged.  Rows with a null doc_id count as one
document that sorts after all others.  Other columns are passed by.  An empty
table gives an empty result.  Line keys are told apart by 128 bits of MD5.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

STRIPPED = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIN = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None when it is too short to count."""
    key = line.strip(STRIPPED)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.translate(_LOWER)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc, text_id, pos) of every line that counts; text_id tells rows with one doc_id apart."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, where, rows = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                row = zlib.crc32(raw)
                for pos, line in enumerate(raw.split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        digests.append(hashlib.md5(key, usedforsecurity=False).digest())
                        ids.append(_MIN if doc is None else doc)
                        where.append(pos)
                        rows.append(row)
                if len(ids) > 200_000:
                    yield batch_of(digests, ids, rows, where)
                    ids, digests, where, rows = [], [], [], []
            yield batch_of(digests, ids, rows, where)

    def batch_of(digests: list, ids: list, rows: list, where: list) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(where, pa.int32())], ["h1", "h2", "doc", "text_id", "pos"])

    return docs.mapInArrow(split, "h1 long, h2 long, doc long, text_id long, pos int")


def _runs(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts of hash runs and of (hash, document) runs, as masks."""
    new_hash = np.ones(len(h1), bool)
    new_hash[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_hash.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return new_hash, new_doc


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its first and last (hash, document), and how many documents those hashes have in it."""
    first = last = None
    head = tail = 0
    pid = TaskContext.get().partitionId()
    whole = True  # the partition has one hash only
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (np.asarray(batch.column(c)) for c in ("h1", "h2", "doc"))
        new_hash, new_doc = _runs(h1, h2, doc)
        if last is not None:
            new_hash[0] = (h1[0], h2[0]) != last[:2]
            new_doc[0] = new_hash[0] or doc[0] != last[2]
        else:
            first = (int(h1[0]), int(h2[0]), int(doc[0]))
            new_hash[0] = False
        starts = np.flatnonzero(new_hash)
        if whole:
            head += int(new_doc[: starts[0] if len(starts) else None].sum())
        if len(starts):
            whole, tail = False, int(new_doc[starts[-1] :].sum())
        else:
            tail += int(new_doc.sum())
        last = (int(h1[-1]), int(h2[-1]), int(doc[-1]))
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"pid": pid, "f1": first[0], "f2": first[1], "fd": first[2], "l1": last[0], "l2": last[1], "ld": last[2], "head": head, "tail": tail, "whole": whole}])


def _carries(rows: list, min_docs: int) -> dict[int, tuple]:
    """What each partition must know: documents of its first hash before it and whether its first document was among
    them; documents of its last hash after it, other than its last document, up to min_docs."""
    rows = sorted(rows, key=lambda r: r.pid)
    before, seen, same = {}, 0, None  # same: the (hash, document) that ended the last partition
    for r in rows:
        go_on = same is not None and same[:2] == (r.f1, r.f2)
        count = seen if go_on else 0
        shared = go_on and same[2] == r.fd
        before[r.pid] = (count, shared)
        seen = (count + r.head - shared) if r.whole else r.tail
        same = (r.l1, r.l2, r.ld)
    after, seen, same = {}, 0, None
    for r in reversed(rows):
        go_on = same is not None and same[:2] == (r.l1, r.l2)
        count = seen - (same[2] == r.ld) if go_on else 0
        after[r.pid] = count
        seen = min(min_docs + 1, (count + r.head) if r.whole else r.head)
        same = (r.f1, r.f2, r.fd)
    return {r.pid: (*before[r.pid], after[r.pid], r.l1, r.l2) for r in rows}


def _dropper(carries: dict[int, tuple], min_docs: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams a partition; holds back lines of at most min_docs - 2 documents of one hash."""
        key, doc, count, after = None, None, 0, 0
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        begun = False

        def out(parts: list) -> pa.RecordBatch:
            cols = [np.concatenate([p[i] for p in parts]) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32())], ["doc", "text_id", "pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, docs, text_id, pos = (np.asarray(batch.column(c)) for c in ("h1", "h2", "doc", "text_id", "pos"))
            if not begun:
                begun = True
                earlier, shared, later, l1, l2 = carries[TaskContext.get().partitionId()]
                key, count = (h1[0], h2[0]), earlier
                doc = docs[0] if shared else None
                after = later if key == (l1, l2) else 0
            new_hash, new_doc = _runs(h1, h2, docs)
            bounds = np.append(np.flatnonzero(new_doc), len(h1))
            dropped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                now = (h1[a], h2[a])
                if now != key:
                    key, doc, count, waiting = now, None, 0, []
                    after = later if key == (l1, l2) else 0
                if doc is None or docs[a] != doc:
                    doc, count = docs[a], count + 1
                if count == 1:
                    continue  # the document that keeps its lines
                part = (docs[a:b], text_id[a:b], pos[a:b])
                if count + after >= min_docs:
                    dropped += [*waiting, part]
                    waiting = []
                else:
                    waiting.append(part)
            if dropped:
                yield out(dropped)

    return drop


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """(doc_id, text_id, n_dropped, keep): documents that lose lines, with the compressed bitmap of the lines to keep.

    Bit i of the bitmap (most significant first) is 1 if line i stays; lines
    after its end stay.  text_id is the CRC-32 of the text.  Documents that lose
    nothing have no row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    # a checkpoint keeps both the partitions and the order inside them
    placed = cut(_lines(docs, min_chars).repartitionByRange(n, *order).sortWithinPartitions(*order, "text_id", "pos"))
    summaries = placed.mapInArrow(_edges, "pid long, f1 long, f2 long, fd long, l1 long, l2 long, ld long, head long, tail long, whole boolean").collect()
    dropped = placed.mapInArrow(_dropper(_carries(summaries, min_docs), min_docs), "doc long, text_id long, pos int")
    per_doc = dropped.groupBy("doc", "text_id").agg(F.collect_set("pos").alias("pos"))
    return per_doc.mapInArrow(_bitmaps, "doc_id long, text_id long, n_dropped long, keep binary")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keeps = []
        for pos in batch.column("pos").to_pylist():
            bits = np.ones(max(pos) + 1, np.uint8)
            bits[pos] = 0
            keeps.append(zlib.compress(np.packbits(bits).tobytes() + bytes([-len(bits) % 8])))
        ids = [None if d == _MIN else d for d in batch.column("doc").to_pylist()]
        counts = [len(p) for p in batch.column("pos").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("text_id"), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())], ["doc_id", "text_id", "n_dropped", "keep"])


def unpack(keep: bytes) -> np.ndarray:
    """The bits of a bitmap: True where a line stays."""
    raw = zlib.decompress(keep)
    return np.unpackbits(np.frombuffer(raw[:-1], np.uint8)).astype(bool)[: 8 * (len(raw) - 1) - raw[-1]]


def kept_lines(raw: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """(text of the lines that stay, lines before, lines dropped)."""
    lines = raw.split(b"\n")
    if keep is None:
        return raw, len(lines), 0
    stays = unpack(keep)
    left = [x for i, x in enumerate(lines) if i >= len(stays) or stays[i]]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def with_bitmaps(docs: DataFrame, keeps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the column _keep, null where all lines stay."""
    keeps = keeps.select(F.col("doc_id").alias("_k_doc"), F.col("text_id").alias("_k_text"), F.col("keep").alias("_keep")).hint("shuffle_hash")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_k_doc")) & (F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")) == F.col("_k_text"))
    return docs.join(keeps, same, "left").drop("_k_doc", "_k_text")


def drop_lines(docs: DataFrame, keeps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the lines of each text that stay; a null text stays null."""

    def rest(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if not (t.is_valid and k.is_valid) else kept_lines(t.as_py().encode(), k.as_py())[0].decode() for t, k in zip(texts, bitmaps)], pa.string())

    return with_bitmaps(docs, keeps, id_col=id_col, text_col=text_col).withColumn(text_col, F.arrow_udf(rest, "string")(F.col(text_col), F.col("_keep"))).drop("_keep")


def line_digests(docs: DataFrame, keeps: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_lines((t.as_py() or "").encode(), k.as_py()) for t, k in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    joined = with_bitmaps(docs.select("doc_id", "text"), keeps).select("doc_id", "text", "_keep")
    return joined.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
