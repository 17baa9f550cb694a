"""Language-model scoring from a log-frequency Bloom filter.

Counts of word pairs in the training documents are quantised to levels
``1 + floor(log2(count))``; a pair of level q is entered q times, once per level.  A count is
read back by probing level 1, 2, ... until a probe misses, and taken as the least of its level.  The score is the
sum of ``log10(fraction * min(1, c(u w) / c(u)) + (1 - fraction) * p(w))`` over the words
and the end of the text, where p(w) is the word's own smoothed share and c(u) the exact count of u; after a word
u that training doesn't hold, p(w) alone.  As a level's least count is no more than the count, what a context gives
its words sums to one at most, false hits apart (about one absent pair in 512).

The filter is a row of segments, told by the leading bits of a pair's hash, each with as many bits as its pairs
need for an eighth of them to be set.  While ``filter_bits`` hold twice the training tokens (a bound on all
entries) and all words are among the ``top`` ones, the segments are put together and broadcast.  Beyond that
they stay where their shard is built: documents are dealt into chunks, each n-gram of a chunk goes to its shard with
its number in the training documents, the shard fills its segment, probes it and sends the levels
back to the chunks.  The segments, and so the scores, are the same on both ways.  Pairs are
told apart by 32 bits beside the shard's, which grow with the token count; counts of single words are exact.

Beside it stands the exact base score, the sum of
``log10((c + 0.5) / (N + 0.5 * (V + 1)))`` with each token's exact training
count c.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the end of a text is one
more token.  Edge cases: null or blank text has only its end; a null id trains
and counts as the empty string; repeated rows are trained and scored each; other
columns are passed by; with no training rows every count is 0; an empty table
gives an empty result.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.textops import Words, mix64, slices

_U = np.uint64
END, START = _U(0x1D2C3B4A59687786), _U(0x70819203A4B5C6D7)
PROBES = 3
FLUSH = 4_000_000
#: Entries times probes over bits at which an eighth of the bits is set.
FILL = 0.1335


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by END, and the first of each row."""
    rows = len(words.counts)
    bounds = words.bounds + np.arange(rows + 1)
    out = np.empty(len(words.hash) + rows, _U)
    ends = bounds[1:] - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words.hash
    out[ends] = END
    return out, bounds


def pairs_of(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with the one before it in its row, hash of the one before it)."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    return mix64(before * _U(0xD1B54A32D192ED03) + tokens * _U(0x8CB92BA72F3D8DD7) + _U(2)), before


def single(tokens: np.ndarray) -> np.ndarray:
    return mix64(tokens + _U(0x2545F4914F6CDD1D))


def _spots(keys: np.ndarray, level: int, cells: np.ndarray) -> np.ndarray:
    """PROBES bit numbers inside its segment for each key at a level; cells: the segments' bits, a power of two."""
    base = mix64(keys.astype(_U) + _U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = mix64(base) | _U(1)
    inside = np.asarray(cells, _U) - _U(1)
    return np.stack([(base + _U(i) * step) & inside for i in range(PROBES)], axis=1)


def least_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level: shares of a context then sum to one at most."""
    return np.where(level > 0, np.exp2(np.maximum(level, 1) - 1.0), 0.0)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def segment_of(parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of a segment: each n-gram entered once per level; as many bits as leave an eighth of them set at most."""
    levels = level_of(counts)
    cells = 1 << max(6, int(PROBES * levels.sum() / FILL).bit_length())
    bits = np.zeros(cells, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        bits[_spots(parts[levels >= level], level, cells).ravel().astype(np.int64)] = True
    return bits


class LogFilter:
    """Segments side by side; ``bits`` are packed, ``start`` and ``cells`` are by segment."""

    def __init__(self, bits: np.ndarray, start: np.ndarray, cells: np.ndarray):
        self.bits, self.start, self.cells = bits, start.astype(_U), cells.astype(_U)

    @classmethod
    def of(cls, segments: dict[int, np.ndarray], count: int) -> LogFilter:
        """From packed bits by number of segment; one without n-grams is all zeros."""
        sizes = np.array([8 * len(segments[i]) if i in segments else 64 for i in range(count)], np.int64)
        whole = np.zeros(int(sizes.sum()) // 8, np.uint8)
        start = np.cumsum(sizes) - sizes
        for i, x in segments.items():
            whole[start[i] // 8 : start[i] // 8 + len(x)] = x
        return cls(whole, start, sizes)

    def _has(self, segment: np.ndarray, parts: np.ndarray, level: int) -> np.ndarray:
        spots = _spots(parts, level, self.cells[segment]) + self.start[segment][:, None]
        return (((self.bits[(spots >> _U(3)).astype(np.int64)] >> (_U(7) - (spots & _U(7))).astype(np.uint8)) & 1) > 0).all(axis=1)

    def levels(self, segment: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """By probing level 1, 2, ... until one misses."""
        level = np.zeros(len(parts), np.int64)
        live, now = np.arange(len(parts)), 0
        while len(live) and now < 48:
            now += 1
            live = live[self._has(segment[live], parts[live], now)]
            level[live] = now
        return level


def _split(docs: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumn("held_out", F.crc32(name.cast("binary")) % 5 == 1)


def token_counts(train: DataFrame) -> DataFrame:
    """(h, c): training tokens by hash, with their exact counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])

        for batch in batches:
            for _, raw, offsets in slices(batch.column(0)):
                held.append(tokens_of(Words(raw, offsets))[0])
                size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return train.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def ngram_shards(train: DataFrame, shard_bits: int) -> DataFrame:
    """(shard, rest, counts): word pairs of a shard, the shard_bits leading bits of their hash; the next 32 bits and the counts, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            shard = value >> _U(64 - shard_bits)
            names, starts = np.unique(shard, return_index=True)
            ends = np.append(starts[1:], len(value))
            rest = ((value << _U(shard_bits)) >> _U(32)).astype(np.uint32)
            n = np.minimum(n, (1 << 32) - 1).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int64)), pa.array([rest[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["shard", "rest", "counts"]
            )

        for batch in batches:
            for _, raw, offsets in slices(batch.column(0)):
                tokens, bounds = tokens_of(Words(raw, offsets))
                held.append(pairs_of(tokens, bounds)[0])
                size += len(tokens)
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def out() -> pa.RecordBatch:
            rest, where = np.unique(np.concatenate([np.frombuffer(r, np.uint32) for r, _ in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([np.frombuffer(c, np.uint32) for _, c in parts]).astype(np.float64)).astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([rest.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["shard", "rest", "counts"])

        for batch in batches:
            for s, r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if s != shard and parts:
                    yield out()
                    parts = []
                shard = s
                parts.append((r, c))
        if parts:
            yield out()

    schema = "shard long, rest binary, counts binary"
    packed = train.select("text").mapInArrow(pack, schema)
    return packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, schema)


def log_filter(train: DataFrame, shard_bits: int) -> LogFilter:
    """The whole filter, for a broadcast: its segments are those that the shards would build."""
    shards = ngram_shards(train, shard_bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(segment_of(np.frombuffer(r, np.uint32), np.frombuffer(c, np.uint64))).tobytes() for r, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["segment", "bits"])

    rows = shards.mapInArrow(build, "segment long, bits binary").collect()
    return LogFilter.of({r["segment"]: np.frombuffer(r["bits"], np.uint8) for r in rows}, 1 << shard_bits)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """First places of the runs of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _part(keys: np.ndarray, kind: int, shard_bits: int) -> np.ndarray:
    """What of a key tells it apart: all bits of a word, 32 beside the shard's of a pair."""
    return keys if kind == 0 else ((keys << _U(shard_bits)) >> _U(32)).astype(np.uint32)


def asked(docs: DataFrame, shard_bits: int) -> DataFrame:
    """(shard, kind, part, chunk, n): the words (kind 0) and pairs (1) of the chunks, packed by shard, with their number in training documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            words, pairs, chunk, train = (np.concatenate(x) for x in zip(*held))
            for kind, keys in ((0, words), (1, pairs)):
                shard = (keys >> _U(64 - shard_bits)).astype(np.uint32)
                part = _part(keys, kind, shard_bits)
                order = np.argsort(keys)
                order = order[np.argsort((shard[order].astype(_U) << _U(32)) | chunk[order], kind="stable")]
                shard, part, where = shard[order], part[order], chunk[order]
                first = _runs(shard, where, part)
                n = np.add.reduceat(train[order], first).astype(np.uint32)
                shard, part, where = shard[first], part[first], where[first]
                starts = _runs(shard)
                ends = np.append(starts[1:], len(shard))
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in (part, where, n)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[starts].astype(np.int64)), pa.array(np.full(len(starts), kind, np.int32)), *packed], ["shard", "kind", "part", "chunk", "n"])

        for batch in batches:
            chunks, train = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2))
            for low, raw, offsets in slices(batch.column(0)):
                tokens, bounds = tokens_of(Words(raw, offsets))
                rows, times = slice(low, low + len(bounds) - 1), np.diff(bounds)
                held.append((single(tokens), pairs_of(tokens, bounds)[0], np.repeat(chunks[rows].astype(np.uint32), times), np.repeat(train[rows].astype(np.int64), times)))
                size += len(tokens)
                if size > FLUSH // 2:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return docs.select("text", "chunk", (~F.col("held_out")).alias("train")).mapInArrow(ask, "shard long, kind int, part binary, chunk binary, n binary")


def answered(questions: DataFrame, shards: int) -> DataFrame:
    """(chunk, kind, shard, counts): for each chunk and shard the counts of its words, or the levels of its pairs, in the
    order of their hashes.  A shard enters the pairs of its training documents in its segment of the filter; the levels are
    read back from that by probes."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def out() -> Iterator[pa.RecordBatch]:
            shard, kind = key
            part, chunk, n = (np.concatenate([np.frombuffer(x, t) for x in xs]) for xs, t in zip(zip(*parts), (np.uint32 if kind else _U, np.uint32, np.uint32)))
            names, where = np.unique(part, return_inverse=True)
            total = np.minimum(np.bincount(where, n), (1 << 32) - 1).astype(np.uint32)
            if kind:
                trained = total > 0
                model = LogFilter.of({0: np.packbits(segment_of(names[trained], total[trained]))}, 1)
                total = model.levels(np.zeros(len(names), np.int64), names).astype(np.uint8)
            order = np.argsort((chunk.astype(_U) << _U(32)) | where.astype(_U))
            chunk, where = chunk[order], where[order]
            first = _runs(chunk, where)
            chunk, counts = chunk[first], total[where[first]]
            starts = _runs(chunk)
            ends = np.append(starts[1:], len(chunk))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk[starts].astype(np.int64)), pa.array(np.full(len(starts), kind, np.int32)), pa.array(np.full(len(starts), shard, np.int64)), pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                ["chunk", "kind", "shard", "counts"],
            )

        for batch in batches:
            for s, k, *row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (s, k) != key and parts:
                    yield from out()
                    parts = []
                key = (s, k)
                parts.append(row)
        if parts:
            yield from out()

    return questions.repartition(max(1, shards // 4), "shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "chunk long, kind int, shard long, counts binary")


def _scores(tokens: np.ndarray, bounds: np.ndarray, c_word: np.ndarray, c_pair: np.ndarray, c_end: float, n: int, v: int, fraction: float) -> list[pa.Array]:
    """n_tokens, n_known, base_score, score of each row."""
    c_before = np.empty(len(tokens))
    c_before[1:] = c_word[:-1]
    c_before[bounds[:-1]] = c_end  # a text starts as often as one ends
    likely = np.minimum(1.0, np.divide(c_pair, c_before, out=np.zeros(len(tokens)), where=c_before > 0))
    weight = np.where(c_before > 0, fraction, 0.0)
    own = (c_word + 0.5) / (n + 0.5 * (v + 1))
    sums = [np.add.reduceat(x, bounds[:-1]) for x in ((c_word > 0).astype(np.int64), np.log10(own), np.log10(weight * likely + (1 - weight) * own))]
    return [pa.array(np.diff(bounds)), *map(pa.array, sums)]


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_by_filter(docs: DataFrame, counts: DataFrame, model: LogFilter, shard_bits: int, n: int, v: int, fraction: float) -> DataFrame:
    table = counts.toArrow()
    h = np.asarray(table.column("h").combine_chunks()).view(_U)
    order = np.argsort(h)
    held = docs.sparkSession.sparkContext.broadcast((model, h[order], np.asarray(table.column("c").combine_chunks())[order].astype(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, known, c = held.value

        def exact(tokens: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(len(tokens))
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            return np.where(known[at] == tokens, c[at], 0.0)

        for batch in batches:
            for low, raw, offsets in slices(batch.column(1)):
                tokens, bounds = tokens_of(Words(raw, offsets))
                pairs, at = np.unique(pairs_of(tokens, bounds)[0], return_inverse=True)
                near = least_of(lm.levels((pairs >> _U(64 - shard_bits)).astype(np.int64), _part(pairs, 1, shard_bits)))
                made = _scores(tokens, bounds, exact(tokens), near[at], exact(np.array([END]))[0], n, v, fraction)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(low, len(bounds) - 1) for i in (0, 2)] + made, _NAMES)

    return docs.select("doc_id", "text", "held_out").mapInArrow(score, _SCHEMA)


def shard_bits_of(n: int) -> int:
    """A shard has 2^18 tokens, more on large corpora, where a task's n-grams would else be a row each."""
    return max(5, (n // min(1 << 23, max(1 << 18, 16 * isqrt(n)))).bit_length())


def _score_by_shards(docs: DataFrame, shard_bits: int, n: int, v: int, fraction: float) -> DataFrame:
    chunks = max(512, n >> 19)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    answers = answered(asked(docs, shard_bits), 1 << shard_bits)
    mask = _U(((1 << 64) - 1) ^ ((1 << (32 - shard_bits)) - 1)) if shard_bits < 32 else _U((1 << 64) - 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, known, rows = None, ([], []), []

        def out() -> Iterator[pa.RecordBatch]:
            exact, near = (np.concatenate([np.frombuffer(x, t) for x in xs]) for xs, t in zip(known, (np.uint32, np.uint8)))
            exact, near = exact.astype(np.float64), least_of(near.astype(np.float64))
            raw = pa.array([zlib.decompress(r[2]) for r in rows], pa.binary()).cast(pa.large_string())
            parts = [tokens_of(Words(b, o)) for _, b, o in slices(raw)]
            words, w_at = np.unique(np.concatenate([single(t) for t, _ in parts]), return_inverse=True)
            pairs, p_at = np.unique(np.concatenate([pairs_of(t, b)[0] & mask for t, b in parts]), return_inverse=True)
            if len(words) != len(exact) or len(pairs) != len(near):
                raise RuntimeError("a chunk's n-grams differ from those it asked for")
            c_end = exact[np.searchsorted(words, single(np.array([END])))[0]]
            low = at = 0
            for tokens, bounds in parts:
                span, count = slice(at, at + len(tokens)), len(bounds) - 1
                own = rows[low : low + count]
                made = _scores(tokens, bounds, exact[w_at[span]], near[p_at[span]], c_end, n, v, fraction)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.bool_()), *made], _NAMES)
                low, at = low + count, at + len(tokens)

        for batch in batches:
            for c, kind, counts, *row in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if c != chunk and rows:
                    yield from out()
                    known, rows = ([], []), []
                chunk = c
                if kind < 2:
                    known[kind].append(counts)
                else:
                    rows.append(row)
        if rows:
            yield from out()

    both = answers.select("chunk", "kind", "shard", "counts", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("text"))

    def deflated(texts: pa.Array) -> pa.Array:
        return pa.array([zlib.compress((t.as_py() or "").encode(), 3) for t in texts], pa.binary())

    texts = docs.withColumn("text", F.arrow_udf(deflated, "binary")("text")).select("chunk", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("shard"), F.lit(None).cast("binary").alias("counts"), "doc_id", "held_out", "text")
    dealt = both.unionByName(texts).repartition(max(1, chunks // 4), "chunk").sortWithinPartitions("chunk", "kind", "shard")
    return dealt.select("chunk", "kind", "counts", "doc_id", "held_out", "text").mapInArrow(score, _SCHEMA)


def lm_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 27, top: int = 1 << 17, fraction: float = 0.4) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = _split(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    train = docs.where(~F.col("held_out"))
    counts = written(token_counts(train))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    shard_bits = shard_bits_of(n)
    if v <= top and PROBES * 2 * n <= FILL * filter_bits:
        out = _score_by_filter(docs, counts, log_filter(train, shard_bits), shard_bits, n, v, fraction)
    else:
        out = _score_by_shards(docs, shard_bits, n, v, fraction)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
