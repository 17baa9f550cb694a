"""Approximate nearest neighbours by cross-polytope hashing, for inner products.

Vectors are dealt into bands by norm, four to a factor of two below the greatest norm
and one for all below a 256th of it, so that inside a band the direction decides.  A
hash turns unit vectors by a pseudo-rotation, three rounds of random signs and a fast
Hadamard transform, and takes the signed axis next to the result.  A table's code
concatenates so many hashes that a bucket holds one or two entries if evenly filled:
its length follows the number of entries of the band, the last hash looks at fewer
coordinates.

A query probes the buckets, over all tables and bands, that its products with their
axes make the likeliest places of a neighbour (a ratio of likelihoods for a neighbour
at the sample's typical score against any vector).  How many, ``probes``, is measured:
the exact neighbours of ``SAMPLE`` queries a dimension are found by one pass over all
rows, and the least number of probes is taken at which ``goal`` of them are met.  The
rule is the same at every size; a query lists ``LISTED`` codes of a table at most, and where these don't reach the goal
at any number of probes, all codes are a bit shorter until they do.  On a few hundred vectors in many dimensions, where
neighbours hardly differ from others, it comes to probing most buckets.

Neighbouring codes of a table form cells of about ``CELL`` entries; a query visits a
cell once, with the codes that it asks for.  A query's k-th best score among ``SEEDS``
entries of the sample, which are candidates too, is a floor: a cell hands on nothing
below it, since that can't be among the k nearest.  Candidates are ranked by inner
product in double precision on the original vectors, ties to the smaller id.  Equal vectors are
one index entry with their smallest ids, as many as a result can hold, so a vector
that a third of all rows share is no group of its own.  Cells with more entries or
visits are split.

Edge cases.  Vectors that are null, empty, zero or hold a null or non-finite component
take no part, nor do rows with a null id; they are neither queries nor candidates.
Vectors are compared with those of the same dimension.  Rows that repeat id and vector
count once; one id with several vectors is scored by the best of them.  Other columns
are passed by.  No query or an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, written

CELL = 8192
SAMPLE = 64
SEEDS = 4096
#: Queries in a task, whose lists of codes are long work for little input.
QUERIES = 256
BANDS_AN_OCTAVE, OCTAVES = 4, 8
#: Codes of a table that are ranked for a query, and codes of all tables held at once.
LISTED, HELD = 1 << 12, 1 << 22
UNREACHED = np.iinfo(np.int64).max
_RESULT = "query_id long, ids array<long>, scores array<double>"


def walsh(width: int) -> np.ndarray:
    at = np.arange(width)
    return np.where(np.bitwise_count(at[:, None] & at[None, :]) & 1, -1.0, 1.0).astype(np.float32)


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row, in steps of radix 16; the width is a power of two."""
    n, width = rows.shape
    done = 1
    while done < width:
        radix = min(16, width // done)
        rows = (rows.reshape(-1, radix) @ walsh(radix)).reshape(n, width // radix, radix).transpose(0, 2, 1).reshape(n, width)
        done *= radix
    return rows / np.float32(np.sqrt(width))


def width_of(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def rotated(unit: np.ndarray, table: int, place: int, seed: int) -> np.ndarray:
    """unit turned by the pseudo-rotation of one hash of a table."""
    width = width_of(unit.shape[1])
    rows = np.zeros((len(unit), width), np.float32)
    rows[:, : unit.shape[1]] = unit
    for sign in np.random.default_rng([seed, table, place, width]).choice(np.array([-1, 1], np.float32), (3, width)):
        rows = hadamard(rows * sign)
    return rows


def coordinates(count: int, dim: int) -> list[int]:
    """How many coordinates each hash of a code looks at, for ``count`` entries: all, but for the last."""
    whole = width_of(dim).bit_length()  # bits of an axis and its sign
    bits = min(max(1, count.bit_length() - 1), 3 * whole)
    return [1 << (min(whole, bits - done) - 1) for done in range(0, bits, whole)]


def listed(plan: list[int]) -> list[int]:
    """How many axes of each hash are combined for a query's list of codes."""
    left, out = LISTED, [0] * len(plan)
    for i, place in enumerate(sorted(range(len(plan)), key=plan.__getitem__)):
        out[place] = min(2 * plan[place], int(left ** (1 / (len(plan) - i)) + 1e-9))
        left //= out[place]
    return out


def axes_of(turned: np.ndarray, many: int) -> np.ndarray:
    """Number of the signed axis next to each row: 2a for axis a, 2a + 1 for its opposite."""
    own = turned[:, :many]
    axis = np.abs(own).argmax(axis=1)
    return 2 * axis + (own[np.arange(len(own)), axis] < 0)


def codes_of(unit: np.ndarray, table: int, plan: list[int], seed: int) -> np.ndarray:
    code = np.zeros(len(unit), np.int64)
    for place, many in enumerate(plan):
        code = code * (2 * many) + axes_of(rotated(unit, table, place, seed), many)
    return code


@dataclass
class Scheme:
    """What all tasks know of one dimension: bands with their code lengths, and how to probe."""

    dim: int
    top: float  # the greatest norm
    counts: dict[int, int]  # entries by band
    tables: int
    seed: int
    typical: float = 0.0  # score of a neighbour over its query's norm
    probes: int = 0
    shorter: int = 0  # bits that codes leave off, so that the listed ones reach what is sought
    seeds: tuple[list[list[int]], np.ndarray] = ((), np.zeros((0, 0)))  # ids and vectors of the entries that give the floors

    def plan(self, band: int) -> list[int]:
        return coordinates(max(1, self.counts[band] >> self.shorter), self.dim)

    def band_top(self, band: int) -> float:
        return self.top / 2 ** (band / BANDS_AN_OCTAVE)

    def cell_span(self, band: int) -> int:
        """Codes in a cell."""
        space = int(np.prod([2 * m for m in self.plan(band)]))
        return max(1, space * CELL // max(CELL, self.counts[band]))

    def likely(self, unit: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(band, table, codes, score of each code) for each row of unit, the likeliest codes of the table."""
        width = width_of(self.dim)
        turned: dict[tuple[int, int], np.ndarray] = {}
        for band in sorted(self.counts):
            plan, lists = self.plan(band), listed(self.plan(band))
            c = min(0.95, max(0.05, self.typical / self.band_top(band)))
            for table in range(self.tables):
                code, score = np.zeros((len(unit), 1), np.int64), np.full((len(unit), 1), -width * c * c / 2)
                for place, many in enumerate(plan):
                    if (table, place) not in turned:
                        turned[table, place] = rotated(unit, table, place, self.seed)
                    own = turned[table, place][:, :many]
                    both = np.stack([own, -own], axis=2).reshape(len(unit), -1)
                    most = expected_most(many) / np.sqrt(width)
                    worth = width / (1 - c * c) * (c * most * both - c * c * most * most / 2)
                    few = lists[place]
                    axis = np.argpartition(-worth, few - 1, axis=1)[:, :few]
                    code = (code[:, :, None] * (2 * many) + axis[:, None, :]).reshape(len(unit), -1)
                    score = (score[:, :, None] + np.take_along_axis(worth, axis, axis=1)[:, None, :]).reshape(len(unit), -1)
                yield band, table, code, score


    def step(self) -> int:
        """Queries whose codes are ranked at once."""
        return max(1, HELD // (self.tables * sum(int(np.prod(listed(self.plan(b)))) for b in self.counts)))


@lru_cache
def expected_most(many: int) -> float:
    """Mean of the greatest of many absolute normal values."""
    return float(np.abs(np.random.default_rng(1).normal(size=(2048, many))).max(axis=1).mean())


def needed_probes(scheme: Scheme, unit: np.ndarray, near: list[tuple[int, np.ndarray, int]], goal: float) -> int:
    """The least number of probes that meets ``goal`` of the neighbours; near: (row of unit, unit vector, band)."""
    places = np.zeros((scheme.tables, len(near)), np.int64)
    for band in scheme.counts:
        own = [i for i, (_, _, b) in enumerate(near) if b == band]
        if own:
            for table in range(scheme.tables):
                places[table, own] = codes_of(np.array([near[i][1] for i in own]), table, scheme.plan(band), scheme.seed)
    rank = np.full(len(near), UNREACHED)
    for low in range(0, len(unit), scheme.step()):
        parts = list(scheme.likely(unit[low : low + scheme.step()]))
        order = np.sort(-np.concatenate([s for *_, s in parts], axis=1), axis=1)
        for i, (row, _, b) in enumerate(near):
            if low <= row < low + len(order):
                for band, table, code, score in parts:
                    at = np.flatnonzero(code[row - low] == places[table, i]) if band == b else ()
                    if len(at):
                        rank[i] = min(rank[i], np.searchsorted(order[row - low], -score[row - low, at[0]], "right"))
    if not len(rank):
        return 1
    return int(np.sort(rank)[int(np.ceil(goal * len(rank))) - 1])


def fit_probes(scheme: Scheme, unit: np.ndarray, near: list[tuple[int, np.ndarray, int]], goal: float) -> None:
    """Sets ``probes``, and ``shorter`` where the listed codes of longer ones don't reach ``goal``: codes of ``LISTED`` values are all listed, so
    some length always does."""
    for scheme.shorter in range(max(n.bit_length() for n in scheme.counts.values()) + 1):
        scheme.probes = needed_probes(scheme, unit, near, goal)
        if scheme.probes < UNREACHED:
            return
    raise ValueError(f"no number of probes finds {goal:.0%} of the sample's neighbours in {scheme.dim} dimensions")


def probed(scheme: Scheme, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, table, code) of the probes of each row of unit."""
    parts = list(scheme.likely(unit))
    scores = np.concatenate([s for *_, s in parts], axis=1)
    few = min(scheme.probes, scores.shape[1])
    at = np.argpartition(-scores, few - 1, axis=1)[:, :few]
    codes = np.take_along_axis(np.concatenate([c for _, _, c, _ in parts], axis=1), at, axis=1)
    bands, tables = (np.repeat([p[i] for p in parts], [p[2].shape[1] for p in parts])[at] for i in (0, 1))
    return np.repeat(np.arange(len(unit)), few), bands.ravel(), tables.ravel(), codes.ravel()


def _parts(batch: pa.RecordBatch, kind: type, step: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, matrix) of a batch with columns ``dim`` and ``vec``."""
    for low in range(0, batch.num_rows, step):
        part = batch.slice(low, step)
        dims = np.asarray(part.column("dim"))
        for dim in np.unique(dims).tolist():
            own = part.filter(pa.array(dims == dim))
            yield dim, own, np.frombuffer(b"".join(own.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(vectors: DataFrame, kind: type) -> DataFrame:
    """Each list of numbers as bytes beside its dimension and norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            dims = np.diff(np.asarray(lists.offsets)).astype(np.int32)
            flat = np.asarray(lists.flatten(), kind)
            ends = np.cumsum(dims)
            rows = [flat[e - d : e] for d, e in zip(dims, ends)]
            norms = [float(np.linalg.norm(r.astype(np.float64))) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(dims), pa.array(norms, pa.float64()), batch.column("asked")], ["id", "vec", "dim", "norm", "asked"])

    return vectors.mapInArrow(run, "id long, vec binary, dim int, norm double, asked boolean")


def _sample_neighbours(entries: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], kind: type, k: int) -> DataFrame:
    """(dim, query, vec, norm, score): the k nearest entries of each sampled query, over all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = defaultdict(list)
        for batch in batches:
            for dim, own, x in _parts(batch, kind, 4096):
                ids, queries = sample[dim]
                scores = queries @ x.T
                names = own.column("ids").to_pylist()
                few = min(k + 1, len(x))
                for row, picks in enumerate(np.argpartition(-scores, few - 1, axis=1)[:, :few]):
                    held = best[dim, row]
                    for p in picks:
                        if names[p] != [ids[row]]:  # the query itself
                            held.append((-scores[row, p], own.column("vec")[int(p)].as_py()))
                    held.sort()
                    del held[k:]
        out = [{"dim": d, "query": q, "vec": v, "score": -s} for (d, q), held in best.items() for s, v in held]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("dim", pa.int32()), ("query", pa.int32()), ("vec", pa.binary()), ("score", pa.float64())]))

    found = entries.mapInArrow(run, "dim int, query int, vec binary, score double")
    place = F.row_number().over(Window.partitionBy("dim", "query").orderBy(F.desc("score"), "vec"))
    return found.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def _schemes(entries: DataFrame, asked: DataFrame, kind: type, k: int, tables: int, seed: int, goal: float) -> dict[int, Scheme]:
    tops = {r["dim"]: r["top"] for r in entries.groupBy("dim").agg(F.max("norm").alias("top")).collect()}
    band = F.least(F.floor(F.log2(F.element_at(F.create_map(*[F.lit(x) for pair in tops.items() for x in pair]), F.col("dim")) / F.col("norm")) * BANDS_AN_OCTAVE), F.lit(BANDS_AN_OCTAVE * OCTAVES)) if tops else F.lit(0)
    schemes: dict[int, Scheme] = {}
    for r in entries.groupBy("dim", band.cast("int").alias("band")).count().collect():
        schemes.setdefault(r["dim"], Scheme(r["dim"], tops[r["dim"]], {}, tables, seed)).counts[r["band"]] = r["count"]
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "vec"))
    chosen = asked.withColumn("_n", place).where(F.col("_n") <= SAMPLE).select("dim", "id", "vec").collect()
    sample = {}
    for dim in {r["dim"] for r in chosen}:
        own = sorted((r["id"], bytes(r["vec"])) for r in chosen if r["dim"] == dim)
        sample[dim] = np.array([i for i, _ in own]), np.frombuffer(b"".join(v for _, v in own), kind).reshape(-1, dim).astype(np.float64)
    found = _sample_neighbours(entries.where(F.col("dim").isin(list(sample))), sample, kind, k).collect() if sample else []
    for dim, (_, queries) in sample.items():
        own, scheme = [r for r in found if r["dim"] == dim], schemes[dim]
        length = np.linalg.norm(queries, axis=1)
        last = defaultdict(list)
        near = []
        for r in own:
            x = np.frombuffer(r["vec"], kind).astype(np.float64)
            norm = np.linalg.norm(x)
            near.append((r["query"], x / norm, band_of(scheme.top, norm)))
            last[r["query"]].append(r["score"] / length[r["query"]])
        scheme.typical = float(np.median([min(x) for x in last.values()])) if last else 0.0
        fit_probes(scheme, _unit(queries), near, goal)
    seeds = [r for dim in sample for r in entries.where(F.col("dim") == dim).select("dim", "ids", "vec").orderBy(F.xxhash64("vec"), "vec").limit(SEEDS).collect()]
    for dim, scheme in schemes.items():
        own = sorted((bytes(r["vec"]), r["ids"]) for r in seeds if r["dim"] == dim)
        scheme.seeds = [i for _, i in own], np.frombuffer(b"".join(v for v, _ in own), kind).reshape(-1, dim)
    return schemes


def band_of(top: float, norm: float) -> int:
    return min(int(np.floor(np.log2(top / norm) * BANDS_AN_OCTAVE)), BANDS_AN_OCTAVE * OCTAVES) if norm < top else 0


def _index(entries: DataFrame, schemes: Broadcast, kind: type) -> DataFrame:
    """(dim, band, tab, cell, code, ids, vec): one row per entry and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, x in _parts(batch, kind, 4096):
                scheme = schemes.value[dim]
                bands = np.array([band_of(scheme.top, n) for n in own.column("norm").to_pylist()], np.int32)
                for band in np.unique(bands).tolist():
                    here = np.flatnonzero(bands == band)
                    rows, unit = own.take(pa.array(here)), _unit(x[here])
                    for table in range(scheme.tables):
                        code = codes_of(unit, table, scheme.plan(band), scheme.seed)
                        fixed = [pa.array(np.full(len(here), v, np.int32)) for v in (dim, band, table)]
                        yield pa.RecordBatch.from_arrays([*fixed, pa.array(code // scheme.cell_span(band)), pa.array(code), rows.column("ids"), rows.column("vec")], ["dim", "band", "tab", "cell", "code", "ids", "vec"])

    return entries.select("dim", "norm", "ids", "vec").mapInArrow(run, "dim int, band int, tab int, cell long, code long, ids array<long>, vec binary")


def _visits(asked: DataFrame, schemes: Broadcast, kind: type, k: int) -> DataFrame:
    """(dim, band, tab, cell, codes, id, vec, floor): one row per query and cell that it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, x in _parts(batch, kind, 1024):
                scheme = schemes.value[dim]
                ids = np.asarray(own.column("id"))
                seeds = x @ scheme.seeds[1].astype(np.float64).T
                for at, names in enumerate(scheme.seeds[0]):
                    if len(names) == 1:
                        seeds[ids == names[0], at] = -np.inf
                floor = -np.sort(-seeds, axis=1)[:, k - 1] if seeds.shape[1] >= k else np.full(len(x), -np.inf)
                floor -= 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0))  # products round by the matrix's shape
                for low in range(0, len(x), scheme.step()):
                    row, band, table, code = probed(scheme, _unit(x[low : low + scheme.step()]))
                    span = np.ones(max(scheme.counts) + 1, np.int64)
                    for b in scheme.counts:
                        span[b] = scheme.cell_span(b)
                    cell = code // span[band]
                    order = np.lexsort((code, cell, table, band, row))
                    row, band, table, code, cell = (v[order] for v in (row, band, table, code, cell))
                    new = np.ones(len(row), bool)
                    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in (row, band, table, cell)])
                    starts = np.flatnonzero(new)
                    codes = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(code))
                    at = row[starts] + low
                    fixed = [pa.array(v.astype(np.int32)) for v in (np.full(len(starts), dim), band[starts], table[starts])]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(cell[starts]), codes, own.column("id").take(pa.array(at)), own.column("vec").take(pa.array(at)), pa.array(floor[at])], ["dim", "band", "tab", "cell", "codes", "id", "vec", "floor"])

    return asked.select("dim", "id", "vec").mapInArrow(run, "dim int, band int, tab int, cell long, codes array<long>, id long, vec binary, floor double")


def _seeded(asked: DataFrame, schemes: Broadcast, kind: type, k: int) -> DataFrame:
    """(query_id, ids, scores): the best of the seeds for each query, so that what is at its floor is a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, x in _parts(batch, kind, 1024):
                names, vectors = schemes.value[dim].seeds
                y = vectors.astype(np.float64)
                few = min(k + 1, len(y))
                at = np.argpartition(-(x @ y.T), few - 1, axis=1)[:, :few] if few else np.zeros((len(x), 0), np.int64)
                yield _ranked(np.repeat(np.asarray(own.column("id")), few), np.arange(len(x)).repeat(few), at.ravel(), x, y, names, k)

    return asked.select("dim", "id", "vec").mapInArrow(run, _RESULT)


def _ranked(query: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, names: list[list[int]], k: int, floor: np.ndarray | None = None) -> pa.RecordBatch:
    """The k best of each row of x among the entries ``at``, without the query itself: a row (query_id, ids, scores) each."""
    score = np.concatenate([[0.0][:0], *[np.einsum("ij,ij->i", x[row[a : a + 65536]], y[at[a : a + 65536]]) for a in range(0, len(at), 65536)]])
    if floor is not None:
        good = score >= floor[row]
        query, row, at, score = query[good], row[good], at[good], score[good]
    many = np.array([len(names[i]) for i in at], np.int64)
    ids = np.array([v for i in at for v in names[i]], np.int64)
    query, row, score = (np.repeat(v, many) for v in (query, row, score))
    other = ids != query
    query, row, score, ids = query[other], row[other], score[other], ids[other]
    order = np.lexsort((ids, -score, row))
    query, row, score, ids = query[order], row[order], score[order], ids[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    query, row, score, ids = query[kept], row[kept], score[kept], ids[kept]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    ends = pa.array(np.append(starts, len(row)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(query[starts].astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(score))], ["query_id", "ids", "scores"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from the lists of all cells that a query looked into; of an id's scores the best counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, parts in zip(batch.column("query_id").to_pylist(), batch.column("parts").to_pylist()):
                ids = np.concatenate([np.array(x["ids"], np.int64) for x in parts])
                scores = np.concatenate([np.array(x["scores"], np.float64) for x in parts])
                order = np.lexsort((ids, -scores))
                _, first = np.unique(ids[order], return_index=True)
                best = order[np.sort(first)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query)), pa.array(np.arange(1, len(best) + 1, dtype=np.int32)), pa.array(ids[best]), pa.array(scores[best])], ["query_id", "rank", "vec_id", "score"])

    lists = found.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("parts"))
    return lists.mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def _cell_best(k: int, kind: type):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        if not left.num_rows or not right.num_rows:
            return empty
        dim = left.column("dim")[0].as_py()
        left = left.take(pa.array(np.argsort(np.asarray(left.column("code")), kind="stable")))
        code = np.asarray(left.column("code"))
        y, x = (np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64) for t in (left, right))
        lists = right.column("codes").combine_chunks()
        asked, row = np.asarray(lists.flatten()), np.repeat(np.arange(right.num_rows), np.diff(np.asarray(lists.offsets)))
        low, high = np.searchsorted(code, asked, "left"), np.searchsorted(code, asked, "right")
        many = high - low
        row = np.repeat(row, many)
        at = np.arange(len(row)) + np.repeat(low - np.cumsum(many) + many, many)
        query, floor = np.asarray(right.column("id")), np.asarray(right.column("floor"))
        return pa.Table.from_batches([_ranked(query[row], row, at, x, y, left.column("ids").to_pylist(), k, floor)])

    return best


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, tables: int = 16, goal: float = 0.94, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows found of each row where ``is_query`` holds: query_id, rank, vec_id, score."""
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind, word = (np.float32, "float") if single else (np.float64, "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{word}>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    # + 0 makes -0.0 and 0.0 one value
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite).withColumn("vec", F.transform("vec", lambda v: v + F.lit(0).cast(word)))
    rows = written(_packed(rows, kind))
    place = Window.partitionBy("vec").orderBy("id")
    unique = rows.select("id", "vec", "dim", "norm").distinct().withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1)
    entries = written(unique.groupBy("vec").agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = rows.where("asked").select("id", "dim", "vec").distinct()
    asked = written(asked.repartition(1 + asked.count() // QUERIES, "id"))
    schemes = vectors.sparkSession.sparkContext.broadcast(_schemes(entries, asked, kind, k, tables, seed, goal))

    bucket = ["dim", "band", "tab", "cell"]
    index, visits = written(_index(entries, schemes, kind)), written(_visits(asked, schemes, kind, k))
    parts = index.groupBy(*bucket).agg(F.ceil(F.count("*") / (4 * CELL)).cast("int").alias("c_parts"))
    parts = cut(parts.join(visits.groupBy(*bucket).agg(F.ceil(F.count("*") / (4 * CELL)).cast("int").alias("q_parts")), bucket))
    large = parts.where("c_parts > 1 or q_parts > 1")  # all others are one part
    keys = [*bucket, "c_part", "q_part"]

    def dealt(rows: DataFrame, own: str, other: str, by: str) -> DataFrame:
        rows = rows.join(parts.select(*bucket), bucket, "left_semi").join(large, bucket, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("c_parts", "q_parts")})
        return rows.withColumns({f"{own}_part": F.pmod(F.xxhash64(by), F.col(f"{own}_parts")).cast("int"), f"{other}_part": F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))}).drop("c_parts", "q_parts")

    left, right = dealt(index, "c", "q", "vec"), dealt(visits, "q", "c", "id")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_cell_best(k, kind), _RESULT)
    return _merged(found.union(_seeded(asked, schemes, kind, k)), k)
