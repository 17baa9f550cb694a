"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its distinct ``k``-word shingles.  Two sets link when
``den * |A & B| >= num * |A | B|``.  The signatures of a set are taken from a
prefix of it in one global order, rare shingles before frequent ones, each class
by hash:

* a rare shingle is a signature by itself;
* frequent shingles fall into groups by the leading bits of their hash, and
  every pair of prefix shingles of one group is a signature.

If ``tau`` shingles of a set may be missing from a partner, its prefix extends
until (rare shingles) + sum over groups (shingles - 1) reaches ``tau + 1``.  Any
two linked sets then share a signature whatever shingles differ, so candidates
lose no link; which shingles count as frequent changes the work, never the
result.  The number of groups follows the set's size; a set near a power of two
signs for both numbers.

Candidates of a signature are compared with one hub first, the set with the
fewest rare shingles, which is the middle of a group of near copies; that joins
the group without naming its pairs.  What then still lies in different
components under one signature is compared in full, closest pairs of each
component first, so that pairs which a merge settles are not verified; signatures with the
same members count as one, those with nearly the same members are compared as one group where their union has fewer pairs than
they have, and a pair is not named again under a later group that short lists of groups show.  A group of many members is
compared part against part, those of its largest component only against the others; a group of m is dealt to so many parts that
a member is repeated ``sqrt(m / CELL)`` times or so.  Before any set moves, parity sketches give an exact lower bound of the
symmetric difference.

Edge cases.  Null or blank text: an empty set, linked with nothing; its
component is its own doc_id.  Repeated rows: one result row each, told apart by
``text_key`` where one id has several texts.  Null doc_id:
a row with null doc_id; a component's id is its smallest non-null doc_id.
Columns other than the id and the text are ignored.  An empty table gives an
empty result.  Sets are identified by 64 bits of a BLAKE2 digest and their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, written
from tidemark.llm.textops import Words, mix64, shingle_sets, shingles, slices

_U = np.uint64
SMALL = 16
CELL = 256
FEW = 16


def text_key(text: Column) -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(text.cast("string"))


def blank(text: Column) -> Column:
    """Whether a text has no word."""
    return ~F.coalesce(text.cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")


def allowance(size: int, num: int, den: int) -> int:
    """Shingles of a set that a linked partner may lack."""
    return size - -(-num * size // den)


def bands(size: int, num: int, den: int) -> range:
    """Logarithms of the group counts under which a set meets every partner of a possible size; 0 means singles only."""
    of = lambda s: 0 if s < SMALL else (s // 4).bit_length() - 1
    return range(of(-(-num * size // den)), of(size * den // num) + 1) if size else range(0)


def signatures(hashes: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of one set: ``hashes`` ascending and distinct, ``frequent`` a mask over them."""
    need = allowance(len(hashes), num, den) + 1
    rare = hashes[~frequent]
    out = []
    for band in bands(len(hashes), num, den):
        if band == 0:
            out.append(hashes[:need])
            continue
        out.append(rare[:need])
        if len(rare) >= need:
            continue
        common = hashes[frequent]
        group = common >> _U(64 - band)
        again = np.zeros(len(common), bool)
        again[1:] = group[1:] == group[:-1]
        gained = np.cumsum(again)
        stop = int(np.searchsorted(gained, need - len(rare))) + 1
        common, group = common[:stop], group[:stop]
        step = 1
        while step < len(common):  # pairs at this distance inside a group
            same = group[step:] == group[:-step]
            if not same.any():
                break
            out.append(mix64(common[:-step][same] * _U(0x9FB21C651E98DF25) + common[step:][same] + _U(band)))
            step += 1
    return np.unique(np.concatenate(out)) if out else np.zeros(0, _U)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the hashes per cell, as bits; about half as many cells as hashes, 256 at least."""
    cells = max(256, 1 << max(1, (len(hashes) - 1).bit_length()) - 1)
    return np.packbits((np.bincount((hashes & _U(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _heavy(docs: DataFrame, k: int, top: int) -> np.ndarray:
    """Up to ``top`` of the most frequent shingles, ascending.

    Tasks report those that they see in two documents or more; the sums rank
    them.  At most ``top`` values of 8 bytes reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            twice = n > 1
            return pa.RecordBatch.from_arrays([pa.array(value[twice].view(np.int64)), pa.array(n[twice].astype(np.int64))], ["h", "n"])

        for batch in batches:
            seen: set[bytes] = set()
            for hashes in shingle_sets(batch.column(0), k):
                if (key := hashlib.blake2b(hashes.tobytes(), digest_size=8).digest()) not in seen:
                    seen.add(key)
                    held.append(hashes)
                    size += len(hashes)
                if size > 6_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4")
    rows = counts.orderBy(F.desc("n"), "h").limit(top).select("h").toArrow()
    return np.sort(np.asarray(rows.column("h").combine_chunks()).view(_U))


def _index(docs: DataFrame, k: int, num: int, den: int, heavy: np.ndarray) -> DataFrame:
    """Per document: doc_id, text_key, n, node, sketch, number of rare shingles, signatures."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(top >> _U(42)).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column(0)
            for low, raw, offsets in slices(batch.column(1)):
                hashes, bounds = shingles(Words(raw, offsets), k)
                sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, _U)
                hit = maybe[(flat >> _U(42)).astype(np.int64)]
                at = np.flatnonzero(hit)
                if len(top):
                    hit[at] = top[np.minimum(np.searchsorted(top, flat[at]), len(top) - 1)] == flat[at]
                ends = np.cumsum(sizes)
                signs = [signatures(s, hit[e - len(s) : e], num, den) for s, e in zip(sets, ends)]
                many = np.concatenate([[0], np.cumsum([len(s) for s in signs])]).astype(np.int32)
                values = pa.array(np.concatenate(signs).view(np.int64) if signs else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, len(sets)),
                        batch.column(2).slice(low, len(sets)),
                        pa.array(sizes, pa.int64()),
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) - int(hit[e - len(s) : e].sum()) for s, e in zip(sets, ends)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(many), values),
                    ],
                    ["doc_id", "text_key", "n", "node", "sketch", "rare", "sigs"],
                )

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(build, "doc_id long, text_key long, n long, node long, sketch binary, rare long, sigs array<long>")


def apart_by_members(sigs: DataFrame) -> DataFrame:
    """One of the signatures (sig, m members, h0 and h1 over their nodes, and what else follows from these) of each set of members, as the
    others name the same pairs; the members are told by their number and 128 bits."""
    return sigs.groupBy(*[c for c in sigs.columns if c != "sig"]).agg(F.min("sig").alias("sig")).drop("h0", "h1")


def grouped(placed: DataFrame) -> DataFrame:
    """(node, label, sig): groups that hold together every two nodes of different labels which a signature of ``placed`` (same columns) does.

    Signatures with one label are left out.  The others meet by the member whose hash is least, as lists with much in common mostly do;
    those that meet are one group, named by that hash, if their union has no more pairs than they have, and else stay as they are.
    """
    mixed = placed.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(2)], F.min(F.xxhash64("node", F.lit(2))).alias("root"))
    mixed = cut(apart_by_members(mixed.where("low < high").drop("low", "high")))
    lists = cut(placed.select("node", "label", "sig").join(mixed.select("sig", "root"), "sig"))
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1)
    union = lists.select("root", "node").distinct().groupBy("root").agg(F.count("*").alias("u"))
    union = union.join(mixed.groupBy("root").agg(F.sum(pairs("m")).alias("apart")), "root").where(pairs("u") <= F.col("apart")).select("root", F.lit(True).alias("_one"))
    names = mixed.join(union, "root", "left").select("sig", F.when(F.col("_one"), F.col("root")).otherwise(F.col("sig")).alias("_group"))
    return lists.join(names, "sig").select("node", "label", F.col("_group").alias("sig")).distinct()


def dealt(groups: DataFrame) -> DataFrame:
    """``groups`` (node, label, sig) with each node's ``part`` of its group, the first part ``others`` of those outside the largest label
    and the number of ``parts``.  Of a group of m each part has about sqrt(m * CELL) nodes, so two parts are m * CELL comparisons."""
    sizes = groups.groupBy("sig", "label").agg(F.count("*").alias("c")).groupBy("sig").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"))
    room = F.sqrt(F.col("m") * CELL)
    small = F.col("m") <= CELL
    others = F.when(small, 0).otherwise(F.ceil(F.col("top.c") / room)).cast("int")
    rest = F.when(small, 1).otherwise(F.ceil((F.col("m") - F.col("top.c")) / room)).cast("int")
    sizes = sizes.select("sig", others.alias("others"), (others + rest).alias("parts"), F.col("top.label").alias("_top"))
    inner = (F.col("others") > 0) & (F.col("label") == F.col("_top"))
    among = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    part = F.when(inner, among(F.greatest("others", F.lit(1)))).otherwise(F.col("others") + among(F.col("parts") - F.col("others")))
    return groups.join(sizes, "sig").withColumn("part", part).drop("_top")


def opposite(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of the comparison of nodes that are ``dealt``, with the parts ``p <= q`` that meet: every two nodes of a group of which
    one at least is outside the largest label meet once if their parts differ, and if not, twice, either way round."""
    last = F.col("parts") - 1
    x = placed.withColumns({"p": F.col("part"), "q": F.explode(F.sequence(F.greatest("part", "others"), last))})
    y = placed.where("part >= others").withColumns({"q": F.col("part"), "p": F.explode(F.sequence(F.lit(0), F.col("part")))})
    return x, y


def first_met(sig: Column, x: Column, y: Column) -> Column:
    """Whether no smaller signature is on both lists (the smallest signatures of two sets); so a pair is named under its smallest common
    signature, and again only where that one is not on both lists."""
    return F.coalesce(F.array_min(F.array_intersect(x, y)) >= sig, F.lit(True))


def _close(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, gap): the pairs whose sizes and sketches leave a link possible."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            size = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            gaps = np.array([apart(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())], np.int64)
            # a link has (num + den) * gap <= (den - num) * (|A| + |B|)
            keep = pa.array((num + den) * gaps <= (den - num) * size)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(gaps)], ["a", "b", "gap"]).filter(keep)

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(bound, "a long, b long, gap long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = wanted.join(nodes.select("node", "doc_id"), "node").select("node", F.col("doc_id").alias("want_id"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id"))).select("node", "text")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes_ = batch.column(0).to_pylist()
            found: list[tuple[int, bytes]] = []
            size = 0
            for node, hashes in zip(nodes_, shingle_sets(batch.column(1), k)):
                if node_of(hashes) == node:  # a repeated doc_id may bring other texts
                    found.append((node, hashes.tobytes()))
                    size += hashes.nbytes
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], ["node", "items"])
                    found, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], ["node", "items"])

    sets = written(texts.mapInArrow(load, "node long, items binary").dropDuplicates(["node"]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * common >= num * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    return both.select("a", "b", "items_a", "items_b").mapInArrow(judge, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100, top: int = 1 << 18) -> DataFrame:
    """Per document: doc_id, text_key, n_shingles (set size), component_id, component_key (null without a word), n_copies
    (documents with the same set).

    ``num / den`` is the Jaccard threshold; ``top`` bounds the list of frequent
    shingles that is broadcast (8 bytes each).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = written(_index(docs, k, num, den, _heavy(docs, k, top)))
    nodes = written(index.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("n_copies")))
    postings = index.where("node is not null").select("node", "rare", F.explode("sigs").alias("sig"))
    shared = postings.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("sig")
    members = written(postings.join(shared, "sig").distinct())

    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    hubs = members.groupBy("sig").agg(F.min_by("node", F.struct("rare", F.xxhash64("node", "sig"))).alias("y"))
    stars = members.select("sig", F.col("node").alias("x")).join(hubs, "sig").where("x <> y").select(*pair).distinct()
    stars = cut(_close(stars, nodes, num, den))
    best = stars.select(F.col("a").alias("x"), F.col("b").alias("y"), "gap").union(stars.select(F.col("b").alias("x"), F.col("a").alias("y"), "gap"))
    best = best.groupBy("x").agg(F.min_by("y", F.struct("gap", "y")).alias("y")).select(*pair).distinct()
    links = cut(_verified(cut(best), nodes, docs, k, num, den))
    label = components(links)

    word = lambda i: F.conv(F.substring(F.hex("sketch"), 16 * i + 1, 16), 16, -10).cast("long")
    cells = nodes.withColumn("_short", F.col("n") <= 512)  # sketches of 256 cells as they are; longer ones are compared after
    cells = cells.select("node", "n", *[F.when(F.col("_short"), word(i)).alias(f"w{i}") for i in range(4)])
    placed = members.drop("rare").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = dealt(cut(grouped(placed))).groupBy("node").agg(F.first("label").alias("label"), F.collect_list(F.struct("sig", "part", "others", "parts")).alias("at"))
    placed = placed.withColumn("few", F.slice(F.sort_array(F.col("at.sig")), 1, FEW)).join(cells, "node")
    placed = cut(placed.select("node", "label", "few", *cells.columns[1:], F.inline("at")))
    x, y = (side.alias(name) for side, name in zip(opposite(placed), "xy"))
    gap = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(1, 4)), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
    possible = ((F.col("x.p") < F.col("x.q")) | (F.col("x.node") < F.col("y.node"))) & (F.col("x.label") != F.col("y.label")) & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n"))
    possible &= F.coalesce((num + den) * gap <= (den - num) * (F.col("x.n") + F.col("y.n")), F.lit(True))
    possible &= first_met(F.col("x.sig"), F.col("x.few"), F.col("y.few"))
    met = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    rest = x.join(y, met & possible).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    rest = cut(_close(rest, nodes, num, den).join(best, ["a", "b"], "left_anti"))
    for closest in (True, False):
        sides = [label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
        rest = rest.select("a", "b", "gap").join(sides[0], "a", "left").join(sides[1], "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")
        rest = cut(rest)
        if rest.isEmpty():
            break
        now = rest
        if closest:  # a few closest pairs of each component, by map-side combined minima
            few = [rest.groupBy(c, F.pmod(F.xxhash64("a", "b"), F.lit(4)).alias("p")).agg(F.min(F.struct("gap", "a", "b")).alias("m")).select("m.a", "m.b") for c in ("la", "lb")]
            now = cut(few[0].union(few[1]).distinct())
        links = cut(links.union(_verified(now.select("a", "b"), nodes, docs, k, num, den)))
        label = components(links)
        rest = rest.join(now.select("a", "b"), ["a", "b"], "left_anti") if closest else rest.limit(0)

    named = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id", "n_copies", F.col("label").alias("component_key"))
    return index.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select(
        "doc_id", "text_key", "n_shingles", "component_key", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies")
    )
