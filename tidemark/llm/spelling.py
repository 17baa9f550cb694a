"""Spelling variants: words of a corpus grouped by one inserted, deleted or replaced code point.

Words are maximal runs of Latin letters, ASCII folded, counted in the task before they are
shuffled.  Pairs at distance one come from a self-join of the vocabulary's trie.  A trie
node at distance 0 of a node is that node itself; at distance 1 are, where a branch is
left, its siblings (replaced), its parent (inserted) and, further down, pairs of nodes
reached from such a pair by the same character.  These active pairs go down level by level
and a pair of two word ends is emitted.

The trie is partitioned by prefix.  Take m code points for the shorter word of a pair and
``h = m // 2``: either both words share the first h, or they share the last ``m - h``.
So a word goes to one part for each of its two possible m, by its prefix into the trie of
words and by its suffix into the trie of reversed words; each part is a subtrie of its own
and every pair is met in one of them.  In a part only words of m and m + 1 code points meet.
A part of more than ``largest`` words isn't built in one task: there the nodes at distance one
are dealt out singly, by what is left of a word when one code point is taken out.  Such a
key has no more members than the alphabet and the word's length give.

Edge cases: null and empty texts have no words; rows without an id count under an empty id; repeated rows count
each; equal counts tie towards the smaller word in code-point order; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

PART = 1 << 20
HELD = 400_000
CELLS = 1 << 21
LARGEST = 100_000
_RUN_LETTERS = "a-zÀ-ÿ"


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of all runs, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _runs_in(text: str, pattern: re.Pattern, gap: re.Pattern) -> Iterator[list[str]]:
    """Runs of a text, part by part; only A-Z are lower-cased."""
    low = 0
    while low < len(text):
        cut = gap.search(text, low + PART) if len(text) - low > PART else None
        high = cut.end() if cut else len(text)
        yield pattern.findall(text[low:high].encode().lower().decode())
        low = high


def _counter(min_chars: int, garble: int | None):
    """Counts (word, n) of rows (doc_id, text); one run of a document in ``garble`` loses a code point, told by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, gap = re.compile(f"[{_RUN_LETTERS}]{{{min_chars},}}"), re.compile(f"[^A-Z{_RUN_LETTERS}]")
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words: Counter[str] = Counter()
                for runs in _runs_in(text.as_py() or "", pattern, gap):
                    words.update(runs)
                if garble:
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, h in [(w, h) for w in words if not (h := zlib.crc32(w.encode(), seed)) % garble]:
                        at, n = h % len(word), words.pop(word)
                        if len(word) > min_chars:
                            total[word[:at] + word[at + 1 :]] += n
                total.update(words)
                if len(total) > HELD:
                    yield out()
                    total.clear()
        yield out()

    return run


def word_counts(docs: DataFrame, min_chars: int = 5, min_count: int = 3, garble: int | None = None) -> DataFrame:
    """(word, n): words of at least ``min_chars`` code points that occur ``min_count`` times in all.

    With ``garble`` the run r of document d loses the code point ``h % length`` wherever ``h = crc32("d:r")`` is a
    multiple of it: known misspellings to be found again.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counter(min_chars, garble), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _parts(words: DataFrame) -> DataFrame:
    """(m, back, part, rest, word, n): the parts of the trie a word belongs to; ``rest`` is what follows the shared
    code points, from there outwards."""

    def place(m: str, back: int) -> str:
        h = f"int({m} / 2)"
        shared, rest = (f"right(word, {m} - {h})", f"reverse(left(word, size - {m} + {h}))") if back else (f"left(word, {h})", f"substring(word, {h} + 1)")
        return f"named_struct('m', {m}, 'back', {back}, 'part', {shared}, 'rest', {rest})"

    roles = F.expr(f"filter(array({', '.join(place(m, back) for m in ('size', '(size - 1)') for back in (0, 1))}), x -> x.m > 0)")
    return words.withColumn("size", F.length("word")).select("word", "n", F.explode(roles).alias("x")).select("x.*", "word", "n")


class _Trie:
    """Level by level, the nodes of sorted rows of code points: parent, character, first row and whether a row ends there."""

    def __init__(self, root: np.ndarray, chars: np.ndarray, sizes: np.ndarray):
        n, width = chars.shape
        new = np.ones(n, bool)
        new[1:] = root[1:] != root[:-1]
        node = np.cumsum(new) - 1
        self.first = [np.flatnonzero(new)]
        self.parent, self.char = [np.zeros(len(self.first[0]), np.int64)], [np.zeros(len(self.first[0]), np.int64)]
        self.keys = [self.parent[0]]
        self.ends = [sizes[self.first[0]] == 0]
        for level in range(width):
            new = new.copy()
            new[1:] |= chars[1:, level] != chars[:-1, level]
            inside = sizes > level
            at = np.flatnonzero(new & inside)
            self.first.append(at)
            self.parent.append(node[at])
            self.char.append(chars[at, level].astype(np.int64))
            self.keys.append(node[at] << 21 | self.char[-1])
            self.ends.append(sizes[at] == level + 1)
            node = np.cumsum(new & inside) - 1
        self.levels = width
        for level in range(width + 1):  # first child and number of children of each node
            below = self.parent[level + 1] if level < width else np.zeros(0, np.int64)
            low = np.searchsorted(below, np.arange(len(self.first[level])))
            high = np.searchsorted(below, np.arange(len(self.first[level])), "right")
            self.first[level] = (self.first[level], low, high - low)

    def same_child(self, x_level: int, x: np.ndarray, y_level: int, y: np.ndarray, other: np.ndarray | None = None):
        """(i, child of x[i], child of y[i]) of all pairs of children by the same character, but not by ``other[i]``."""
        _, low, count = self.first[x_level]
        i = np.repeat(np.arange(len(x)), count[x])
        child = _runs(low[x], count[x])
        char = self.char[x_level + 1][child]
        if other is not None:
            keep = char != other[i]
            i, child, char = i[keep], child[keep], char[keep]
        keys = self.keys[y_level + 1]
        asked = y[i] << 21 | char
        at = np.searchsorted(keys, asked)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == asked[hit]
        return i[hit], child[hit], at[hit]


def trie_pairs(root: np.ndarray, chars: np.ndarray, sizes: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs at distance one within each root: two rows of ``short`` code points, or a row (second) of them and one (first) of one more.

    Rows are sorted by root and code points; ``chars`` is zero behind a row's end.
    """
    trie = _Trie(root, chars, sizes)
    nothing = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    replaced = (nothing, nothing)  # nodes of this level
    inserted = (nothing, nothing)  # a node of the next level, a node of this level
    for level in range(trie.levels + 1):
        rows, low, count = trie.first[level]
        x, y = replaced
        both = trie.ends[level][x] & trie.ends[level][y]
        a, b = rows[x[both]], rows[y[both]]
        kept = short[a] == level
        found.append((a[kept], b[kept]))
        if level == trie.levels:
            break
        deeper = trie.first[level + 1][0]
        _, went_x, went_y = trie.same_child(level, x, level, y)
        child = np.arange(len(deeper))
        parent = trie.parent[level + 1]
        later = low[parent] + count[parent] - 1 - child  # siblings behind this one
        replaced = (np.concatenate([went_x, np.repeat(child, later)]), np.concatenate([went_y, _runs(child + 1, later)]))
        # inserted pairs of this level: those that came down, and every node above its own child
        x, y = np.concatenate([inserted[0], child]), np.concatenate([inserted[1], parent])
        fresh = np.concatenate([np.full(len(inserted[0]), -1), trie.char[level + 1]])  # the inserted one isn't the next one too
        both = trie.ends[level + 1][x] & trie.ends[level][y]
        a, b = deeper[x[both]], rows[y[both]]
        kept = short[b] == level
        found.append((a[kept], b[kept]))
        if level + 1 < trie.levels:
            _, x, y = trie.same_child(level + 1, x, level, y, fresh)
            inserted = (x, y)
    return tuple(np.concatenate(z) for z in zip(*found))


def _block_pairs(block: pa.Table) -> pa.RecordBatch:
    """Pairs of the whole parts of a block whose rows are sorted by (m, back, part, rest)."""
    m, back = block.column("m").to_numpy(), block.column("back").to_numpy()
    part = block.column("part").combine_chunks()
    changed = np.ones(len(m), bool)
    changed[1:] = (m[1:] != m[:-1]) | (back[1:] != back[:-1]) | ~pc.equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)
    rest = block.column("rest").to_pylist()
    sizes = np.fromiter(map(len, rest), np.int64, len(rest))
    chars = np.zeros((len(rest), int(sizes.max(initial=0))), np.uint32)
    chars[np.repeat(np.arange(len(rest)), sizes), _runs(np.zeros(len(rest), np.int64), sizes)] = np.frombuffer("".join(rest).encode("utf-32-le"), np.uint32)
    short = np.where(back == 1, m // 2, m - m // 2)
    a, b = trie_pairs(np.cumsum(changed), chars, sizes, short)
    if chars.shape[1]:  # met in the other trie too: the first m // 2 code points agree
        twice = (back[a] == 1) & (sizes[a] > sizes[b])
        twice[twice] = (chars[a[twice], 1:] == chars[b[twice], :-1]).all(axis=1)
        a, b = a[~twice], b[~twice]
    words, n = block.column("word").combine_chunks(), block.column("n").to_numpy()
    return pa.RecordBatch.from_arrays([words.take(pa.array(a)), pa.array(n[a]), words.take(pa.array(b)), pa.array(n[b])], ["a", "n_a", "b", "n_b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows into blocks of whole parts and joins each block's tries."""
    held: list[pa.RecordBatch] = []
    cells = 0

    def ready(last: bool) -> pa.Table | None:
        nonlocal held, cells
        table = pa.Table.from_batches(held)
        end = len(table)
        if not last:  # the last part may go on
            m, back, part = (table.column(c)[-1].as_py() for c in ("m", "back", "part"))
            same = pc.and_(pc.and_(pc.equal(table.column("m"), m), pc.equal(table.column("back"), back)), pc.equal(table.column("part"), part))
            end -= pc.sum(same).as_py()
        held, cells = table.slice(end).combine_chunks().to_batches(), 0
        return table.slice(0, end) if end else None

    for batch in batches:
        for low in range(0, len(batch), 1 << 14):
            held.append(batch.slice(low, 1 << 14))
            cells += held[-1].num_rows * (pc.max(held[-1].column("m")).as_py() + 1)
            if cells > CELLS and (block := ready(False)) is not None:
                yield _block_pairs(block)
    if held and (block := ready(True)) is not None:
        yield _block_pairs(block)


_PART = ["m", "back", "part"]


def _dealt_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of parts too large for one task: nodes at distance one meet by what is left without one code point."""
    short = "if(back = 1, int(m / 2), m - int(m / 2))"
    at = F.expr("explode(sequence(0, length(rest) - 1))").alias("at")
    without = F.expr("concat(left(rest, at), substring(rest, at + 2))").alias("left_over")
    less = rows.where(f"length(rest) = {short}")
    holes = less.where("length(rest) > 0").select("*", at).select(*_PART, "at", without, "word", "n")
    x, y = holes.alias("x"), holes.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*_PART, "at", "left_over")]
    replaced = x.join(y, [*same, F.col("x.word") < F.col("y.word")]).select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b"))
    more = rows.where(f"length(rest) = {short} + 1").select("*", at).where("substring(rest, at + 1, 1) <> substring(rest, at + 2, 1)")  # of equal neighbours the last
    more = more.select(*_PART, "at", without, "word", "n", "rest")
    z = less.select(*_PART, F.col("rest").alias("left_over"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    inserted = more.join(z, [*_PART, "left_over"]).where("back = 0 or substring(rest, 2) <> left_over").select(F.col("word").alias("a"), F.col("n").alias("n_a"), "b", "n_b")
    return replaced.union(inserted)


def near_pairs(words: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(a, n_a, b, n_b): each unordered pair of ``words(word, n)`` at distance one once; words must be distinct."""
    rows = _parts(words)
    large = written(rows.groupBy(*_PART).count().where(F.col("count") > largest).select(*_PART))
    dealt = not large.isEmpty()
    small = rows.join(large, _PART, "left_anti") if dealt else rows
    small = small.repartition(*_PART).sortWithinPartitions(*_PART, "rest")
    pairs = small.mapInArrow(_blocks, "a string, n_a long, b string, n_b long")
    return pairs.union(_dealt_pairs(rows.join(large, _PART, "left_semi"))) if dealt else pairs


def spelling_forms(words: DataFrame, ratio: int = 2, largest: int = LARGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``.

    A word's form is its near word of largest n if that is ``ratio`` times the word's n or more; its root is where following forms ends.
    Forms at least double, so no chain is longer than the binary length of the largest count.
    """
    pairs = near_pairs(words, largest)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    found = written(joined)
    at = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = on.select("word", "root")
        if on.where("moved").isEmpty():
            break
    return found.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, garble: int | None = None) -> DataFrame:
    """``spelling_forms`` of the words of all documents."""
    return spelling_forms(written(word_counts(docs, min_chars, min_count, garble)))
