"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Each byte of a text gets a label: none, a token of A ends here, a token of B does, or both
do.  A regular expression scans the labels for spans up to each both-label; the labels in
a span say how many tokens of A and of B form the group.  The two tokens that end at a
both-label are a link, and links are counted over the corpus.

A text is cut into pieces before a single space that follows a Latin letter, digit or
mark.  There both tokenizers start a new token whatever comes next (``Tokenizers`` checks
that no piece of B holds a space behind another character, and that A splits words the
same way), so a piece is tokenised and labelled once and looked up when it comes
again.  What a worker remembers is bounded by ``REMEMBERED`` pieces, and a long text goes
through in parts.

The two tokens of a link end in the same bytes, so one is a suffix of the other.  The pairs of ids
of which that holds are listed from the vocabularies alone, at most as many as the vocabularies have
bytes; a link is its place in that list, and corpus counts are one number per place.  They
are the only table that is broadcast, of the same size at any corpus size.

Edge cases: null and empty texts, and texts whose bytes a tokenizer doesn't give back, have no tokens
(zeros, empty strings, no links); repeated rows and rows without an id count as rows of their own;
ties for a token's best partner all count as best; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

REMEMBERED = 300_000
PART = 1 << 19
SPACE = "▁"
_SOLID = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)]))
_CUT = re.compile("(?<=[!-~À-ÿ]) ")
_SPAN = re.compile(rb"([ab]*)x")
#: Fixed value: how byte-level BPE splits a text into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Byte values that the byte-level alphabet shows as themselves.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level entries: shown bytes as themselves, the others from U+0100 on in order."""
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    return {chr(b): b for b in _SHOWN} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Byte-level tokenizer A and piece tokenizer B, held by the bytes of their files so that tasks need no path."""

    def __init__(self, a_json: bytes, b_model: bytes):
        self.a_json, self.b_model = a_json, b_model

    def __getstate__(self):
        return {"a_json": self.a_json, "b_model": self.b_model}

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Tokenizers:
        """Files of a local path on the driver, a few MB."""
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    @cached_property
    def a(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        made = Tokenizer.from_str(self.a_json.decode())
        made.encode_special_tokens = True
        return made

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        letters = _byte_alphabet()
        out = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        return out

    @cached_property
    def b_bytes(self) -> list[bytes]:
        out = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else piece.replace(SPACE, " ").encode())
        return out

    @cached_property
    def in_pieces(self) -> bool:
        """Whether texts may be cut: A splits words as byte-level BPE does, and no piece of B holds a space behind another character."""
        made = json.loads(self.a_json)
        split = made.get("pre_tokenizer") or {}
        by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
        return bool(by_word) and not any(b" " in x.lstrip(b" ") for x in self.b_bytes)

    @cached_property
    def pairs(self) -> np.ndarray:
        """Sorted codes ``a << 32 | b`` of all ids of which one's bytes are a suffix of the other's: at most a code for each byte of the
        vocabularies and for each pair of ids with the same bytes."""
        ids_of: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = ({}, {})
        for of, tokens in zip(ids_of, (self.a_bytes, self.b_bytes)):
            for i, x in enumerate(tokens):
                if x:
                    of.setdefault(x, []).append(i)
        found = set()
        for x, ids in ids_of[0].items():
            for k in range(len(x)):
                found.update(a << 32 | b for b in ids_of[1].get(x[k:], ()) for a in ids)
        for x, ids in ids_of[1].items():
            for k in range(1, len(x)):
                found.update(a << 32 | b for a in ids_of[0].get(x[k:], ()) for b in ids)
        return np.array(sorted(found), np.int64)

    @cached_property
    def words_of_a(self):
        """A's words by the same ranks, as a merge rank of byte-level BPE is its id; it has no special tokens."""
        import tiktoken

        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in self.a.get_added_tokens_decoder()}
        return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.in_pieces:
            encode = self.words_of_a.encode_ordinary
            return [encode(" " + x) for x in texts]
        return [e.ids for e in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


def _of(items: list) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64, len(items))


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of all runs, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


class Known:
    """Alignments of pieces, by slot: ``counts`` (A, B, groups, links, bad), ``text`` of the groups and link places."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.a_len, self.b_len = _of(tokenizers.a_bytes), _of(tokenizers.b_bytes)
        self.a_text, self.b_text = (np.array([[f"{i}{c}" for i in range(len(x))] for c in tails], object) for x, tails in ((tokenizers.a_bytes, ",|"), (tokenizers.b_bytes, ",;")))
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((1 << 12, 4), np.int64)
        self.start, self.loose, self.places = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool), np.zeros(1 << 14, np.int32)
        self.n_places = 0

    def learn(self, new: list[str]) -> None:
        """Label the bytes of all new pieces in one string and scan it."""
        t, raw = self.t, [(" " + x).encode() for x in new]
        a, b = t.encode_a(new), t.encode_b(new)
        length, n_a, n_b = _of(raw), _of(a), _of(b)
        flat_a = np.fromiter(chain.from_iterable(a), np.int64, n_a.sum())
        flat_b = np.fromiter(chain.from_iterable(b), np.int64, n_b.sum())
        ends_a, ends_b = np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b])
        joined = b"".join(raw)
        good = np.ones(len(new), bool)
        if b"".join(map(t.a_bytes.__getitem__, flat_a.tolist())) != joined or b"".join(map(t.b_bytes.__getitem__, flat_b.tolist())) != joined:
            for i, x in enumerate(raw):
                good[i] = b"".join(t.a_bytes[j] for j in a[i]) == x and b"".join(t.b_bytes[j] for j in b[i]) == x
            keep = np.flatnonzero(good)
            length = np.where(good, length, 0)
            flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
            ends_a, ends_b = np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b])
            assert len(keep) or not len(flat_a)
        label = np.full(length.sum(), ord("n"), np.uint8)
        label[ends_a - 1] = ord("a")
        at_b = label[ends_b - 1]
        label[ends_b - 1] = np.where(at_b == ord("a"), ord("x"), ord("b"))
        both = np.flatnonzero(label == ord("x"))
        owner = np.searchsorted(np.cumsum(length), both, "right")
        n_groups = np.bincount(owner, minlength=len(new)).astype(np.int64)
        spans = _SPAN.findall(label.tobytes().replace(b"n", b""))
        in_a = np.fromiter([x.count(b"a") for x in spans], np.int64, len(spans)) + 1
        in_b = _of(spans) - in_a + 2
        last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        shown = np.empty(len(flat_a) + len(flat_b), object)
        tail_a, tail_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        tail_a[last_a] = tail_b[last_b] = 1
        shown[_runs(np.cumsum(in_a + in_b) - in_a - in_b, in_a)] = self.a_text[tail_a, flat_a]
        shown[_runs(np.cumsum(in_a + in_b) - in_b, in_b)] = self.b_text[tail_b, flat_b]
        shown = shown.tolist()
        codes = flat_a[last_a] << 32 | flat_b[last_b]
        places = np.searchsorted(t.pairs, codes)
        assert (t.pairs[places] == codes).all()
        first, had, ends = len(self.text), np.cumsum(n_groups), np.cumsum(n_a + n_b)
        self.slot.update(zip(new, range(first, first + len(new))))
        self.text += ["".join(shown[low:high])[:-1] for low, high in zip((ends - n_a - n_b).tolist(), ends.tolist())]
        last, end = len(self.text), self.n_places + len(places)
        self.counts, self.start, self.loose, self.places = _room(self.counts, last), _room(self.start, last), _room(self.loose, last), _room(self.places, end)
        self.counts[first:last] = np.stack([n_a, n_b, n_groups, ~good], 1)
        self.loose[first:last] = [x[-1:] not in _SOLID for x in new]
        self.start[first:last] = self.n_places + had - n_groups
        self.places[self.n_places : end] = places
        self.n_places = end

    def slots(self, pieces: list[str]) -> list[int]:
        """Slots of the pieces, which are learnt if new; beyond ``REMEMBERED`` pieces all earlier ones are forgotten."""
        found = list(map(self.slot.get, pieces))
        if None in found:
            new = {x for x, i in zip(pieces, found) if i is None}
            if len(self.slot) + len(new) > REMEMBERED:
                self.forget()
                new = set(pieces)
            self.learn(list(new))
            found = list(map(self.slot.get, pieces))
        return found


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy at the front of an array of at least twice its length."""
    if len(x) >= n:
        return x
    wider = np.zeros((max(n, 2 * len(x)), *x.shape[1:]), x.dtype)
    wider[: len(x)] = x
    return wider


def joined(pieces: list[str]) -> list[str]:
    """Pieces between single spaces, those that may not be cut put together again; each stands behind a space that it doesn't show."""
    out, parts = [], []
    for x in pieces:
        parts.append(x)
        if x[-1:] in _SOLID:
            out.append(" ".join(parts))
            parts = []
    if parts == [""] and out:  # one space at the end: B has no piece for an empty text
        out[-1] += " "
    elif parts:
        out.append(" ".join(parts))
    return out


def parts_of(text: str) -> Iterator[str]:
    """The text cut into parts of about ``PART`` characters, at spaces where pieces may be cut."""
    low = 0
    while len(text) - low > 2 * PART and (cut := _CUT.search(text, low + PART)):
        if cut.end() == len(text):
            break
        yield text[low : cut.start()]
        low = cut.end()
    yield text[low:]


_known: dict[bytes, Known] = {}


def _aligned(tokenizers: Tokenizers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.get(tokenizers.a_json + tokenizers.b_model)
        if known is None:  # a worker serves many tasks
            _known.clear()
            known = _known[tokenizers.a_json + tokenizers.b_model] = Known(tokenizers)
        whole = not tokenizers.in_pieces

        def out(ids: list, parts: list[tuple[int, str]]) -> pa.RecordBatch:
            """Rows of the documents ``ids`` from (place in ids, part of its text), in order."""
            pieces = [[x] if whole else x.split(" ") for _, x in parts]
            found = known.slots(list(chain.from_iterable(pieces)))
            n = _of(pieces)
            loose = np.bincount(np.repeat(np.arange(len(parts)), n), weights=known.loose[found], minlength=len(parts))
            if loose.any() and not whole:
                pieces = [joined(x) if y else x for x, y in zip(pieces, loose)]
                found = known.slots(list(chain.from_iterable(pieces)))
                n = _of(pieces)
            slot = np.array(found, np.int64)
            row = np.repeat(np.array([i for i, _ in parts], np.int64), n)
            counts = known.counts[slot]
            bad = np.bincount(row, weights=counts[:, 3], minlength=len(ids)) > 0
            counts[bad[row]] = 0
            totals = [np.bincount(row, weights=counts[:, k], minlength=len(ids)).astype(np.int64) for k in range(3)]
            text, get, low = [[] for _ in ids], known.text.__getitem__, 0
            for (i, _), k in zip(parts, n.tolist()):
                text[i].append(";".join(map(get, found[low : low + k])))
                low += k
            text = ["" if bad[i] else ";".join(x) for i, x in enumerate(text)]
            links = known.places[_runs(known.start[slot], counts[:, 2])]
            ends = np.concatenate([[0], np.cumsum(totals[2])])
            columns = [pa.array(ids, pa.int64()), *map(pa.array, totals), pa.array(text, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(links))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

        ids, parts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                parts += [(len(ids), x) for x in ([text] if whole else parts_of(text)) if x]
                ids.append(doc_id.as_py())
                size += len(text)
                if size > PART:
                    yield out(ids, parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield out(ids, parts)

    return run


def align(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) of each row: ``groups`` as ``a1,a2|b1;a3|b2,b3`` in decimal ids, ``links`` as places in
    ``tokenizers.pairs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_aligned(tokenizers), "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and the n + 1 offsets of a list column."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def link_counts(aligned: DataFrame, n_places: int) -> np.ndarray:
    """How often each place of the pair list is linked: summed in the task, then over tasks; the result is as long as the list."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_places, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=n_places)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["place", "n"])

    sums = aligned.select("links").mapInArrow(counted, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_places, np.int64)
    counts[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
    return counts


def link_scores(aligned: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """``aligned`` without its links, with n_links, n_best (links whose count is the highest of their B id) and count_sum."""
    pairs = tokenizers.pairs
    counts = link_counts(aligned, len(pairs))
    of_b = pairs & 0xFFFFFFFF
    highest = np.zeros(len(tokenizers.b_bytes), np.int64)
    np.maximum.at(highest, of_b, counts)
    sent = aligned.sparkSession.sparkContext.broadcast((counts, counts == highest[of_b]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            links, ends = _flat(batch.column("links"))
            sums = [np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)]) for x in (best, counts)]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ends)), *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], [*names, "n_links", "n_best", "count_sum"])

    names = [c for c in aligned.columns if c != "links"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")
    return aligned.mapInArrow(scored, f"{kinds}, n_links long, n_best long, count_sum long")


def alignment_digests(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """One row per document: its counts, and the SHA-256 of its groups."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    once = written(align(docs, tokenizers).select("doc_id", "n_a", "n_b", "n_groups", digest, "links"))
    return link_scores(once, tokenizers).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
