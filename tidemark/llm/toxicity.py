"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word (a run of letters; every byte from 128 on is one) goes in as the embedding of the
word beside the mean embedding of its character trigrams, both learnt.  Two gated recurrent
networks read a window of ``WINDOW`` words forwards and backwards, attention weights
their states, and the pooled state gives the window's log-odds.  Windows start every ``STEP``
words, so each word is read with ``STEP`` words of context on one side at least; all
windows of the whole text are scored and a document has its worst window's score.

Training (numpy, on the driver) sees document labels only: in every epoch all windows of the
sample are scored, and each document teaches by its worst window and some others drawn
by chance.  The sample is bounded: ``fit_rows`` distinct labelled texts in the order of their hash,
of at most ``fit_chars`` characters each; of near copies among them one is taken, with the share of their toxic labels as target.
Scoring covers all documents, and a task holds one slice of texts and one block of windows at a time.

Edge cases: null and empty texts, and texts without letters, are one window without words; repeated rows and null
ids are scored each; a score equal to the threshold counts as toxic; labels that are null are not used, and without labels of both
kinds every score is the share of toxic ones (0.5 without any); an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import Words, mix64, shingle_sets, slices

WINDOW, STEP = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
CHAR_CELLS = 1 << 12
BLOCK = 2048
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLDED = np.arange(256, dtype=np.uint32)
_FOLDED[65:91] += 32


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of rows by place."""
    return np.stack([np.bincount(at, weights=x, minlength=n) for x in rows.T], 1).astype(np.float32)


class Read:
    """A slice of texts as words of its own table: ``word`` (places in the table), windows of them, and the table's hashes and trigram cells."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = Words(raw, offsets, _IS_LETTER)
        self.hash, at, self.word = np.unique(words.hash, return_index=True, return_inverse=True)
        size = words.end[at] - words.start[at]
        framed = np.zeros(int((size + 2).sum()), np.uint32)  # a zero at both ends of each word
        ends = np.cumsum(size + 2)
        framed[_runs(ends - size - 1, size)] = _FOLDED[raw[_runs(words.start[at], size)]]
        middle = _runs(ends - size - 1, size)
        code = framed[middle - 1] << 16 | framed[middle] << 8 | framed[middle + 1]
        self.cell = (mix64(code.astype(np.uint64) + np.uint64(77)) >> np.uint64(52)).astype(np.int64)
        self.cells = size
        n = words.counts
        windows = np.maximum(1, -(-(n - (WINDOW - STEP)) // STEP))
        self.doc = np.repeat(np.arange(len(n)), windows)
        within = _runs(np.zeros(len(n), np.int64), windows) * STEP
        self.first = words.bounds[:-1][self.doc] + within
        self.within = within
        self.size = np.minimum(WINDOW, n[self.doc] - within)
        self.windows, self.words = windows, n

    def chosen(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table (0 behind the end) and lengths of windows."""
        size = self.size[at]
        places = self.first[at][:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < size[:, None]
        if not len(self.word):
            return np.zeros(places.shape, np.int64), size
        return np.where(inside, self.word[np.minimum(places, len(self.word) - 1)], 0), size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights in ``w`` by name; ``known`` are the sorted hashes of words with an embedding of their own, place 0 is for all others."""

    def __init__(self, known: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        width, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.known = known
        shapes = {"word": (len(known) + 1, WORD_DIM), "char": (CHAR_CELLS, CHAR_DIM), "in": (width, 6 * h), "in0": (6 * h,), "fwd": (h, 3 * h), "bwd": (h, 3 * h), "att": (2 * h, h), "att1": (h,), "out": (2 * h,), "out0": (1,)}
        scale = {"word": 0.05, "char": 0.1, "in0": 0, "out0": 0}
        self.w = {k: (r.standard_normal(s) * scale.get(k, s[0] ** -0.5)).astype(np.float32) for k, s in shapes.items()}

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == hashes[hit]
        return np.where(hit, at + 1, 0)

    def inputs(self, read: Read) -> np.ndarray:
        """What the gates of both directions get from each word of the table."""
        return self._embedded(self.places(read.hash), read.cell, read.cells) @ self.w["in"] + self.w["in0"]

    def _embedded(self, place: np.ndarray, cell: np.ndarray, cells: np.ndarray) -> np.ndarray:
        if not len(place):
            return np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.w["char"][cell], np.cumsum(cells) - cells) / cells[:, None].astype(np.float32)
        return np.concatenate([self.w["word"][place], chars], 1)

    def _states(self, inputs: np.ndarray, index: np.ndarray, size: np.ndarray, backward: bool, keep: list | None) -> np.ndarray:
        h, u = HIDDEN, self.w["bwd" if backward else "fwd"]
        side = inputs[:, 3 * h :] if backward else inputs[:, : 3 * h]
        side = np.ascontiguousarray(side)
        state = np.zeros((len(index), h), np.float32)
        out = np.zeros((WINDOW, len(index), h), np.float32)
        full = bool((size == WINDOW).all())
        for t in range(WINDOW - 1, -1, -1) if backward else range(WINDOW):
            x, s = side[index[:, t]], state @ u
            gate = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            reset, stay = gate[:, :h], gate[:, h:]
            new = np.tanh(x[:, 2 * h :] + reset * s[:, 2 * h :])
            after = new + stay * (state - new)
            if not full:
                after *= (t < size)[:, None]
            if keep is not None:
                keep.append((t, state, reset, stay, new, s[:, 2 * h :]))
            state = out[t] = after
        return out

    def forward(self, inputs: np.ndarray, index: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log-odds of windows."""
        steps: tuple[list | None, list | None] = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._states(inputs, index, size, False, steps[0]), self._states(inputs, index, size, True, steps[1])], 2)
        seen = np.tanh(states @ self.w["att"])
        weight = np.exp(seen @ self.w["att1"]) * (np.arange(WINDOW)[:, None] < size)
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "seen": seen, "weight": weight, "pooled": pooled}
        return pooled @ self.w["out"] + self.w["out0"]

    def gradients(self, place: np.ndarray, cell: np.ndarray, cells: np.ndarray, index: np.ndarray, size: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean cross-entropy of windows, and its value; words come as embedding places and trigram cells."""
        h, w, keep = HIDDEN, self.w, {}
        embedded = self._embedded(place, cell, cells)
        inputs = embedded @ w["in"] + w["in0"]
        odds = self.forward(inputs, index, size, keep)
        p = _sigmoid(odds)
        loss = float(np.mean(np.logaddexp(0, odds) - target * odds))
        d = ((p - target) / len(p)).astype(np.float32)
        g = {"out": keep["pooled"].T @ d, "out0": np.array([d.sum()], np.float32)}
        pooled = np.outer(d, w["out"])
        weight, states, seen = keep["weight"], keep["states"], keep["seen"]
        by_step = np.einsum("bh,tbh->tb", pooled, states)
        score = weight * (by_step - (weight * by_step).sum(axis=0))
        back = (score[:, :, None] * w["att1"]) * (1 - seen * seen)
        g["att1"] = np.einsum("tb,tbh->h", score, seen)
        g["att"] = np.einsum("tbi,tbj->ij", states, back, optimize=True)
        to_states = weight[:, :, None] * pooled + back @ w["att"].T
        to_inputs = np.zeros((WINDOW, len(index), 6 * h), np.float32)
        for side, name in enumerate(("fwd", "bwd")):
            u, at = w[name], slice(side * 3 * h, (side + 1) * 3 * h)
            g[name], carry = np.zeros_like(u), np.zeros((len(index), h), np.float32)
            for t, before, reset, stay, new, recent in reversed(keep["steps"][side]):
                up = (carry + to_states[t][:, side * h : (side + 1) * h]) * (t < size)[:, None]
                new_in = up * (1 - stay) * (1 - new * new)
                stay_in = up * (before - new) * stay * (1 - stay)
                reset_in = new_in * recent * reset * (1 - reset)
                to_inputs[t][:, at] = np.concatenate([reset_in, stay_in, new_in], 1)
                to_s = np.concatenate([reset_in, stay_in, new_in * reset], 1)
                g[name] += before.T @ to_s
                carry = up * stay + to_s @ u.T
        flat = index.T.ravel()
        order = np.argsort(flat, kind="stable")
        seen_at, first = np.unique(flat[order], return_index=True)
        of_words = np.zeros((len(inputs), 6 * h), np.float32)
        of_words[seen_at] = np.add.reduceat(to_inputs.reshape(-1, 6 * h)[order], first)
        g["in"], g["in0"] = embedded.T @ of_words, of_words.sum(axis=0)
        to_embedded = of_words @ w["in"].T
        g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
        if len(place):
            g["word"] = _summed(place, to_embedded[:, :WORD_DIM], len(w["word"]))
            g["char"] = _summed(cell, np.repeat(to_embedded[:, WORD_DIM:] / cells[:, None].astype(np.float32), cells, axis=0), CHAR_CELLS)
        return g, loss

    def odds(self, read: Read) -> np.ndarray:
        """Log-odds of all windows, block after block."""
        inputs = self.inputs(read).astype(np.float32)
        return np.concatenate([self.forward(inputs, *read.chosen(np.arange(low, min(low + BLOCK, len(read.first))))) for low in range(0, len(read.first), BLOCK)])


class _Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float, decay: float):
        self.w, self.rate, self.decay, self.t = w, rate, decay, 0
        self.m = {k: np.zeros_like(x) for k, x in w.items()}
        self.v = {k: np.zeros_like(x) for k, x in w.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, x in self.w.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.01 * (g[k] * g[k] - self.v[k])
            x -= (self.rate * rate) * ((self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6) + self.decay * x)


def without_copies(texts: list[str], target: np.ndarray, bands: int = 3) -> tuple[list[str], np.ndarray]:
    """One text of each group of near copies, with the group's mean target: a text copied often would teach its own words.

    Texts are copies if they agree in two least hashes of their five-word shingles, in any of ``bands`` pairs of such.
    """
    keys = mix64(np.arange(1, 2 * bands + 1, dtype=np.uint64)) | np.uint64(1)
    group, of = list(range(len(texts))), {}

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, found in enumerate(shingle_sets(pa.array(texts, pa.large_string()), 5)):
        if len(found):
            least = [int(mix64(found * k).min()) for k in keys]
            for b in range(bands):
                other = of.setdefault((b, *least[2 * b : 2 * b + 2]), i)
                group[max(top(i), top(other))] = min(top(i), top(other))
    first, at = np.unique([top(i) for i in range(len(texts))], return_inverse=True)
    return [texts[i] for i in first], np.bincount(at, weights=target) / np.bincount(at)


def _association(toxic: np.ndarray, total: np.ndarray, all_toxic: float, n: int) -> np.ndarray:
    """How much more often toxic texts have a word than others do, in standard errors; the largest is 3."""
    p = total / n
    z = (toxic / all_toxic - (total - toxic) / (n - all_toxic)) / np.sqrt(p * (1 - p) * (1 / all_toxic + 1 / (n - all_toxic)) + 1e-9)
    return (3 * z / max(1.0, np.abs(z).max(initial=0))).astype(np.float32)


def train(texts: list[str], target: np.ndarray, epochs: int = 6, steps: int = 300, batch: int = 64, least: float = 0.01, doubt: float = 0.5, patience: int = 3, rate: float = 0.01, decay: float = 0.02, seed: int = 7) -> Network:
    """A network from texts and the share of toxic labels of each.

    Words have an embedding of their own if a share ``least`` of the texts has them (and four texts).  Its first
    number starts as how far toxic texts have the word more often.  After a third of the epochs (as many as
    give ``steps`` updates, ``epochs`` at least) a text labelled toxic whose worst window is still below ``doubt`` teaches nothing: its label
    is taken for an error, not learnt by heart.  A fifth of the texts, kept out, tells which epoch was the best.
    """
    r = np.random.default_rng(seed)
    ((_, raw, offsets),) = slices(pa.array(texts, pa.large_string()), 1 << 50)
    read = Read(raw, offsets)
    n, ends = len(texts), np.cumsum(read.windows)
    in_text = np.unique(read.word * n + np.repeat(np.arange(n), read.words))
    texts_with = np.bincount(in_text // n, minlength=len(read.hash))
    often = texts_with >= max(4, least * n)
    net = Network(read.hash[often], seed)
    net.w["word"][1:, 0] = _association(np.bincount(in_text // n, weights=target[in_text % n], minlength=len(read.hash))[often], texts_with[often], float(target.sum()), n)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    net.w["out0"][:] = np.log(share / (1 - share))
    adam, place_of, starts = _Adam(net.w, rate, decay), net.places(read.hash), np.cumsum(read.cells) - read.cells
    kept_out = np.arange(n) % 5 == 0
    best: tuple[tuple[float, float], int, dict] = ((np.inf, np.inf), 0, net.w)
    epochs = max(epochs, -(-steps * batch // (2 * n)))
    for epoch in range(epochs + 1):
        odds = net.odds(read)
        worst = np.lexsort((odds, read.doc))[ends - 1]
        wrong = (odds[worst] > 0) != (target > 0.5)
        lost = (float(wrong[kept_out].mean()), float((np.logaddexp(0, odds[worst]) - target * odds[worst])[kept_out].mean()))
        if lost < best[0]:
            best = (lost, epoch, {k: x.copy() for k, x in net.w.items()})
        if epoch == epochs or epoch >= best[1] + patience:
            break
        use = (target < 0.5) | (3 * epoch < epochs) | (_sigmoid(odds[worst]) >= doubt)
        drawn = ends - read.windows + (r.random(n) * read.windows).astype(np.int64)
        clean = ends - read.windows + (r.random(n) * read.windows).astype(np.int64)
        use &= ~kept_out
        at = r.permutation(np.unique(np.concatenate([worst[use], drawn[use] if epoch < 1 else worst[:0], clean[(target < 0.5) & ~kept_out]])))
        for low in range(0, len(at), batch):
            index, size = read.chosen(at[low : low + batch])
            used, local = np.unique(index, return_inverse=True)
            used = used[: len(read.word)]
            cell = read.cell[_runs(starts[used], read.cells[used])]
            g, _ = net.gradients(place_of[used], cell, read.cells[used], local.reshape(index.shape), size, target[read.doc[at[low : low + batch]]].astype(np.float32))
            adam.step(g, min(1.0, 2 - 2 * epoch / epochs))
    net.w = best[2]
    return net


class ToxicModel:
    """A trained network, or the share of toxic labels where there were none of one kind."""

    def __init__(self, net: Network | None, share: float):
        self.net, self.share = net, share

    def scores(self, texts: pa.Array) -> pa.StructArray:
        """(score, n_windows, worst_word) of each text: its worst window's probability, and the number of the word at which that starts."""
        score, count, worst = np.full(len(texts), self.share), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for low, raw, offsets in slices(texts):
            read = Read(raw, offsets)
            rows = np.arange(low, low + len(read.windows))
            count[rows] = read.windows
            if self.net is not None:
                odds = self.net.odds(read)
                last = np.lexsort((-read.within, odds, read.doc))[np.cumsum(read.windows) - 1]  # of equal windows the first
                score[rows], worst[rows] = _sigmoid(odds[last].astype(np.float64)), read.within[last]
        return pa.StructArray.from_arrays([pa.array(score), pa.array(count), pa.array(worst)], ["score", "n_windows", "worst_word"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 5000, fit_chars: int = 40_000) -> ToxicModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); equal texts count once, with the share of their labels.

    Labels meet digests of texts; only the texts of the sample move.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.length("text") <= fit_chars).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    known = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
    shares = keyed.select("doc_id", "key").join(known, "doc_id").groupBy("key").agg(F.avg("toxic").alias("share")).orderBy(F.xxhash64("key"), "key").limit(fit_rows)
    once = keyed.select("key", "text").join(F.broadcast(shares), "key").groupBy("key").agg(F.first("text").alias("text"), F.first("share").alias("share")).orderBy("key").select("text", "share").toArrow()
    share = once.column("share").to_numpy()
    if not len(share) or share.max() < 0.5 or share.min() >= 0.5:
        return ToxicModel(None, float(share.mean()) if len(share) else 0.5)
    return ToxicModel(train(*without_copies(once.column("text").to_pylist(), share)), float(share.mean()))


def toxicity(model: ToxicModel, spark) -> Callable[[Column], Column]:
    """A column function: struct of score, n_windows and worst_word of a text."""
    sent = spark.sparkContext.broadcast(model)

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            yield sent.value.scores(x)

    return F.arrow_udf(scored, "score double, n_windows long, worst_word long")


def toxicity_scores(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on), n_windows and worst_word of each row."""
    found = docs.select("doc_id", toxicity(model, docs.sparkSession)(F.col("text").cast("string")).alias("x"))
    return found.select("doc_id", "x.score", (F.col("x.score") >= threshold).cast("int").alias("predicted"), "x.n_windows", "x.worst_word")
