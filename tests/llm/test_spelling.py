"""Spelling variants against all pairs of words by brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling
from tidemark.llm.spelling import near_pairs, spelling_forms, spelling_variants, word_counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_pairs(words):
    return Counter(tuple(sorted(p)) for p in itertools.combinations(sorted(set(words)), 2) if near(*p))


def plain_forms(counts):
    links = {w: [] for w in counts}
    for a, b in plain_pairs(counts):
        links[a].append(b)
        links[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(links[w]), counts[form[w]] if form[w] else None))
    return rows


def plain_counts(docs, min_chars, min_count, garble):
    total = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if garble and h % garble == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= min_chars:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= min_count}


def vocabulary(seed, n, alphabet, sizes):
    r = random.Random(seed)
    return sorted({"".join(r.choice(alphabet) for _ in range(r.choice(sizes))) for _ in range(n)})


@pytest.mark.parametrize("largest", [1, 12, 100_000])
@pytest.mark.parametrize(("alphabet", "sizes"), [("ab", range(1, 9)), ("aeé", (5, 6, 7)), ("abcdefgh", (5, 6))])
def test_pairs(spark, alphabet, sizes, largest):
    words = vocabulary(len(alphabet), 220, alphabet, sizes)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = near_pairs(df, largest).collect()
    assert all(words[r.n_a] == r.a and words[r.n_b] == r.b for r in got)
    assert Counter(tuple(sorted((r.a, r.b))) for r in got) == plain_pairs(words)


def test_blocks(spark, monkeypatch):
    """Parts that come in several batches stay whole."""
    import pyarrow as pa

    words = vocabulary(9, 400, "abc", (5, 6, 7)) + ["x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    rows = spelling._parts(df).orderBy("m", "back", "part", "rest").toArrow()
    monkeypatch.setattr(spelling, "CELLS", 64)
    out = list(spelling._blocks(iter(rows.combine_chunks().to_batches(max_chunksize=7))))
    got = Counter(tuple(sorted((r["a"], r["b"]))) for b in out for r in b.to_pylist())
    assert got == plain_pairs(words) and len(out) > 20
    assert list(spelling._blocks(iter([]))) == [] and isinstance(out[0], pa.RecordBatch)


def test_forms_and_chains(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 33, "lonely": 9, "tiexxx": 3, "tieyxx": 6, "tiezxx": 6, "halfxy": 5, "halfxz": 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling_forms(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_forms(counts)
    assert next(r for r in got if r[0] == "aaaaa")[2] == "bbbbb"
    assert next(r for r in got if r[0] == "tiexxx")[1] == "tieyxx"


@pytest.mark.parametrize("garble", [None, 3, 97])
def test_documents(spark, monkeypatch, garble):
    monkeypatch.setattr(spelling, "PART", 50)
    r = random.Random(2)
    stock = vocabulary(4, 60, "abcdeÉé", (4, 5, 6, 7))
    texts = [" ".join(r.choice(stock) for _ in range(40)) for _ in range(30)]
    texts += [None, "", "  \n", texts[0], texts[0], "Straße straße STRASSE Straße × ×××××÷÷ ×××××÷÷ ×××××÷÷", "ÀÉàé1ABCDE_abcde-AbCdE日本", "abcdé" * 2000, "x" * 9000]
    docs = [(i if i not in (3, 30) else None, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, 1, "w", "f") for i, t in docs], "doc_id long, text string, n int, word string, form string").repartition(4)
    counts = plain_counts(docs, 5, 3, garble)
    assert {tuple(x) for x in word_counts(table, 5, 3, garble).collect()} == set(counts.items())
    got = spelling_variants(table, 5, 3, garble)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(x) for x in got.collect()} == plain_forms(counts)
    assert spelling_variants(table.where("false"), 5, 3, garble).count() == 0
