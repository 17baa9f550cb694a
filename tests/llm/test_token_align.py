"""Token alignment against whole-text tokenisation and a walk over every byte."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_align as ta
from tidemark.llm.token_align import Tokenizers, align, alignment_digests

FILES = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", "a ", " a", "a  b", "a\n b", "tab\t x  ", "don't  stop", "x<|endoftext|>y", "<s> </s>", "nul\x00l", "naïve café", "日本語 テキスト", "🙂🙂 🙂", "a▁b", "ok but ▁", "nb sp x　y", "é" * 50, "  x", "ﬁ Ａ １", "--- ***  !!", "\r\n\r\n x", "1 234 567.89"]


@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizers.read(*FILES)


@lru_cache
def whole_a():
    made = Tokenizer.from_file(FILES[0])
    made.encode_special_tokens = True
    return made


def plain_groups(t, text):
    """(n_a, n_b, groups, links) by whole-text encodings and sets of end offsets."""
    if not text:
        return 0, 0, "", []
    a, b = whole_a().encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
        return 0, 0, "", []

    def ends(ids, of):
        at, out = 0, []
        for i in ids:
            at += len(of[i])
            out.append(at)
        return out

    ends_a, ends_b = ends(a, t.a_bytes), ends(b, t.b_bytes)
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return len(a), len(b), ";".join(groups), links


def aligned_here(t, texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [r for out in ta._aligned(t)([batch]) for r in out.to_pylist()]


def same(t, texts):
    for text, row in zip(texts, aligned_here(t, texts)):
        n_a, n_b, groups, links = plain_groups(t, text)
        assert (row["n_a"], row["n_b"], row["groups"], row["n_groups"]) == (n_a, n_b, groups, len(links)), repr(text)
        assert [(int(c) >> 32, int(c) & 0xFFFFFFFF) for c in t.pairs[row["links"]]] == links


def test_odd_texts(tokenizers):
    assert tokenizers.in_pieces
    same(tokenizers, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'▁.aé 　s"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_random_texts(texts):
    same(test_random_texts.t, texts)


test_random_texts.t = Tokenizers.read(*FILES)


def test_parts_and_forgetting(tokenizers, monkeypatch):
    r = random.Random(5)
    long = " ".join(r.choice(["naïve", "the", "x\n", "", "ünter", "don't", "日本"]) + str(r.randrange(900)) * r.randrange(2) for _ in range(3000))
    monkeypatch.setattr(ta, "PART", 700)
    monkeypatch.setattr(ta, "REMEMBERED", 150)
    same(tokenizers, [long, *ODD, long[5:9000], "x" * 3000, " " * 2000])


def test_table(spark, tokenizers):
    texts = [*ODD, "the cat sat", "the cat sat", "a cat in a hat ate a rat"]
    rows = [(i if i != 3 else None, x, "en", 7, "g") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_links int, groups string").repartition(3)
    plain = [plain_groups(tokenizers, x) for x in texts]
    count = Counter(x for p in plain for x in p[3])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    want = Counter()
    for (i, *_), (n_a, n_b, groups, links) in zip(rows, plain):
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want[i, n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest] += 1
    got = alignment_digests(docs, tokenizers)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert alignment_digests(docs.where("false"), tokenizers).count() == 0
    assert align(docs, tokenizers).where("n_a = 0").count() == sum(not p[2] for p in plain)


def test_pairs_are_bounded(tokenizers):
    held = sum(map(len, tokenizers.a_bytes)) + sum(map(len, tokenizers.b_bytes))
    assert len(tokenizers.pairs) <= held
