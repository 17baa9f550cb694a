"""Currentness by sums along lines of single inputs, and by the closure where ways part or run in circles."""

import random
from collections import Counter

import pytest

from tidemark.operators import provenance


def by_hand(recorded, current):
    inputs, gone, changed = {}, Counter(), Counter()
    for a, i, digest in recorded:
        if i is not None:
            inputs.setdefault(a, set()).add(i)
        gone[a] += current.get(i) is None
        changed[a] += current.get(i) is not None and current[i] != digest
    out = {}
    for a in inputs:
        depth, level = {}, {a}
        while level:
            level = {i for x in level for i in inputs.get(x, ())} - set(depth)
            depth |= dict.fromkeys(level, max(depth.values(), default=0) + 1)
        bad = [sum(c[x] for x in set(depth) | {a}) for c in (gone, changed)]
        out[a] = (len(depth), max(depth.values()), *bad, "cyclic" if a in depth else "stale" if sum(bad) else "fresh")
    return out


def of_spark(spark, recorded, current):
    rows = provenance.currentness(spark.createDataFrame(recorded, "artifact long, input long, digest string"), spark.createDataFrame(list(current.items()), "input long, digest string")).collect()
    assert len({r.artifact for r in rows}) == len(rows)
    return {r.artifact: (r.inputs, r.depth, r.gone, r.changed, r.state) for r in rows}


@pytest.mark.parametrize("shape", ["lines", "mixed"])
def test_currentness_against_plain_walks(spark, shape):
    rng = random.Random(5)
    recorded = [(i, i + 1, "d") for i in range(100, 137)] + [(500 + i, 501 + i, "d") for i in range(16)] + [(137, 138, "e"), (600, 110, "d"), (601, 110, "d")]
    if shape == "mixed":  # several inputs, cycles that lines lead into, records without an input, repeated records
        recorded += [(a, b, "d") for a, b in ((1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (7, 7), (8, 7), (20, 21), (20, 22), (22, 23), (24, 20), (25, 24), (26, 105), (26, 25), (27, 26), (30, 31), (30, 31))]
        recorded += [(31, None, "d"), (32, 33, "d"), (33, None, "d"), (40, None, "d"), (34, 35, "d"), (34, None, "d")]
        recorded += [(rng.randrange(1000, 1100), rng.randrange(1000, 1160), rng.choice("de")) for _ in range(90)]
    current = {i: rng.choice("dddddx") for i in {i for _, i, _ in recorded if i is not None} if rng.random() < 0.9}
    assert of_spark(spark, recorded, current) == by_hand(recorded, current)


def test_lines_are_not_written_pair_by_pair(spark, monkeypatch):
    kept, put = [], provenance._kept

    def counted(df, path):
        out = put(df, path)
        kept.append(out.count())
        return out

    monkeypatch.setattr(provenance, "_kept", counted)
    n = 200
    recorded = [(i, i + 1, "d") for i in range(n)]
    assert of_spark(spark, recorded, {i: "d" for i in range(1, n + 1)}) == {i: (n - i, n - i, 0, 0, "fresh") for i in range(n)}
    assert sum(kept) <= 10 * n  # their pairs are n * (n + 1) / 2
