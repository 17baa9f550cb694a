"""Which signatures name a pair of sets: all pairs are named, and hardly one twice."""

import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.llm import ngram_join


def test_every_pair_is_named_and_few_twice(spark):
    rng = random.Random(11)
    sign = lambda: rng.randrange(-(2**63), 2**63)
    members = defaultdict(set)
    for base in range(0, 60, 6):  # groups that share forty signatures, of which some lack a member
        for _ in range(40):
            members[sign()] = {base + i for i in range(6) if rng.random() < 0.9}
    for _ in range(50):  # loose pairs, and twins under another name
        pair, s = set(rng.sample(range(60), 2)), sign()
        members[s] |= pair
        members[sign()] |= members[s]
    wanted = {p for m in members.values() for p in combinations(sorted(m), 2)}
    shared = sum(len(m) * (len(m) - 1) // 2 for m in members.values())

    posts = spark.createDataFrame([(s, n) for s, m in members.items() for n in m], "sig long, node long")
    sigs = posts.groupBy("sig").agg(F.count("*").alias("m"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(2)])
    kept = ngram_join.apart_by_members(sigs)
    assert kept.count() == len({frozenset(m) for m in members.values() if m})
    few = posts.join(kept, "sig").groupBy("node").agg(F.collect_list("sig").alias("s")).select("node", "s", F.slice(F.sort_array("s"), 1, ngram_join.FEW).alias("few"))
    x, y = (few.select("node", F.explode("s").alias("sig"), "few").alias(c) for c in "xy")
    named = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & ngram_join.first_met(F.col("x.sig"), F.col("x.few"), F.col("y.few"))).select("x.node", "y.node").collect()
    assert {tuple(r) for r in named} == wanted
    assert len(named) < 1.5 * len(wanted) < shared / 3


def test_large_groups_meet_in_few_rows(spark):
    """Forty signatures over nearly the same 1,200 sets, of which 500 are one component: every pair of components meets, and rows stay few."""
    rng = random.Random(5)
    members = {rng.randrange(-(2**63), 2**63): [n for n in range(1200) if rng.random() < 0.8] for _ in range(40)}
    members |= {s: [2000, 2001 + s] for s in range(20)} | {20: list(range(500))}  # pairs with one common set stay pairs; one component is no group
    label = lambda n: 0 if n < 500 else n
    placed = spark.createDataFrame([(n, label(n), s) for s, m in members.items() for n in m], "node long, label long, sig long")
    groups = ngram_join.grouped(placed).cache()
    assert groups.where("node >= 2000").count() == 40 and groups.where("sig = 20").count() == 0
    x, y = (side.alias(c) for side, c in zip(ngram_join.opposite(ngram_join.dealt(groups)), "xy"))
    before = sum(len(m) * -(-len(m) // ngram_join.CELL) for m in members.values())
    assert x.count() < before / 8 and y.count() < before / 8

    met = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q")) & (F.col("x.label") != F.col("y.label"))
    met &= (F.col("x.p") < F.col("x.q")) | (F.col("x.node") < F.col("y.node"))
    named = x.join(y, met).select("x.sig", F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    assert named.count() == named.distinct().count()
    lists = {n: set() for m in members.values() for n in m}
    for s, m in members.items():
        for n in m:
            lists[n].add(s)
    wanted = {(a, b) for a, b in combinations(sorted(lists), 2) if label(a) != label(b) and lists[a] & lists[b]}
    found = {(r.a, r.b) for r in named.select("a", "b").distinct().collect()}
    assert wanted <= found and all(b < 2000 or a == 2000 for a, b in found)
