"""Column helpers: windows that are null until full, latches, domain-safe arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SESSIONS_PER_YEAR = 252
RISK_FREE_ANNUAL = 0.04


def trailing(spec: WindowSpec, n: int) -> WindowSpec:
    """The n rows that end at the current one."""
    return spec.rowsBetween(1 - n, 0)


def full(aggregate: Column, counted: Column, spec: WindowSpec, n: int) -> Column:
    """An aggregate over the last n rows, null unless all n have a value."""
    last = trailing(spec, n)
    return F.when(F.count(counted).over(last) == n, aggregate.over(last))


def is_true(condition: Column) -> Column:
    """Null comparisons are False, as where a missing value must not act."""
    return F.coalesce(condition, F.lit(False))


def log_ratio(now: Column, before: Column) -> Column:
    """ln(now / before), null unless both are positive."""
    return F.when((now > 0) & (before > 0), F.log(now / before))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def latch(set_: Column, reset: Column, spec: WindowSpec) -> Column:
    """True since the last row where set_ held, unless reset held later; reset wins on one row."""
    state = F.when(is_true(reset), F.lit(False)).when(is_true(set_), F.lit(True))
    return F.coalesce(F.last(state, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))


def ewm_std(x: Column, position: Column, spec: WindowSpec, span: int) -> Column:
    """Bias-corrected exponentially weighted deviation with a minimum of ``span`` values.

    Weights decay with the row position, over missing values too.  ``position``
    counts from 0 inside the window's partition; the scaled sums hold up to about
    10,000 rows for a span of 60, and a longer history is an error.
    """
    decay = -math.log1p(-2 / (span + 1))
    most = int(340 / decay)
    w = F.when(position > most, F.raise_error(F.lit(f"an exponential window of span {span} holds {most} rows at most")).cast("double")).when(x.isNotNull(), F.exp(position * F.lit(decay)))
    past = spec.rowsBetween(Window.unboundedPreceding, 0)
    s0, s2 = F.sum(w).over(past), F.sum(w * w).over(past)
    m = F.sum(w * x).over(past) / s0
    q = F.sum(w * x * x).over(past) / s0
    return F.when(F.count(x).over(past) >= span, F.sqrt(F.greatest(q - m * m, F.lit(0.0)) * s0 * s0 / (s0 * s0 - s2)))


def edge_squared(bars: Column) -> Column:
    """Signed squared spread of the EDGE estimator over an array of log bars (o, h, l, c), oldest first.

    The first bar only gives the previous values; null where the estimate is
    undefined.
    """
    n = F.size(bars) - 1
    at = lambda i, f: F.get(bars, i)[f]

    def term(i: Column) -> Column:
        o, h, low = at(i, "o"), at(i, "h"), at(i, "l")
        h1, l1, c1 = at(i - 1, "h"), at(i - 1, "l"), at(i - 1, "c")
        mid, mid1 = (h + low) / 2, (h1 + l1) / 2
        moved = ((h != low) | (low != c1)).cast("double")
        return F.struct(
            moved.alias("tau"),
            (mid - o).alias("r1"),
            (o - mid1).alias("r2"),
            (mid - c1).alias("r3"),
            (c1 - mid1).alias("r4"),
            (o - c1).alias("r5"),
            (moved * ((o != h).cast("double") + (o != low).cast("double"))).alias("po"),
            (moved * ((c1 != h1).cast("double") + (c1 != l1).cast("double"))).alias("pc"),
        )

    terms = F.transform(F.sequence(F.lit(1), n), term)
    mean = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, t: a + f(t)) / n
    facts = F.struct(
        terms.alias("t"),
        *[mean(terms, lambda t, k=k: t[k]).alias(k) for k in ("tau", "po", "pc", "r1", "r3", "r5")],
    )

    def solve(s: Column) -> Column:
        pull = lambda t, r: t[r] - s[r] / s["tau"] * t["tau"]
        xs = F.transform(
            s["t"],
            lambda t: F.struct(
                (-4.0 / s["po"] * pull(t, "r1") * t["r2"] - 4.0 / s["pc"] * pull(t, "r3") * t["r4"]).alias("a"),
                (-4.0 / s["po"] * pull(t, "r1") * t["r5"] - 4.0 / s["pc"] * pull(t, "r5") * t["r4"]).alias("b"),
            ),
        )
        sums = F.struct(*[mean(xs, f).alias(k) for k, f in (("e1", lambda t: t["a"]), ("e2", lambda t: t["b"]), ("q1", lambda t: t["a"] * t["a"]), ("q2", lambda t: t["b"] * t["b"]))])

        def weigh(m: Column) -> Column:
            v1, v2 = m["q1"] - m["e1"] * m["e1"], m["q2"] - m["e2"] * m["e2"]
            return F.when(v1 + v2 > 0, (v2 * m["e1"] + v1 * m["e2"]) / (v1 + v2)).otherwise((m["e1"] + m["e2"]) / 2)

        return F.get(F.transform(F.array(sums), weigh), F.lit(0))

    defined = F.filter(F.array(facts), lambda s: (s["tau"] * n >= 2) & (s["po"] != 0) & (s["pc"] != 0))
    return F.get(F.transform(defined, solve), F.lit(0))


def edge_terms(spec: WindowSpec) -> dict[str, Column]:
    """The row terms of the EDGE estimator, from the columns open, high, low, close and the bar before."""
    logs = {k: F.log(k) for k in ("open", "high", "low", "close")}
    o, h, low = logs["open"], logs["high"], logs["low"]
    h1, l1, c1 = (F.lag(logs[k]).over(spec) for k in ("high", "low", "close"))
    mid, mid1 = (h + low) / 2, (h1 + l1) / 2
    tau = ((h != low) | (low != c1)).cast("double")
    touches = lambda x, a, b: tau * ((x != a).cast("double") + (x != b).cast("double"))
    return {"tau": tau, "r1": mid - o, "r2": o - mid1, "r3": mid - c1, "r4": c1 - mid1, "r5": o - c1, "po": touches(o, h, low), "pc": touches(c1, h1, l1)}


def with_edge(bars: DataFrame, spec: WindowSpec, n: int, name: str = "edge") -> DataFrame:
    """bars (open, high, low, close) with ``edge_squared`` of the last n returns, in moving averages only: each of the two
    estimates is a fixed mixture of four row products, so its mean and mean square are averages of these products and of
    their products.  The steps are columns of their own, so that nothing is worked out twice."""
    last = trailing(spec, n)
    terms = {f"_{k}": x for k, x in edge_terms(spec).items()}
    mixtures = {"1": ("r1 r2", "tau r2", "r3 r4", "tau r4"), "2": ("r1 r5", "tau r5", "r5 r4", "tau r4")}
    products = {f"_p{m}{i}": F.col(f"_{x.split()[0]}") * F.col(f"_{x.split()[1]}") for m, xs in mixtures.items() for i, x in enumerate(xs)}
    pairs = [(m, i, j) for m in mixtures for i in range(4) for j in range(i, 4)]
    products |= {f"_q{m}{i}{j}": F.col(f"_p{m}{i}") * F.col(f"_p{m}{j}") for m, i, j in pairs}
    averaged = ["_tau", "_po", "_pc", "_r1", "_r3", "_r5", *products]
    out = bars.withColumns(terms).withColumns({k: x for k, x in products.items() if k[1] == "p"}).withColumns({k: x for k, x in products.items() if k[1] == "q"})
    out = out.withColumns({f"_m{k}": F.avg(k).over(last) for k in averaged} | {"_seen": F.count("_r3").over(last)})
    m = lambda k: F.col(f"_m_{k}")
    shares = {f"_s{k}{i}": x for k, r in (("1", "r3"), ("2", "r5")) for i, x in enumerate((-4 / m("po"), 4 / m("po") * m("r1") / m("tau"), -4 / m("pc"), 4 / m("pc") * m(r) / m("tau")))}
    fine = (F.col("_seen") == n) & (m("tau") * n >= 2) & (m("po") != 0) & (m("pc") != 0)
    out = out.withColumns({k: F.when(fine, x) for k, x in shares.items()})
    share = lambda k, i: F.col(f"_s{k}{i}")
    out = out.withColumns({f"_e{k}": sum((share(k, i) * m(f"p{k}{i}") for i in range(1, 4)), share(k, 0) * m(f"p{k}0")) for k in mixtures})
    squares = {k: sum(((1 if i == j else 2) * share(k, i) * share(k, j) * m(f"q{k}{i}{j}") for x, i, j in pairs if x == k), F.lit(0.0)) for k in mixtures}
    out = out.withColumns({f"_v{k}": squares[k] - F.col(f"_e{k}") * F.col(f"_e{k}") for k in mixtures})
    e1, e2, v1, v2 = (F.col(k) for k in ("_e1", "_e2", "_v1", "_v2"))
    return out.withColumn(name, F.when(v1 + v2 > 0, (v2 * e1 + v1 * e2) / (v1 + v2)).otherwise((e1 + e2) / 2))
