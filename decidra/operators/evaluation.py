"""Evaluation of decision lanes as aggregations: losses, curves, agreement, certificates, exact tests.

Counts and sums are taken in one aggregation over all rows; what is computed on the driver works on these few numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions import scores as sc
from decidra.operators import metrics

#: The band within which two values count as tied.
BAND = 0.15
# Bins of winning margins.
MARGIN_BINS = (0.01, 0.05, 0.10)


def multiclass_losses(df: DataFrame, probabilities: str, label: str, eps: float = 1e-12) -> DataFrame:
    """Mean Brier score and negative log likelihood of probability arrays, each scaled to the sum 1.

    A row whose probabilities are negative, not finite or without mass, or whose label is none of them, is an error. Rows
    with a null array or label take no part.
    """
    p, y = F.col(probabilities), F.col(label)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))) | (total <= 0) | (F.size(p) == 0) | (y < 0) | (y >= F.size(p))
    share = F.transform(p, lambda x: x / total)
    brier = F.aggregate(F.transform(share, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    nll = -F.ln(F.greatest(F.get(share, y), F.lit(eps)))
    checked = lambda c: F.when(bad, F.raise_error(F.lit("invalid probabilities or label")).cast("double")).otherwise(c)
    return df.where(p.isNotNull() & y.isNotNull()).agg(F.avg(checked(brier)).alias("brier"), F.avg(checked(nll)).alias("nll"))


def prefix_curve(df: DataFrame, risk: str, failure: str) -> DataFrame:
    """(k, coverage, risk, threshold): for each distinct risk score, the rows up to it and the share of failures among them.

    Rows of one score are one step of the curve, so that it does not depend on their order.
    """
    rows = df.where(F.col(risk).isNotNull() & F.col(failure).isNotNull())
    each = rows.groupBy(F.col(risk).cast("double").alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(failure).cast("double")).alias("f"))
    total = rows.count()
    return metrics.running(each, "threshold", {"n": "k", "f": "failures"}).select("k", (F.col("k") / total).alias("coverage"), (F.col("failures") / F.col("k")).alias("risk"), "threshold")


def risk_at(curve: DataFrame, coverage: float) -> DataFrame:
    """The risk at the coverage nearest to the wanted one, the smaller one of two that are equally near."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage must be in (0, 1]")
    return curve.agg(F.min(F.struct(F.abs(F.col("coverage") - coverage).alias("d"), "coverage", "risk"))["risk"].alias("risk"))


def coverage_at(curve: DataFrame, most: float) -> DataFrame:
    """The largest coverage whose risk is within the bound, else 0."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("risk") <= most, F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def coverage_at_risk(df: DataFrame, risk: str, rates: tuple[float, ...] = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    """(rate, coverage): the largest share of rows, lowest risk first, whose mean risk stays within each rate.

    Among rows of one risk the prefix may end anywhere, as their mean risk is one value from the first to the last.
    """
    rows = df.where(F.col(risk).isNotNull()).select(F.col(risk).cast("double").alias("r"))
    each = rows.groupBy("r").agg(F.count("*").alias("n")).withColumn("w", F.col("r") * F.col("n"))
    curve = metrics.running(each, "r", {"n": "upto", "w": "sum"})
    before_n, before_w = F.col("upto") - F.col("n"), F.col("sum") - F.col("w")
    total = rows.count()
    out = []
    for f in rates:
        # of the rows of risk r beyond the rate, as many fit as their excess is covered by what is left so far
        room = F.when(F.col("r") <= f, F.when((before_w + F.col("r") * F.col("n")) <= f * F.col("upto"), F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.floor((f * before_n - before_w) / (F.col("r") - f) + 1e-9)))
        fits = F.when((F.col("sum") <= f * F.col("upto") + 1e-12), F.col("upto")).when(room >= 1, before_n + room)
        out.append(F.struct(F.lit(f).alias("rate"), F.round(F.coalesce(F.max(fits), F.lit(0)) / max(total, 1), 4).alias("coverage")))
    return curve.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.rate", "x.coverage")


def clipped_ece(df: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Calibration error of confidences that are first clipped to [0, 1]."""
    return metrics.ece(df.withColumn(confidence, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))), confidence, correct, bins)


def accuracy(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """(n, accuracy, within_one) of whole-number predictions; rows without a label take no part."""
    p, y = F.col(predicted), F.col(label)
    return df.where(y.isNotNull()).agg(F.count("*").alias("n"), F.avg((p == y).cast("double")).alias("accuracy"), F.avg((F.abs(p - y) <= 1).cast("double")).alias("within_one"))


def order_statistic(df: DataFrame, value: str, q: float) -> DataFrame:
    """The value at place min(n - 1, int(q n)) of the sorted rows, found through counts by value; null without rows."""
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = df.where(F.col(value).isNotNull()).count()
    place = min(total - 1, int(q * total))
    return metrics.running(rows, "v", {"n": "upto"}).agg(F.min(F.when(F.col("upto") > place, F.col("v"))).alias("value"))


def better_temperature(df: DataFrame, scores: str, label: str, fitted: float, default: float, bins: int = 15) -> tuple[float, dict[str, float]]:
    """The temperature of the smaller held-out calibration error, the default if they are equal, and both errors."""
    errors = {}
    for name, t in (("fitted", fitted), ("default", default)):
        p = sc.softmax(F.col(scores), t)
        rows = df.where(F.col(label).isNotNull()).select(F.array_max(p).alias("c"), (F.array_position(p, F.array_max(p)) - 1 == F.col(label)).cast("int").alias("y"))
        errors[name] = metrics.ece(rows, "c", "y", bins).first()[0]
    return (fitted if (errors["fitted"] or 0.0) < (errors["default"] or 0.0) else default), errors


def relation(a: Column, b: Column, band: float = BAND) -> Column:
    """1 if a is clearly greater than b, -1 if clearly smaller, 0 if they are tied within the band."""
    return F.when(a - b > band, 1).when(b - a > band, -1).otherwise(0)


def winner_agreement(df: DataFrame, decision: str, candidate: str, a: str, b: str) -> DataFrame:
    """(decisions, agreement): how often two scorings have the same best candidate; ties by the smallest candidate."""
    best = lambda s: F.min(F.struct((-F.col(s)).alias("c"), F.col(candidate).alias("i")))["i"]
    each = df.groupBy(decision).agg(best(a).alias("_a"), best(b).alias("_b"))
    return each.agg(F.count("*").alias("decisions"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))


def sign_accuracy(df: DataFrame, decision: str, candidate: str, a: str, b: str, block: int = 4096) -> DataFrame:
    """(pairs, accuracy): of the pairs of a decision that differ under ``a``, the share that ``b`` orders the same way.

    Pairs are the unit of this measure. They are joined by decision and block of candidates, so that a decision with very
    many candidates is spread over many tasks; every pair is counted once.
    """
    rows = df.select(decision, F.col(candidate).alias("i"), F.col(a).alias("a"), F.col(b).alias("b"), F.pmod(F.xxhash64(candidate), F.lit(block)).alias("s"))
    blocks = rows.select(decision, "s").distinct()
    left = rows.join(blocks.withColumnRenamed("s", "other"), decision)
    met = left.alias("x").join(rows.alias("y"), [F.col(f"x.{decision}") == F.col(f"y.{decision}"), F.col("x.other") == F.col("y.s"), F.col("x.i") < F.col("y.i")])
    pair = met.select(F.signum(F.col("x.a") - F.col("y.a")).alias("sa"), F.signum(F.col("x.b") - F.col("y.b")).alias("sb")).where("sa <> 0")
    return pair.agg(F.count("*").alias("pairs"), F.avg((F.col("sa") == F.col("sb")).cast("double")).alias("accuracy"))


def relation_crosstab(df: DataFrame, a: str, b: str, c: str, d: str, band: float = BAND) -> DataFrame:
    """(before, after, n): relations of (a, b) against those of (c, d); off-diagonal rows are crossings."""
    return df.groupBy(relation(F.col(a), F.col(b), band).alias("before"), relation(F.col(c), F.col(d), band).alias("after")).agg(F.count("*").alias("n"))


def trace_agreement(df: DataFrame, before: str, after: str, truth: str) -> DataFrame:
    """(n, agreement, fixes, regressions) of two traces (arrays of survivors by stage) against a true one, order aside."""
    same = lambda x, y: F.array_sort(F.col(x)) == F.array_sort(F.col(y))
    rows = df.select(same(before, after).alias("s"), same(before, truth).alias("b"), same(after, truth).alias("a"))
    rate = lambda c: F.avg(c.cast("double"))
    return rows.agg(F.count("*").alias("n"), rate(F.col("s")).alias("agreement"), rate(F.col("a") & ~F.col("b")).alias("fixes"), rate(F.col("b") & ~F.col("a")).alias("regressions"))


def calibration_radius(df: DataFrame, error: str, q: float = 0.999) -> DataFrame:
    """(radius): the q quantile of absolute errors, as an order statistic."""
    return order_statistic(df.withColumn(error, F.abs(F.col(error))), error, q).withColumnRenamed("value", "radius")


def certificates(df: DataFrame, decision: str, candidate: str, value: str, radius: float, band: float = BAND) -> DataFrame:
    """(decision, kept, dropped, open, certified): candidates that surely stay within the band of the best, surely do not, or may.

    A value may be off by half the radius either way: kept if gap + radius <= band, dropped if gap - radius > band. A
    decision is certified if no candidate is open.
    """
    best = df.groupBy(decision).agg(F.max(value).alias("_best"))
    gap = F.col("_best") - F.col(value)
    rows = df.join(best, decision)
    counts = rows.groupBy(decision).agg(F.count_if((gap + radius <= band) | (gap == 0)).alias("kept"), F.count_if((gap - radius > band) & (gap != 0)).alias("dropped"), F.count("*").alias("_n"))
    open_ = F.col("_n") - F.col("kept") - F.col("dropped")
    return counts.select(decision, "kept", "dropped", open_.alias("open"), (open_ == 0).alias("certified"))


def top_set_agreement(df: DataFrame, decision: str, candidate: str, a: str, b: str) -> DataFrame:
    """(decisions, agreement, chance): whether the best candidate of ``b`` is among the best ones of ``a``, and how often by chance."""
    best = df.groupBy(decision).agg(F.max(a).alias("_m"), F.min(F.struct((-F.col(b)).alias("c"), F.col(candidate).alias("i")))["i"].alias("_b"), F.count("*").alias("_k"))
    rows = df.join(best, decision).groupBy(decision).agg(
        F.max(((F.col(candidate) == F.col("_b")) & (F.col(a) == F.col("_m"))).cast("int")).alias("hit"), (F.count_if(F.col(a) == F.col("_m")) / F.max("_k")).alias("chance")
    )
    return rows.agg(F.count("*").alias("decisions"), F.avg("hit").alias("agreement"), F.avg("chance").alias("chance"))


def margin_bin(margin: Column) -> Column:
    """The number of a margin's bin, from 0."""
    return sum((F.when(margin >= b, 1).otherwise(0) for b in MARGIN_BINS), F.lit(0))


def agreement_by_margin(df: DataFrame, margin: str, agreed: str) -> DataFrame:
    """(bin, n, agreement) by bins of the winning margin."""
    return df.where(F.col(margin).isNotNull()).groupBy(margin_bin(F.col(margin)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(agreed).cast("double")).alias("agreement"))


def full_order_agreement(df: DataFrame, decision: str, candidate: str, a: str, b: str) -> DataFrame:
    """(decisions, agreement): how often two scorings put all candidates of a decision in one order; ties by candidate.

    Ranks are counted through sorted windows, which spill; no list of candidates is built.
    """
    from pyspark.sql import Window

    place = lambda s: F.row_number().over(Window.partitionBy(decision).orderBy(F.desc(s), candidate))
    each = df.withColumn("_a", place(a)).withColumn("_b", place(b)).groupBy(decision).agg(F.min((F.col("_a") == F.col("_b")).cast("int")).alias("same"))
    return each.agg(F.count("*").alias("decisions"), F.avg("same").alias("agreement"))


def divergence(teacher: Column, student: Column, eps: float = 1e-12) -> Column:
    """Kullback-Leibler divergence of two probability arrays."""
    terms = F.zip_with(teacher, student, lambda t, s: F.when(t > 0, t * (F.ln(t) - F.ln(F.greatest(s, F.lit(eps))))).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)


def bootstrap(df: DataFrame, decision: str, difference: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(mean, low, high): the mean difference over decisions and its 95 % interval, by Poisson weights hashed from the decision.

    Rows are multiplied by replicate within their task and combine there before the shuffle, so ``replicates`` rows a task move.
    """
    u = (F.pmod(F.xxhash64(decision, F.lit(seed), "_r"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cumulative = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cumulative), F.lit(0))
    rows = df.where(F.col(difference).isNotNull()).select(decision, F.col(difference).cast("double").alias("_d"))
    each = rows.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight).groupBy("_r").agg((F.sum(F.col("_w") * F.col("_d")) / F.sum("_w")).alias("m"))
    means = each.agg(F.array_sort(F.collect_list("m")).alias("m"))  # as many numbers as replicates
    return rows.agg(F.avg("_d").alias("mean")).crossJoin(means).select("mean", F.get("m", F.lit(int(0.025 * replicates))).alias("low"), F.get("m", F.lit(min(replicates - 1, int(0.975 * replicates)))).alias("high"))


def _tail(n: int, k: int, p: float) -> float:
    """The probability of at most k of n at rate p."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def upper_bound(failures: int, n: int, level: float = 0.95) -> float:
    """The one-sided Clopper-Pearson upper bound of a rate, by bisection on the binomial tail."""
    if not 0 <= failures <= n or n < 1:
        raise ValueError("failures must be between 0 and n, and n at least 1")
    if failures == n:
        return 1.0
    low, high = failures / n, 1.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _tail(n, failures, middle) > 1 - level else (low, middle)
    return high


def mcnemar(only_a: int, only_b: int) -> float:
    """The exact two-sided p value of discordant counts."""
    n = only_a + only_b
    return min(1.0, 2 * _tail(n, min(only_a, only_b), 0.5)) if n else 1.0


def paired_test(df: DataFrame, a: str, b: str) -> tuple[int, int, float]:
    """(only a right, only b right, exact McNemar p value) of two columns of outcomes; the counts come from one aggregation."""
    right = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    x, y = df.agg(F.count_if(right(a) & ~right(b)), F.count_if(right(b) & ~right(a))).first()
    return x, y, mcnemar(x, y)


def stability(df: DataFrame, decision: str, candidate: str, value: str, noise: float, replicates: int = 16, seed: int = 0) -> DataFrame:
    """(bin, decisions, stable): the share of decisions whose winner stays under hashed noise, by bins of the winning margin."""
    from decidra.operators.models import best_two

    own = best_two(df.select(decision, candidate, F.col(value).cast("double").alias("_v")), decision, candidate, "_v")
    noisy = df.select(decision, candidate, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r"), F.col(value).cast("double").alias("_v"))
    shift = noise * (2 * (F.pmod(F.xxhash64(decision, candidate, "_r", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))) - 1)
    win = noisy.groupBy(decision, "_r").agg(F.min(F.struct((-(F.col("_v") + shift)).alias("c"), F.col(candidate).alias("i")))["i"].alias("_w"))
    kept = own.join(win, decision).groupBy(decision, "margin").agg(F.min((F.col(candidate) == F.col("_w")).cast("int")).alias("same"))
    return kept.groupBy(margin_bin(F.col("margin")).alias("bin")).agg(F.count("*").alias("decisions"), F.avg("same").alias("stable"))


def integrability(pairs: DataFrame, decision: str, i: str, j: str, r: str) -> DataFrame:
    """(decision, share, residual_rms): how much of an antisymmetric comparison is a difference of potentials.

    ``pairs`` holds both directions of every pair of a decision. The potential is the mean over the others scaled to fit
    least squares on a complete matrix; the share is 1 - residual / total sum of squares.
    """
    n = pairs.select(decision, i).distinct().groupBy(decision).agg(F.count("*").alias("_n"))
    q = pairs.groupBy(decision, F.col(i).alias("_i")).agg(F.sum(r).alias("_s")).join(n, decision).select(decision, "_i", (F.col("_s") / F.col("_n")).alias("_q"))
    both = pairs.join(q.withColumnRenamed("_i", i), [decision, i]).join(q.select(decision, F.col("_i").alias(j), F.col("_q").alias("_p")), [decision, j])
    left = F.col(r) - (F.col("_q") - F.col("_p"))
    return both.groupBy(decision).agg((1 - F.sum(left * left) / F.sum(F.col(r) * F.col(r))).alias("share"), F.sqrt(F.avg(left * left)).alias("residual_rms"))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(edges, nodes, max_degree) of an undirected graph."""
    ends = edges.select(F.col(a).alias("v")).unionAll(edges.select(F.col(b).alias("v"))).groupBy("v").agg(F.count("*").alias("d"))
    return ends.agg((F.sum("d") / 2).cast("long").alias("edges"), F.count("*").alias("nodes"), F.max("d").alias("max_degree"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(v, component): connected components by the least vertex, with pointer jumping; lineage is cut each round."""
    from decidra.session import cut_lineage

    both = cut_lineage(edges.select(F.col(a).alias("v"), F.col(b).alias("w")).unionAll(edges.select(F.col(b).alias("v"), F.col(a).alias("w"))).distinct())
    state = both.select("v").distinct().withColumn("component", F.col("v"))
    for _ in range(rounds):
        near = both.join(state.select(F.col("v").alias("w"), "component"), "w").groupBy("v").agg(F.min("component").alias("c"))
        new = state.join(near, "v").select("v", F.least("component", "c").alias("component"))
        jump = new.select(F.col("v").alias("component"), F.col("component").alias("root"))
        new = cut_lineage(new.join(jump, "component", "left").select("v", F.coalesce("root", "component").alias("component")))
        if new.join(state.withColumnRenamed("component", "old"), "v").where("component <> old").isEmpty():
            return new
        state = new
    raise ValueError(f"no fixed point after {rounds} rounds")
