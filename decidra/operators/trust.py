"""Observations of two scoring lanes, risk controls, and the policy that decides what to do."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions.scores import softmax
from decidra.operators.metrics import quantiles


def _top(values: Column) -> Column:
    """Index and value of the largest element, the first of equal ones, and the next largest."""
    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct((-v).alias("c"), i.alias("i"))))
    return ranked


def observe(df: DataFrame, semantic: str = "semantic", lexical: str = "bm25", tau: float = 0.05, compat: bool = True) -> DataFrame:
    """Adds the inference features of each row. With ``compat`` top1_share is the mass of the first candidate, else of the top one.

    Rows with a null or empty score array get null features.
    """
    sem, lex = F.col(semantic), F.col(lexical)
    s, l = _top(sem), _top(lex)  # noqa: E741
    n = F.size(sem)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = total(sem) / n
    sd = F.sqrt(total(F.transform(sem, lambda v: (v - mean) * (v - mean))) / n)
    share = softmax(sem, tau)
    entropy = -total(F.transform(F.filter(share, lambda p: p > 0), lambda p: p * F.ln(p))) / F.ln(F.greatest(n, F.lit(2)).cast("double"))
    s1, s2 = -F.get(s, F.lit(0))["c"], F.coalesce(-F.get(s, F.lit(1))["c"], -F.get(s, F.lit(0))["c"])
    l1, l2 = -F.get(l, F.lit(0))["c"], F.coalesce(-F.get(l, F.lit(1))["c"], -F.get(l, F.lit(0))["c"])
    agree = (F.get(s, F.lit(0))["i"] == F.get(l, F.lit(0))["i"]).cast("double")
    features = {
        "semantic_top1": s1, "semantic_top2": s2, "semantic_margin": s1 - s2, "semantic_top1_z": F.when((n > 1) & (sd > 1e-12), (s1 - mean) / sd).otherwise(0.0), "semantic_ood_dist": 1 - s1,
        "bm25_top1": l1, "bm25_top2": l2, "bm25_margin": l1 - l2, "lane_agree": agree, "lane_disagree_margin": F.when(agree < 0.5, s1 - s2).otherwise(s1), "candidate_count": n,
        "score_entropy": F.when(n > 1, entropy).otherwise(0.0), "top1_share": F.get(share, F.lit(0)) if compat else F.array_max(share),
    }
    usable = (F.size(sem) > 0) & (F.size(lex) > 0)
    return df.withColumns({k: F.when(usable, v) for k, v in features.items()})


@dataclass(frozen=True)
class Policy:
    act: float = 0.10
    escalate: float = 0.60
    disagreement: float = 0.15
    escalation_available: bool = True
    rerun_allowed: bool = True


def policy(risk: Column, missing: Column, ambiguous: Column, agree: Column, margin: Column, candidates: Column, p: Policy = Policy()) -> Column:
    """ACT, ASK_FOR_INFO, RERUN_CHEAP_LANE, ESCALATE or ABSTAIN; schema states go first, a null risk abstains."""
    rerun = F.lit(p.rerun_allowed) & (agree < 0.5) & (margin < p.disagreement) & (candidates > 1)
    return (
        F.when((missing > 0) | (ambiguous > 0), "ASK_FOR_INFO").when(risk <= p.act, "ACT").when(rerun, "RERUN_CHEAP_LANE").when((risk >= p.escalate) & F.lit(p.escalation_available), "ESCALATE").otherwise("ABSTAIN")
    )


def decile_rates(fit: DataFrame, score: str, error: str) -> tuple[list[float], list[float]]:
    """Edges of ten quantile bins of a score and the error rate in each (0 in empty ones); 21 numbers, whatever the rows."""
    edges = quantiles(fit, score, [i / 10 for i in range(11)])
    if edges is None:
        raise ValueError("nothing to fit on")
    rows = dict(fit.where(F.col(score).isNotNull()).groupBy(bin_of(F.col(score), edges).alias("b")).agg(F.avg(F.col(error).cast("double")).alias("r")).collect())
    return list(edges), [rows.get(i) or 0.0 for i in range(10)]


def bin_of(score: Column, edges: list[float]) -> Column:
    return sum((F.when(score >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))


def decile_risk(score: Column, edges: list[float], rates: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, rates)), bin_of(score, edges) + 1)


SIMPLE = ["semantic_top1", "semantic_margin", "semantic_top1_z", "semantic_ood_dist", "lane_agree", "score_entropy", "top1_share", "candidate_count"]


def controls(seen: DataFrame, error: str, fit: Column) -> DataFrame:
    """Adds the risks of six controls to the rows that are not in ``fit``: A top score, B margin, C both, D agreement, E distance, F logistic.

    Scales, bins and weights come from the ``fit`` rows alone, as a few sums of one aggregation each; A to E are the error
    rate of the decile of the score.
    """
    own, rest = seen.where(fit), seen.where(~F.coalesce(fit, F.lit(False)))
    m = own.agg(F.avg("semantic_top1"), F.stddev_pop("semantic_top1"), F.avg("semantic_margin"), F.stddev_pop("semantic_margin")).first()
    z = lambda c, k: (F.col(c) - (m[k] or 0.0)) / ((m[k + 1] or 0.0) + 1e-9)
    top, margin = z("semantic_top1", 0), z("semantic_margin", 2)
    scores = {
        "a_top1": -F.col("semantic_top1"), "b_margin": -F.col("semantic_margin"), "c_top1_margin": -(top + margin), "d_lane_agree": (1 - F.col("lane_agree")) - margin,
        "e_ood": F.col("semantic_ood_dist") - F.col("top1_share"),
    }
    for name, score in scores.items():
        edges, rates = decile_rates(own.withColumn("_s", score), "_s", error)
        rest = rest.withColumn(name, decile_risk(score, edges, rates))
    weights, bias, scale = fit_logistic(own, SIMPLE, error)
    return rest.withColumn("f_logistic", logistic_risk(SIMPLE, weights, bias, scale))


def fit_logistic(df: DataFrame, features: list[str], label: str, iterations: int = 800, rate: float = 0.5, l2: float = 1e-3, rows: int = 50_000) -> tuple[list[float], float, list[tuple[float, float]]]:
    """Weights, bias and (mean, deviation) of each feature, by gradient descent on standardised features.

    Fitted on at most ``rows`` rows, chosen by hash; means and deviations are of all rows.
    """
    moments = df.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in features for f in (F.avg, F.stddev_pop))).first()
    scale = [(moments[2 * i] or 0.0, moments[2 * i + 1] if (moments[2 * i + 1] or 0.0) >= 1e-9 else 1.0) for i in range(len(features))]
    pdf = df.select(*features, F.col(label).cast("double").alias("_y")).dropna().orderBy(F.xxhash64(*features)).limit(rows).toPandas()
    x = (pdf[features].to_numpy(float) - [m for m, _ in scale]) / [s for _, s in scale]
    y, w, b = pdf["_y"].to_numpy(), np.zeros(len(features)), 0.0
    for _ in range(iterations if len(y) else 0):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = w - rate * (error @ x / len(y) + l2 * w)
        b -= rate * error.mean()
    return w.tolist(), float(b), scale


def logistic_risk(features: list[str], weights: list[float], bias: float, scale: list[tuple[float, float]]) -> Column:
    z = sum((F.lit(w) * (F.col(c) - m) / s for c, w, (m, s) in zip(features, weights, scale)), F.lit(bias))
    return 1 / (1 + F.exp(-z))
