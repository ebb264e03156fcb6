"""Contracts of learned models, and the stand-ins that need no weights.

An embedder maps a text column to a vector column, an entailment model maps premise and hypothesis to a margin (above 0:
entailed); both may be native expressions or Arrow UDFs. Texts are embedded once per distinct text, joined back on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions.scores import bound
from decidra.session import cut_lineage, unique_name

Embedder = Callable[[Column], Column]
Entailment = Callable[[Column, Column], Column]
# Size of the stand-in's vectors, words it passes over, and its margin.
DIMENSIONS, MARGIN = 64, 3.0
STOP_WORDS = "the a an is are this that it of to and or in on for example".split()
# Bounds of the support states.
EVIDENCE_FLOOR, SUPPORT = 0.30, 0.5


def content_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def normalized(vector: Column) -> Column:
    """To length 1; all zeros stay."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return bound(vector, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))))


def hashed_words(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The embedder stand-in: a hashed bag of content words of length 1."""
    places = F.transform(content_words(text), lambda w: (F.crc32(w.cast("binary")) % dimensions).cast("int"))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(own, lambda p: p == i)).cast("double"))
    return bound(places, lambda own: normalized(counts(own)))


def shared_word(premise: Column, said: Column) -> Column:
    """The entailment stand-in: whether a content word of the hypothesis stands in the premise."""
    words = F.regexp_extract_all(F.lower(premise), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.arrays_overlap(content_words(said), words), MARGIN).otherwise(-MARGIN)


def embedded(df: DataFrame, text: str, embedder: Embedder = hashed_words, out_col: str = "vector") -> DataFrame:
    """Adds the vector of each text; every distinct text is embedded once. Null texts get a null vector."""
    key, held = unique_name(df, "_text"), unique_name(df, "_vector")
    once = df.select(F.col(f"`{text}`").alias(key)).where(F.col(key).isNotNull()).distinct()
    vectors = cut_lineage(once.withColumn(held, embedder(F.col(key))))
    return df.join(vectors, F.col(f"`{text}`") == F.col(key), "left").drop(key).withColumn(out_col, F.col(held)).drop(held)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors of an array whose mask is not 0, of length 1; null if the mask is all 0."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])
    doubles = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda k: F.aggregate(F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), doubles(k[0]), lambda s, v: F.zip_with(s, doubles(v), lambda a, b: a + b))
    return bound(kept, lambda k: F.when(F.size(k) > 0, normalized(F.transform(total(k), lambda x: x / F.size(k)))))


def predicate_margin(holds: Column, fails: Column) -> Column:
    """Half the lead of the margin for a proposition over that for its opposite; its sign decides."""
    return 0.5 * (holds - fails)


def template_median(margins: Column) -> Column:
    """The median of the margins of several wordings."""
    ordered = F.array_sort(margins)
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def support_state(evidence: Column, support: Column) -> Column:
    return (
        F.when(evidence < EVIDENCE_FLOOR, "UNKNOWN").when(support >= SUPPORT, "SUPPORTED").when(support <= -SUPPORT, "CONTRADICTED").otherwise("AMBIGUOUS")
    )


def match(states: DataFrame, candidates: DataFrame, state_id: str, state: str, candidate_id: str, candidate: str, embedder: Embedder = hashed_words, scope: str | None = None) -> DataFrame:
    """(state_id, candidate_id, score, margin): the candidate of the highest cosine for each state, and its lead.

    Ties go to the smallest candidate id; with one candidate the margin is infinite. With ``scope``, a column of both
    inputs, states are compared with the candidates of their scope only. Vectors are flattened to (dimension, value)
    rows, so that the products are sums which combine before they are shuffled, and no list of candidates is collected.
    """
    keys = [scope] if scope else []
    left = embedded(states.select(*keys, F.col(state_id).alias("_s"), F.col(state).alias("_st")), "_st", embedder, "_sv")
    right = embedded(candidates.select(*keys, F.col(candidate_id).alias("_c"), F.col(candidate).alias("_ct")), "_ct", embedder, "_cv")
    flat = lambda df, i, v: df.select(*keys, i, F.posexplode(v).alias("_d", f"{v}x")).where(F.col(f"{v}x") != 0)
    met = flat(left, "_s", "_sv").join(flat(right, "_c", "_cv"), [*keys, "_d"]).groupBy(*keys, "_s", "_c").agg(F.sum(F.col("_svx") * F.col("_cvx")).alias("score"))
    return best_two(cut_lineage(met), "_s", "_c", "score").select(F.col("_s").alias(state_id), F.col("_c").alias(candidate_id), "score", "margin")


def best_two(scored: DataFrame, query: str, candidate: str, score: str) -> DataFrame:
    """(query, candidate, score, margin): the best candidate of each query and its lead over the next, by two aggregations."""
    first = scored.groupBy(query).agg(F.max(score).alias("_m"), F.count("*").alias("_n"))
    top = scored.join(first, query).where(F.col(score) == F.col("_m")).groupBy(query).agg(F.min(candidate).alias(candidate), F.count("*").alias("_ties"), F.max(score).alias(score), F.max("_n").alias("_n"))
    second = scored.join(first.select(query, F.col("_m").alias("_top")), query).where(F.col(score) < F.col("_top")).groupBy(query).agg(F.max(score).alias("_second"))
    margin = F.when(F.col("_ties") > 1, 0.0).when(F.col("_n") == 1, float("inf")).otherwise(F.col(score) - F.col("_second"))
    return top.join(second, query, "left").select(query, candidate, score, margin.alias("margin"))


def perceptron(hidden: list[list[float]], hidden_bias: list[float], out: list[float], bias: float):
    """A success head of one hidden layer with exact GELU, and a sigmoid: an Arrow UDF from features to a probability."""
    from math import erf

    w, b, o = np.array(hidden), np.array(hidden_bias), np.array(out)
    phi = np.vectorize(lambda x: 0.5 * (1 + erf(x / 2**0.5)), otypes=[float])

    @F.pandas_udf("double")  # type: ignore[call-overload]
    def run(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_list()) @ w.T + b
        return pd.Series(1 / (1 + np.exp(-((x * phi(x)) @ o + bias))))

    return run


def success_choice(df: DataFrame, query: str, candidate: str, probability: str, floor: float = 0.7) -> DataFrame:
    """(query, candidate, probability, escalate): the likeliest success; to be escalated below the floor or without a candidate."""
    best = df.where(F.col(candidate).isNotNull() & F.col(probability).isNotNull()).groupBy(query).agg(F.max(F.struct(F.col(probability).alias("p"), F.col(candidate).alias("c"))).alias("_b"))
    every = df.select(query).distinct()
    return every.join(best, query, "left").select(query, F.col("_b.c").alias(candidate), F.col("_b.p").alias(probability), F.coalesce(F.col("_b.p") < floor, F.lit(True)).alias("escalate"))
