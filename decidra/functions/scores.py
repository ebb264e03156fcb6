"""Scalar functions of scores: sigmoid, softmax, temperatures, decay, reliability bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default temperatures by kind and number of options.
TEMPERATURES = {"choice:2": 0.05, "choice:3-5": 0.04239, "choice:6-10": 0.06211, "choice:11+": 0.05, "choice_nli": 3.03617, "noul": 1.0, "score": 0.05}


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    """Of an array; null and empty arrays stay as they are."""
    t = F.greatest(F.lit(temperature) if isinstance(temperature, (int, float)) else temperature, F.lit(1e-6))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, y: a + y)
    shifted = lambda s: bound(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp((x - m) / t)))
    return bound(scores, lambda s: bound(shifted(s), lambda e: bound(total(e), lambda n: F.transform(e, lambda x: x / n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def temperature_key(kind: Column, options: Column) -> Column:
    size = F.when(options <= 2, "2").when(options <= 5, "3-5").when(options <= 10, "6-10").otherwise("11+")
    return F.when(kind == "choice", F.concat(F.lit("choice:"), size)).otherwise(kind)


def temperature(kind: Column, options: Column, table: dict[str, float] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in sorted({**TEMPERATURES, **(table or {})}.items()) for x in (k, v)])
    return F.coalesce(known[temperature_key(kind, options)], F.lit(1.0))


def decayed(reliability: Column, age: Column, half_life: float) -> Column:
    return reliability * F.pow(F.lit(0.5), age / half_life)


def lower_bound(estimate: Column, n: Column) -> Column:
    return estimate - 1.28 * F.sqrt(estimate * (1 - estimate) / (n + 1))


def signature(values: Column, buckets: int = 16) -> Column:
    clipped = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.array_join(F.transform(values, lambda v: F.least(F.lit(buckets - 1), F.floor(buckets * clipped(v)).cast("int")).cast("string")), ",")


def readable(name: Column) -> Column:
    return F.trim(F.translate(name, "_-", "  "))


def norm(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), F.lit("[^a-z0-9]+"), F.lit("_")), F.lit("_"))
