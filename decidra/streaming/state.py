"""Online state: last-seen facts, decayed experiences, running reliability; in batch and as streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


#: Clock ranges in which a key's events are ordered apart, so that a hot key is many tasks.
RANGES = 64


def fact_age(events: DataFrame, key: str, clock: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``age``: clock ticks since the key was last seen before, null for the first time.

    Events are ordered within ranges of the clock; the first of a range looks up the last of the ranges before, which are
    at most ``ranges`` rows per key.
    """
    low, high = events.agg(F.min(clock), F.max(clock)).first()
    if low is None:
        return events.withColumn("age", F.lit(None).cast(events.schema[clock].dataType))
    width = (high - low) // ranges + 1
    rows = events.withColumn("_b", F.floor((F.col(clock) - F.lit(low)) / width))
    own = Window.partitionBy(key, "_b").orderBy(clock)
    last = rows.groupBy(key, "_b").agg(F.max(clock).alias("_last"))
    before = last.select(key, "_b", F.max("_last").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    joined = rows.withColumn("_lag", F.lag(clock).over(own)).join(before.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & (rows["_b"] == before["_b"]))
    return joined.select(*(rows[c] for c in events.columns), (F.col(clock) - F.coalesce("_lag", "_before")).alias("age"))


def seen_within(events: DataFrame, key: str, clock: str, ticks: int) -> DataFrame:
    return fact_age(events, key, clock).withColumn("seen_within", F.coalesce(F.col("age") <= ticks, F.lit(False)))


def reliability(events: DataFrame, key: str, order: str, success: str, start: float = 0.8, keep: float = 0.9, ranges: int = RANGES) -> DataFrame:
    """(key, n, estimate): the exponential average of successes per key, folded in order; events without a success or order take no part.

    A run of events is a pair: how many they are, and the sum of their terms as if it were the last run. Pairs compose, so
    events are folded within ranges of the order first, by ranks from each range's end, and the ranges, at most ``ranges``
    per key, after that. A hot key is many tasks, and no term is left out.
    """
    rows = events.where(F.col(success).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(success).cast("double").alias("_y"))
    low, high = rows.agg(F.min("_o"), F.max("_o")).first()
    width = ((high - low) // ranges + 1) if low is not None else 1
    placed = rows.withColumn("_b", F.floor((F.col("_o") - F.lit(low or 0)) / width))
    back = F.row_number().over(Window.partitionBy("_k", "_b").orderBy(F.desc("_o"))) - 1
    folded = placed.withColumn("_t", (1 - keep) * F.pow(F.lit(keep), back) * F.col("_y")).groupBy("_k", "_b").agg(F.count("*").alias("n"), F.sum("_t").alias("s"))
    behind = F.coalesce(F.sum("n").over(Window.partitionBy("_k").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = folded.withColumn("s", F.col("s") * F.pow(F.lit(keep), behind)).groupBy("_k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return whole.select(F.col("_k").alias(key), "n", (F.lit(start) * F.pow(F.lit(keep), F.col("n")) + F.col("s")).alias("estimate"))


def retrieve(experiences: DataFrame, lookups: DataFrame, signature: str, age: str, half_life: float, least: float = 0.1) -> DataFrame:
    """Experiences of a signature with their decayed weight, those below ``least`` left out."""
    from decidra.functions.scores import decayed

    hit = lookups.join(experiences, signature)
    return hit.withColumn("weight", decayed(F.col("reliability"), F.col(age), half_life)).where(F.col("weight") >= least)


def stream_last_seen(events: DataFrame, key: str, clock: str) -> DataFrame:
    """Streaming ``fact_age``: one state value per key, the last clock. ``clock`` is a sequence number of the input."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in batches:
            ticks = sorted(pdf[clock])
            ages = []
            for t in ticks:
                ages.append(None if last is None else t - last)
                last = t
            yield pd.DataFrame({key: k[0], clock: ticks, "age": pd.array(ages, dtype="Int64")})
        state.update((int(last),))

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{clock}` long, age long", "last long", "append", "NoTimeout")


def stream_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Watermarked tumbling counts per kind; events later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def _stateful(events: DataFrame, key: str, step, out: str, state: str) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {out}", state, "append", "NoTimeout")


def stream_reliability(events: DataFrame, key: str, order: str, success: str, start: float = 0.8, keep: float = 0.9) -> DataFrame:
    """Streaming ``reliability``: (key, n, estimate) after each micro-batch; the state of a key is two numbers."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        estimate, n = state.get if state.exists else (start, 0)
        for y in pd.concat(list(batches)).dropna(subset=[success]).sort_values(order)[success].astype(float):
            estimate, n = keep * estimate + (1 - keep) * y, n + 1
        state.update((float(estimate), int(n)))
        yield pd.DataFrame({key: [k[0]], "n": [n], "estimate": [estimate]})

    return _stateful(events, key, step, "n long, estimate double", "estimate double, n long")


def stream_triggers(events: DataFrame, signature: str, clock: str, value: str, half_life: float, least: float = 0.1) -> DataFrame:
    """Streaming trigger bank: (signature, clock, n, best) of the experiences that an event finds under its signature.

    Experiences are the numbers of earlier events of the signature, with a weight that halves every ``half_life`` ticks;
    ``best`` is the value of the one of the highest weighted value. Those whose weight has fallen below ``least`` are
    forgotten, so the state of a signature holds the events of a bounded time.
    """
    reach = half_life * math.log2(1 / least)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ticks, values = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for now, v in pd.concat(list(batches)).sort_values(clock)[[clock, value]].itertuples(index=False):
            keep = [i for i, t in enumerate(ticks) if now - t <= reach]
            ticks, values = [ticks[i] for i in keep], [values[i] for i in keep]
            weighted = [x * 0.5 ** ((now - t) / half_life) for t, x in zip(ticks, values)]
            out.append((k[0], int(now), len(values), values[max(range(len(values)), key=weighted.__getitem__)] if values else None))
            ticks.append(int(now))
            values.append(float(v))
        state.update((ticks, values))
        yield pd.DataFrame(out, columns=[signature, clock, "n", "best"])

    return _stateful(events, signature, step, f"`{clock}` long, n int, best double", "ticks array<long>, x array<double>")


def stream_answers(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts request -> answers: each micro-batch goes through ``answer``, the plan that batches take, and on to ``write``."""
    return requests.writeStream.foreachBatch(lambda batch, n: write(answer(batch), n)).option("checkpointLocation", checkpoint)


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """The frame with counters that are taken while it is computed, and where to read them."""
    at = Observation(name)
    return df.observe(at, *(c.alias(k) for k, c in counts.items())), at
