"""Calibration, ranking and selective-risk metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ece(df: DataFrame, confidence: str, correct: str, bins: int = 15, right_closed: bool = False) -> DataFrame:
    """Expected calibration error. Bins are closed on the left (the last on both sides) or, as an option, on the right."""
    c, y = F.col(confidence), F.col(correct).cast("double")
    at = F.greatest(F.lit(0), F.ceil(c * bins) - 1) if right_closed else F.least(F.lit(bins - 1), F.floor(c * bins))
    each = df.where(c.isNotNull() & y.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("c"), F.avg(y).alias("y"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("y"))) / F.sum("n")).alias("ece"))


def binary_losses(df: DataFrame, p: str, label: str, eps: float = 1e-12) -> DataFrame:
    """Brier score and negative log likelihood."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return df.agg(F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("nll"))


def _counts_by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def running(df: DataFrame, key: str, sums: dict[str, str], ascending: bool = True, parts: int = 64) -> DataFrame:
    """Running sums over a total order, without one task for all rows: ranges by quantiles, sums within, offsets between."""
    from pyspark.sql import functions as F  # noqa: F811

    order = F.col(key).asc() if ascending else F.col(key).desc()
    cuts = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 1000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col(key) > F.lit(c)).cast("int")
    placed = df.withColumn("_b", bucket if ascending else -bucket)
    totals = placed.groupBy("_b").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))  # at most `parts` rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", *(F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums))
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "_b")
    return out.select("*", *((F.col(f"_o_{s}") + F.sum(s).over(within)).alias(name) for s, name in sums.items())).drop("_b", *(f"_o_{s}" for s in sums))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float] | None:
    """Quantiles with linear interpolation, through counts by value in ranges: no task holds all values. None without rows."""
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = df.where(F.col(value).isNotNull()).count()
    if not total:
        return None
    places = [q * (total - 1) for q in shares]
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    found = running(rows, "v", {"n": "upto"}).agg(*(at(k).alias(f"q{i}_{j}") for i, p in enumerate(places) for j, k in enumerate((int(p), min(total - 1, int(p) + 1))))).first()
    return [found[2 * i] + (p - int(p)) * (found[2 * i + 1] - found[2 * i]) for i, p in enumerate(places)]


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null with one class only. Rows are grouped by score first."""
    each = running(_counts_by_score(df, score, label), "s", {"n": "upto"})
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    total = each.agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    return total.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auroc"))


def auprc(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Average precision; ties are in the order of the id."""
    ranked = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("long").alias("y"), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")).alias("k"), (-F.col(score)).alias("s"), F.lit(1).cast("long").alias("one"))
    part = ranked.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    offset = running(part, "s", {"n": "upto", "pos": "hits"}).select("s", (F.col("upto") - F.col("n")).alias("n0"), (F.col("hits") - F.col("pos")).alias("h0"))
    w = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = ranked.withColumn("i", F.sum("one").over(w)).withColumn("h", F.sum("y").over(w)).join(offset, "s")
    return each.agg((F.sum(F.when(F.col("y") == 1, (F.col("h") + F.col("h0")) / (F.col("i") + F.col("n0")))) / F.sum("y")).alias("auprc"))


def risk_coverage(df: DataFrame, risk: str, tie: str, grid: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90, 1.0)) -> DataFrame:
    """(coverage, risk): the mean of the lowest-risk share of the rows."""
    rows = df.where(F.col(risk).isNotNull()).select(F.col(risk).cast("double").alias("r"), F.lit(1).cast("long").alias("one"))
    by = rows.groupBy("r").agg(F.count("*").alias("n")).withColumn("w", F.col("r") * F.col("n"))
    curve = running(by, "r", {"n": "upto", "w": "sum"})
    total = rows.count()
    wanted = [max(1, round(c * total)) for c in grid]
    out = []
    for c, k in zip(grid, wanted):
        at = F.min(F.when(F.col("upto") >= k, F.struct("upto", "sum", "r")))
        out.append(F.struct(F.lit(c).alias("coverage"), ((at["sum"] - (at["upto"] - k) * at["r"]) / k).alias("risk")))
    return curve.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.coverage", F.round("x.risk", 4).alias("risk"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, query: str, doc: str, gain: str, k: int = 10) -> DataFrame:
    """nDCG, recall and MRR at k per query; ``ranked`` has (query, doc, rank from 0), ``relevant`` (query, doc, gain)."""
    found = ranked.where(F.col("rank") < k).join(relevant, [query, doc])
    dcg = found.groupBy(query).agg(F.sum(F.col(gain) / F.log2(F.col("rank") + 2)).alias("dcg"), F.count_if(F.col(gain) > 0).alias("hits"), F.min(F.when(F.col(gain) > 0, F.col("rank"))).alias("first"))
    best = relevant.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(gain), doc)))
    ideal = best.groupBy(query).agg(F.sum(F.when(F.col("_r") <= k, F.col(gain) / F.log2(F.col("_r") + 1))).alias("ideal"), F.count_if(F.col(gain) > 0).alias("relevant"))
    return ideal.join(dcg, query, "left").select(query, F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"), F.when(F.col("relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("relevant")).otherwise(0.0).alias("recall"), F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"))


def temperature_grid(df: DataFrame, scores: str, label: str, lo: float = 0.003, hi: float = 5.0, n: int = 160, refine: int = 8) -> float:
    """The temperature of the least mean negative log likelihood: one aggregation over a grid per round, each finer.

    Raises if no row has scores and a label within them.
    """
    import math

    from decidra.functions.scores import softmax

    for _ in range(1 + refine):
        grid = [math.exp(math.log(lo) + (math.log(hi) - math.log(lo)) * i / (n - 1)) for i in range(n)]
        rows = df.where((F.col(label) >= 0) & (F.col(label) < F.size(scores)))
        losses = [F.avg(-F.ln(F.greatest(F.get(softmax(F.col(scores), t), F.col(label)), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(grid)]
        values = list(rows.agg(*losses).first())
        if values[0] is None:
            raise ValueError("no row has scores and a label")
        i = min(range(n), key=lambda k: values[k])
        lo, hi, n = grid[max(i - 1, 0)], grid[min(i + 1, n - 1)], 9
        if hi / lo < 1.0005:
            break
    return math.sqrt(lo * hi)
