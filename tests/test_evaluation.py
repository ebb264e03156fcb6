import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.operators import evaluation as ev
from decidra.operators import models, slots, trust


def test_multiclass_losses(spark):
    df = spark.createDataFrame([([2.0, 2.0], 0), ([0.0, 1.0], 1), (None, 0), ([1.0], None)], "p array<double>, y int")
    got = ev.multiclass_losses(df, "p", "y").first()
    assert got.brier == pytest.approx(0.25) and got.nll == pytest.approx(-math.log(0.5) / 2)
    for bad in (([-1.0, 2.0], 0), ([0.0, 0.0], 0), ([1.0], 1)):
        with pytest.raises(Exception, match="invalid"):
            ev.multiclass_losses(spark.createDataFrame([bad], "p array<double>, y int"), "p", "y").collect()


def test_curves_against_plain_python(spark):
    rng = random.Random(3)
    risks = [rng.choice([0.0, 0.05, 0.1, 0.3, 0.9]) for _ in range(200)]
    df = spark.createDataFrame([(r, int(rng.random() < r)) for r in risks], "r double, f int")
    cum = np.cumsum(np.sort(risks)) / np.arange(1, 201)
    for row in ev.coverage_at_risk(df, "r").collect():
        ok = np.where(cum <= row.rate + 1e-12)[0]
        assert row.coverage == pytest.approx((ok[-1] + 1) / 200 if len(ok) else 0.0, abs=1e-4)
    curve = ev.prefix_curve(df, "r", "f")
    assert curve.agg(F.max("k")).first()[0] == 200 and ev.coverage_at(curve, -1.0).first()[0] == 0.0
    with pytest.raises(ValueError):
        ev.risk_at(curve, 0.0)
    assert ev.order_statistic(df, "r", 0.95).first()[0] == sorted(risks)[min(199, int(0.95 * 200))]


def test_agreement(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 0.8), ("a", 2, 0.9, 0.9), ("a", 3, 0.1, 0.2), ("b", 1, 0.5, 0.1), ("b", 2, 0.4, 0.3)], "d string, c int, x double, y double")
    assert ev.winner_agreement(df, "d", "c", "x", "y").first().agreement == 0.0
    top = ev.top_set_agreement(df, "d", "c", "x", "y").first()
    assert top.agreement == 0.5 and top.chance == pytest.approx((2 / 3 + 1 / 2) / 2)
    pairs = ev.sign_accuracy(df, "d", "c", "x", "y", 2).first()
    assert pairs.pairs == 3 and pairs.accuracy == pytest.approx(2 / 3)
    assert ev.full_order_agreement(df, "d", "c", "x", "x").first().agreement == 1.0
    kept = {r.d: (r.kept, r.dropped, r.open, r.certified) for r in ev.certificates(df, "d", "c", "x", 0.06).collect()}
    assert kept == {"a": (2, 1, 0, True), "b": (1, 0, 1, False)}
    traces = spark.createDataFrame([(["a"], ["b"], ["b"]), (["a", "b"], ["b", "a"], ["a", "b"]), (["x"], ["y"], ["x"])], "b array<string>, a array<string>, t array<string>")
    assert tuple(ev.trace_agreement(traces, "b", "a", "t").first()) == (3, 1 / 3, 1 / 3, 1 / 3)


def test_exact_tests():
    assert ev.upper_bound(0, 459) == pytest.approx(1 - 0.05 ** (1 / 459), abs=1e-9) and ev.upper_bound(3, 3) == 1.0
    assert ev.mcnemar(0, 0) == 1.0 and ev.mcnemar(1, 9) == pytest.approx(2 * 11 / 1024)
    with pytest.raises(ValueError):
        ev.upper_bound(2, 1)


def test_bootstrap_and_stability(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(1, 1, 400))], "d int, x double")
    got = ev.bootstrap(df, "d", "x").first()
    assert got.low < got.mean < got.high and got.high - got.low == pytest.approx(4 / 20, rel=0.35)
    sure = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.1)], "d string, c int, v double")
    assert [tuple(r) for r in ev.stability(sure, "d", "c", "v", 0.05).collect()] == [(3, 1, 1.0)]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), *[(k, k + 1) for k in range(20, 40)]], "a long, b long")
    got = {r.v: r.component for r in ev.components(edges, "a", "b").collect()}
    assert got[3] == 1 and got[8] == 7 and got[40] == 20
    assert tuple(ev.degrees(edges, "a", "b").first()) == (23, 26, 2)
    pairs = [("d", i, j, q[0] - q[1]) for i in range(3) for j in range(3) if i != j for q in [((1.0, 2.5, -1.0)[i], (1.0, 2.5, -1.0)[j])]]
    fit = ev.integrability(spark.createDataFrame(pairs, "d string, i int, j int, r double"), "d", "i", "j", "r").first()
    assert fit.share == pytest.approx(1) and fit.residual_rms == pytest.approx(0, abs=1e-9)


def test_controls_and_heads(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.random(4)], [float(x) for x in rng.random(4)], int(rng.random() < 0.3)) for i in range(200)]
    seen = trust.observe(spark.createDataFrame(rows, "i int, semantic array<double>, bm25 array<double>, error int"))
    got = trust.controls(seen, "error", F.col("i") < 100).select("i", "a_top1", "e_ood", "f_logistic").collect()
    assert {r.i for r in got} == set(range(100, 200)) and all(0 <= v <= 1 for r in got for v in r[1:])
    head = models.perceptron([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0], [1.0, -1.0], 0.0)
    p = spark.createDataFrame([([1.0, 1.0],), ([2.0, 0.0],)], "x array<double>").select(head("x")).collect()
    assert p[0][0] == pytest.approx(0.5) and p[1][0] == pytest.approx(1 / (1 + math.exp(-2 * 0.9772498680518208)))
    cases = spark.createDataFrame([("q", "a", 0.6), ("q", "b", 0.9), ("r", "a", 0.5), ("s", None, None)], "q string, c string, p double")
    assert {r.q: (r.c, r.escalate) for r in models.success_choice(cases, "q", "c", "p").collect()} == {"q": ("b", False), "r": ("a", True), "s": (None, True)}
    states = spark.createDataFrame([(0.1, 0.9), (0.5, 0.6), (0.5, -0.5), (0.5, 0.1)], "e double, s double").select(models.support_state(F.col("e"), F.col("s"))).collect()
    assert [r[0] for r in states] == ["UNKNOWN", "SUPPORTED", "CONTRADICTED", "AMBIGUOUS"]


def test_nested_tools(spark):
    stop = slots.Arg("stop", "object", fields=(slots.Arg("mail", "email", required=True), slots.Arg("nights", "integer")))
    tool = slots.Tool("add_stop", "add_stop", "Adds a stop.", args=(stop, slots.Arg("legs", "array", item_type="date"), slots.Arg("cabin", "enum", True, enum=("business_class", "economy"))))
    assert tool.required_paths() == ["stop.mail", "cabin"] and slots.Tool.from_json(tool.to_json()) == tool
    assert tool.card_text() == "add stop; Adds a stop.; required: cabin; stop: object; legs: array; cabin: enum(business_class,economy)"
    assert slots.tools_of(slots.catalog(spark, [tool])) == [tool]
    df = spark.createDataFrame([("BUSINESS_CLASS, nights 3",), ("economy; a@b.de, nights 2",), ("economy",), ("nothing",)], "t string")
    calls = [r.call for r in slots.compile_call(slots.extract_all(df, "t", tool), tool).collect()]
    assert [(c.outcome, c.missing) for c in calls] == [("ASK_FOR_INFO", ["stop.mail"]), ("ACT", []), ("ACT", []), ("ASK_FOR_INFO", ["cabin"])]
    where = {e.arg: (e.start, e.end) for e in calls[1].evidence}
    assert where["cabin"] == (0, 7) and where["stop.mail"] == (9, 15) and calls[3].reasons == ["required arg cabin unresolved"]
    items = spark.createDataFrame([(["2026-01-02", "x"],)], "a array<string>").select(slots.coerce_items(F.col("a"), "date").alias("i")).first().i
    assert items["items"] == ["2026-01-02"] and items.invalid == 1
    args = [{"cabin": "economy", "stop": '{"mail": "a@b.de", "z": 1}', "legs": '["2026-01-02", "x"]'}, {"stop": "3", "legs": "{}", "cabin": "first"}, {"cabin": "economy", "stop": '{"nights": "2"}'}]
    errors = [r[0] for r in spark.createDataFrame([(a,) for a in args], "a map<string,string>").select(slots.schema_errors(F.col("a"), tool)).collect()]
    assert set(errors[0]) == {"array legs has an invalid item", "unsupported arg stop.z"} and errors[2] == ["missing required arg stop.mail"]
    assert set(errors[1]) == {"arg stop must be object", "arg legs must be array", "arg cabin invalid enum"}
