import itertools
import random

import pytest
from pyspark.sql import functions as F

from decidra.functions import facts as ff
from decidra.plans import executor
from decidra.plans.program import compile_instruction


def frame(spark, texts, decision="d"):
    return spark.createDataFrame([(decision, k, t) for k, t in texts.items()], "decision_id string, candidate_id string, text string")


def answer(spark, question, texts, **kw):
    return executor.decide(frame(spark, texts), question, **kw).first()


def test_second_axis_decides(spark):
    got = answer(spark, "minimize latency, then cost", {"a": "latency 30; cost 5", "b": "latency 30; cost 2"})
    assert got.answer == "b" and got.structured and got.trust_state == "tie"


def test_routing_with_floor(spark):
    texts = {"opus": "supports tools; quality 0.95; latency 900; cost 15", "haiku": "supports tools; quality 0.75; latency 200; cost 1", "tiny": "supports tools; quality 0.4; latency 50; cost 0.1", "plain": "no tools; quality 0.9; latency 20; cost 0.1"}
    got = answer(spark, "supports tools and quality at least 0.7; minimize latency, then cost", texts)
    assert got.answer == "haiku" and got.eligible == 2


def test_abstains_without_eligible(spark):
    got = answer(spark, "permitted; minimize cost", {"a": "not permitted; cost 1", "b": "prohibited; cost 2"})
    assert got.answer is None and got.decision_mode == "abstain" and got.eligible == 0


def test_order_and_names_do_not_matter(spark):
    texts = {"x": "latency 3; cost 2", "y": "latency 1; cost 9", "z": "latency 1; cost 4"}
    won = {texts[answer(spark, "minimize latency, then cost", dict(p)).answer] for p in itertools.permutations(texts.items())}
    assert won == {"latency 1; cost 4"}


def test_band_keeps_the_first_axis_as_last_word(spark):
    texts = {"a": "speed 1.00; price 9", "b": "speed 0.90; price 1", "c": "speed 0.80; price 0"}
    assert answer(spark, "maximize speed, then minimize price", texts, resolution=0.15).answer == "b"


def test_facts(spark):
    row = spark.createDataFrame([("cost: 5; latency 3k, size = 2m, quality 80% cost 7",), (None,), ("",)], "t string").select(ff.facts(F.col("t")).alias("f")).collect()
    assert [(x.key, x.value) for x in row[0].f] == [("cost", 5.0), ("latency", 3000.0), ("size", 2e6), ("quality", 80.0), ("cost", 7.0)]
    assert row[1].f is None and row[2].f == []


def test_identity_is_cut(spark):
    df = spark.createDataFrame([("Option Bravo: slow",), ("cost: 5; latency 3",)], "t string")
    assert [r[0] for r in df.select(ff.strip_identity(F.col("t"))).collect()] == ["slow", "5; latency 3"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = [(f"d{rng.randrange(40)}", f"c{i:03d}", f"latency {rng.randrange(4)}; cost {rng.randrange(5)}; {'permitted' if rng.random() < 0.7 else 'not permitted'}") for i in range(300)]
    got = {r.decision_id: r.answer for r in executor.decide(spark.createDataFrame(rows, "decision_id string, candidate_id string, text string"), "permitted; minimize latency, then cost").collect()}
    for d in {r[0] for r in rows}:
        ok = [r for r in rows if r[0] == d and "not" not in r[2]]
        best = min(ok, key=lambda r: (int(r[2].split()[1][:-1]), int(r[2].split()[3][:-1]), r[2], r[1])) if ok else None
        assert got[d] == (best[1] if best else None)


def test_each_question_like_one_question(spark):
    decisions = spark.createDataFrame([("p", "minimize latency, then cost"), ("q", "maximize cost"), ("r", None)], "decision_id string, question string")
    rows = [(d, c, i, t) for d in "pqr" for i, (c, t) in enumerate({"a": "latency 3; cost 1", "b": "latency 2; cost 1", "c": "latency 9; cost 8"}.items())]
    got = {r.decision_id: r.answer for r in executor.decide_each(decisions, spark.createDataFrame(rows, "decision_id string, candidate_id string, pos int, text string")).collect()}
    assert got == {"p": "b", "q": "c", "r": "b"}


def test_nulls_empty_and_certificate(spark):
    empty = spark.createDataFrame([], "decision_id string, candidate_id string, text string")
    assert executor.decide(empty, "minimize cost").collect() == []
    got = answer(spark, "minimize cost", {"a": None, "b": "cost 1"})
    assert got.answer is None and got.decision_mode == "abstain" and got.reason == executor.NO_LANE and not got.structured  # a candidate does not state the axis
    assert executor.certificate(frame(spark, {"a": "cost 2"}), "minimize cost").first().asDict() == {"decision_id": "d", "candidate_id": "a", "stage": "MIN cost", "value": 2.0}


def test_probabilities_sum_to_one(spark):
    texts = {"a": "permitted; cost 1", "b": "permitted; cost 2", "c": "not permitted; cost 0"}
    got = {r.candidate_id: r.probability for r in executor.probabilities(frame(spark, texts), compile_instruction("permitted; minimize cost")).collect()}
    assert got["c"] == 0 and abs(sum(got.values()) - 1) < 1e-12 and got["a"] > got["b"]


def test_program_without_axis_is_one_hot(spark):
    got = {r.candidate_id: r.probability for r in executor.probabilities(frame(spark, {"a": "permitted; z", "b": "permitted; y", "c": "illegal"}), "permitted").collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_rounding_and_margin(spark):
    assert spark.range(1).select(executor.quantized(F.lit(1.0005))).first()[0] == 1.0
    assert answer(spark, "minimize cost", {"a": "cost 1", "b": "cost 4", "c": "cost 2.5"}).primary_margin == 1.5
    assert answer(spark, "minimize cost", {"a": "cost 1"}).primary_margin is None


def test_own_grounder_answers_what_is_not_stated(spark):
    scale = ["none", "little", "ample", "vast"]

    def grounder(texts, stages):
        values = F.array(*(F.when(F.contains("text", F.lit("not permitted")), -1.0).otherwise(1.0) if s.kind == "FILTER" else F.coalesce(*(F.when(F.contains("text", F.lit(w)), float(k)) for k, w in enumerate(scale))) for s in stages))
        return texts.select("decision_id", "candidate_id", values.alias("values"))

    got = answer(spark, "Choose the permitted option with the most headroom.", {"a": "permitted; headroom ample", "b": "permitted; headroom little"}, grounder=grounder)
    assert got.answer == "a" and got.decision_mode == "crux"
    got = answer(spark, "Choose the permitted option with the most headroom.", {"a": "not permitted; headroom ample", "b": "not permitted; headroom vast"}, grounder=grounder)
    assert got.answer is None and got.trust_state == "abstain" and got.reason == executor.NO_CANDIDATE


def test_survivors_by_stage(spark):
    texts = {"gpt": "supports tools; quality 0.92; latency 800; cost 0.9", "haiku": "supports tools; quality 0.74; latency 200; cost 0.1", "local": "no tool support; quality 0.60; latency 50; cost 0.0"}
    got = executor.survivors(frame(spark, texts), "supports tools and quality at least 0.7; minimize latency, then cost").orderBy("stage_no", "candidate_id").collect()
    assert [(r.stage, r.candidate_id) for r in got] == [("FILTER tool_support", "gpt"), ("FILTER tool_support", "haiku"), ("FILTER quality>=0.7", "gpt"), ("FILTER quality>=0.7", "haiku"), ("MIN latency", "haiku"), ("MIN cost", "haiku")]
