import json
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from decidra.functions import statements as stm
from decidra.operators import models
from decidra.plans import systemone as so

QUESTIONS = "request_id long, pos int, qname string, qtype string, instructions string, criteria string"
REQUESTS = "request_id long, state string, state_kind string, assets string"
STATEMENTS = {
    "Is this message about billing?": "This message is about billing.", "Does this message express urgency?": "This message expresses urgency.", "Can the customer log in?": "The customer can log in.",
    "Is the sentiment of this movie review positive?": "The sentiment of this movie review is positive.", "Is the customer asking for a refund?": "The customer is asking for a refund.",
    "Was the package delivered on time?": "The package was delivered on time.", "Has the issue been resolved?": "The issue has been resolved.", "Is this a billing issue?": "This is a billing issue.",
    "Do these reviews mention shipping?": "These reviews mention shipping.", "Did the customer pay the invoice?": "The customer paid the invoice.", "Does the user threaten to cancel or leave?": "The user threatens to cancel or leave.",
    "This message contains unsolicited advertising.": "This message contains unsolicited advertising.", "Which team should handle this?": "Which team should handle this?", "Is it?": "Is it?", "": "",
}


def test_statements(spark):
    df = spark.createDataFrame([(q,) for q in STATEMENTS] + [(None,)], "q string")
    got = [r[0] for r in df.select(stm.to_statement(F.col("q"))).collect()]
    assert got == [*STATEMENTS.values(), ""]


def test_options_and_hypotheses(spark):
    df = spark.createDataFrame([("billing_team", "Payments and refunds."), ("x", "US tax"), ("y_z", None)], "k string, d string")
    got = df.select(stm.hypothesis(F.col("k"), F.col("d")), stm.option_text(F.lit("choice"), F.col("k"), F.col("d")), stm.option_text(F.lit("score"), F.col("k"), F.col("d"))).collect()
    assert [r[0] for r in got] == ["This example is payments and refunds.", "This example is US tax.", "This example is y z."]
    assert [r[1] for r in got] == ["billing team: Payments and refunds.", "x: US tax", "y z"] and [r[2] for r in got] == ["Payments and refunds.", "US tax", "level y_z"]


def test_assets(spark):
    df = spark.createDataFrame([("see img1, img10 and img1", ["img1", "img10"]), ("img1", ["img1"]), ("none", None), (None, ["a"])], "t string, n array<string>")
    got = df.select(stm.with_assets(F.col("t"), F.col("n")), stm.assets_in(F.col("t"), F.col("n"))).collect()
    assert got[0][0] == "see the attached image, the attached image and the attached image" and got[0][1] == ["img1", "img10"]
    assert got[1][0] is None and got[1][1] == ["img1"] and got[2][0] == "none" and got[3][0] is None


def bag(text):
    v = [0.0] * 64
    for w in re.findall("[a-z0-9]+", text.lower()):
        if w not in models.STOP_WORDS:
            v[zlib.crc32(w.encode()) % 64] += 1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


def test_stand_ins(spark):
    texts = ["The invoice is overdue and the invoice counts", "", "A 12 b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(models.hashed_words(F.col("t"))).collect()]
    assert all(g == pytest.approx(bag(t)) for g, t in zip(got, texts))
    rows = spark.createDataFrame([([[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "v array<array<double>>, m array<int>").select(models.masked_mean(F.col("v"), F.col("m"))).collect()
    assert rows[0][0] == pytest.approx([2 / math.hypot(2, 2), 2 / math.hypot(2, 2)]) and rows[1][0] is None


def asked(spark, state, kind, *questions, **kw):
    requests = spark.createDataFrame([(1, state, kind, None)], REQUESTS)
    rows = spark.createDataFrame([(1, k, q[0], q[1], q[2], json.dumps(q[3]) if q[3] is not None else None) for k, q in enumerate(questions)], QUESTIONS)
    return {r.qname: r for r in so.answer(requests, rows, **kw).collect()}


TEAM = ("team", "choice", "Which team?", {"billing": "invoice payment refund", "technical": "error crash login", "shipping": "parcel delivery"})


def test_lanes(spark):
    got = asked(spark, "my invoice payment failed", "text", TEAM, ("urgent", "noul", "Is the invoice urgent?", None), ("mood", "score", "How angry?", ["calm", "angry invoice"]), ("one", "choice", "x", {"only": "thing"}), ("area", "box", None, None))
    team = json.loads(got["team"].answer)
    cos = [sum(a * b for a, b in zip(bag("my invoice payment failed"), bag(f"{k}: {v}"))) for k, v in TEAM[3].items()]
    e = [math.exp((c - max(cos)) / 0.04239) for c in cos]
    assert team["choice"] == "billing" and got["team"].lane == "matcher" and got["team"].p == pytest.approx([x / sum(e) for x in e])
    assert json.loads(got["urgent"].answer)["noul"] == pytest.approx(1 / (1 + math.exp(-3)), abs=1e-6) and got["urgent"].lane == "nli"
    assert json.loads(got["mood"].answer)["score"] > 0.5 and got["one"].lane == "exact" and got["area"].lane == "unreadable" and got["area"].answer is None


def test_exact_lane_and_floor(spark):
    state = json.dumps({"invoice": {"status": "Overdue", "is_large": True}})
    got = asked(spark, state, "object", ("status", "choice", None, {"paid": None, "overdue": None}), ("is_large", "noul", None, None), TEAM, config=so.Config(floor=2.0))
    assert json.loads(got["status"].answer)["choice"] == "overdue" and json.loads(got["is_large"].answer)["noul"] == 1.0
    assert not got["status"].below_floor and got["team"].below_floor


def test_uncertain_choices_are_reranked(spark):
    same = lambda text: F.array(F.lit(1.0), F.lit(0.0))
    got = asked(spark, "the parcel came late", "text", TEAM, embedder=same)["team"]
    assert got.lane == "matcher+nli" and json.loads(got.answer)["choice"] == "shipping" and sum(got.p) == pytest.approx(1)


def test_two_sided_yes_no(spark):
    two = ("late", "noul", "x", {"true": "The parcel came late.", "false": "The parcel was early."})
    got = asked(spark, "the parcel came late", "text", two, ("no", "noul", None, {"false": "nothing of that kind"}))
    assert json.loads(got["late"].answer)["noul"] == pytest.approx(0.5) and json.loads(got["no"].answer)["noul"] == pytest.approx(1 / (1 + math.exp(-3)), abs=1e-6)


def test_second_tier_escalation_and_merge(spark):
    def tier2(rows):
        return rows.where("qtype = 'score'").select("request_id", "pos", F.array(F.lit(0.0), F.lit(1.0)).alias("probabilities"))

    requests = spark.createDataFrame([(1, "my invoice", "text", None), (2, "x", "text", '{"img": "..."}')], REQUESTS)
    questions = spark.createDataFrame([(1, 0, "team", "choice", "Which?", json.dumps(TEAM[3])), (1, 1, "mood", "score", "How?", '["a", "b"]'), (2, 0, "b", "box", None, None)], QUESTIONS)
    got = so.answer(requests, questions, config=so.Config(floor=0.999), tier2=tier2)
    lanes = {(r.request_id, r.qname): (r.lane, r.below_floor) for r in got.collect()}
    assert lanes[1, "mood"] == ("tier2", False)
    reasons = so.unreadable(questions, requests)
    assert [r.request_id for r in reasons.collect()] == [2]
    out = so.escalations(got, requests, questions, reasons).collect()
    assert {(r.request_id, r.qname) for r in out} >= {(2, "b")}
    remote = spark.createDataFrame([(1, "team", "remote")], "request_id long, qname string, remote_answer string")
    assert [(r.qname, r.lane) for r in so.merged(got, remote).where("request_id = 1").collect()] == [("team", "escalated"), ("mood", "tier2")]
    assert {r.counter: r.n for r in so.counters(got).collect()}["questions"] == 3


def test_matcher(spark):
    states = spark.createDataFrame([(1, "red apple"), (2, "")], "i long, t string")
    candidates = spark.createDataFrame([("a", "green apple"), ("b", "red apple pie"), ("c", None)], "c string, d string")
    got = models.match(states, candidates, "i", "t", "c", "d").collect()
    assert [(r.i, r.c) for r in got] == [(1, "b")] and got[0].margin > 0


def test_empty_tables(spark):
    assert so.answer(spark.createDataFrame([], REQUESTS), spark.createDataFrame([], QUESTIONS)).count() == 0
