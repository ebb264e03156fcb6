import math
import random

import pytest
from pyspark.sql import functions as F

from decidra.functions import scores as sc
from decidra.operators import metrics, retrieval, slots, trust, units
from decidra.sources import requests as rq
from decidra.streaming import state as st


def one(df):
    return df.first()[0]


def test_bm25_like_the_formula(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, None), (4, "cat cat Größe")], "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(docs, spark.createDataFrame([(1, "cat größe cat")], "query_id long, query string")).collect()}
    sizes = {1: 3, 2: 2, 3: 0, 4: 3}
    avg = 2.0
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    w = lambda tf, d: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(1, sizes[d]) / avg))
    assert got[1, 1] == pytest.approx(2 * idf(2) * w(1, 1)) and got[1, 4] == pytest.approx(2 * idf(2) * w(2, 4) + idf(1) * w(1, 4)) and set(got) == {(1, 1), (1, 4)}


def test_sentences_within_budget(spark):
    filler = " ".join(f"Filler number {i} says nothing." for i in range(60))
    df = spark.createDataFrame([(1, filler + " The invoice is overdue.", "overdue invoice"), (2, "Short text.", "x"), (3, None, None)], "id long, text string, q string")
    got = {r.id: r.selected for r in retrieval.select_sentences(df, "id", "text", "q", 25).collect()}
    assert "overdue" in got[1] and len(got[1].split()) < 25 and got[2] == "Short text." and got[3] == ""


def test_metrics_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, round(rng.random(), 2), int(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    pos, neg = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    area = sum((p[1] > n[1]) + 0.5 * (p[1] == n[1]) for p in pos for n in neg) / (len(pos) * len(neg))
    assert one(metrics.auroc(df, "s", "y")) == pytest.approx(area)
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    hits, total = 0, 0.0
    for k, r in enumerate(ranked, 1):
        hits += r[2]
        total += r[2] * hits / k
    assert one(metrics.auprc(df, "s", "y", "id")) == pytest.approx(total / len(pos))
    low = sorted(r[1] for r in rows)
    got = {r.coverage: r.risk for r in metrics.risk_coverage(df, "s", "id").collect()}
    assert got[0.25] == pytest.approx(sum(low[:50]) / 50, abs=1e-4) and got[1.0] == pytest.approx(sum(low) / 200, abs=1e-4)
    assert one(metrics.auroc(df.where("y = 1"), "s", "y")) is None


def test_temperature_is_recovered(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        s = [rng.gauss(0, 0.1) for _ in range(4)]
        e = [math.exp(x / 0.08) for x in s]
        rows.append((s, rng.choices(range(4), e)[0]))
    t = metrics.temperature_grid(spark.createDataFrame(rows, "s array<double>, y int"), "s", "y", n=40)
    assert 0.06 < t < 0.11


def test_ece_edges(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 0), (0.5, 1), (None, 1)], "c double, y int")
    assert one(metrics.ece(df, "c", "y", 10)) == pytest.approx(0.5 / 3) == one(metrics.ece(df, "c", "y", 10, True))


def test_slots(spark):
    cases = [("Fly on 2026-09-25, business class", "2026-09-25", "VALUE"), ("on 25/09/2026 or 26/09/2026", None, "AMBIGUOUS"), ("day is 01/02/2026 not 03/02/2026", "2026-02-01", "VALUE"), ("no date", None, "MISSING"), (None, None, "MISSING"), ("on 31/12/69", "1969-12-31", "VALUE")]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select(slots.extract_slot(F.col("t"), slots.Arg("day", "date")).alias("s"))
    assert [(r.s.value, r.s.state) for r in df.collect()] == [(v, s) for _, v, s in cases]
    kind = slots.Arg("cabin", "enum", enum=("economy", "business"))
    got = spark.createDataFrame([("BUSINESS please",), ("economy or business",), ("businesslike",)], "t string").select(slots.extract_slot(F.col("t"), kind).alias("s")).collect()
    assert [r.s.state for r in got] == ["VALUE", "AMBIGUOUS", "MISSING"] and got[0].s.value == "business"


def test_coercion(spark):
    cases = [("integer", "2.5", None), ("integer", "1,200", "1200"), ("boolean", "Yes", "true"), ("boolean", "maybe", None), ("url", "see www.a.example/x).", "https://www.a.example/x"), ("datetime", "2026-01-02 7:05", "2026-01-02T07:05:00"), ("datetime", "2026-01-02 25:00", None), ("date", "2026-13-01", None), ("email", "to a.b@c.example now", "a.b@c.example"), ("integer", "12345", "123")]
    for kind, raw, want in cases:
        assert one(spark.createDataFrame([(raw,)], "r string").select(slots.coerce(F.col("r"), slots.Arg("a", kind)))) == want, (kind, raw)
    assert one(spark.createDataFrame([("12345",)], "r string").select(slots.coerce(F.col("r"), slots.Arg("a", "integer"), compat=False))) == "12345"
    with pytest.raises(ValueError):
        slots.Arg("a", "enum")


def test_calls(spark):
    tool = slots.Tool("t", "t", args=(slots.Arg("mail", "email", required=True), slots.Arg("day", "date")))
    df = spark.createDataFrame([("a@b.example on 2026-01-02", None), ("nothing", None), ("a@b.example and c@d.example", None), ("a@b.example", ["x"])], "t string, extra array<string>")
    got = slots.compile_call(slots.extract_all(df, "t", tool), tool, extra=F.coalesce("extra", F.array().cast("array<string>"))).select("call.*").collect()
    assert [r.outcome for r in got] == ["ACT", "ASK_FOR_INFO", "ASK_FOR_INFO", "REJECT"] and got[2].ambiguous == ["mail"] and got[0].args == {"mail": "a@b.example", "day": "2026-01-02"}
    errors = spark.createDataFrame([({"mail": "x", "z": "1"},)], "a map<string,string>").select(slots.schema_errors(F.col("a"), tool)).first()[0]
    assert errors == ["unsupported arg z", "arg mail invalid email"]


def test_observation_and_policy(spark):
    df = spark.createDataFrame([([0.52, 0.50, 0.48], [1.0, 9.0, 0.5], 0.95), ([0.9], [1.0], 0.05), ([], [], 0.5), (None, None, None)], "semantic array<double>, bm25 array<double>, risk double")
    rows = trust.observe(df).withColumn("d", trust.policy(F.col("risk"), F.lit(0), F.lit(0), F.col("lane_agree"), F.col("semantic_margin"), F.col("candidate_count"))).collect()
    assert [r.d for r in rows] == ["RERUN_CHEAP_LANE", "ACT", "ABSTAIN", "ABSTAIN"] and rows[0].lane_agree == 0 and rows[2].semantic_top1 is None


def test_validation_collects_all_errors(spark):
    requests = spark.createDataFrame([(1, None, "s", None), (2, "m", None, "[1]"), (3, "m", "s", None)], "request_id long, model string, state string, assets string")
    questions = spark.createDataFrame([(1, 0, "a", "choice", "{}"), (1, 1, "b", "bogus", None), (3, 0, "c", "score", '["x"]'), (3, 1, "d", "noul", '{"maybe": 1}')], "request_id long, pos int, qname string, qtype string, criteria string")
    got = {r.request_id: r.errors for r in rq.validate(requests, questions).collect()}
    assert got[1] == ["model: missing", "questions.a.criteria: too_short", "questions.b.type: union_tag_invalid"]
    assert got[2] == ["state: missing", "questions: too_short", "assets: dict_type"] and got[3] == ["questions.d.criteria: noul_criteria"]


def test_exact_lane(spark):
    state = '{"invoice": {"status": "Overdue", "is_large": true, "risk": 2}}'
    requests = spark.createDataFrame([(1, state, "object")], "request_id long, state string, state_kind string")
    questions = spark.createDataFrame([(1, 0, "status", "choice", '{"overdue": "", "paid": ""}'), (1, 1, "Is large", "noul", None), (1, 2, "risk", "score", '["a","b","c"]'), (1, 3, "mood", "choice", '{"only": ""}'), (1, 4, "gone", "noul", None)], "request_id long, pos int, qname string, qtype string, criteria string")
    got = [(r.answer, r.lane) for r in rq.exact_answers(requests, questions).orderBy("pos").collect()]
    assert got == [("overdue", "exact"), ("true", "exact"), ("2", "exact"), ("only", "exact"), (None, "nli")]


def test_state_batch_and_stream_agree(spark, tmp_path):
    rows = [(i, i % 3) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "seq long, k int")
    df.write.parquet(str(tmp_path / "in"))
    query = st.stream_last_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "seq").writeStream.format("memory").queryName("ages").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    batch = {(r.k, r.seq, r.age) for r in st.fact_age(df, "k", "seq").collect()}
    assert {(r.k, r.seq, r.age) for r in spark.table("ages").collect()} == batch


def test_reliability_like_a_fold(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.random() < 0.6) for i in range(50)]
    e = 0.8
    for _, _, ok in rows:
        e = 0.9 * e + 0.1 * ok
    assert st.reliability(spark.createDataFrame(rows, "k int, i int, ok boolean"), "k", "i", "ok").first().estimate == pytest.approx(e)


def test_scores(spark):
    row = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0])], "a array<double>, z array<double>").select(sc.softmax(F.col("a"), 1.0), sc.cosine(F.col("a"), F.col("z")), sc.signature(F.col("a")), sc.norm(F.lit("Is--Large?"))).first()
    assert row[0] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)]) and row[1] == 0 and row[2] == "15,15" and row[3] == "is_large"


@pytest.mark.parametrize("text,mark,units_,want", [
    ("latency 2.5 s; price: $0.192/Mtok", ".", "", [("latency", 2_500_000), ("price", 192)]),
    ("Latenz: ca. 103.000; Energie 9.296 J", ",", "latency=us", [("latency", 103000), ("energy", 9_296_000)]),
    ("With 239,000 tokens per hour, its speed is approx. average.", ".", "", [("throughput", 239000)]),
    ("(latency ms, memory GiB) latency 5; RAM 2", ".", "latency=s\nmemory=MB", [("latency", 5000), ("memory", 2**31)]),
    ("実測の応答時間は約2500000。品質は9.63/10です。", ".", "latency=us", [("latency", 2_500_000), ("quality", 9630)]),
    ("It shows a latency of half a second. quality 404‰", ".", "", [("latency", 500_000), ("quality", 4040)]),
    ("The response time is about 4 min 12 s here.", ".", "", [("latency", 252_000_000)]),
    ("speed figures are not available; open 7 hours", ".", "", []),
    ("memory 5", ".", "", [("memory", None)]),
])
def test_measurements(text, mark, units_, want):
    assert [(q, v) for q, v, _ in units.read_measurements(text, mark, units_)] == want


def test_measurement_rows(spark):
    df = spark.createDataFrame([(1, "latency 2 s", None, None, "kept"), (2, None, ".", "", "x"), (3, "", ".", "", "x"), (1, "latency 2 s", None, None, "kept")], "id long, t string, m string, u string, measurements string")
    got = units.measurements(df, F.col("t"), F.col("m"), F.col("u")).orderBy("id").collect()
    assert [len(r.measurements) for r in got] == [1, 1, 0, 0] and got[0].measurements[0].base_value == 2_000_000


def test_measurements_are_read_once(spark):
    df = units.measurements(spark.createDataFrame([("latency 2 s",), ("none",)], "t string"), F.col("t"), F.lit("."), F.lit(""))
    some = df.select("t", F.transform("measurements", lambda m: m["base_value"]).alias("v")).where(F.size("v") > 0)
    assert some._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.t, r.v) for r in some.collect()] == [("latency 2 s", [2_000_000])]


def test_units_by_identity(spark):
    sizes = {"mass": {"g": 1e-3, "kg": 1.0}, "density": {"kg/m3": 1.0, "g/cm3": 1000.0}, "volume": {"l": 1e-3, "m3": 1.0}}
    identity = [{"mass": 1, "density": -1, "volume": -1}]
    df = spark.createDataFrame([(2000.0, 1.0, 2.0), (None, 1.0, 1.0), (0.0, 1.0, 1.0)], "mass double, density double, volume double")
    got = [r.units for r in units.resolve_units(df, sizes, identity).collect()]
    assert got[0].residual == pytest.approx(0, abs=1e-9) and not got[0].unique  # 2000 kg = 1 g/cm3 x 2 m3, and so on
    assert got[1].choice is None and not got[1].unique and got[2].choice is None
    known = units.resolve_units(df.limit(1), {**sizes, "density": {"g/cm3": 1000.0}, "volume": {"l": 1e-3}}, identity).first().units
    assert known.unique and known.choice["mass"] == "g"
    with pytest.raises(ValueError):
        units.resolve_units(df, sizes, [])
