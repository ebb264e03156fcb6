import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.sources import files
from decidra.streaming import state as st


def test_calibration_round_trip(spark, tmp_path):
    files.save_calibration(spark, {"noul": 2.0}, f"file://{tmp_path}/c", rows=3)
    got = files.load_calibration(spark, f"file://{tmp_path}/c")
    assert got["noul"] == 2.0 and got["choice:2"] == 0.05 and "rows" not in got


def test_tensors(spark, tmp_path):
    data = np.arange(6, dtype="<f4").tobytes()
    header = json.dumps({"__metadata__": {"a": "b"}, "w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "e": {"dtype": "F32", "shape": [0], "data_offsets": [24, 24]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + data)
    got = {r.name: r for r in files.tensors(spark, f"file://{tmp_path}/m.safetensors").collect()}
    assert got["w"].shape == [2, 3] and np.frombuffer(got["w"].data, "<f4").tolist() == [0, 1, 2, 3, 4, 5] and len(got["e"].data) == 0


def test_json_bodies(spark):
    bodies = [(1, '{"model": "m", "state": {"a": 1}, "questions": {"q": {"type": "noul"}, "r": {"type": "choice", "criteria": {"x": "y"}}}, "assets": {"i": "d"}}'), (2, "no json"), (3, None)]
    requests, questions, errors = files.json_requests(spark.createDataFrame(bodies, "i long, b string"), "b", "i")
    assert [(r.request_id, r.model, r.state_kind, r.state) for r in requests.collect()] == [(1, "m", "object", '{"a":1}')]
    assert [(r.pos, r.qname, r.qtype, r.criteria) for r in questions.orderBy("pos").collect()] == [(0, "q", "noul", None), (1, "r", "choice", '{"x":"y"}')]
    assert {(r.request_id, r.error.type) for r in errors.collect()} == {(2, "json_invalid"), (3, "json_invalid")}


def test_recording_is_checked(spark, tmp_path):
    schema = "run string, step long, before string, after string"
    steps = [("a", 0, "s", "t"), ("a", 1, "t", "u"), ("b", 0, "s", "t"), ("b", 1, "x", "y"), ("c", 0, "s", "t"), ("c", 2, "t", "u")]
    files.record(spark.createDataFrame(steps, schema), f"file://{tmp_path}/r", 2)
    got = {(r.run, r.step): (r.gap, r.broken) for r in files.replay(spark, f"file://{tmp_path}/r", schema).collect()}
    assert got == {("a", 0): (False, False), ("a", 1): (False, False), ("b", 0): (False, False), ("b", 1): (False, True), ("c", 0): (False, False), ("c", 2): (True, False)}


def test_labelled_rows_are_the_same_every_time(spark, data):
    path = f"{data}/task_rows.parquet"
    a, b = (files.labelled(spark, path, "state", "label", "row_id", 20, seed=s) for s in (1, 1))
    assert a.collect() == b.collect() and a.count() == 20 and a.where("label is null").isEmpty()


def run_stream(spark, frame, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    q = frame(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_reliability_stream_like_batch(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, float(i % 2)) for i in range(30)]
    schema = "k string, t long, y double"
    want = {r.k: r.estimate for r in st.reliability(spark.createDataFrame(rows, schema), "k", "t", "y", ranges=3).collect()}
    got = {r.k: r.estimate for r in run_stream(spark, lambda s: st.stream_reliability(s, "k", "t", "y"), tmp_path, rows, schema, "rel")}
    assert got == pytest.approx(want)


def test_trigger_stream_forgets(spark, tmp_path):
    rows = [("s", 0, 5.0), ("s", 10, 1.0), ("s", 100, 2.0)]
    got = {r.t: (r.n, r.best) for r in run_stream(spark, lambda s: st.stream_triggers(s, "k", "t", "v", 10.0), tmp_path, rows, "k string, t long, v double", "trig")}
    assert got == {0: (0, None), 10: (1, 5.0), 100: (0, None)}


def test_requests_as_a_stream(spark, tmp_path):
    schema, out = "i long, t string", []
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(f"{tmp_path}/in")
    q = st.stream_answers(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda b: b.withColumn("u", F.upper("t")), lambda df, n: out.extend(df.collect()), f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.u for r in out) == ["A", "B"]


def test_observed_counters(spark):
    df, seen = st.observed(spark.range(10), "n", n=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    df.collect()
    assert seen.get == {"n": 10, "even": 5}


def test_hot_keys_are_folded_in_ranges(spark):
    rows = [("hot", t, float(t % 5 == 0)) for t in range(500)] + [("cold", 499, 1.0), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, y double")
    estimate = 0.8
    for t in range(500):
        estimate = 0.999 * estimate + 0.001 * (t % 5 == 0)
    got = {r.k: (r.n, r.estimate) for r in st.reliability(df, "k", "t", "y", keep=0.999, ranges=7).collect()}
    assert got["hot"] == (500, pytest.approx(estimate)) and got["cold"] == (1, pytest.approx(0.8 * 0.999 + 0.001))
    ages = {(r.k, r.t): r.age for r in st.fact_age(df, "k", "t", ranges=7).collect()}
    assert ages["hot", 0] is None and set(ages["hot", t] for t in range(1, 500)) == {1} and len(ages) == 502
    assert st.fact_age(df.limit(0), "k", "t").count() == 0 and st.reliability(df.limit(0), "k", "t", "y").count() == 0
