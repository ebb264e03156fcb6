"""Requests: validation with all errors collected, the exact lane, and the shaping of answers."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decidra.functions.scores import norm

# Limits and kinds of questions.
MAX_CHOICES, MAX_LEVELS, MAX_QUESTIONS = 255, 10, 64
KINDS = ("noul", "choice", "score", "box")


def latest(requests: DataFrame, key: str = "request_id", order: str = "ingested_at") -> DataFrame:
    """One row per request: the latest delivery. Deliveries of one request combine before they are shuffled."""
    others = [c for c in requests.columns if c not in (key, order)]
    best = requests.groupBy(key).agg(F.max(F.struct(order, *others)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in requests.columns if c != key))


def question_errors(kind: Column, criteria: Column) -> Column:
    """The errors of one question as an array of texts; criteria are JSON."""
    shape = F.when(criteria.isNull(), "none").when(F.json_array_length(criteria).isNotNull(), "list").when(F.json_object_keys(criteria).isNotNull(), "object").otherwise("other")
    keys = F.coalesce(F.json_object_keys(criteria), F.expr("cast(array() as array<string>)"))
    n = F.when(shape == "list", F.json_array_length(criteria)).otherwise(F.size(keys))
    checks = [
        F.when(kind.isNull(), "type: union_tag_not_found").when(~kind.isin(*KINDS), "type: union_tag_invalid"),
        F.when((kind == "choice") & (shape == "none"), "criteria: missing").when((kind == "choice") & (shape != "object"), "criteria: dict_type").when((kind == "choice") & (n < 1), "criteria: too_short").when((kind == "choice") & (n > MAX_CHOICES), "criteria: too_long"),
        F.when((kind == "score") & (shape == "none"), "criteria: missing").when((kind == "score") & (shape != "list"), "criteria: list_type").when((kind == "score") & (n < 1), "criteria: too_short").when((kind == "score") & (n > MAX_LEVELS), "criteria: too_long"),
        F.when((kind == "noul") & (shape != "none") & ((shape != "object") | (F.size(F.array_except(keys, F.array(F.lit("true"), F.lit("false")))) > 0)), "criteria: noul_criteria"),
    ]
    return F.array_compact(F.array(*checks))


def validate(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """(request_id, errors): every error of every request, in order; valid requests have an empty array."""
    each = questions.select("request_id", "pos", "qname", question_errors(F.col("qtype"), F.col("criteria")).alias("e"))
    flat = each.select("request_id", "pos", F.explode(F.transform("e", lambda x: F.concat_ws(".", F.lit("questions"), F.coalesce("qname", F.lit("")), x))).alias("e"))
    of = flat.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("qe"))
    count = questions.groupBy("request_id").agg(F.count("*").alias("nq"))
    body = requests.join(of, "request_id", "left").join(count, "request_id", "left")
    own = F.array_compact(F.array(
        F.when(F.col("model").isNull(), "model: missing"), F.when(F.col("state").isNull(), "state: missing"),
        F.when(F.col("nq").isNull(), "questions: too_short").when(F.col("nq") > MAX_QUESTIONS, "questions: too_long"),
        F.when(F.col("assets").isNotNull() & F.json_object_keys("assets").isNull(), "assets: dict_type"),
    ))
    return body.select("request_id", F.concat(own, F.transform(F.coalesce("qe", F.expr("cast(array() as array<struct<pos:int,e:string>>)")), lambda x: x["e"])).alias("errors"))


def _flatten(value, top: bool, sep: str) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, dict):
        return (sep if top else "; ").join(f"{k}: {t}" if (t := _flatten(v, False, sep)) else str(k) for k, v in value.items())
    if isinstance(value, list):
        return (sep if top else "; ").join(t for t in (_flatten(v, False, sep) for v in value) if t)
    return json.dumps(value)


def _one_text(state: str | None) -> str | None:
    try:
        return None if state is None else _flatten(json.loads(state), True, "\n")
    except ValueError:
        return state.strip()


@F.arrow_udf(T.StringType())  # type: ignore[call-overload]
def _state_text(states: pa.Array) -> pa.Array:
    return pa.array([_one_text(s) for s in states.to_pylist()], pa.string())


def state_text(state: Column, kind: Column) -> Column:
    """The state as text: one ``key: value`` line per field of an object, one line per item of an array."""
    return F.when(kind.isin("object", "array"), _state_text(F.when(kind.isin("object", "array"), state))).otherwise(F.trim(state, F.lit(" \t\r\n")))


def _clean(name: object) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).lower()).strip("_")


def _fields(state: str) -> dict[str, str]:
    """JSON of the first value, breadth first and three levels deep, of each cleaned key of a state."""
    found: dict[str, str] = {}
    try:
        level = [json.loads(state)]
    except ValueError:
        return found
    for _ in range(3):
        own = [kv for d in level if isinstance(d, dict) for kv in d.items()]
        for k, v in own:
            found.setdefault(_clean(k), json.dumps(v))
        level = [v for _, v in own]
    return found


@F.arrow_udf(T.StringType())  # type: ignore[call-overload]
def _find_field(states: pa.Array, names: pa.Array) -> pa.Array:
    read: dict[str, dict[str, str]] = {}  # a state is parsed once for all its questions in a batch
    out = []
    for state, name in zip(states.to_pylist(), names.to_pylist()):
        if state is None:
            out.append(None)
            continue
        if state not in read:
            read[state] = _fields(state)
        out.append(read[state].get(_clean(name or "")))
    return pa.array(out, pa.string())


def find_field(state: Column, name: Column) -> Column:
    """JSON of the first value, breadth first and three levels deep, whose key is the name but for case and punctuation."""
    return _find_field(state, name)


def exact_answers(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """(request_id, pos, qname, qtype, answer, lane): questions read off an object state, or with a single option.

    ``answer`` is "true"/"false" for yes/no questions, the option for choices, the level for scores; null where another
    lane must answer.
    """
    rows = questions.join(requests.select("request_id", "state", "state_kind"), "request_id")
    keys = F.coalesce(F.json_object_keys("criteria"), F.expr("cast(array() as array<string>)"))
    n = F.when(F.col("qtype") == "score", F.coalesce(F.json_array_length("criteria"), F.lit(0))).otherwise(F.size(keys))
    value = F.when(F.col("state_kind") == "object", find_field(F.when(F.col("state_kind") == "object", F.col("state")), F.col("qname")))
    rows = rows.withColumn("_v", value).withColumn("_k", keys).withColumn("_n", n)
    text = F.when(F.col("_v").rlike('^"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col("_v"), F.lit("}")), "$.v"))
    plain = F.lower(F.trim(F.coalesce(text, F.when(F.col("_v").isin("true", "false"), F.col("_v")))))
    hits = F.filter("_k", lambda k: norm(k) == norm(F.coalesce(text, F.when(F.col("_v").isin("true", "false"), F.initcap("_v")))))
    level = F.when(F.col("_v").rlike(r"^-?\d+(\.0+)?$"), F.col("_v").try_cast("double").cast("int"))
    forced = F.when((F.col("qtype") == "choice") & (F.col("_n") == 1), F.col("_k")[0]).when((F.col("qtype") == "score") & (F.col("_n") == 1), "0")
    read = (
        F.when((F.col("qtype") == "noul") & plain.isin("true", "yes"), "true").when((F.col("qtype") == "noul") & plain.isin("false", "no"), "false")
        .when((F.col("qtype") == "choice") & (F.size(hits) == 1), hits[0]).when((F.col("qtype") == "score") & (level >= 0) & (level < F.col("_n")), level.cast("string"))
    )
    answer = F.coalesce(forced, read)
    return rows.select("request_id", "pos", "qname", "qtype", answer.alias("answer"), F.when(answer.isNotNull(), "exact").when(F.col("qtype") == "noul", "nli").otherwise("matcher").alias("lane"))
