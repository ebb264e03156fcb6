"""Queries of the decision engine over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions import facts as ff
from decidra.functions import scores as sc
from decidra.operators import evaluation as ev
from decidra.operators import metrics, models, retrieval, slots, trust, units
from decidra.plans import executor
from decidra.plans import systemone as so
from decidra.plans.program import compile_instruction
from decidra.session import bounded_broadcast, cut_lineage, table
from decidra.sources import files
from decidra.sources import requests as rq
from decidra.streaming import state as st

LEXI = "meets the quality floor 20; minimize retail price, then part key"
FLOOR = "permitted; quality at least 0; maximize balance"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("retail price "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("; quality "), F.col("p_size").cast("string"), F.lit("; part key "), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_brand").alias("decision_id"), F.col("p_partkey").alias("candidate_id"), text.alias("text"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.when(F.col("s_suppkey") % 3 == 0, "not permitted").otherwise("permitted")
    text = F.concat(allowed, F.lit("; balance "), F.col("s_acctbal").cast("decimal(18,2)").cast("string"), F.lit("; quality 1"))
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("decision_id"), F.col("s_suppkey").alias("candidate_id"), text.alias("text"))


_PARTS_SQL = "SELECT p_brand AS decision_id, p_partkey AS candidate_id, round(p_retailprice, 2) AS price, p_size AS quality FROM part"
_SUPPLIERS_SQL = "SELECT s_nationkey AS decision_id, s_suppkey AS candidate_id, round(s_acctbal, 2) AS balance, s_suppkey % 3 <> 0 AS ok FROM supplier"


def decide_min_lexi(spark, d):
    out = executor.decide(_parts(spark, d), LEXI)
    return out.select("decision_id", "answer", "decision_mode", F.col("eligible").cast("long"), "primary_margin", "trust_state")


def decide_filter_floor(spark, d):
    out = executor.decide(_suppliers(spark, d), FLOOR)
    return out.select("decision_id", "answer", "decision_mode", F.col("eligible").cast("long"))


def decide_abstain(spark, d):
    return executor.decide(_suppliers(spark, d), "permitted; quality at least 2; maximize balance").select("decision_id", "answer", "decision_mode", F.col("eligible").cast("long"))


def decide_band(spark, d):
    """The tolerance band of 0.15: later axes only narrow, the first axis decides among the survivors."""
    return executor.decide(_suppliers(spark, d), "maximize quality, then balance", resolution=0.15).select("decision_id", "answer")


def decide_probabilities(spark, d):
    out = executor.probabilities(_suppliers(spark, d), FLOOR, temperature=500.0)
    return out.select("decision_id", "candidate_id", F.round("probability", 6).alias("probability"))


def decide_certificate(spark, d):
    return executor.certificate(_suppliers(spark, d), FLOOR)


#: Units in which the engine's programs state quantities, as sizes in base units: ms, dollars per million tokens, tokens,
#: megabytes, percent, tokens a second, joules.
PROGRAM_UNITS = {"latency": 1e3, "price": 1e3, "context": 1.0, "memory": 1e6, "quality": 100.0, "throughput": 3600.0, "energy": 1e3}


def _latest_candidates(spark, d):
    return table(spark, d, "candidates").groupBy("decision_id", "candidate_id").agg(F.min("pos").alias("pos"), F.max(F.struct("loaded_at", "text", "catalog_id")).alias("r")).select("decision_id", "candidate_id", "pos", "r.text", "r.catalog_id")


def decide_each(spark, d):
    """All decisions with their own questions over all candidates, quantities read in one unit; deliveries of a candidate count once."""
    decisions = table(spark, d, "decisions").groupBy("decision_id").agg(F.max("question").alias("question"))
    measured = units.with_declared(_latest_candidates(spark, d), table(spark, d, "catalog_units"), table(spark, d, "model_catalogs"))
    known = F.filter("measurements", lambda m: m["base_value"].isNotNull())
    size = F.create_map(*[F.lit(x) for kv in PROGRAM_UNITS.items() for x in kv])
    facts = F.transform(known, lambda m: F.struct(m["quantity"].alias("key"), (m["base_value"] / size[m["quantity"]]).alias("value")))
    return executor.decide_each(decisions, measured.withColumn("facts", facts), "facts")


def decide_questions(spark, d):
    """A question for each brand: those with an even number ask for the cheapest of a least quality, the others for the largest."""
    decisions = table(spark, d, "part").select(F.col("p_brand").alias("decision_id")).distinct()
    question = F.when(F.substring("decision_id", -1, 1).cast("int") % 2 == 0, LEXI).otherwise("maximize quality, then minimize retail price")
    out = executor.decide_each(decisions.withColumn("question", question), _parts(spark, d), pos="candidate_id")
    return out.select("decision_id", "answer", "decision_mode", F.col("eligible").cast("long").alias("eligible"), "primary_margin", "trust_state")


def decide_unread(spark, d):
    """A program with an axis that half of the candidates do not state: the structured lane does not admit it."""
    parts = _parts(spark, d).withColumn("text", F.when(F.col("candidate_id") % 2 == 0, F.concat("text", F.lit("; elegance 3"))).otherwise(F.col("text")))
    return executor.decide(parts, "maximize elegance").select("decision_id", "answer", "decision_mode", "trust_state", "reason")


def decide_survivors(spark, d):
    out = executor.survivors(_suppliers(spark, d), FLOOR)
    return out.groupBy("decision_id", "stage").agg(F.count("*").alias("n"))


def _fact_texts(spark, d):
    text = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit("; quantity "), F.col("l_quantity").cast("int").cast("string"), F.lit("; ship weight: "), F.col("l_linenumber").cast("string"), F.lit("k; quantity = "), F.col("l_partkey").cast("string"), F.lit(" s, no number here"))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), text.alias("t"))


def parse_facts(spark, d):
    found = _fact_texts(spark, d).select("l_orderkey", "l_linenumber", ff.facts(F.col("t")).alias("f"))
    return found.select("l_orderkey", "l_linenumber", *(ff.fact(F.col("f"), k).alias(k) for k in ("quantity", "ship_weight", "absent")), F.size("f").cast("long").alias("facts"))


def enum_filter(spark, d):
    phrase = F.when(F.col("o_orderstatus") == "F", "tools unsupported").when(F.col("o_orderstatus") == "O", "supports tools").otherwise("unknown")
    value = ff.concept_value(phrase, "tool_support")
    return table(spark, d, "orders").groupBy("o_orderstatus", value.alias("value")).agg(F.count("*").alias("n"))


def bm25_scores(spark, d):
    """All documents of plain English tickets' words against the evaluation items that are divisible by 20."""
    items = table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    got = retrieval.bm25(table(spark, d, "documents").where("text is not null"), items)
    return got.select("query_id", "doc_id", F.round("score", 4).alias("score"))


def bm25_df(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(retrieval.terms(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


def _lanes(spark, d):
    o = table(spark, d, "observations")
    pairs = o.select("obs_id", F.posexplode(F.arrays_zip("semantic", "bm25")).alias("pos", "z"))
    return pairs.select("obs_id", F.col("pos").cast("long").alias("pos"), F.col("z.semantic").alias("semantic"), F.col("z.bm25").alias("bm25"))


def rrf_fusion(spark, d):
    rows = _lanes(spark, d)
    a, b = rows.select("obs_id", "pos", F.col("semantic").alias("score")), rows.select("obs_id", "pos", F.col("bm25").alias("score"))
    return retrieval.rrf(a, b, "obs_id", "pos").select("obs_id", "pos", F.round("rrf", 9).alias("rrf"))


def select_state(spark, d):
    rows = rq.latest(table(spark, d, "requests").select("request_id", "state", "ingested_at"))
    asked = table(spark, d, "questions").groupBy("request_id").agg(F.min(F.struct("pos", "instructions"))["instructions"].alias("q"))
    return retrieval.select_sentences(rows.join(asked, "request_id"), "request_id", "state", "q", 92)


def cosine_match(spark, d):
    """Each vector against the mean vector of each label: the best label and its lead.

    Vectors and means are flattened to (dimension, value) rows and joined on the dimension; the products are sums that
    combine before they are shuffled, whatever the number of labels.
    """
    vectors = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    flat = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    means = flat.groupBy("label", "i").agg(F.avg("x").alias("m"))
    norms = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mn"))
    scaled = cut_lineage(means.join(norms, "label").select(F.col("label").alias("candidate"), "i", (F.col("m") / F.col("mn")).alias("m")))
    lengths = vectors.select("vec_id", F.sqrt(sc.dot(F.col("embedding"), F.col("embedding"))).alias("n"))
    products = flat.select("vec_id", "i", "x").join(bounded_broadcast(scaled), "i").groupBy("vec_id", "candidate").agg(F.sum(F.col("x") * F.col("m")).alias("p"))
    scored = products.join(lengths, "vec_id").select("vec_id", "candidate", F.round(F.col("p") / F.col("n"), 9).alias("c"))
    best = models.best_two(cut_lineage(scored), "vec_id", "candidate", "c")
    return best.select("vec_id", F.col("candidate").cast("long").alias("label"), F.round("margin", 4).alias("lead"))


def softmax_temperature(spark, d):
    rows = table(spark, d, "observations").select("obs_id", sc.softmax(F.col("semantic"), sc.temperature(F.lit("choice"), F.size("semantic"))).alias("p"))
    return rows.select("obs_id", F.posexplode("p").alias("pos", "p")).select("obs_id", F.col("pos").cast("long").alias("pos"), F.round("p", 6).alias("p"))


def fit_temperature(spark, d):
    rows = table(spark, d, "observations").select("semantic", (F.array_position("bm25", F.array_max("bm25")) - 1).cast("int").alias("y"))
    return spark.createDataFrame([(float(metrics.temperature_grid(rows, "semantic", "y")),)], "temperature double")


def _graded(spark, d):
    o = table(spark, d, "observations").where("risk is not null")
    return o.select("obs_id", F.col("risk"), (1 - F.col("risk")).alias("confidence"), ((F.col("n_required_missing") + F.col("n_ambiguous")) > 0).cast("int").alias("error"))


def ece15(spark, d):
    return metrics.ece(_graded(spark, d), "risk", "error", 15).select(F.round("ece", 6).alias("ece"))


def ece10_right(spark, d):
    return metrics.ece(_graded(spark, d), "risk", "error", 10, right_closed=True).select(F.round("ece", 6).alias("ece"))


def brier_nll(spark, d):
    return metrics.binary_losses(_graded(spark, d), "risk", "error").select(F.round("brier", 6).alias("brier"), F.round("nll", 6).alias("nll"))


def auroc(spark, d):
    return metrics.auroc(_graded(spark, d), "risk", "error").select(F.round("auroc", 6).alias("auroc"))


def auprc(spark, d):
    return metrics.auprc(_graded(spark, d), "risk", "error", "obs_id").select(F.round("auprc", 6).alias("auprc"))


def risk_coverage(spark, d):
    return metrics.risk_coverage(_graded(spark, d), "risk", "obs_id").select(F.col("coverage"), F.round("risk", 3).alias("risk"))


def ranking_quality(spark, d):
    rows = _lanes(spark, d)
    ranked = retrieval.rank(rows, "semantic", ["obs_id"], "pos")
    return metrics.ranking_quality(ranked.select("obs_id", "pos", "rank"), rows.where("bm25 > 0").select("obs_id", "pos", F.col("bm25").alias("gain")), "obs_id", "pos", "gain", 3).select("obs_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")))


def lane_agreement(spark, d):
    seen = trust.observe(table(spark, d, "observations"))
    return seen.where("lane_agree is not null").agg(F.round(F.avg("lane_agree"), 6).alias("agreement"), F.count("*").alias("n"))


def observation_features(spark, d):
    seen = trust.observe(table(spark, d, "observations")).where("candidate_count > 0")
    names = ["semantic_top1", "semantic_top2", "semantic_margin", "semantic_top1_z", "bm25_top1", "bm25_margin", "lane_agree", "score_entropy", "top1_share"]
    return seen.select("obs_id", F.col("candidate_count").cast("long").alias("candidate_count"), *(F.round(c, 5).alias(c) for c in names))


def trust_policy(spark, d):
    seen = trust.observe(table(spark, d, "observations"))
    decided = seen.select("obs_id", trust.policy(F.col("risk"), F.col("n_required_missing"), F.col("n_ambiguous"), F.col("lane_agree"), F.col("semantic_margin"), F.col("candidate_count")).alias("decision"))
    return decided


def decile_risk(spark, d):
    rows = _graded(spark, d)
    edges, rates = trust.decile_rates(rows, "confidence", "error")
    return rows.select("obs_id", F.round(trust.decile_risk(F.col("confidence"), edges, rates), 6).alias("decile_risk"))


def logistic_risk(spark, d):
    seen = trust.observe(table(spark, d, "observations").where("risk is not null")).withColumn("error", (F.col("risk") > 0.5).cast("int"))
    names = ["semantic_margin", "bm25_margin", "lane_agree", "score_entropy"]
    w, b, scale = trust.fit_logistic(seen, names, "error")
    return seen.select("obs_id", F.round(trust.logistic_risk(names, w, b, scale), 4).alias("logistic_risk"))


SUPPORT = slots.Tool("support", "support", args=(slots.Arg("mail", "email", required=True), slots.Arg("day", "date"), slots.Arg("ticket", "id"), slots.Arg("shift", "enum", enum=("late", "night", "early"))))


def _states(spark, d):
    return rq.latest(table(spark, d, "requests").where("state is not null").select("request_id", "state", "ingested_at"))


def slot_states(spark, d):
    got = slots.extract_all(_states(spark, d), "state", SUPPORT)
    return got.select("request_id", *(F.col("slots")[n]["state"].alias(n) for n in ("mail", "day", "shift")))


def compile_calls(spark, d):
    got = slots.compile_call(slots.extract_all(_states(spark, d), "state", SUPPORT), SUPPORT)
    return got.groupBy(F.col("call.outcome").alias("outcome")).agg(F.count("*").alias("n"))


def request_validation(spark, d):
    requests = rq.latest(table(spark, d, "requests"))
    return rq.validate(requests, table(spark, d, "questions")).select("request_id", F.explode("errors").alias("error"))


def exact_lane(spark, d):
    return rq.exact_answers(rq.latest(table(spark, d, "requests").select("request_id", "state", "state_kind", "ingested_at")), table(spark, d, "questions"))


def lane_counts(spark, d):
    return exact_lane(spark, d).groupBy("qtype", "lane").agg(F.count("*").alias("n"))


def latest_requests(spark, d):
    return rq.latest(table(spark, d, "requests")).select("request_id", "model", "channel", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"))


def input_tokens(spark, d):
    states = rq.latest(table(spark, d, "requests").select("request_id", "state", "model", "ingested_at"))
    return states.where("state is not null").groupBy(F.coalesce("model", F.lit("standard")).alias("model")).agg(F.sum(retrieval.token_count(F.col("state"))).alias("tokens"), F.count("*").alias("n"))


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


def fact_age(spark, d):
    return st.fact_age(_events(spark, d), "user_id", "event_id").select("event_id", "user_id", "age")


def seen_within(spark, d):
    got = st.seen_within(_events(spark, d), "user_id", "event_id", 100)
    return got.groupBy("event_type", "seen_within").agg(F.count("*").alias("n"))


def ema_reliability(spark, d):
    rows = _events(spark, d).withColumn("ok", F.col("event_type") != "error")
    return st.reliability(rows, "event_type", "event_id", "ok").select("event_type", "n", F.round("estimate", 6).alias("estimate"))


def user_reliability(spark, d):
    rows = _events(spark, d).withColumn("ok", F.col("event_type") != "error")
    got = st.reliability(rows, "user_id", "event_id", "ok")
    return got.select("user_id", "n", F.round("estimate", 6).alias("estimate"), F.round(sc.lower_bound(F.col("estimate"), F.col("n")), 6).alias("bound"))


def trigger_decay(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max("event_id").alias("now"))
    weight = sc.decayed(F.lit(1.0), F.col("now") - F.col("event_id"), 2000.0)
    aged = e.crossJoin(bounded_broadcast(now)).withColumn("weight", weight).where(F.col("weight") >= 0.1)
    return aged.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 5).alias("weight"))


def pairwise_potential(spark, d):
    """Mean of the antisymmetric comparison over all others of a decision: with a comparator that is a difference of scores it is a sum, and no pairs are made."""
    rows = _lanes(spark, d)
    total = rows.groupBy("obs_id").agg(F.sum("semantic").alias("t"), F.count("*").alias("n"))
    q = F.when(F.col("n") > 1, (F.col("semantic") * F.col("n") - F.col("t")) / (F.col("n") - 1)).otherwise(0.0)
    return rows.join(total, "obs_id").select("obs_id", "pos", F.round(q, 6).alias("potential"))


def state_texts(spark, d):
    rows = rq.latest(table(spark, d, "requests").select("request_id", "state", "state_kind", "ingested_at"))
    return rows.select("request_id", rq.state_text(F.col("state"), F.col("state_kind")).alias("text"))


def multiclass_losses(spark, d):
    rows = table(spark, d, "observations").select(sc.softmax(F.col("semantic"), 0.05).alias("p"), (F.array_position("bm25", F.array_max("bm25")) - 1).cast("int").alias("y")).where("size(p) > 0 and y >= 0")
    return ev.multiclass_losses(rows, "p", "y").select(F.round("brier", 6).alias("brier"), F.round("nll", 6).alias("nll"))


def coverage_at_risk(spark, d):
    return ev.coverage_at_risk(_graded(spark, d), "risk")


def prefix_curve(spark, d):
    got = ev.prefix_curve(_graded(spark, d), "risk", "error")
    return got.select("k", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"), "threshold")


def curve_points(spark, d):
    curve = ev.prefix_curve(_graded(spark, d), "risk", "error")
    a = ev.risk_at(curve, 0.5).select(F.lit("risk at 0.5").alias("point"), F.round("risk", 6).alias("value"))
    return a.unionAll(ev.coverage_at(curve, 0.6).select(F.lit("coverage at 0.6"), F.round("coverage", 6)))


def latency_p95(spark, d):
    return ev.order_statistic(table(spark, d, "events"), "value", 0.95)


def label_accuracy(spark, d):
    """Priced quantity bands of lines against their bands by number."""
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 10).cast("int").alias("y"), F.floor(F.col("l_extendedprice") / 12000).cast("int").alias("p"))
    return ev.accuracy(rows, "p", "y").select("n", F.round("accuracy", 6).alias("accuracy"), F.round("within_one", 6).alias("within_one"))


def _two_lanes(spark, d):
    return _lanes(spark, d).where("semantic is not null and bm25 is not null")


def winner_agreement(spark, d):
    return ev.winner_agreement(_two_lanes(spark, d), "obs_id", "pos", "semantic", "bm25").select("decisions", F.round("agreement", 6).alias("agreement"))


def sign_accuracy(spark, d):
    return ev.sign_accuracy(_two_lanes(spark, d), "obs_id", "pos", "semantic", "bm25", 4).select("pairs", F.round("accuracy", 6).alias("accuracy"))


def relation_crosstab(spark, d):
    rows = table(spark, d, "observations").where("size(semantic) > 1 and size(bm25) > 1")
    pair = rows.select(*(F.col(c)[k].alias(f"{c}{k}") for c in ("semantic", "bm25") for k in (0, 1)))
    return ev.relation_crosstab(pair, "semantic0", "semantic1", "bm250", "bm251")


def top_set_agreement(spark, d):
    return ev.top_set_agreement(_two_lanes(spark, d), "obs_id", "pos", "semantic", "bm25").select("decisions", F.round("agreement", 6).alias("agreement"), F.round("chance", 6).alias("chance"))


def full_order_agreement(spark, d):
    return ev.full_order_agreement(_two_lanes(spark, d), "obs_id", "pos", "semantic", "bm25").select("decisions", F.round("agreement", 6).alias("agreement"))


def certificate_counts(spark, d):
    got = ev.certificates(_two_lanes(spark, d), "obs_id", "pos", "semantic", 0.03)
    return got.groupBy("certified").agg(F.count("*").alias("n"), F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), F.sum("open").alias("open"))


def margin_bins(spark, d):
    seen = trust.observe(table(spark, d, "observations")).where("lane_agree is not null")
    return ev.agreement_by_margin(seen, "semantic_margin", "lane_agree").select("bin", "n", F.round("agreement", 6).alias("agreement"))


def lane_divergence(spark, d):
    rows = table(spark, d, "observations").where("size(semantic) > 0")
    kl = ev.divergence(sc.softmax(F.col("semantic"), 0.1), sc.softmax(F.col("semantic"), 0.2))
    return rows.select("obs_id", F.round(kl, 6).alias("kl"))


def calibration_radius(spark, d):
    rows = _graded(spark, d).withColumn("off", F.col("risk") - F.col("error"))
    return ev.calibration_radius(rows, "off").select(F.round("radius", 9).alias("radius"))


def graph_degrees(spark, d):
    """Customers and the days of their orders as a graph."""
    return ev.degrees(table(spark, d, "orders").select("o_custkey", (F.to_date("o_orderdate").cast("string")).alias("day"), (-F.col("o_orderkey")).alias("o")), "o_custkey", "o")


def graph_components(spark, d):
    """Components of parts that were ordered together, by number of parts."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    first = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("hub"))
    got = ev.components(lines.join(first, "l_orderkey").where("l_partkey <> hub").select("l_partkey", "hub").distinct(), "l_partkey", "hub")
    return got.groupBy("component").agg(F.count("*").alias("parts"))


def bootstrap_interval(spark, d):
    rows = trust.observe(table(spark, d, "observations")).where("candidate_count > 0")
    return ev.bootstrap(rows, "obs_id", "semantic_margin").select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def noise_stability(spark, d):
    return ev.stability(_two_lanes(spark, d), "obs_id", "pos", "semantic", 0.02)


def object_calls(spark, d):
    """Calls of a tool with a nested argument: a contact of mail and phone, which an optional day goes with."""
    contact = slots.Arg("contact", "object", required=True, fields=(slots.Arg("mail", "email", required=True), slots.Arg("ticket", "id")))
    tool = slots.Tool("callback", "callback", args=(contact, slots.Arg("day", "date")))
    got = slots.compile_call(slots.extract_all(_states(spark, d), "state", tool), tool)
    return got.select("request_id", F.col("call.outcome").alias("outcome"), F.array_join("call.missing", ",").alias("missing"), F.array_join("call.ambiguous", ",").alias("ambiguous"))


def mail_slots(spark, d):
    """The e-mail address of each state as a typed slot, with its place."""
    got = _states(spark, d).withColumn("s", slots.extract_slot(F.col("state"), slots.Arg("mail", "email")))
    return got.select("request_id", F.col("s.state").alias("slot_state"), F.col("s.value").alias("value"), F.col("s.start").cast("long").alias("start"), F.size("s.candidates").cast("long").alias("candidates"))


def request_errors(spark, d):
    """Requests by the number of their questions that have no valid type or criteria."""
    each = table(spark, d, "questions").select("request_id", F.size(rq.question_errors(F.col("qtype"), F.col("criteria"))).alias("n"))
    return each.groupBy("request_id").agg(F.sum("n").cast("long").alias("errors"))


def json_bodies(spark, d):
    """Requests written as JSON bodies and read back: their questions."""
    body = F.to_json(F.struct(F.lit("standard").alias("model"), F.lit("x").alias("state"), F.create_map(F.coalesce("qname", F.lit("q")), F.struct(F.col("qtype").alias("type"), "instructions")).alias("questions")))
    rows = table(spark, d, "questions").groupBy("request_id").agg(F.min(F.struct("pos", "qname", "qtype", "instructions")).alias("q")).select("request_id", "q.*").withColumn("body", body)
    _, questions, _ = files.json_requests(rows, "body", "request_id")
    return questions.select("request_id", "qname", "qtype", "instructions")


def trust_controls(spark, d):
    """Risks of the six controls on the odd observations, fitted on the even ones."""
    seen = trust.observe(table(spark, d, "observations").where("risk is not null")).where("candidate_count > 0").withColumn("error", (F.col("risk") > 0.5).cast("int"))
    got = trust.controls(seen, "error", F.col("obs_id") % 2 == 0)
    return got.select("obs_id", *(F.round(c, 6).alias(c) for c in ("a_top1", "b_margin", "c_top1_margin", "d_lane_agree", "e_ood", "f_logistic")))


def system_one(spark, d):
    """All questions of the latest deliveries, answered with the stand-in models."""
    asked = rq.latest(table(spark, d, "requests").select("request_id", "state", "state_kind", "ingested_at"))
    return so.answer(asked, table(spark, d, "questions")).select("request_id", "pos", "qname", "qtype", "lane", "answer", "confidence")


def text_match(spark, d):
    """The evaluation item nearest to each decision's state, by the hashed bag of words."""
    states = table(spark, d, "decisions").where("state is not null").groupBy("decision_id").agg(F.max("state").alias("state"))
    return models.match(states, table(spark, d, "eval_items"), "decision_id", "state", "item_id", "text").select("decision_id", "item_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    decide_min_lexi, decide_filter_floor, decide_abstain, decide_band, decide_probabilities, decide_certificate, decide_each, decide_questions, decide_unread, decide_survivors, parse_facts, enum_filter, bm25_scores, bm25_df, rrf_fusion, select_state, cosine_match,
    softmax_temperature, fit_temperature, ece15, ece10_right, brier_nll, auroc, auprc, risk_coverage, ranking_quality, lane_agreement, observation_features, trust_policy, decile_risk, logistic_risk, slot_states, compile_calls,
    request_validation, exact_lane, lane_counts, latest_requests, input_tokens, fact_age, seen_within, ema_reliability, user_reliability, trigger_decay, pairwise_potential, state_texts, multiclass_losses, coverage_at_risk, prefix_curve, curve_points, latency_p95, label_accuracy, winner_agreement, sign_accuracy, relation_crosstab,
    top_set_agreement, full_order_agreement, certificate_counts, margin_bins, lane_divergence, calibration_radius, graph_degrees, graph_components, bootstrap_interval, noise_stability, trust_controls, system_one, text_match,
    object_calls, mail_slots, request_errors, json_bodies,
)}

_GRADED = "(SELECT obs_id, risk, 1 - risk AS confidence, CASE WHEN n_required_missing + n_ambiguous > 0 THEN 1 ELSE 0 END AS error FROM observations WHERE risk IS NOT NULL)"
_LANES = "(SELECT obs_id, (i - 1)::BIGINT AS pos, semantic[i] AS semantic, bm25[i] AS bm25 FROM (SELECT obs_id, semantic, bm25, unnest(range(1, len(semantic) + 1)) AS i FROM observations))"
_LATEST = "(SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ingested_at DESC) = 1)"

SQL = {
    "decide_min_lexi": f"""WITH c AS ({_PARTS_SQL}), e AS (SELECT *, quality >= 20 AS ok FROM c),
        w AS (SELECT decision_id, candidate_id, price FROM e WHERE ok QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY price, candidate_id) = 1),
        o AS (SELECT e.decision_id, min(e.price) AS other FROM e JOIN w USING (decision_id) WHERE e.ok AND e.candidate_id <> w.candidate_id GROUP BY 1),
        g AS (SELECT decision_id, count_if(ok)::BIGINT AS eligible FROM e GROUP BY 1)
        SELECT g.decision_id, w.candidate_id AS answer, CASE WHEN w.candidate_id IS NULL THEN 'abstain' ELSE 'structured' END AS decision_mode, eligible, round(other - price, 4) AS primary_margin,
        CASE WHEN w.candidate_id IS NULL THEN 'abstain' WHEN other IS NULL OR round(other - price, 4) > 0 THEN 'confident' ELSE 'tie' END AS trust_state FROM g LEFT JOIN w USING (decision_id) LEFT JOIN o USING (decision_id)""",
    "decide_filter_floor": f"""WITH c AS ({_SUPPLIERS_SQL}), w AS (SELECT decision_id, candidate_id FROM c WHERE ok QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY balance DESC, candidate_id) = 1)
        SELECT g.decision_id, w.candidate_id AS answer, CASE WHEN w.candidate_id IS NULL THEN 'abstain' ELSE 'structured' END AS decision_mode, eligible FROM (SELECT decision_id, count_if(ok)::BIGINT AS eligible FROM c GROUP BY 1) g LEFT JOIN w USING (decision_id)""",
    "decide_abstain": "SELECT s_nationkey AS decision_id, CAST(NULL AS BIGINT) AS answer, 'abstain' AS decision_mode, 0::BIGINT AS eligible FROM supplier GROUP BY 1",
    "decide_band": f"""WITH c AS ({_SUPPLIERS_SQL}), b AS (SELECT *, max(balance) OVER (PARTITION BY decision_id) AS best FROM c), t AS (SELECT *, (CASE WHEN ok THEN 'permitted' ELSE 'not permitted' END) || '; balance ' || printf('%.2f', balance) || '; quality 1' AS text FROM b WHERE best - balance <= 0.15)
        SELECT decision_id, candidate_id AS answer FROM t QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY text, candidate_id) = 1""",
    "decide_probabilities": f"""WITH c AS ({_SUPPLIERS_SQL}), e AS (SELECT *, CASE WHEN ok THEN exp((balance - max(CASE WHEN ok THEN balance END) OVER (PARTITION BY decision_id)) / 500.0) END AS x FROM c)
        SELECT decision_id, candidate_id, round(coalesce(x / sum(x) OVER (PARTITION BY decision_id), 0.0), 6) AS probability FROM e""",
    "decide_certificate": f"""WITH c AS ({_SUPPLIERS_SQL}) SELECT decision_id, candidate_id, 'FILTER permitted' AS stage, CASE WHEN ok THEN 1.0 ELSE -1.0 END::DOUBLE AS value FROM c
        UNION ALL SELECT decision_id, candidate_id, 'FILTER quality>=0.0', 1.0::DOUBLE FROM c UNION ALL SELECT decision_id, candidate_id, 'MAX balance', balance FROM c""",
    "decide_questions": f"""WITH c AS ({_PARTS_SQL}), e AS (SELECT *, right(decision_id, 1)::INT % 2 = 0 AS even FROM c), f AS (SELECT *, NOT even OR quality >= 20 AS ok, CASE WHEN even THEN price ELSE -quality END AS k0, CASE WHEN even THEN candidate_id ELSE price END AS k1 FROM e),
        w AS (SELECT decision_id, candidate_id, k0 FROM f WHERE ok QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY k0, k1, 'retail price ' || printf('%.2f', price) || '; quality ' || quality || '; part key ' || candidate_id, candidate_id) = 1),
        o AS (SELECT f.decision_id, min(f.k0) AS other FROM f JOIN w USING (decision_id) WHERE f.ok AND f.candidate_id <> w.candidate_id GROUP BY 1), g AS (SELECT decision_id, count_if(ok)::BIGINT AS eligible FROM f GROUP BY 1)
        SELECT g.decision_id, w.candidate_id AS answer, CASE WHEN w.candidate_id IS NULL THEN 'abstain' ELSE 'structured' END AS decision_mode, eligible, round(other - k0, 4)::DOUBLE AS primary_margin,
        CASE WHEN w.candidate_id IS NULL THEN 'abstain' WHEN other IS NULL OR round(other - k0, 4) > 0 THEN 'confident' ELSE 'tie' END AS trust_state FROM g LEFT JOIN w USING (decision_id) LEFT JOIN o USING (decision_id)""",
    "decide_unread": """SELECT p_brand AS decision_id, CASE WHEN bool_and(p_partkey % 2 = 0) THEN min(p_partkey) END AS answer, CASE WHEN bool_and(p_partkey % 2 = 0) THEN 'structured' ELSE 'abstain' END AS decision_mode,
        CASE WHEN bool_and(p_partkey % 2 = 0) THEN 'tie' ELSE 'abstain' END AS trust_state, CASE WHEN NOT bool_and(p_partkey % 2 = 0) THEN 'crux lane disabled' END AS reason FROM part GROUP BY 1""",
    "decide_survivors": f"""WITH c AS ({_SUPPLIERS_SQL}), b AS (SELECT *, max(CASE WHEN ok THEN balance END) OVER (PARTITION BY decision_id) AS best FROM c)
        SELECT decision_id, 'FILTER permitted' AS stage, count(*) AS n FROM b WHERE ok GROUP BY 1 UNION ALL SELECT decision_id, 'FILTER quality>=0.0', count(*) FROM b WHERE ok GROUP BY 1
        UNION ALL SELECT decision_id, 'MAX balance', count(*) FROM b WHERE ok AND balance = best GROUP BY 1""",
    "parse_facts": r"""WITH t AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'order ' || l_orderkey || '; quantity ' || l_quantity::INT || '; ship weight: ' || l_linenumber || 'k; quantity = ' || l_partkey || ' s, no number here' AS t FROM lineitem),
        m AS (SELECT *, '(?i)([a-z][a-z _-]*?)\s*[:=]?\s*(-?[0-9]*\.?[0-9]+)\s*(ms|s|k|m|%)?\b' AS p FROM t),
        f AS (SELECT l_orderkey, l_linenumber, regexp_extract_all(t, '(?i)([a-z][a-z _-]*?)\s*[:=]?\s*(-?[0-9]*\.?[0-9]+)\s*(ms|s|k|m|%)?\b', 1) AS k, regexp_extract_all(t, '(?i)([a-z][a-z _-]*?)\s*[:=]?\s*(-?[0-9]*\.?[0-9]+)\s*(ms|s|k|m|%)?\b', 2) AS n, regexp_extract_all(t, '(?i)([a-z][a-z _-]*?)\s*[:=]?\s*(-?[0-9]*\.?[0-9]+)\s*(ms|s|k|m|%)?\b', 3) AS u FROM m),
        v AS (SELECT l_orderkey, l_linenumber, list_transform(k, lambda x: replace(trim(lower(x)), ' ', '_')) AS k, list_transform(n, lambda x, i: x::DOUBLE * CASE lower(u[i]) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END) AS n FROM f)
        SELECT l_orderkey, l_linenumber, list_filter(n, lambda x, i: k[i] = 'quantity')[-1] AS quantity, list_filter(n, lambda x, i: k[i] = 'ship_weight')[-1] AS ship_weight, list_filter(n, lambda x, i: k[i] = 'absent')[-1] AS absent, len(k) AS facts FROM v""",
    "enum_filter": "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE -1.0 END::DOUBLE AS value, count(*) AS n FROM orders GROUP BY 1, 2",
    "rrf_fusion": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY semantic DESC, pos) - 1 AS a, row_number() OVER (PARTITION BY obs_id ORDER BY bm25 DESC, pos) - 1 AS b FROM {_LANES})
        SELECT obs_id, pos, round(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 9) AS rrf FROM l""",
    "softmax_temperature": f"""WITH l AS (SELECT *, count(*) OVER (PARTITION BY obs_id) AS n, max(semantic) OVER (PARTITION BY obs_id) AS m FROM {_LANES}),
        e AS (SELECT obs_id, pos, exp((semantic - m) / CASE WHEN n <= 2 THEN 0.05 WHEN n <= 5 THEN 0.04239 WHEN n <= 10 THEN 0.06211 ELSE 0.05 END::DOUBLE) AS x FROM l)
        SELECT obs_id, pos, round(x / sum(x) OVER (PARTITION BY obs_id), 6) AS p FROM e""",
    "ece15": f"SELECT round(sum(n * abs(c - y)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(risk) AS c, avg(error) AS y FROM {_GRADED} GROUP BY least(14, floor(risk * 15)))",
    "ece10_right": f"SELECT round(sum(n * abs(c - y)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(risk) AS c, avg(error) AS y FROM {_GRADED} GROUP BY greatest(0, ceil(risk * 10) - 1))",
    "brier_nll": f"SELECT round(avg((risk - error) ** 2), 6) AS brier, round(avg(-(error * ln(q) + (1 - error) * ln(1 - q))), 6) AS nll FROM (SELECT *, least(greatest(risk, 1e-12), 1 - 1e-12) AS q FROM {_GRADED})",
    "auroc": f"""WITH r AS (SELECT error, rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2.0 AS k FROM {_GRADED})
        SELECT round((sum(CASE WHEN error = 1 THEN k END) - sum(error) * (sum(error) + 1) / 2.0) / (sum(error) * (count(*) - sum(error))), 6)::DOUBLE AS auroc FROM r""",
    "auprc": f"""WITH r AS (SELECT error, sum(error) OVER w AS h, row_number() OVER w AS i FROM {_GRADED} WINDOW w AS (ORDER BY risk DESC, obs_id ROWS UNBOUNDED PRECEDING))
        SELECT round(sum(CASE WHEN error = 1 THEN h::DOUBLE / i END) / sum(error), 6)::DOUBLE AS auprc FROM r""",
    "risk_coverage": f"""WITH r AS (SELECT avg(risk) OVER (ORDER BY risk, obs_id ROWS UNBOUNDED PRECEDING) AS m, row_number() OVER (ORDER BY risk, obs_id) AS i, count(*) OVER () AS n FROM {_GRADED}),
        g AS (SELECT unnest([0.10, 0.25, 0.50, 0.75, 0.90, 1.0])::DOUBLE AS coverage) SELECT coverage, round(round(m, 4), 3) AS risk FROM g JOIN r ON i = greatest(1, round_even(coverage * n, 0)::BIGINT)""",
    "ranking_quality": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY semantic DESC, pos) - 1 AS rank, row_number() OVER (PARTITION BY obs_id ORDER BY bm25 DESC, pos) AS ideal FROM {_LANES} WHERE semantic IS NOT NULL)
        SELECT obs_id, round(CASE WHEN sum(CASE WHEN ideal <= 3 AND bm25 > 0 THEN bm25 / log2(ideal + 1) END) > 0 THEN coalesce(sum(CASE WHEN rank < 3 AND bm25 > 0 THEN bm25 / log2(rank + 2) END), 0) / sum(CASE WHEN ideal <= 3 AND bm25 > 0 THEN bm25 / log2(ideal + 1) END) ELSE 0 END, 6) AS ndcg,
        round(count_if(rank < 3 AND bm25 > 0)::DOUBLE / count_if(bm25 > 0), 6) AS recall, round(coalesce(1.0::DOUBLE / (min(CASE WHEN rank < 3 AND bm25 > 0 THEN rank END) + 1), 0), 6) AS mrr FROM l GROUP BY obs_id HAVING count_if(bm25 > 0) > 0""",
    "lane_agreement": f"""WITH l AS (SELECT obs_id, arg_min(pos, (-semantic, pos)) AS s, arg_min(pos, (-bm25, pos)) AS b FROM {_LANES} GROUP BY 1) SELECT round(avg(CASE WHEN s = b THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS agreement, count(*) AS n FROM l""",
    "trust_policy": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY semantic DESC, pos) AS r, row_number() OVER (PARTITION BY obs_id ORDER BY bm25 DESC, pos) AS q FROM {_LANES}),
        f AS (SELECT obs_id, count(*) AS n, max(CASE WHEN r = 1 THEN semantic END) - coalesce(max(CASE WHEN r = 2 THEN semantic END), max(CASE WHEN r = 1 THEN semantic END)) AS margin, max(CASE WHEN r = 1 AND q = 1 THEN 1 ELSE 0 END) AS agree FROM l GROUP BY 1)
        SELECT obs_id, CASE WHEN n_required_missing > 0 OR n_ambiguous > 0 THEN 'ASK_FOR_INFO' WHEN risk <= 0.10 THEN 'ACT' WHEN agree < 0.5 AND margin < 0.15 AND n > 1 THEN 'RERUN_CHEAP_LANE' WHEN risk >= 0.60 THEN 'ESCALATE' ELSE 'ABSTAIN' END AS decision FROM observations LEFT JOIN f USING (obs_id)""",
    "bm25_df": r"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS term FROM documents) GROUP BY 1",
    "bm25_scores": r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT count(*) AS n, greatest(1.0::DOUBLE, avg(len(w))) AS avgdl FROM t), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3),
        df AS (SELECT term, count(*) AS df FROM f GROUP BY 1), q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS term FROM eval_items WHERE item_id % 20 = 0)
        SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(dl, 1) / avgdl))), 4) AS score FROM q JOIN f USING (term) JOIN df USING (term), s GROUP BY 1, 2""",
    "cosine_match": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label AS candidate, i, avg(x) AS m FROM e GROUP BY 1, 2),
        c AS (SELECT vec_id, candidate, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 9) AS c FROM e JOIN m USING (i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, candidate) AS k FROM c)
        SELECT vec_id, max(CASE WHEN k = 1 THEN candidate END)::BIGINT AS label, round(max(CASE WHEN k = 1 THEN c END) - max(CASE WHEN k = 2 THEN c END), 4) AS lead FROM r GROUP BY 1""",
    "observation_features": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY semantic DESC, pos) AS r, row_number() OVER (PARTITION BY obs_id ORDER BY bm25 DESC, pos) AS q, exp((semantic - max(semantic) OVER (PARTITION BY obs_id)) / 0.05::DOUBLE) AS x FROM {_LANES}),
        p AS (SELECT *, x / sum(x) OVER (PARTITION BY obs_id) AS p FROM l), f AS (SELECT obs_id, count(*) AS n, max(semantic) AS s1, coalesce(max(CASE WHEN r = 2 THEN semantic END), max(semantic)) AS s2, avg(semantic) AS mu, stddev_pop(semantic) AS sd, max(bm25) AS b1,
        coalesce(max(CASE WHEN q = 2 THEN bm25 END), max(bm25)) AS b2, max(CASE WHEN r = 1 AND q = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS agree, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS ent, max(CASE WHEN pos = 0 THEN p END) AS share FROM p GROUP BY 1)
        SELECT obs_id, n AS candidate_count, round(s1, 5) AS semantic_top1, round(s2, 5) AS semantic_top2, round(s1 - s2, 5) AS semantic_margin, round(CASE WHEN n > 1 AND sd > 1e-12 THEN (s1 - mu) / sd ELSE 0 END, 5) AS semantic_top1_z, round(b1, 5) AS bm25_top1, round(b1 - b2, 5) AS bm25_margin,
        agree AS lane_agree, round(CASE WHEN n > 1 THEN ent / ln(greatest(n, 2)) ELSE 0 END, 5) AS score_entropy, round(share, 5) AS top1_share FROM f""",
    "ema_reliability": """WITH r AS (SELECT event_type, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS i FROM events)
        SELECT event_type, count(*) AS n, round(0.8::DOUBLE * pow(0.9::DOUBLE, count(*)) + sum(CASE WHEN ok AND i < 600 THEN 0.1::DOUBLE * pow(0.9::DOUBLE, i) ELSE 0 END), 6) AS estimate FROM r GROUP BY 1""",
    "input_tokens": rf"""SELECT coalesce(model, 'standard') AS model, sum(floor(len(list_filter(regexp_split_to_array(trim(state), '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) + 2)::BIGINT AS tokens, count(*) AS n FROM {_LATEST} WHERE state IS NOT NULL GROUP BY 1""",
    "latest_requests": f"SELECT request_id, model, channel, ingested_at FROM {_LATEST}",
    "fact_age": "SELECT event_id, user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS age FROM events",
    "seen_within": "SELECT event_type, coalesce(age <= 100, false) AS seen_within, count(*) AS n FROM (SELECT event_type, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS age FROM events) GROUP BY 1, 2",
    "user_reliability": """WITH r AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS i FROM events),
        e AS (SELECT user_id, count(*) AS n, 0.8::DOUBLE * pow(0.9::DOUBLE, count(*)) + sum(CASE WHEN ok THEN 0.1::DOUBLE * pow(0.9::DOUBLE, i) ELSE 0 END) AS estimate FROM r GROUP BY 1)
        SELECT user_id, n, round(estimate, 6) AS estimate, round(estimate - 1.28 * sqrt(estimate * (1 - estimate) / (n + 1)), 6) AS bound FROM e""",
    "trigger_decay": "SELECT user_id, count(*) AS n, round(sum(w), 5) AS weight FROM (SELECT user_id, pow(0.5::DOUBLE, (max(event_id) OVER () - event_id) / 2000.0::DOUBLE) AS w FROM events) WHERE w >= 0.1 GROUP BY 1",
    "pairwise_potential": f"""SELECT a.obs_id, a.pos, round(coalesce(avg(0.5 * ((a.semantic - b.semantic) - (b.semantic - a.semantic))), 0), 6) AS potential FROM {_LANES} a LEFT JOIN {_LANES} b ON a.obs_id = b.obs_id AND a.pos <> b.pos GROUP BY 1, 2""",
    "decile_risk": f"""WITH g AS {_GRADED}, q AS (SELECT quantile_cont(confidence, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM g), b AS (SELECT obs_id, error, len(list_filter(e, lambda x: confidence >= x)) AS bin FROM g, q)
        SELECT obs_id, round(avg(error) OVER (PARTITION BY bin), 6) AS decile_risk FROM b""",
    "multiclass_losses": f"""WITH l AS (SELECT obs_id, pos, exp((semantic - max(semantic) OVER w) / 0.05::DOUBLE) AS x, row_number() OVER (PARTITION BY obs_id ORDER BY bm25 DESC, pos) = 1 AS y FROM {_LANES} WINDOW w AS (PARTITION BY obs_id)), p AS (SELECT *, x / sum(x) OVER (PARTITION BY obs_id) AS p FROM l),
        o AS (SELECT obs_id, sum((p - CASE WHEN y THEN 1 ELSE 0 END) ** 2) AS b, max(CASE WHEN y THEN -ln(greatest(p, 1e-12)) END) AS n FROM p GROUP BY 1) SELECT round(avg(b), 6) AS brier, round(avg(n), 6) AS nll FROM o""",
    "coverage_at_risk": f"""WITH r AS (SELECT avg(risk) OVER (ORDER BY risk, obs_id ROWS UNBOUNDED PRECEDING) AS m, row_number() OVER (ORDER BY risk, obs_id) AS i, count(*) OVER () AS n FROM {_GRADED}),
        g AS (SELECT unnest([0.01, 0.02, 0.05, 0.10, 0.15, 0.20])::DOUBLE AS rate) SELECT rate, round(coalesce(max(CASE WHEN m <= rate + 1e-12 THEN i END), 0) / max(n)::DOUBLE, 4) AS coverage FROM g, r GROUP BY 1""",
    "prefix_curve": f"""WITH r AS (SELECT risk AS threshold, count(*) OVER (ORDER BY risk) AS k, sum(error) OVER (ORDER BY risk) AS f, count(*) OVER () AS n FROM {_GRADED}) SELECT DISTINCT k, round(k / n::DOUBLE, 6) AS coverage, round(f / k::DOUBLE, 6) AS risk, threshold FROM r""",
    "curve_points": f"""WITH r AS (SELECT DISTINCT count(*) OVER (ORDER BY risk) / (count(*) OVER ())::DOUBLE AS c, sum(error) OVER (ORDER BY risk) / (count(*) OVER (ORDER BY risk))::DOUBLE AS r FROM {_GRADED})
        SELECT 'risk at 0.5' AS point, round(arg_min(r, (abs(c - 0.5), c)), 6) AS value FROM r UNION ALL SELECT 'coverage at 0.6', round(coalesce(max(CASE WHEN r <= 0.6 THEN c END), 0), 6) FROM r""",
    "latency_p95": "WITH e AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT value FROM e WHERE i = least(n - 1, floor(0.95 * n)::BIGINT)",
    "label_accuracy": "WITH r AS (SELECT floor(l_quantity / 10)::INT AS y, floor(l_extendedprice / 12000)::INT AS p FROM lineitem) SELECT count(*) AS n, round(avg((p = y)::INT), 6) AS accuracy, round(avg((abs(p - y) <= 1)::INT), 6) AS within_one FROM r WHERE y IS NOT NULL",
    "winner_agreement": f"WITH l AS (SELECT obs_id, arg_min(pos, (-semantic, pos)) AS s, arg_min(pos, (-bm25, pos)) AS b FROM {_LANES} WHERE semantic IS NOT NULL AND bm25 IS NOT NULL GROUP BY 1) SELECT count(*) AS decisions, round(avg((s = b)::INT), 6) AS agreement FROM l",
    "sign_accuracy": f"SELECT count(*) AS pairs, round(avg((sign(x.semantic - y.semantic) = sign(x.bm25 - y.bm25))::INT), 6) AS accuracy FROM {_LANES} x JOIN {_LANES} y ON x.obs_id = y.obs_id AND x.pos < y.pos WHERE x.semantic <> y.semantic",
    "relation_crosstab": """SELECT CASE WHEN semantic[1] - semantic[2] > 0.15::DOUBLE THEN 1 WHEN semantic[2] - semantic[1] > 0.15::DOUBLE THEN -1 ELSE 0 END AS before, CASE WHEN bm25[1] - bm25[2] > 0.15::DOUBLE THEN 1 WHEN bm25[2] - bm25[1] > 0.15::DOUBLE THEN -1 ELSE 0 END AS after, count(*) AS n FROM observations WHERE len(semantic) > 1 AND len(bm25) > 1 GROUP BY 1, 2""",
    "top_set_agreement": f"""WITH l AS (SELECT *, max(semantic) OVER (PARTITION BY obs_id) = semantic AS top, row_number() OVER (PARTITION BY obs_id ORDER BY bm25 DESC, pos) = 1 AS win FROM {_LANES} WHERE semantic IS NOT NULL AND bm25 IS NOT NULL),
        g AS (SELECT obs_id, max((top AND win)::INT) AS hit, avg(top::INT) AS chance FROM l GROUP BY 1) SELECT count(*) AS decisions, round(avg(hit), 6) AS agreement, round(avg(chance), 6) AS chance FROM g""",
    "full_order_agreement": f"""WITH l AS (SELECT obs_id, row_number() OVER (PARTITION BY obs_id ORDER BY semantic DESC, pos) = row_number() OVER (PARTITION BY obs_id ORDER BY bm25 DESC, pos) AS same FROM {_LANES} WHERE semantic IS NOT NULL AND bm25 IS NOT NULL),
        g AS (SELECT obs_id, bool_and(same)::INT AS same FROM l GROUP BY 1) SELECT count(*) AS decisions, round(avg(same), 6) AS agreement FROM g""",
    "certificate_counts": f"""WITH l AS (SELECT obs_id, max(semantic) OVER (PARTITION BY obs_id) - semantic AS gap FROM {_LANES} WHERE semantic IS NOT NULL AND bm25 IS NOT NULL), g AS (SELECT obs_id, count_if(gap + 0.03::DOUBLE <= 0.15::DOUBLE OR gap = 0) AS kept, count_if(gap - 0.03::DOUBLE > 0.15::DOUBLE AND gap <> 0) AS dropped, count(*) AS n FROM l GROUP BY 1)
        SELECT kept + dropped = n AS certified, count(*) AS n, sum(kept)::BIGINT AS kept, sum(dropped)::BIGINT AS dropped, sum(n - kept - dropped)::BIGINT AS open FROM g GROUP BY 1""",
    "margin_bins": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY semantic DESC, pos) AS r, row_number() OVER (PARTITION BY obs_id ORDER BY bm25 DESC, pos) AS q FROM {_LANES}), f AS (SELECT obs_id, max(CASE WHEN r = 1 THEN semantic END) - coalesce(max(CASE WHEN r = 2 THEN semantic END), max(semantic)) AS m, max((r = 1 AND q = 1)::INT) AS agree FROM l GROUP BY 1)
        SELECT (m >= 0.01::DOUBLE)::INT + (m >= 0.05::DOUBLE)::INT + (m >= 0.1::DOUBLE)::INT AS bin, count(*) AS n, round(avg(agree), 6) AS agreement FROM f GROUP BY 1""",
    "lane_divergence": f"""WITH l AS (SELECT *, max(semantic) OVER (PARTITION BY obs_id) AS m FROM {_LANES}), e AS (SELECT obs_id, exp((semantic - m) / 0.1::DOUBLE) AS a, exp((semantic - m) / 0.2::DOUBLE) AS b FROM l), p AS (SELECT obs_id, a / sum(a) OVER (PARTITION BY obs_id) AS t, b / sum(b) OVER (PARTITION BY obs_id) AS s FROM e)
        SELECT obs_id, round(sum(CASE WHEN t > 0 THEN t * (ln(t) - ln(greatest(s, 1e-12))) ELSE 0 END), 6) AS kl FROM p GROUP BY 1""",
    "calibration_radius": f"WITH e AS (SELECT abs(risk - error) AS v, row_number() OVER (ORDER BY abs(risk - error)) - 1 AS i, count(*) OVER () AS n FROM {_GRADED}) SELECT round(v, 9) AS radius FROM e WHERE i = least(n - 1, floor(0.999 * n)::BIGINT)",
    "graph_degrees": "WITH e AS (SELECT o_custkey AS v FROM orders UNION ALL SELECT -o_orderkey FROM orders), g AS (SELECT v, count(*) AS d FROM e GROUP BY 1) SELECT (sum(d) / 2)::BIGINT AS edges, count(*) AS nodes, max(d) AS max_degree FROM g",
    "mail_slots": rf"""WITH m AS (SELECT request_id, state, list_distinct(regexp_extract_all(state, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}.+-]+@[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}-]+\.[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}.-]+')) AS v FROM {_LATEST} WHERE state IS NOT NULL)
        SELECT request_id, CASE len(v) WHEN 0 THEN 'MISSING' WHEN 1 THEN 'VALUE' ELSE 'AMBIGUOUS' END AS slot_state, CASE WHEN len(v) = 1 THEN v[1] END AS value, CASE WHEN len(v) = 1 THEN strpos(state, v[1]) - 1 END AS start, CASE WHEN len(v) > 1 THEN len(v) ELSE 0 END AS candidates FROM m""",
    "json_bodies": "SELECT request_id, coalesce(f.qname, 'q') AS qname, f.qtype AS qtype, f.instructions AS instructions FROM (SELECT request_id, arg_min({'qname': qname, 'qtype': qtype, 'instructions': instructions}, (pos, qname, qtype, instructions)) AS f FROM questions GROUP BY 1)",
}
