"""Requests answered question by question: exact lane, matcher with rerank, entailment, second tier, escalation.

One plan for all questions of all requests. Each question takes the cheapest lane that can answer it; states are cut to
the sentences that matter, texts are embedded once each, and only uncertain choices reach the entailment model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions import scores as sc
from decidra.functions import statements as stm
from decidra.operators import models, retrieval
from decidra.session import cut_lineage
from decidra.sources import requests as rq

#: A second tier: open questions (request_id, pos, qtype, text, options) -> (request_id, pos, probabilities array<double>).
SecondTier = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    """Budgets in tokens, floors, and the bounds of each lane."""

    state_budget: int = 92
    nli_budget: int = 220
    floor: float = 0.0
    rerank_below: float = 0.6
    rerank_top: int = 5
    rerank_max_options: int = 20
    tier2_noul: bool = False
    tier2_score: bool = True
    tier2_choice_below: float = 0.8
    tier2_max_options: int = 50
    tier2_max_images: int = 4
    temperatures: dict[str, float] = field(default_factory=dict)


KEY = ["request_id", "pos"]
_PART = "struct<key:string,description:string>"


def with_options(questions: DataFrame) -> DataFrame:
    """Adds ``options array<struct<key,description>>`` in the order of the request; scores have the keys 0, 1, ..."""
    spoken = F.from_json("criteria", "map<string,string>")
    choice = F.transform(F.json_object_keys("criteria"), lambda k: F.struct(k.alias("key"), spoken[k].alias("description")))
    levels = F.transform(F.from_json("criteria", "array<string>"), lambda d, i: F.struct(i.cast("string").alias("key"), d.alias("description")))
    none = F.expr(f"cast(array() as array<{_PART}>)")
    return questions.withColumn("options", F.coalesce(F.when(F.col("qtype") == "choice", choice).when(F.col("qtype") == "score", levels), none))


def unreadable(questions: DataFrame, requests: DataFrame, config: Config = Config(), tier2: bool = False) -> DataFrame:
    """(request_id, reason): the requests that no local lane can answer."""
    options = F.when(F.col("qtype") == "choice", F.size(F.json_object_keys("criteria")))
    each = questions.groupBy("request_id").agg(F.bool_or(F.col("qtype") == "box").alias("box"), F.max(options).alias("most"))
    named = F.coalesce(F.size(F.json_object_keys("assets")), F.lit(0)) > 0
    reason = (
        F.when(F.col("box"), "a box question, which no local lane answers")
        .when(named & (not tier2), "images, which need the second tier")
        .when(named & (F.col("most") > config.tier2_max_options), f"an image choice with more than {config.tier2_max_options} options")
    )
    return requests.join(each, "request_id").select("request_id", reason.alias("reason")).where("reason is not null")


def _selected(df: DataFrame, query: Column, budget: int) -> DataFrame:
    """(request_id, pos, selected): the sentences of each question's state that matter for the query."""
    rows = df.select(F.struct(*KEY).alias("k"), F.col("text"), query.alias("q"))
    return retrieval.select_sentences(rows, "k", "text", "q", budget).select(F.col("k.request_id").alias("request_id"), F.col("k.pos").alias("pos"), "selected")


def cosines(open_: DataFrame, embedder: models.Embedder, config: Config) -> DataFrame:
    """(request_id, pos, cosines array<double>): of the selected state with each option, in the order of the options."""
    said = F.coalesce("instructions", F.lit(""))
    text = F.when(F.col("qtype") == "score", F.concat_ws(" ", said, stm.option_text(F.lit("score"), F.col("o.key"), F.col("o.description")))).otherwise(stm.option_text(F.lit("choice"), F.col("o.key"), F.col("o.description")))
    each = open_.select(*KEY, "qtype", "instructions", "text", F.posexplode("options").alias("at", "o")).withColumn("option", text)
    texts = each.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "option"))), lambda x: x["option"]), " ").alias("all"))
    states = _selected(open_.join(texts, KEY), F.concat_ws(" ", "instructions", "all"), config.state_budget)
    vectors = models.embedded(each.select(*KEY, "at", "option"), "option", embedder, "ov").join(models.embedded(states, "selected", embedder, "sv"), KEY)
    scored = vectors.select(*KEY, F.struct("at", sc.dot(F.col("ov"), F.col("sv")).alias("c")).alias("x"))
    return scored.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("cosines"))


def reranked(open_: DataFrame, entails: models.Entailment, config: Config) -> DataFrame:
    """(request_id, pos, moved array<struct<at,p>>): the top options of uncertain choices, ordered by entailment within their mass."""
    n = F.size("p")
    gate = (F.col("qtype") == "choice") & (n > 1) & (n <= config.rerank_max_options) & (F.array_max("p") < config.rerank_below)
    ranked = F.slice(F.array_sort(F.transform("p", lambda p, i: F.struct((-p).alias("c"), i.alias("at")))), 1, config.rerank_top)
    top = open_.where(gate).withColumn("top", ranked)
    each = top.select(*KEY, "instructions", "text", F.explode("top").alias("t"), "options").select(
        *KEY, "instructions", "text", F.col("t.at").alias("at"), (-F.col("t.c")).alias("p"), stm.hypothesis(F.get("options", F.col("t.at"))["key"], F.get("options", F.col("t.at"))["description"]).alias("said")
    )
    all_said = each.groupBy(*KEY).agg(F.first("text").alias("text"), F.first("instructions").alias("instructions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("c"), "at", "said"))), lambda x: x["said"]), " ").alias("all"))
    states = _selected(all_said, F.concat_ws(" ", "instructions", "all"), config.nli_budget)
    margins = each.join(states, KEY).withColumn("z", entails(F.col("selected"), F.col("said")))
    lists = margins.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "p", "z"))).alias("x"))
    share = sc.softmax(F.transform("x", lambda x: x["z"]), sc.temperature(F.lit("choice_nli"), F.lit(0), config.temperatures))
    mass = F.aggregate("x", F.lit(0.0), lambda s, x: s + x["p"])
    return lists.select(*KEY, F.zip_with("x", share, lambda x, s: F.struct(x["at"].alias("at"), (s * mass).alias("p"))).alias("moved"))


def noul_margins(open_: DataFrame, entails: models.Entailment, config: Config) -> DataFrame:
    """(request_id, pos, z): the evidence of yes/no questions as one logit, from one or two hypotheses."""
    said = F.from_json("criteria", "map<string,string>")
    yes, no = (F.nullif(F.trim(F.coalesce(said[k], F.lit(""))), F.lit("")) for k in ("true", "false"))
    own = F.nullif(stm.to_statement(F.col("instructions")), F.lit(""))
    rows = open_.select(*KEY, "text", "instructions", yes.alias("y"), no.alias("n"), own.alias("own"))
    rows = cut_lineage(rows.withColumn("y", F.coalesce("y", F.when(F.col("instructions").isNotNull() | F.col("n").isNull(), F.col("own")))))
    states = _selected(rows, F.concat_ws(" ", "y", "n"), config.nli_budget)
    m = rows.join(states, KEY).withColumn("my", F.when(F.col("y").isNotNull(), entails(F.col("selected"), F.col("y")))).withColumn("mn", F.when(F.col("n").isNotNull(), entails(F.col("selected"), F.col("n"))))
    return m.select(*KEY, F.coalesce((F.col("my") - F.col("mn")) / 2, F.col("my"), -F.col("mn")).alias("z"))


def shaped(kind: Column, options: Column, p: Column) -> tuple[Column, Column]:
    """The answer as JSON text and its confidence, from probabilities (of yes alone for yes/no questions)."""
    six = lambda x: F.round(x, 6)
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    keys = F.transform(options, lambda o: o["key"])
    shares = F.map_from_arrays(keys, F.transform(p, six))
    score = F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    yes = F.get(p, F.lit(0))
    confidence = F.when(kind == "noul", F.greatest(yes, 1 - yes)).otherwise(F.array_max(p))
    choice = F.struct(F.lit("choice").alias("type"), F.get(keys, best).alias("choice"), six(confidence).alias("confidence"), shares.alias("probabilities"))
    legend = F.map_from_arrays(keys, F.transform(options, lambda o: F.coalesce(o["description"], F.lit(""))))
    level = F.struct(F.lit("score").alias("type"), six(score).alias("score"), six(confidence).alias("confidence"), legend.alias("legend"), shares.alias("probabilities"))
    answer = F.when(kind == "noul", F.to_json(F.struct(F.lit("noul").alias("type"), six(yes).alias("noul")))).when(kind == "choice", F.to_json(choice)).when(kind == "score", F.to_json(level))
    return answer, confidence


def _exact(rows: DataFrame, requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds ``exact``: the probabilities of questions that the exact lane answers, else null."""
    found = rq.exact_answers(requests, questions).where("lane = 'exact'").groupBy(*KEY).agg(F.min("answer").alias("hit"))
    sure = F.when(F.col("qtype") == "noul", F.array((F.col("hit") == "true").cast("double"))).otherwise(F.transform("options", lambda o: (o["key"] == F.col("hit")).cast("double")))
    return rows.join(found, KEY, "left").withColumn("exact", F.when(F.col("hit").isNotNull(), sure)).drop("hit")


def answer(
    requests: DataFrame, questions: DataFrame, embedder: models.Embedder = models.hashed_words, entails: models.Entailment = models.shared_word, config: Config = Config(), tier2: SecondTier | None = None,
) -> DataFrame:
    """(request_id, pos, qname, qtype, lane, answer, confidence, p, below_floor): one row per question, all requests in one plan.

    ``requests`` has (request_id, state, state_kind), one row per request; ``questions`` (request_id, pos, qname, qtype,
    instructions, criteria), of which one row per (request_id, pos) counts. Questions without options, and box questions,
    have a null answer and lane "unreadable". Null states are empty texts.
    """
    states = requests.select("request_id", "state", "state_kind")
    once = questions.dropDuplicates(KEY).select(*KEY, "qname", "qtype", "instructions", "criteria")
    text = F.coalesce(rq.state_text(F.col("state"), F.col("state_kind")), F.lit(""))
    rows = with_options(once).join(states.select("request_id", text.alias("text")), "request_id")
    rows = cut_lineage(_exact(rows, states, once))  # read by each lane
    usable = F.col("exact").isNull() & F.when(F.col("qtype") == "noul", F.lit(True)).otherwise(F.col("qtype").isin("choice", "score") & (F.size("options") > 0))
    open_ = rows.where(usable)
    options = open_.where("qtype <> 'noul'")
    cos = cut_lineage(cosines(options, embedder, config))
    tau = sc.temperature(F.col("qtype"), F.size("cosines"), config.temperatures)
    matched = options.join(cos, KEY).withColumn("p", sc.softmax(F.col("cosines"), tau)).drop("cosines")
    matched = cut_lineage(matched)
    moved = cut_lineage(reranked(matched, entails, config))
    again = F.transform("p", lambda p, i: F.coalesce(F.element_at(F.transform(F.filter("moved", lambda m: m["at"] == i), lambda m: m["p"]), 1), p))
    by_match = matched.join(moved, KEY, "left").select(*KEY, F.when(F.col("moved").isNull(), F.col("p")).otherwise(again).alias("p"), F.when(F.col("moved").isNull(), "matcher").otherwise("matcher+nli").alias("lane"))
    nouls = open_.where("qtype = 'noul'")
    temperature = sc.temperature(F.lit("noul"), F.lit(0), config.temperatures)
    by_nli = cut_lineage(noul_margins(nouls, entails, config)).select(*KEY, F.when(F.col("z").isNotNull(), F.array(sc.sigmoid(F.col("z") / temperature))).alias("p"), F.lit("nli").alias("lane"))
    local = by_match.unionByName(by_nli)
    if tier2 is not None:
        local = _second_tier(open_, local, tier2, config)
    out = rows.join(local, KEY, "left").withColumn("lane", F.when(F.col("exact").isNotNull(), "exact").otherwise(F.coalesce("lane", F.lit("unreadable")))).withColumn("p", F.coalesce("exact", "p"))
    said, confidence = shaped(F.col("qtype"), F.col("options"), F.col("p"))
    out = out.select(*KEY, "qname", "qtype", "lane", said.alias("answer"), F.round(confidence, 6).alias("confidence"), "p")
    return out.withColumn("below_floor", F.coalesce((F.col("lane") != "exact") & (F.col("confidence") < config.floor), F.lit(False)))


def _second_tier(open_: DataFrame, local: DataFrame, tier2: SecondTier, config: Config) -> DataFrame:
    """Local answers, with those of the second tier in the place of the ones that are routed to it; a missing one falls back."""
    few = F.size("options") <= config.tier2_max_options
    routed = open_.select(*KEY, "qtype", "instructions", "text", "options").join(local.select(*KEY, F.array_max("p").alias("top")), KEY)
    wanted = F.when(F.col("qtype") == "noul", F.lit(config.tier2_noul)).when(F.col("qtype") == "score", F.lit(config.tier2_score)).otherwise(few & (F.col("top") < config.tier2_choice_below))
    remote = tier2(routed.where(wanted).drop("top")).select(*KEY, F.col("probabilities").alias("_p"))
    taken = F.when(F.col("_p").isNotNull(), "tier2").otherwise(F.col("lane"))
    return local.join(remote, KEY, "left").select(*KEY, F.coalesce("_p", "p").alias("p"), taken.alias("lane"))


def escalations(answers: DataFrame, requests: DataFrame, questions: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """(request_id, pos, qname, reason): what is to be sent on: answers below the floor, and all questions of unreadable requests."""
    low = answers.where("below_floor").select(*KEY, "qname", F.lit("below the floor").alias("reason"))
    if reasons is None:
        return low
    whole = questions.dropDuplicates(KEY).join(reasons, "request_id").select(*KEY, "qname", "reason")
    return whole.unionAll(low.join(reasons.select("request_id"), "request_id", "left_anti"))


def merged(answers: DataFrame, remote: DataFrame) -> DataFrame:
    """Local answers with remote ones (request_id, qname, remote_answer) in their place, in the order of the request."""
    both = answers.join(remote.select("request_id", "qname", "remote_answer").dropDuplicates(["request_id", "qname"]), ["request_id", "qname"], "left")
    lane = F.when(F.col("remote_answer").isNotNull(), "escalated").otherwise(F.col("lane"))
    return both.withColumn("answer", F.coalesce("remote_answer", "answer")).withColumn("lane", lane).drop("remote_answer").orderBy(*KEY)


def counters(answers: DataFrame) -> DataFrame:
    """(counter, n): requests, questions, answers below the floor, and one counter per lane."""
    lanes = answers.groupBy(F.col("lane").alias("counter")).agg(F.count("*").alias("n"))
    totals = answers.agg(F.countDistinct("request_id").alias("requests"), F.count("*").alias("questions"), F.count_if("below_floor").alias("below_floor"))
    each = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in totals.columns))).alias("x")).select("x.counter", "x.n")
    return lanes.unionAll(each)
