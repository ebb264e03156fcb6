"""Decisions as DataFrame plans: filters, then lexicographic preferences with a tolerance band.

A decision is a group of candidates. Every text is grounded once, into a narrow row of one value per stage. The rows
combine by (decision, cost on the first axis) before they are shuffled, so a decision with very many candidates is spread
and costs no more than any other; from these groups come winner and runner-up. With a band each axis is one aggregation
more, over grounded rows that are kept by a checkpoint.

A program is answered only if every candidate states every stage of it (lane admission); otherwise another lane has to,
and without one the decision abstains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decidra.functions import facts as ff
from decidra.plans.program import Stage, compile_instruction
from decidra.session import bounded_broadcast, cut_lineage

PROGRAM = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("threshold", T.DoubleType())]))
#: Values count to three digits. Rounding goes through the scaled double, as binary rounding does: 1.0005 becomes 1.0.
SCALE = 1000.0
# Reasons of decisions without an answer.
NO_CANDIDATE, NO_LANE = "no candidate satisfies the constraints", "crux lane disabled"


def quantized(value: Column) -> Column:
    return F.rint(value * SCALE) / SCALE


def ground(own: Column, found: Column, program: list[Stage]) -> list[Column]:
    """One double per stage from a text and its facts: at least 0 if a filter is met, the value of an axis (0 if not stated), rounded to 3 digits."""
    out = []
    for s in program:
        key = ff.axis_key(s.key)
        if s.kind == "FILTER" and s.threshold is not None:
            value = F.coalesce(ff.fact(found, s.key) - F.lit(s.threshold), F.lit(-1.0))
        elif s.kind == "FILTER":
            value = ff.concept_value(own, s.key)
        else:
            value = F.coalesce(ff.fact(found, key), F.lit(0.0))
        out.append(quantized(value))
    return out


def admitted(found: Column, program: list[Stage]) -> Column:
    """Whether every stage can be read from the facts of a text as it stands; the structured lane needs it of all candidates."""
    needs = [F.lit(True)]
    for s in program:
        if s.kind != "FILTER" or s.threshold is not None:
            needs.append(ff.fact(found, ff.axis_key(s.key)).isNotNull())
        elif s.key not in ff.ASSERTED:
            needs.append(F.lit(False))
    return F.least(*needs) if len(needs) > 1 else needs[0]


#: A lane of one's own: (texts as (decision_id, candidate_id, text), stages) -> (decision_id, candidate_id, values array<double>), one value per stage.
Grounder = Callable[[DataFrame, list[Stage]], DataFrame]


def grounded(candidates: DataFrame, stages: list[Stage], decision: str, candidate: str, text: str, pos: str | None = None, strip: bool = True) -> DataFrame:
    """(decision_id, candidate_id, _pos, _content, _admitted, _values): each text read once, one value per stage."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = candidates.select(F.col(decision).alias("decision_id"), F.col(candidate).alias("candidate_id"), (F.col(pos) if pos else F.col(candidate)).alias("_pos"), body.alias("_body"), (ff.strip_identity(body) if strip else body).alias("_content"))
    rows = rows.withColumn("_all", ff.facts(F.col("_body")))
    rows = rows.withColumn("_own", F.when(F.col("_content") == F.col("_body"), F.col("_all")).otherwise(ff.facts(F.col("_content"))))
    values = ground(F.col("_content"), F.col("_own"), stages)
    each = F.array(*values) if values else F.expr("cast(array() as array<double>)")
    return rows.select("decision_id", "candidate_id", "_pos", "_content", admitted(F.col("_all"), stages).alias("_admitted"), each.alias("_values"))


def _met(stages: list[Stage]) -> Column:
    met = F.lit(True)
    for k, s in enumerate(stages):
        if s.kind == "FILTER":
            met = met & (F.col("_values")[k] >= 0)
    return met


def _costs(stages: list[Stage]) -> list[Column]:
    """Less is better: values whose direction is MAX change their sign."""
    return [(-F.col("_values")[k] if s.kind == "MAX" else F.col("_values")[k]) for k, s in enumerate(stages) if s.kind != "FILTER"]


def _winners(rows: DataFrame) -> DataFrame:
    """(decision_id, _win, _other, eligible, candidates, structured) of rows with ``_eligible``, ``_first``, ``_in`` and ``_ranked``.

    ``_other`` is the least first cost of the eligible candidates but the winner.
    """
    own = F.when(F.col("_eligible"), F.col("_first"))
    by_cost = rows.groupBy("decision_id", own.alias("_first"), "_eligible").agg(
        F.min(F.when(F.col("_in"), F.col("_ranked"))).alias("_win"), F.count("*").alias("_n"), F.bool_and("_admitted").alias("structured")
    )
    best = by_cost.groupBy("decision_id").agg(
        F.min("_win").alias("_win"), F.coalesce(F.sum(F.when(F.col("_eligible"), F.col("_n"))), F.lit(0)).alias("eligible"), F.sum("_n").alias("candidates"), F.bool_and("structured").alias("structured")
    )
    # the group of the winner counts only if it holds another candidate
    lone = (F.col("_first") == F.col("_win.first")) & (F.col("_n") == 1)
    others = by_cost.where("_eligible").drop("_win", "structured").join(best.select("decision_id", "_win"), "decision_id").where(F.col("_first").isNotNull() & ~lone)
    return best.join(others.groupBy("decision_id").agg(F.min("_first").alias("_other")), "decision_id", "left")


def _answers(best: DataFrame, lane: str = "structured") -> DataFrame:
    admitted = F.col("structured") if lane == "structured" else F.lit(True)
    answered = admitted & F.col("_win").isNotNull()
    margin = F.when(answered, F.round(F.col("_other") - F.col("_win.first"), 4))
    return best.select(
        "decision_id", F.when(answered, F.col("_win.id")).alias("answer"), F.when(answered, lane).otherwise("abstain").alias("decision_mode"), "eligible", margin.alias("primary_margin"),
        F.when(~answered, "abstain").when(margin.isNull() | (margin > 0), "confident").otherwise("tie").alias("trust_state"), "candidates", "structured",
        F.when(~admitted, NO_LANE).when(F.col("_win").isNull(), NO_CANDIDATE).alias("reason"),
    )


def decide(candidates: DataFrame, program: list[Stage] | str, decision: str = "decision_id", candidate: str = "candidate_id", text: str = "text", pos: str | None = None, resolution: float = 0.0, strip: bool = True, grounder: Grounder | None = None) -> DataFrame:
    """One row per decision: answer, decision_mode, eligible, primary_margin, trust_state, candidates, structured, reason.

    Ties go to the smallest text without its identity, then the lowest position (the candidate id where there is none).
    A decision has a null answer, mode "abstain" and a reason if no candidate is eligible, or if a candidate does not state
    a stage and there is no ``grounder``. With a ``grounder``, its values decide such decisions, in mode "crux". Null texts
    state nothing.
    """
    stages = compile_instruction(program) if isinstance(program, str) else program
    rows = grounded(candidates, stages, decision, candidate, text, pos, strip)
    if resolution > 0 or grounder:
        rows = cut_lineage(rows)  # read once per axis, or by two lanes
    own = _answers(_winners(_ranked(rows, stages, resolution)))
    if grounder is None:
        return own
    open_ = rows.join(rows.groupBy("decision_id").agg(F.bool_and("_admitted").alias("_all")).where("not _all").select("decision_id"), "decision_id", "left_semi")
    learned = grounder(open_.select("decision_id", "candidate_id", F.col("_content").alias("text")), stages).select("decision_id", "candidate_id", F.transform("values", quantized).alias("_values"))
    other = _answers(_winners(_ranked(open_.drop("_values").join(learned, ["decision_id", "candidate_id"]), stages, resolution)), "crux")
    return own.where("structured").unionAll(other.select(own.columns))


def _ranked(rows: DataFrame, stages: list[Stage], resolution: float) -> DataFrame:
    """Rows with their eligibility, whether they survive all axes within the band, and the order of the survivors."""
    costs = _costs(stages)
    rows = rows.withColumn("_eligible", _met(stages)).withColumn("_in", F.col("_eligible"))
    for cost in costs if resolution > 0 else ():
        best = rows.where("_in").groupBy("decision_id").agg(F.min(cost).alias("_best"))
        rows = rows.join(best, "decision_id", "left").withColumn("_in", F.coalesce(F.col("_in") & (cost - F.col("_best") <= resolution), F.lit(False))).drop("_best")
    first = costs[0] if costs else F.lit(None).cast("double")
    order = costs if resolution == 0 else costs[:1]
    ranked = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.col("_content").alias("content"), F.col("_pos").alias("pos"), F.col("candidate_id").alias("id"), first.alias("first"))
    return rows.select("decision_id", "candidate_id", "_eligible", "_in", "_admitted", first.alias("_first"), ranked.alias("_ranked"))


def probabilities(candidates: DataFrame, program: list[Stage] | str, decision: str = "decision_id", candidate: str = "candidate_id", text: str = "text", temperature: float = 0.5) -> DataFrame:
    """(decision_id, candidate_id, probability): softmax of the first axis over eligible candidates, 0 for the others.

    A program without an axis gives 1 to the winner (the smallest text, then id) and 0 to all others.
    """
    stages = compile_instruction(program) if isinstance(program, str) else program
    rows = grounded(candidates, stages, decision, candidate, text)
    costs = _costs(stages)
    if not costs:
        order = F.struct("_content", "candidate_id")
        win = rows.where(_met(stages)).groupBy("decision_id").agg(F.min(order)["candidate_id"].alias("_w"))
        return rows.join(win, "decision_id", "left").select("decision_id", "candidate_id", F.coalesce((F.col("candidate_id") == F.col("_w")).cast("double"), F.lit(0.0)).alias("probability"))
    own = rows.select("decision_id", "candidate_id", F.when(_met(stages), -costs[0]).alias("_v"))
    best = own.groupBy("decision_id").agg(F.max("_v").alias("_m"))
    shifted = own.join(best, "decision_id").withColumn("_e", F.exp((F.col("_v") - F.col("_m")) / max(temperature, 1e-6)))
    total = shifted.groupBy("decision_id").agg(F.sum("_e").alias("_s"))
    return shifted.join(total, "decision_id").select("decision_id", "candidate_id", F.coalesce(F.col("_e") / F.col("_s"), F.lit(0.0)).alias("probability"))


def certificate(candidates: DataFrame, program: list[Stage] | str, decision: str = "decision_id", candidate: str = "candidate_id", text: str = "text") -> DataFrame:
    """(decision_id, candidate_id, stage, value): the evidence of each stage for every candidate, ineligible ones included."""
    stages = compile_instruction(program) if isinstance(program, str) else program
    rows = grounded(candidates, stages, decision, candidate, text)
    each = F.array(*(F.struct(F.lit(s.label).alias("stage"), F.round(F.col("_values")[k], 4).alias("value")) for k, s in enumerate(stages)))
    return rows.select("decision_id", "candidate_id", F.explode(each).alias("e")).select("decision_id", "candidate_id", "e.stage", "e.value")


def survivors(candidates: DataFrame, program: list[Stage] | str, decision: str = "decision_id", candidate: str = "candidate_id", text: str = "text", resolution: float = 0.0) -> DataFrame:
    """(decision_id, candidate_id, stage_no, stage): the candidates left after each stage, filters first, then axes in order.

    A stage at which none is left has no row; nothing follows it.
    """
    stages = compile_instruction(program) if isinstance(program, str) else program
    rows = cut_lineage(grounded(candidates, stages, decision, candidate, text)).withColumn("_in", F.lit(True))
    order = [k for k, s in enumerate(stages) if s.kind == "FILTER"] + [k for k, s in enumerate(stages) if s.kind != "FILTER"]
    out = None
    for n, k in enumerate(order, 1):
        if stages[k].kind == "FILTER":
            rows = rows.withColumn("_in", F.col("_in") & (F.col("_values")[k] >= 0))
        else:
            cost = -F.col("_values")[k] if stages[k].kind == "MAX" else F.col("_values")[k]
            best = rows.where("_in").groupBy("decision_id").agg(F.min(cost).alias("_best"))
            rows = rows.join(best, "decision_id", "left").withColumn("_in", F.coalesce(F.col("_in") & (cost - F.col("_best") <= resolution), F.lit(False))).drop("_best")
        left = rows.where("_in").select("decision_id", "candidate_id", F.lit(n).alias("stage_no"), F.lit(stages[k].label).alias("stage"))
        out = left if out is None else out.unionAll(left)
    return out if out is not None else rows.select("decision_id", "candidate_id", F.lit(0).alias("stage_no"), F.lit("").alias("stage")).where("false")


def decide_each(decisions: DataFrame, candidates: DataFrame, facts: str | None = None, pos: str = "pos") -> DataFrame:
    """Decisions with a question each: distinct questions are compiled once, then grounded stage by stage as columns.

    Inputs: (decision_id, question) and (decision_id, candidate_id, pos, text). ``facts`` names a column
    ``array<struct<key,value>>`` of the candidates with facts that were read otherwise (quantities in common units); else
    the structured facts of the text are read. Output as of ``decide``.
    """

    @F.udf(PROGRAM)  # one row per distinct question
    def compiled(question: str | None):
        return [(s.kind, s.key if s.kind == "FILTER" and s.threshold is None else ff.axis_key(s.key), s.threshold) for s in compile_instruction(question)]

    programs = decisions.select("question").distinct().withColumn("program", compiled("question"))
    planned = decisions.select("decision_id", "question").join(bounded_broadcast(programs), decisions["question"].eqNullSafe(programs["question"])).select("decision_id", "program")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = candidates.select("decision_id", "candidate_id", F.col(pos).alias("_pos"), ff.strip_identity(body).alias("_content"), body.alias("_body"), *([F.col(facts).alias("_facts")] if facts else []))
    if facts:
        rows = rows.withColumn("_all", F.col("_facts"))
    else:
        rows = rows.withColumn("_all", ff.facts(F.col("_body")))
        rows = rows.withColumn("_facts", F.when(F.col("_content") == F.col("_body"), F.col("_all")).otherwise(ff.facts(F.col("_content"))))
    rows = rows.drop("_body").join(planned, "decision_id")
    low = F.lower(F.col("_content"))

    def concept(key: Column) -> Column:
        known = F.lit(-1.0)
        for c in ff.ASSERTED:
            known = F.when(key == c, ff.concept_value(F.col("_content"), c)).otherwise(known)
        other = F.when(F.contains(low, F.concat(F.lit("not "), key)) | F.contains(low, F.concat(F.lit("no "), key)), -1.0).when(F.contains(low, key), 1.0).otherwise(-1.0)
        return F.when(key.isin(*ff.ASSERTED), known).otherwise(other)

    def met(s: Column) -> Column:
        floor = F.coalesce(quantized(ff.fact(F.col("_facts"), s["key"]) - s["threshold"]), F.lit(-1.0))
        return F.when(s["threshold"].isNotNull(), floor).otherwise(concept(s["key"])) >= 0

    def cost(s: Column) -> Column:
        value = quantized(F.coalesce(ff.fact(F.col("_facts"), s["key"]), F.lit(0.0)))
        return F.when(s["kind"] == "MAX", -value).otherwise(value)

    def readable(s: Column) -> Column:
        return F.when((s["kind"] == "FILTER") & s["threshold"].isNull(), s["key"].isin(*ff.ASSERTED)).otherwise(ff.fact(F.col("_all"), s["key"]).isNotNull())

    filters = F.filter("program", lambda s: s["kind"] == "FILTER")
    axes = F.filter("program", lambda s: s["kind"] != "FILTER")
    rows = rows.select("decision_id", "candidate_id", "_pos", "_content", F.forall(filters, met).alias("_eligible"), F.transform(axes, cost).alias("_costs"), F.forall("program", readable).alias("_admitted"))
    first = F.get("_costs", F.lit(0))
    ranked = F.struct(F.col("_costs"), F.col("_content"), F.col("_pos").alias("pos"), F.col("candidate_id").alias("id"), first.alias("first"))
    return _answers(_winners(rows.select("decision_id", "candidate_id", "_eligible", F.col("_eligible").alias("_in"), "_admitted", first.alias("_first"), ranked.alias("_ranked"))))
