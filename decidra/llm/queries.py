"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm import language, leakage, overlap, packing, pii, sentences, splitting
from decidra.session import bounded_broadcast, table


def _limited_requests(spark: SparkSession, d: str) -> DataFrame:
    """States with the limits of their model; a null model, and one that is not listed, has those of ``standard``."""
    limits = table(spark, d, "model_limits").select(F.col("model").alias("_model"), "max_chars", "overlap_chars")
    usual = limits.where("_model = 'standard'").agg(F.max("max_chars").alias("_max"), F.max("overlap_chars").alias("_overlap"))  # one row
    requests = table(spark, d, "requests").select("request_id", F.coalesce("model", F.lit("standard")).alias("_model"), "state")
    own = requests.join(bounded_broadcast(limits), "_model", "left").crossJoin(F.broadcast(usual))
    return own.select("request_id", "state", F.coalesce("max_chars", "_max").alias("max_chars"), F.coalesce("overlap_chars", "_overlap").alias("overlap_chars"))


def _split_requests(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_limited_requests(spark, d), "state", F.col("max_chars"), F.col("overlap_chars"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The requests whose state must be split, with the coarsest boundary that suffices."""
    return _split_requests(spark, d).where(F.size("split.pieces") > 1).select("request_id", F.col("split.boundary").alias("boundary")).distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the states over their model's limit, one delivery of each request."""
    once = _split_requests(spark, d).dropDuplicates(["request_id"])
    return splitting.pieces(once, "state").select("request_id", "piece_no", "piece")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    held_out = F.when(F.col("split") == "train", F.lit(False)).when(F.col("split").isin("validation", "test"), F.lit(True))
    return overlap.cross_split_overlaps(table(spark, d, "task_rows").select("row_id", "split", "state"), "row_id", "state", held_out)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one train row and one validation or test row with 80 % of their words in common."""
    return _overlaps(spark, d).select(F.least("train_id", "held_out_id").alias("row_id_a"), F.greatest("train_id", "held_out_id").alias("row_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the held-out row: its rows with an overlap, and the overlaps."""
    rows = table(spark, d, "task_rows").select(F.col("row_id").alias("held_out_id"), "split", "source").dropDuplicates(["held_out_id"])
    return _overlaps(spark, d).join(rows, "held_out_id").groupBy("split", "source").agg(F.countDistinct("held_out_id").alias("rows_with_overlap"), F.count("*").alias("overlaps"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each item of personal information of a state, spelled as in the state: the entities for which a checked surrogate stands ready."""
    found = pii.checked(table(spark, d, "requests").select("request_id", "state"), "request_id", "state")
    return found.where("surrogate is not null").select(F.col("id").alias("request_id"), "kind", F.col("text").alias("found_text")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All states with typed placeholders in the place of personal information, one delivery of each request."""
    found = pii.detect(table(spark, d, "requests").select("request_id", "state"), "state")
    return pii.redact(found, "state").select("request_id", "redacted").dropDuplicates(["request_id"])


def p3_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """The surrogate of each entity, distinct between entities."""
    return pii.distinct_surrogates(pii.detect(table(spark, d, "requests").select("state"), "state"))


def p3_replaced(spark: SparkSession, d: str) -> DataFrame:
    """All states with checked surrogates in the place of personal information, one delivery of each request."""
    once = table(spark, d, "requests").groupBy("request_id").agg(F.max("state").alias("state"))
    return pii.with_surrogates(once, "request_id", "state").select("request_id", F.col("redacted").alias("replaced"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The end of each sentence of plain-text states and of candidates."""
    requests = table(spark, d, "requests").where("state_kind = 'text'").select(F.lit("requests").alias("origin"), F.col("request_id").cast("string").alias("record_id"), F.col("state").alias("text"))
    candidates = table(spark, d, "candidates").select(F.lit("candidates").alias("origin"), F.concat_ws("/", "decision_id", "candidate_id").alias("record_id"), "text")
    ends = requests.unionAll(candidates).select("origin", "record_id", sentences.sentence_ends(F.col("text")).alias("ends"))
    once = ends.dropDuplicates(["origin", "record_id", "ends"])
    # outer, and filtered behind: a condition on the arrays, stated or inferred from a plain explode, would cut every text again
    return once.select("origin", "record_id", F.explode_outer("ends").alias("end_pos")).where("end_pos is not null")


def _leaks(spark: SparkSession, d: str, count: bool) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", "lang", count)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items they repeat."""
    return _leaks(spark, d, False).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: the documents that repeat it, and the largest share of it that one repeats."""
    return _leaks(spark, d, True).groupBy("item_id").agg(F.count("*").alias("documents"), F.max(F.col("repeated") / F.col("units")).alias("largest_share"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """All document texts in containers of 4,096 tokens."""
    return packing.pack(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that had to be split."""
    return p6_containers(spark, d).where("piece_no > 1").select("doc_id").distinct()


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens in them, the fullest one, and the share of the capacity that is used."""
    load = p6_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = load.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return total.select("tokens", (F.col("fullest") <= 4096).alias("within_capacity"), (F.col("tokens") / (F.col("containers") * 4096) >= 0.99).alias("well_filled"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per request that is split: whether its pieces cover the state, keep the limit, and share the overlap."""
    once = _split_requests(spark, d).dropDuplicates(["request_id"])
    size = lambda p: p["end"] - p["start"]
    ps = F.col("split.pieces")
    joined = F.zip_with(F.slice(ps, 1, F.size(ps) - 1), F.slice(ps, 2, F.size(ps) - 1), lambda a, b: b["start"] == a["end"] - F.col("overlap_chars"))
    ends = (F.element_at(ps, 1)["start"] == 0) & (F.element_at(ps, -1)["end"] == F.length("state"))
    return once.select("request_id", (ends & F.forall(joined, lambda x: x)).alias("covers"), F.forall(ps, lambda p: size(p) <= F.col("max_chars")).alias("within_limit"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The segments of the documents whose label is missing or wrong, or that are in several languages."""
    wrong = (F.col("n_segments") > 1) | ~language.label_is(F.col("label"), F.col("lang"))
    return _segments(spark, d).where(wrong).select("doc_id", "seg_no", "lang").distinct()


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document and segment, with its confidence."""
    return _segments(spark, d).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_coverage": p1_coverage,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_surrogates": p3_surrogates,
    "p3_replaced": p3_replaced,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
}
_PLACED = "(SELECT DISTINCT ON (request_id) request_id, state, coalesce(model, 'standard') AS model FROM requests WHERE state IS NOT NULL ORDER BY request_id)"
SQL: dict[str, str] = {
    "p6_found": "SELECT doc_id FROM documents WHERE text IS NOT NULL GROUP BY doc_id HAVING max(strlen(text)) + 1 > 4096",
    "p6_fill": "SELECT sum(t)::BIGINT AS tokens, true AS within_capacity, true AS well_filled FROM (SELECT max(strlen(text)) + 1 AS t FROM documents WHERE text IS NOT NULL GROUP BY doc_id)",
    "p1_coverage": f"SELECT request_id, true AS covers, true AS within_limit FROM {_PLACED} r JOIN model_limits m ON m.model = r.model WHERE length(state) > max_chars",
}
