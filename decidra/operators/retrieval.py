"""BM25, rank fusion and the selection of relevant sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.session import unique_name

# Word and sentence patterns, and the parameters of the two formulas.
WORD, SENTENCE = r"(?U)\w+", r"(?<=[.!?])\s+|\n+"
K1, B, RRF_K = 1.5, 0.75, 60


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bm25(documents: DataFrame, queries: DataFrame, doc: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query", scope: str | None = None) -> DataFrame:
    """(query, doc, score) of the documents with a word of the query; repeated query words count each time.

    With ``scope``, a column of both inputs, each of its values is an index of its own. Null texts have no words.
    """
    keys = [scope] if scope else []
    docs = documents.select(*keys, F.col(doc).alias("_doc"), terms(F.coalesce(F.col(text), F.lit(""))).alias("_terms"))
    sized = docs.withColumn("_dl", F.size("_terms"))
    postings = sized.select(*keys, "_doc", "_dl", F.explode("_terms").alias("term")).groupBy(*keys, "_doc", "_dl", "term").agg(F.count("*").alias("tf"))
    stats = sized.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("_dl")).alias("avgdl"))
    wanted = queries.select(*keys, F.col(query).alias("_query"), F.explode(terms(F.coalesce(F.col(query_text), F.lit("")))).alias("term")).groupBy(*keys, "_query", "term").agg(F.count("*").alias("qtf"))
    asked = postings.join(wanted.select(*keys, "term").distinct(), [*keys, "term"], "left_semi")
    df = asked.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    hit = asked.join(df, [*keys, "term"]).join(wanted, [*keys, "term"])
    hit = hit.join(stats, keys) if keys else hit.crossJoin(F.broadcast(stats))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - B + B * F.greatest(F.col("_dl"), F.lit(1)) / F.col("avgdl")
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    return hit.groupBy(*keys, "_query", "_doc").agg(F.sum(F.col("qtf") * weight).alias("score")).select(*keys, F.col("_query").alias(query), F.col("_doc").alias(doc), "score")


def rank(df: DataFrame, by: str, within: list[str], tie: str, out: str = "rank") -> DataFrame:
    """0-based rank, the highest first, ties by id."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by), F.asc(tie))) - 1)


def rrf(a: DataFrame, b: DataFrame, query: str, doc: str, score: str = "score", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two scorings of the same documents."""
    left = rank(a, score, [query], doc, "rank_a").select(query, doc, "rank_a")
    right = rank(b, score, [query], doc, "rank_b").select(query, doc, "rank_b")
    return left.join(right, [query, doc]).withColumn("rrf", 1.0 / (k + F.col("rank_a")) + 1.0 / (k + F.col("rank_b")))


def token_count(text: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return (F.floor(words * 1.3) + 2).cast("int")


def select_sentences(df: DataFrame, id_col: str, text: str, query: str, budget: int, out: str = "selected") -> DataFrame:
    """(id, selected): the sentences that matter most for the row's query and fit the budget, in reading order.

    A text that fits is kept whole, as is one of a single sentence. Otherwise sentences are taken in BM25 order within
    their own text, those that do not fit are skipped, and at least the best one is kept.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.coalesce(F.col(query), F.lit("")).alias("_q"))
    sentences = F.filter(F.transform(F.split("_t", SENTENCE), lambda s: F.trim(s)), lambda s: s != "")
    rows = rows.withColumn("_s", sentences).withColumn("_whole", (token_count(F.col("_t")) <= budget) | (F.size("_s") <= 1))
    each = rows.where("not _whole").select("_id", F.posexplode("_s").alias("_pos", "_sentence"))
    scored = bm25(each.withColumn("scope", F.col("_id")), rows.where("not _whole").select(F.col("_id").alias("scope"), F.col("_id").alias("_qid"), F.col("_q")), "_pos", "_sentence", "_qid", "_q", "scope")
    ranked = each.join(scored.select(F.col("scope").alias("_id"), "_pos", "score"), ["_id", "_pos"], "left")
    item = F.struct((-F.coalesce("score", F.lit(0.0))).alias("cost"), F.col("_pos").alias("pos"), token_count(F.col("_sentence")).alias("n"), F.col("_sentence").alias("s"))
    lists = ranked.groupBy("_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    zero = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<pos:int,s:string>>)").alias("kept"))

    def take(acc, i):
        fits = acc["used"] + i["n"] <= budget
        one = F.array(F.struct(i["pos"].alias("pos"), i["s"].alias("s")))
        return F.struct(F.when(fits, acc["used"] + i["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate("_items", zero, take, lambda acc: acc["kept"])
    first = F.array(F.struct(F.col("_items")[0]["pos"].alias("pos"), F.col("_items")[0]["s"].alias("s")))
    joined = F.array_join(F.transform(F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(first)), lambda x: x["s"]), " ")
    chosen = lists.select("_id", joined.alias("_chosen"))
    return rows.join(chosen, "_id", "left").select(F.col("_id").alias(id_col), F.when(F.col("_whole"), F.col("_t")).otherwise(F.col("_chosen")).alias(out))
