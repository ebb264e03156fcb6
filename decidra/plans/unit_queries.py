"""Quantities of the candidates in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.operators import units
from decidra.session import table


def _measured(spark: SparkSession, d: str) -> DataFrame:
    candidates = table(spark, d, "candidates").select("decision_id", "candidate_id", "catalog_id", "text")
    return units.with_declared(candidates, table(spark, d, "catalog_units"), table(spark, d, "model_catalogs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each quantity a candidate's text states with a value, in base units."""
    known = F.filter("measurements", lambda m: m["base_value"].isNotNull())
    values = F.array_sort(F.array_distinct(F.transform(known, lambda m: F.struct(m["quantity"].alias("quantity"), m["base_value"].alias("base_value")))))
    # one row per candidate is shuffled: deliveries that say the same meet in a set before it
    once = _measured(spark, d).select("decision_id", "candidate_id", values.alias("v")).where(F.size("v") > 0).groupBy("decision_id", "candidate_id").agg(F.collect_set("v").alias("v"))
    return once.select("decision_id", "candidate_id", F.explode(F.array_distinct(F.flatten("v"))).alias("m")).select("decision_id", "candidate_id", "m.quantity", "m.base_value")


def p4_unit_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per quantity: how many values have their unit from the text, from the catalog, or none."""
    each = _measured(spark, d).select(F.explode("measurements").alias("m"))
    unit = F.when(F.col("m.base_value").isNull(), "none").when(F.col("m.unit_in_text"), "text").otherwise("catalog")
    return each.groupBy(F.col("m.quantity").alias("quantity"), unit.alias("unit_source")).agg(F.count("*").alias("n"))


#: Units that the lines of orders could be recorded in: pieces, dozens or thousands; dollars, cents or thousands of dollars.
LINE_UNITS = {"quantity": {"piece": 1.0, "dozen": 12.0}, "unit_price": {"dollar": 1.0, "cent": 0.01}, "amount": {"dollar": 1.0, "thousand": 1000.0}, "net": {"dollar": 1.0, "cent": 0.01}}
#: amount = quantity x unit price, and the net amount is the amount with its discount taken off.
LINE_IDENTITIES = ({"amount": 1, "quantity": -1, "unit_price": -1}, {"net": 1, "amount": -1, "kept": -1})


def _scrambled(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their four quantities in units that are not told, by number of the line: each source has its own."""
    lines = table(spark, d, "lineitem").where("l_quantity > 0 and l_extendedprice > 0 and l_discount < 1")
    k = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(16))
    own = lambda bit, a, b: F.when(F.floor(k / bit) % 2 == 0, F.lit(a)).otherwise(F.lit(b))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    kept = 1 - F.col("l_discount")
    return lines.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), own(1, "piece", "dozen").alias("q_unit"), own(2, "dollar", "cent").alias("p_unit"), own(4, "dollar", "thousand").alias("a_unit"), own(8, "dollar", "cent").alias("n_unit"),
        (F.col("l_quantity") / own(1, 1.0, 12.0)).alias("quantity"), (price / own(2, 1.0, 0.01)).alias("unit_price"), (F.col("l_extendedprice") / own(4, 1.0, 1000.0)).alias("amount"), (F.col("l_extendedprice") * kept / own(8, 1.0, 0.01)).alias("net"), kept.alias("kept"),
    )


def p4_identities(spark: SparkSession, d: str) -> DataFrame:
    """The units of quantity, unit price, amount and net amount of all lines, restored from the identities among them."""
    got = units.resolve_units(_scrambled(spark, d), {**LINE_UNITS, "kept": {"share": 1.0}}, LINE_IDENTITIES)
    u = F.col("units")
    return got.select(
        "l_orderkey", "l_linenumber", *(u["choice"][c].alias(n) for c, n in (("quantity", "q_unit"), ("unit_price", "p_unit"), ("amount", "a_unit"), ("net", "n_unit"))), F.round(u["base"]["amount"], 2).alias("amount"), u["unique"].alias("unique_units")
    )


def p4_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Quantity and amount alone, without the unit price: as two combinations of units fit equally well, none is unique."""
    rows = _scrambled(spark, d).select("quantity", "amount", (F.col("amount") / F.col("quantity")).alias("rate"))
    two = {"quantity": {"piece": 1.0, "dozen": 12.0}, "amount": {"dollar": 1.0, "dozen dollars": 12.0}, "rate": {"rate": 1.0}}
    got = units.resolve_units(rows, two, ({"amount": 1, "quantity": -1, "rate": -1},))
    return got.groupBy(F.col("units.unique").alias("unique_units")).agg(F.count("*").alias("n"))


QUERIES = {"p4_found": p4_found, "p4_unit_sources": p4_unit_sources, "p4_identities": p4_identities, "p4_ambiguous": p4_ambiguous}
_K = "((l_orderkey + l_linenumber) % 16)"
SQL = {
    "p4_identities": f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN {_K} % 2 = 0 THEN 'piece' ELSE 'dozen' END AS q_unit, CASE WHEN {_K} // 2 % 2 = 0 THEN 'dollar' ELSE 'cent' END AS p_unit,
        CASE WHEN {_K} // 4 % 2 = 0 THEN 'dollar' ELSE 'thousand' END AS a_unit, CASE WHEN {_K} // 8 % 2 = 0 THEN 'dollar' ELSE 'cent' END AS n_unit, round(l_extendedprice, 2) AS amount, true AS unique_units
        FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 AND l_discount < 1""",
    "p4_ambiguous": "SELECT false AS unique_units, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 AND l_discount < 1",
}
