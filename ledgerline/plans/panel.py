"""The driver's order tables as company-years: one row per customer and financial year, 35 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDS = ["company_name", "cin", "sector", "financial_year", "cohort"]
NUMERIC = (
    "revenue pat interest_expense tax_expense depreciation ebitda total_equity total_borrowings total_assets current_assets current_liabilities "
    "cash_and_equivalents inventory receivables retained_earnings cfo cfi cff net_cash_change capex going_concern_uncertainty emphasis_of_matter "
    "fraud_reported related_party_transactions_amount contingent_liabilities_amount rpt_count pending_legal_cases_count promoter_holding_pct"
).split()
TEXT = ["opinion_type", "auditor_name"]
COLUMNS = [*IDS, *NUMERIC, *TEXT]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def company_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines join their orders, are summed by customer and year, and only then meet the customers."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("k"),
        (F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 4, 1).otherwise(0)).alias("fy"),
    )
    exact = lambda c, kind: F.col(c).cast(f"decimal({kind})")  # noqa: E731  sums of exact products don't depend on their order
    p, disc, tax, qty = exact("l_extendedprice", "12,2"), exact("l_discount", "4,2"), exact("l_tax", "4,2"), exact("l_quantity", "6,2")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def total(value, when=None):
        return F.sum(value if when is None else F.when(when, value)).cast("double")

    sums = rows.groupBy("k", "fy").agg(
        F.count(F.lit(1)).alias("n"),
        total(p).alias("g"),
        total(p * disc).alias("i"),
        total(p * tax).alias("t"),
        (total(p * qty) / 1000).alias("pq"),
        total(p, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("debt"),
        total(p, F.col("l_returnflag") == "A").alias("ca"),
        total(p, F.col("l_returnflag") == "R").alias("cl"),
        total(p, F.col("l_linestatus") == "F").alias("inv"),
        total(p, F.col("o_orderstatus") == "P").alias("rec"),
        total(p, qty < 5).alias("cash"),
        (total(p, qty > 40) / 10).alias("capex"),
    )
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows = sums.join(people, F.col("k") == F.col("c_custkey"))
    g, n, k, fy, bal = (F.col(x) for x in ("g", "n", "k", "fy", "c_acctbal"))
    null = F.lit(None)
    equity = 10 * bal + n
    pat, cfo, cfi, cff = 0.05 * g - F.col("i"), 0.04 * g - F.col("t"), -F.col("pq"), -0.01 * g
    code = F.concat(F.lit("L"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("MH"), (1950 + k % 70).cast("string"), F.lit("PLC"), F.lpad((k % 1000000).cast("string"), 6, "0"))
    columns = {
        "company_name": F.col("c_name"),
        "cin": F.when(k % 13 == 0, F.concat(F.lit("BAD"), k.cast("string"))).otherwise(code),
        "sector": F.col("c_mktsegment"),
        "financial_year": fy.cast("int"),
        "cohort": F.when(bal < 0, "defaulter").otherwise("non_defaulter"),
        "revenue": g,
        "pat": pat,
        "interest_expense": F.col("i"),
        "tax_expense": F.col("t"),
        "depreciation": 0.03 * g,
        "ebitda": F.when(fy % 2 == 0, 0.12 * g - F.col("i")),
        "total_equity": equity,
        "total_borrowings": F.col("debt"),
        "total_assets": g + bal,
        "current_assets": F.col("ca"),
        "current_liabilities": F.col("cl"),
        "cash_and_equivalents": F.col("cash"),
        "inventory": F.col("inv"),
        "receivables": F.col("rec"),
        "retained_earnings": equity - 0.1 * g,
        "cfo": cfo,
        "cfi": cfi,
        "cff": cff,
        "net_cash_change": cfo + cfi + cff,
        "capex": F.col("capex"),
        "going_concern_uncertainty": F.when(n % 6 == 0, 1.0).when(n % 6 == 1, null).otherwise(0.0),
        "emphasis_of_matter": F.when(n % 8 == 0, 1.0).when(n % 8 == 1, null).otherwise(0.0),
        "fraud_reported": F.when(n % 9 == 0, 1.0).when(n % 9 == 1, null).otherwise(0.0),
        "related_party_transactions_amount": F.when(n % 6 == 2, null).when(n % 6 == 3, 0.0).otherwise(0.02 * g),
        "contingent_liabilities_amount": F.when(n % 8 == 2, null).when(n % 8 == 3, 0.0).otherwise(0.15 * g),
        "rpt_count": F.when(n % 6 == 2, null).otherwise((n % 9).cast("double")),
        "pending_legal_cases_count": F.when(n % 9 == 2, null).otherwise((n % 8).cast("double")),
        "promoter_holding_pct": F.when(n % 9 == 3, null).otherwise(30.0 + (n % 40).cast("double")),
        "opinion_type": F.when(n % 5 == 0, "qualified").when(n % 5 == 1, "adverse").when(n % 5 == 2, " Unqualified ").when(n % 5 == 3, null).otherwise(""),
        "auditor_name": F.when(n % 7 != 0, F.concat(F.lit("Auditor "), (n % 3).cast("string"))),
    }
    return rows.select(*[columns[c].alias(c) for c in COLUMNS])


_MONEY = lambda value, when="": f"CAST(sum({value}){f' FILTER (WHERE {when})' if when else ''} AS DOUBLE)"
_P, _DISC, _TAX, _QTY = (f"CAST({c} AS DECIMAL({kind}))" for c, kind in (("l_extendedprice", "12,2"), ("l_discount", "4,2"), ("l_tax", "4,2"), ("l_quantity", "6,2")))
#: The same company-years in DuckDB's SQL, as common table expressions that end with company_year.
SQL = f"""
sums AS (
  SELECT o_custkey AS k, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, count(*) AS n,
    {_MONEY(_P)} AS g, {_MONEY(f"{_P} * {_DISC}")} AS i, {_MONEY(f"{_P} * {_TAX}")} AS t,
    {_MONEY(f"{_P} * {_QTY}")} / 1000 AS pq,
    {_MONEY(_P, "o_orderpriority IN ('1-URGENT', '2-HIGH')")} AS debt,
    {_MONEY(_P, "l_returnflag = 'A'")} AS ca, {_MONEY(_P, "l_returnflag = 'R'")} AS cl,
    {_MONEY(_P, "l_linestatus = 'F'")} AS inv, {_MONEY(_P, "o_orderstatus = 'P'")} AS rec,
    {_MONEY(_P, "l_quantity < 5")} AS cash, {_MONEY(_P, "l_quantity > 40")} / 10 AS capex
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
company_year AS (
  SELECT c_name AS company_name,
    CASE WHEN k % 13 = 0 THEN 'BAD' || k ELSE 'L' || lpad((k % 100000)::VARCHAR, 5, '0') || 'MH' || (1950 + k % 70) || 'PLC' || lpad((k % 1000000)::VARCHAR, 6, '0') END AS cin,
    c_mktsegment AS sector, fy::INT AS financial_year, CASE WHEN c_acctbal < 0 THEN 'defaulter' ELSE 'non_defaulter' END AS cohort,
    g AS revenue, 0.05::DOUBLE * g - i AS pat, i AS interest_expense, t AS tax_expense, 0.03::DOUBLE * g AS depreciation,
    CASE WHEN fy % 2 = 0 THEN 0.12::DOUBLE * g - i END AS ebitda, 10 * c_acctbal + n AS total_equity, debt AS total_borrowings, g + c_acctbal AS total_assets,
    ca AS current_assets, cl AS current_liabilities, cash AS cash_and_equivalents, inv AS inventory, rec AS receivables,
    10 * c_acctbal + n - 0.1::DOUBLE * g AS retained_earnings, 0.04::DOUBLE * g - t AS cfo, -pq AS cfi, -0.01::DOUBLE * g AS cff,
    0.04::DOUBLE * g - t + -pq + -0.01::DOUBLE * g AS net_cash_change, capex,
    CASE n % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN NULL ELSE 0 END AS going_concern_uncertainty,
    CASE n % 8 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN NULL ELSE 0 END AS emphasis_of_matter,
    CASE n % 9 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN NULL ELSE 0 END AS fraud_reported,
    CASE n % 6 WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE 0.02::DOUBLE * g END AS related_party_transactions_amount,
    CASE n % 8 WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE 0.15::DOUBLE * g END AS contingent_liabilities_amount,
    CASE WHEN n % 6 <> 2 THEN (n % 9)::DOUBLE END AS rpt_count, CASE WHEN n % 9 <> 2 THEN (n % 8)::DOUBLE END AS pending_legal_cases_count,
    CASE WHEN n % 9 <> 3 THEN 30.0::DOUBLE + n % 40 END AS promoter_holding_pct,
    CASE n % 5 WHEN 0 THEN 'qualified' WHEN 1 THEN 'adverse' WHEN 2 THEN ' Unqualified ' WHEN 3 THEN NULL ELSE '' END AS opinion_type,
    CASE WHEN n % 7 <> 0 THEN 'Auditor ' || n % 3 END AS auditor_name
  FROM sums JOIN customer ON k = c_custkey)
"""
