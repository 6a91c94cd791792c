"""Queries of cleaning, company lists, plans and pending work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import cohorts, matching
from ..sources import tables
from . import download_plan as dp
from .catalog import query
from .panel import table

#: Messy text made from customers, the same in both engines.
MESSY_SQL = """messy AS (
  SELECT c_custkey AS k, c_name, c_mktsegment AS sector, c_acctbal,
    CASE k % 8 WHEN 0 THEN '-' WHEN 1 THEN 'NA' WHEN 2 THEN NULL WHEN 3 THEN '  ' WHEN 4 THEN 'BAD' || k
      WHEN 5 THEN ' l' || lpad(k::VARCHAR, 5, '0') || ' mh1999plc' || lpad(k::VARCHAR, 6, '0') ELSE 'L' || lpad(k::VARCHAR, 5, '0') || 'MH' || (1890 + k % 130) || 'PLC' || lpad(k::VARCHAR, 6, '0') END AS raw_cin,
    CASE k % 7 WHEN 0 THEN '2016' WHEN 1 THEN (2008 + k % 20) || '.0' WHEN 2 THEN 'nan' WHEN 3 THEN '' WHEN 4 THEN '20x6' WHEN 5 THEN ' ' || (1890 + k % 250) ELSE NULL END AS raw_year,
    CASE k % 8 WHEN 0 THEN '(' || (k % 900) || ',' || lpad((k % 1000)::VARCHAR, 3, '0') || '.50)' WHEN 1 THEN 'Rs. ' || k || '.5' WHEN 2 THEN '--' WHEN 3 THEN 'NA' WHEN 4 THEN (1 + k % 9) || ',' || lpad((k % 1000)::VARCHAR, 3, '0')
      WHEN 5 THEN k || '.25 ' WHEN 6 THEN NULL ELSE k || 'd' END AS raw_amount,
    CASE k % 5 WHEN 0 THEN '2016-03-' || lpad((1 + k % 28)::VARCHAR, 2, '0') WHEN 1 THEN lpad((1 + k % 28)::VARCHAR, 2, '0') || '/06/2017' WHEN 2 THEN '2016-13-40' WHEN 3 THEN 'unknown' ELSE NULL END AS raw_date,
    '  ' || upper(c_name) || '   Pvt.  Ltd ' AS raw_name
  FROM (SELECT *, c_custkey AS k FROM customer))"""


def messy(spark, sf_dir):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    pad = lambda c, n: F.lpad(s(c), n, "0")
    cin = F.when(k % 8 == 0, "-").when(k % 8 == 1, "NA").when(k % 8 == 2, F.lit(None)).when(k % 8 == 3, "  ").when(k % 8 == 4, F.concat(F.lit("BAD"), s(k)))
    cin = cin.when(k % 8 == 5, F.concat(F.lit(" l"), pad(k, 5), F.lit(" mh1999plc"), pad(k, 6))).otherwise(F.concat(F.lit("L"), pad(k, 5), F.lit("MH"), s(1890 + k % 130), F.lit("PLC"), pad(k, 6)))
    year = F.when(k % 7 == 0, "2016").when(k % 7 == 1, F.concat(s(2008 + k % 20), F.lit(".0"))).when(k % 7 == 2, "nan").when(k % 7 == 3, "").when(k % 7 == 4, "20x6").when(k % 7 == 5, F.concat(F.lit(" "), s(1890 + k % 250)))
    amount = F.when(k % 8 == 0, F.concat(F.lit("("), s(k % 900), F.lit(","), pad(k % 1000, 3), F.lit(".50)"))).when(k % 8 == 1, F.concat(F.lit("Rs. "), s(k), F.lit(".5"))).when(k % 8 == 2, "--").when(k % 8 == 3, "NA")
    amount = amount.when(k % 8 == 4, F.concat(s(1 + k % 9), F.lit(","), pad(k % 1000, 3))).when(k % 8 == 5, F.concat(s(k), F.lit(".25 "))).when(k % 8 == 6, F.lit(None)).otherwise(F.concat(s(k), F.lit("d")))
    date = F.when(k % 5 == 0, F.concat(F.lit("2016-03-"), pad(1 + k % 28, 2))).when(k % 5 == 1, F.concat(pad(1 + k % 28, 2), F.lit("/06/2017"))).when(k % 5 == 2, "2016-13-40").when(k % 5 == 3, "unknown")
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), "c_name", F.col("c_mktsegment").alias("sector"), "c_acctbal", cin.alias("raw_cin"), year.alias("raw_year"), amount.alias("raw_amount"), date.alias("raw_date"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("   Pvt.  Ltd ")).alias("raw_name"),
    )


CIN_SQL = "CASE WHEN upper(trim(raw_cin)) NOT IN ('NAN', 'NA', '-', '') AND regexp_full_match(replace(upper(trim(raw_cin)), ' ', ''), '[A-Z0-9]{21}') THEN replace(upper(trim(raw_cin)), ' ', '') END"


@query(f"WITH {MESSY_SQL} SELECT k, {CIN_SQL} AS cin FROM messy")
def normalize_cin(spark, sf_dir):
    return messy(spark, sf_dir).select("k", sc.normalize_cin(F.col("raw_cin")).alias("cin"))


@query(f"WITH {MESSY_SQL} SELECT k, coalesce(regexp_full_match(replace(raw_cin, ' ', ''), '[A-Z0-9]{{21}}'), false) AS valid FROM messy")
def is_valid_cin(spark, sf_dir):
    return messy(spark, sf_dir).select("k", sc.is_valid_cin(F.col("raw_cin")).alias("valid"))


@query(f"""WITH {MESSY_SQL}, y AS (SELECT k, CASE WHEN regexp_full_match(upper(trim(raw_cin)), '[A-Z][0-9]{{5}}[A-Z]{{2}}[0-9]{{4}}[A-Z]{{3}}[0-9]{{6}}') THEN substr(trim(raw_cin), 9, 4)::INT END AS y FROM messy)
SELECT k, CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS incorporation_year FROM y""")
def cin_incorporation_year(spark, sf_dir):
    return messy(spark, sf_dir).select("k", sc.cin_incorporation_year(F.col("raw_cin")).alias("incorporation_year"))


@query(f"WITH {MESSY_SQL} SELECT k, substr(raw_cin, 3, 2) AS hint, coalesce(starts_with(upper(trim(raw_cin)), 'L'), false) AS listed FROM messy")
def cin_parts(spark, sf_dir):
    return messy(spark, sf_dir).select("k", sc.cin_hint(F.col("raw_cin")).alias("hint"), sc.is_listed(F.col("raw_cin")).alias("listed"))


YEAR_SQL = "CASE WHEN try_cast(regexp_replace(trim(raw_year), '\\.0$', '') AS INT) BETWEEN 1900 AND 2100 THEN try_cast(regexp_replace(trim(raw_year), '\\.0$', '') AS INT) END"


@query(f"WITH {MESSY_SQL} SELECT k, {YEAR_SQL} AS year FROM messy")
def parse_year(spark, sf_dir):
    return messy(spark, sf_dir).select("k", sc.parse_year(F.col("raw_year")).alias("year"))


PLAIN = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$'"


@query(f"""WITH {MESSY_SQL}, a AS (SELECT k, regexp_replace(trim(replace(raw_amount, ',', '')), '^\\((.*)\\)$', '-\\1') AS a, regexp_replace(raw_amount, '[^0-9.-]', '', 'g') AS c FROM messy)
SELECT k, CASE WHEN regexp_matches(a, {PLAIN}) THEN a::DOUBLE END AS amount, CASE WHEN regexp_matches(c, {PLAIN}) THEN c::DOUBLE END AS cleaned FROM a""")
def parse_amount(spark, sf_dir):
    return messy(spark, sf_dir).select("k", sc.parse_amount(F.col("raw_amount")).alias("amount"), sc.clean_amount(F.col("raw_amount")).alias("cleaned"))


@query(f"WITH {MESSY_SQL} SELECT k, coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%d/%m/%Y'))::DATE AS date FROM messy")
def parse_date(spark, sf_dir):
    return messy(spark, sf_dir).select("k", sc.parse_date(F.col("raw_date")).alias("date"))


@query(f"""WITH {MESSY_SQL} SELECT k, trim(coalesce(raw_cin, '')) AS text, trim(regexp_replace(lower(raw_name), '[ \\t\\n\\r]+', ' ', 'g')) AS name,
  trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(raw_name)), '[^a-z0-9 ]', ' ', 'g'), '\\b(private|pvt|limited|ltd)\\b', ' ', 'g'), ' +', ' ', 'g')) AS bare
FROM messy""")
def normalize_names(spark, sf_dir):
    return messy(spark, sf_dir).select("k", sc.normalize_text(F.col("raw_cin")).alias("text"), sc.normalize_name(F.col("raw_name")).alias("name"), sc.strip_company_suffix(F.col("raw_name")).alias("bare"))


@query("""SELECT DISTINCT lower(trim(event_type)) AS header, CASE lower(trim(event_type)) WHEN 'purchase' THEN 'amount' WHEN 'view' THEN 'company_name' ELSE lower(trim(event_type)) END AS canonical FROM events""")
def normalize_header(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.lower(F.trim("event_type")).alias("header")).distinct()
    return df.select("header", sc.normalize_header(F.upper("header"), {"purchase": "amount", "view": "company_name"}).alias("canonical"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS plain, CASE WHEN l_tax - 0.04 > 0 THEN l_quantity / (l_tax - 0.04::DOUBLE) END AS positive FROM lineitem".replace("l_tax - 0.04 >", "l_tax - 0.04::DOUBLE >"))
def guarded_ratios(spark, sf_dir):
    d = F.col("l_tax") - 0.04
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sc.safe_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("plain"), sc.safe_positive_divide(F.col("l_quantity"), d).alias("positive"))


@query(f"WITH {MESSY_SQL} SELECT trim(raw_name) AS company_name, {CIN_SQL} AS cin, k AS source_row FROM messy WHERE trim(coalesce(raw_name, '')) <> ''")
def cleaned_company_list(spark, sf_dir):
    return cohorts.cleaned_list(messy(spark, sf_dir), "raw_name", "raw_cin", "k")


@query(f"""WITH {MESSY_SQL}, l AS (SELECT k, raw_cin, CASE k % 4 WHEN 0 THEN raw_name || 'Société' WHEN 1 THEN raw_name || ', "Nord"' || chr(10) || 'Süd' WHEN 2 THEN ' ' ELSE raw_name END AS raw_name FROM messy)
SELECT trim(raw_name) AS company_name, {CIN_SQL} AS cin, CASE WHEN k % 3 = 0 THEN 'latin' ELSE 'unicode' END AS kind FROM l WHERE trim(raw_name) <> ''""")
def read_company_list(spark, sf_dir):
    """Company lists written in two orders of columns, under two sets of headers and in two encodings, and read back at once."""
    k, base = F.col("k"), tables.new_path(spark, "company-lists")
    name = F.when(k % 4 == 0, F.concat("raw_name", F.lit("Société"))).when(k % 4 == 1, F.concat("raw_name", F.lit(', "Nord"\nSüd'))).when(k % 4 == 2, " ").otherwise(F.col("raw_name"))
    rows = messy(spark, sf_dir).select("k", name.alias("name"), F.coalesce("raw_cin", F.lit("")).alias("cin"), "sector")
    write = lambda df, code, kind: df.write.option("header", True).option("escape", '"').option("encoding", code).csv(f"{base}/{kind}")
    write(rows.filter("k % 3 = 0").select(F.col("cin").alias("Corporate Identification Number"), "sector", F.col("name").alias("Name of  Borrower")), "ISO-8859-1", "latin")
    write(rows.filter("k % 3 <> 0").select(F.col("name").alias("Company Name"), "sector", F.col("cin").alias("CIN")), "UTF-8", "unicode")
    return tables.read_company_list(spark, base, places=True).select("company_name", "cin", F.regexp_extract("file", "/(latin|unicode)/", 1).alias("kind"))


LIST_SQL = f"{MESSY_SQL}, list AS (SELECT trim(raw_name) AS company_name, {CIN_SQL} AS cin, k AS source_row FROM messy)"


@query(f"WITH {LIST_SQL} SELECT * FROM list WHERE cin IS NOT NULL")
def rows_with_cin(spark, sf_dir):
    return cohorts.rows_with_cin(cleaned_company_list(spark, sf_dir))


@query(f"WITH {LIST_SQL} SELECT * FROM list WHERE cin IS NULL")
def rows_missing_cin(spark, sf_dir):
    return cohorts.rows_missing_cin(cleaned_company_list(spark, sf_dir))


DONE_SQL = f"{LIST_SQL}, done AS (SELECT cin, CASE WHEN source_row % 3 = 0 THEN 'success' ELSE 'failed' END AS status FROM list WHERE cin IS NOT NULL)"


def done(spark, sf_dir):
    return rows_with_cin(spark, sf_dir).select("cin", F.when(F.col("source_row") % 3 == 0, "success").otherwise("failed").alias("status"))


@query(f"WITH {DONE_SQL} SELECT * FROM list WHERE cin IS NOT NULL AND cin NOT IN (SELECT cin FROM done WHERE status = 'success')")
def pending_companies(spark, sf_dir):
    return cohorts.pending_companies(cleaned_company_list(spark, sf_dir), done(spark, sf_dir))


@query(f"WITH {DONE_SQL}, s AS (SELECT DISTINCT cin FROM done WHERE status = 'success') SELECT count(*) AS with_cin, count(s.cin) AS done, count(*) - count(s.cin) AS pending FROM list LEFT JOIN s USING (cin) WHERE list.cin IS NOT NULL")
def pipeline_status(spark, sf_dir):
    return cohorts.pipeline_status(cleaned_company_list(spark, sf_dir), done(spark, sf_dir))


@query(f"""WITH {LIST_SQL}, r AS (SELECT 'CUSTOMER#' || lpad(k::VARCHAR, 9, '0') || '   Pvt.  Ltd' AS n, 'U' || lpad(k::VARCHAR, 5, '0') || 'DL2001PTC' || lpad(k::VARCHAR, 6, '0') AS c FROM messy WHERE k % 2 = 0)
SELECT company_name, CASE WHEN cin IS NOT NULL THEN cin ELSE r.c END AS cin, source_row FROM list LEFT JOIN r ON company_name = r.n""")
def fill_cin_from_resolved(spark, sf_dir):
    k = F.col("k")
    found = messy(spark, sf_dir).filter(k % 2 == 0)
    code = lambda mark: F.concat(F.lit(mark), F.lpad(k.cast("string"), 5, "0"), F.lit("DL2001PTC"), F.lpad(k.cast("string"), 6, "0")).alias("cin")
    name = F.trim("raw_name").alias("company_name")
    resolved = found.select(name, code("X"), F.lit(1).alias("seq")).unionByName(found.select(name, code("U"), F.lit(2).alias("seq")))
    return cohorts.fill_cin_from_resolved(cleaned_company_list(spark, sf_dir), resolved)


COHORT_SQL = """defaulters AS (
  SELECT c_name AS company_name, 'L' || lpad(c_custkey::VARCHAR, 5, '0') || 'MH1999PLC' || lpad(c_custkey::VARCHAR, 6, '0') AS cin, c_mktsegment AS sector,
    CASE WHEN c_custkey % 4 <> 0 THEN (2008 + c_custkey % 12)::VARCHAR END AS default_year, CASE WHEN c_custkey % 5 = 0 THEN (2007 + c_custkey % 12) || '.0' END AS fy_before_default,
    c_custkey AS source_row, c_acctbal AS amount_crore FROM customer WHERE c_acctbal < 0),
controls AS (
  SELECT c_name AS company_name, CASE WHEN c_custkey % 3 = 0 THEN 'U' ELSE 'L' END || lpad(c_custkey::VARCHAR, 5, '0') || 'MH1999PLC' || lpad(c_custkey::VARCHAR, 6, '0') AS cin,
    CASE c_custkey % 7 WHEN 0 THEN 'Oil & Gas' WHEN 1 THEN NULL ELSE c_mktsegment END AS sector, c_custkey AS source_row FROM customer WHERE c_acctbal >= 0)"""


def both_cohorts(spark, sf_dir):
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer")
    code = lambda mark: F.concat(mark, F.lpad(k.cast("string"), 5, "0"), F.lit("MH1999PLC"), F.lpad(k.cast("string"), 6, "0")).alias("cin")
    defaulters = people.filter("c_acctbal < 0").select(
        F.col("c_name").alias("company_name"), code(F.lit("L")), F.col("c_mktsegment").alias("sector"), F.when(k % 4 != 0, (2008 + k % 12).cast("string")).alias("default_year"),
        F.when(k % 5 == 0, F.concat((2007 + k % 12).cast("string"), F.lit(".0"))).alias("fy_before_default"), k.alias("source_row"), F.col("c_acctbal").alias("amount_crore"),
    )
    controls = people.filter("c_acctbal >= 0").select(
        F.col("c_name").alias("company_name"), code(F.when(k % 3 == 0, "U").otherwise("L")), F.when(k % 7 == 0, "Oil & Gas").when(k % 7 == 1, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("sector"), k.alias("source_row"),
    )
    return defaulters, controls


@query(f"WITH {COHORT_SQL} SELECT company_name, cin, sector, 'defaulter' AS cohort FROM defaulters UNION ALL SELECT company_name, cin, sector, 'non_defaulter' FROM controls")
def union_cohorts(spark, sf_dir):
    return cohorts.union_cohorts(*both_cohorts(spark, sf_dir)).select("company_name", "cin", "sector", "cohort")


ANCHOR_SQL = f"""{COHORT_SQL},
anchored AS (
  SELECT *, CASE WHEN fy_before_default IS NOT NULL THEN regexp_replace(fy_before_default, '\\.0$', '')::INT WHEN default_year IS NOT NULL THEN default_year::INT - 1 ELSE 2023 END AS anchor_fy,
    CASE WHEN fy_before_default IS NOT NULL THEN 'fy_before_default' WHEN default_year IS NOT NULL THEN 'default_year-1' ELSE 'fallback_default_anchor_fy' END AS anchor_reason
  FROM defaulters),
medians AS (SELECT sector, round_even(median(anchor_fy), 0)::INT AS m FROM anchored GROUP BY 1),
overall AS (SELECT round_even(median(anchor_fy), 0)::INT AS m FROM anchored),
placed AS (
  SELECT c.*, coalesce(s.m, o.m) AS anchor_fy, CASE WHEN s.m IS NULL THEN 'global_median_from_defaulters' ELSE 'sector_median_from_defaulters' END AS anchor_reason
  FROM controls c CROSS JOIN overall o LEFT JOIN medians s ON s.sector = CASE WHEN trim(coalesce(c.sector, '')) = 'Oil & Gas' THEN 'Oil & Gas / Energy' ELSE trim(coalesce(c.sector, '')) END)"""


@query(f"WITH {ANCHOR_SQL} SELECT cin, anchor_fy, anchor_reason FROM anchored")
def defaulter_anchor(spark, sf_dir):
    return dp.defaulter_anchor(both_cohorts(spark, sf_dir)[0]).select("cin", "anchor_fy", "anchor_reason")


@query(f"WITH {ANCHOR_SQL} SELECT sector, m AS median_anchor FROM medians")
def median_anchor(spark, sf_dir):
    return dp.median_anchor(dp.defaulter_anchor(both_cohorts(spark, sf_dir)[0]), "sector")


@query(f"WITH {ANCHOR_SQL} SELECT cin, sector, anchor_fy, anchor_reason FROM placed")
def control_anchor(spark, sf_dir):
    defaulters, controls = both_cohorts(spark, sf_dir)
    return dp.control_anchor(controls, dp.defaulter_anchor(defaulters)).select("cin", "sector", "anchor_fy", "anchor_reason")


@query(f"WITH {ANCHOR_SQL} SELECT cin, anchor_fy, anchor_fy - unnest(range(3))::INT AS target_fy FROM anchored")
def lookback_years(spark, sf_dir):
    return dp.lookback_years(dp.defaulter_anchor(both_cohorts(spark, sf_dir)[0]).select("cin", "anchor_fy"))


@query(f"WITH {COHORT_SQL} SELECT cin, d AS doc_type, d NOT IN ('{"', '".join(dp.OPTIONAL)}') AS required FROM defaulters, (SELECT unnest(['{"', '".join(dp.REQUIRED + dp.OPTIONAL)}']) AS d)")
def expand_documents(spark, sf_dir):
    return dp.expand_documents(both_cohorts(spark, sf_dir)[0].select("cin"))


PLAN_SQL = f"""{ANCHOR_SQL},
docs AS (SELECT unnest(['{"', '".join(dp.REQUIRED + dp.OPTIONAL)}']) AS doc_type),
companies AS (
  SELECT 'defaulter' AS cohort, company_name, cin, sector, anchor_fy, anchor_reason FROM anchored UNION ALL
  SELECT 'non_defaulter', company_name, cin, sector, anchor_fy, anchor_reason FROM placed),
valid AS (SELECT * REPLACE (CASE WHEN length(cin) = 21 THEN cin END AS cin) FROM companies),
plan AS (
  SELECT cohort, company_name, cin, sector, coalesce(starts_with(cin, 'L'), false) AS is_listed, anchor_fy, anchor_reason,
    CASE WHEN coalesce(starts_with(cin, 'L'), false) THEN 'bse|nse|mca' ELSE 'mca' END AS source_priority, anchor_fy - y::INT AS target_fy, doc_type,
    doc_type NOT IN ('{"', '".join(dp.OPTIONAL)}') AS required
  FROM valid, range(3) r(y), docs)"""


@query(f"WITH {PLAN_SQL} SELECT * FROM plan")
def download_plan(spark, sf_dir):
    return dp.download_plan(*both_cohorts(spark, sf_dir))


@query(f"WITH {PLAN_SQL} SELECT DISTINCT cin, is_listed, source_priority FROM plan")
def source_priority(spark, sf_dir):
    return dp.download_plan(*both_cohorts(spark, sf_dir)).select("cin", "is_listed", "source_priority").distinct()


@query(f"""WITH {PLAN_SQL} SELECT 'companies' AS metric, count(DISTINCT cin) AS value FROM plan UNION ALL SELECT 'company_years', count(*) FROM (SELECT DISTINCT cin, target_fy FROM plan WHERE cin IS NOT NULL)
UNION ALL SELECT 'required_documents', count(*) FROM plan WHERE required UNION ALL SELECT 'optional_documents', count(*) FROM plan WHERE NOT required
UNION ALL SELECT 'cohort:' || cohort, count(*) FROM plan GROUP BY 1 UNION ALL SELECT 'source_priority:' || source_priority, count(*) FROM plan GROUP BY 1""")
def plan_summary(spark, sf_dir):
    return dp.plan_summary(download_plan(spark, sf_dir))


@query(f"WITH {PLAN_SQL}, y AS (SELECT DISTINCT cin, target_fy FROM plan) SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY cin ORDER BY target_fy DESC) <= 2")
def top_years_per_company(spark, sf_dir):
    return cohorts.top_years_per_company(download_plan(spark, sf_dir), 2)


@query(f"""WITH {PLAN_SQL}, y AS (SELECT DISTINCT cin, target_fy AS financial_year FROM plan WHERE cin IS NOT NULL) SELECT cin, financial_year, company_name FROM y JOIN (SELECT DISTINCT cin, company_name FROM companies) USING (cin)
WHERE NOT (financial_year % 2 = 0 AND ascii(right(cin, 1)) % 2 = 0)""")
def pending_company_years(spark, sf_dir):
    plan = download_plan(spark, sf_dir)
    finished = plan.select("cin", F.col("target_fy").alias("financial_year")).distinct().filter((F.col("financial_year") % 2 == 0) & (F.ascii(F.substring("cin", -1, 1)) % 2 == 0))
    defaulters, controls = both_cohorts(spark, sf_dir)
    companies = defaulters.select("cin", "company_name").unionByName(controls.select("cin", "company_name"))
    return cohorts.pending_company_years(companies, plan, finished).select("cin", "financial_year", "company_name")


@query("""SELECT company_name, source_row FROM (SELECT c_name AS company_name, c_custkey AS source_row FROM customer WHERE c_acctbal >= 0)
WHERE lower(company_name) NOT IN (SELECT lower(replace(s_name, 'Supplier', 'Customer')) FROM supplier)""")
def exclude_listed(spark, sf_dir):
    listed = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))).alias("company_name"))
    return cohorts.exclude_listed(both_cohorts(spark, sf_dir)[1].select("company_name", "source_row"), listed)


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark, sf_dir):
    return cohorts.dedupe_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""WITH m AS (SELECT s_suppkey, 'f' || s_suppkey || '.pdf' AS filename, s_nationkey AS nation FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT filename, l_orderkey, l_linenumber, nation FROM (SELECT 'f' || l_suppkey || '.pdf' AS filename, l_orderkey, l_linenumber FROM lineitem) JOIN m USING (filename)""".replace("s_suppkey, 'f'", "'f'"))
def attach_report_ids(spark, sf_dir):
    file = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"), F.lit(".pdf")).alias("filename")
    manifest = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(file("s_suppkey"), F.col("s_nationkey").alias("nation"))
    return cohorts.attach_report_ids(table(spark, sf_dir, "lineitem").select(file("l_suppkey"), "l_orderkey", "l_linenumber"), manifest)


@query("SELECT * FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS company_name, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS amount, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS note FROM customer) WHERE company_name IS NOT NULL OR amount IS NOT NULL")
def drop_unusable_rows(spark, sf_dir):
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(F.when(k % 3 != 0, F.col("c_name")).alias("company_name"), F.when(k % 5 > 0, F.col("c_acctbal")).alias("amount"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("note"))
    return cohorts.drop_unusable_rows(df, ["company_name", "cin", "amount", "bank_name"])


@query("""WITH t AS (SELECT c_name, s_name, array_to_string(list_sort(string_split(lower(c_name), ' ')), ' ') AS a, array_to_string(list_sort(string_split(lower(s_name), ' ')), ' ') AS b FROM customer JOIN supplier ON c_custkey = s_suppkey),
s AS (SELECT c_name, s_name, 100.0::DOUBLE * (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b)) AS similarity FROM t)
SELECT *, CASE WHEN similarity >= 90 THEN 'auto' WHEN similarity >= 85 THEN 'verify' ELSE 'manual' END AS tier FROM s""")
def match_tiers(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    rows = pairs.select("c_name", "s_name", matching.levenshtein_similarity(F.col("c_name"), F.col("s_name")).alias("similarity"))
    return rows.withColumn("tier", matching.match_tier(F.col("similarity")))


@query("""WITH n AS (SELECT p_name, min(p_partkey) AS place, length(p_name) AS n FROM part GROUP BY 1)
SELECT upper(p_name) || 'Q ' AS company_name, p_partkey::VARCHAR AS cin, place::VARCHAR AS code, p_name AS name, round_even(200.0::DOUBLE * n / (2 * n + 1), 2) AS score FROM part JOIN n USING (p_name)""")
def fuzzy_match_names(spark, sf_dir):
    """Part names and copies of them with a letter too many: every part finds the name that it was made from."""
    parts = table(spark, sf_dir, "part")
    left = parts.select(F.concat(F.upper("p_name"), F.lit("Q ")).alias("company_name"), F.col("p_partkey").cast("string").alias("cin"))
    right = parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("place")).select(F.col("place").cast("string").alias("code"), "name", "place")
    return matching.fuzzy_match_names(left, right)


@query("""SELECT c_name AS company_name, c_custkey AS source_row FROM customer WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 1)""")
def exclude_similar(spark, sf_dir):
    """Controls without those whose name is on a list as it is or with one letter too many; two letters too many are another name."""
    k = F.col("s_suppkey")
    name = F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER"))
    wrong = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(F.lit("qq"), name)).otherwise(F.concat(F.lit("  x"), name))
    controls = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_name").alias("company_name"), F.col("c_custkey").alias("source_row"))
    return matching.exclude_similar(controls, table(spark, sf_dir, "supplier").select(wrong.alias("company_name")), 95, 3)
