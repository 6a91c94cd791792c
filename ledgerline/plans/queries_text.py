"""Queries of report texts, links, statement line items, published tables and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, extract, scoring
from ..operators.ranges import stored
from . import panel, queries_scores  # noqa: F401  its SQL checks the incremental job, too
from .catalog import query
from .panel import table

#: Words that occur in the invented documents, in place of the report words.
WORDS = {"opinion": ("the ",), "disclaimer": ("licensed",), "adverse": (" of ",), "qualified": (" and ",), "going_concern": (" to ",), "uncertainty": ("ing ", "ed "), "emphasis": ("version",), "fraud": (" que ",), "reported": (" le ", " la ")}
HAS = lambda k: "(" + " OR ".join(f"contains(t, '{w}')" for w in WORDS[k]) + ")"


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN {HAS('disclaimer')} AND {HAS('opinion')} THEN 'disclaimer' WHEN {HAS('adverse')} AND {HAS('opinion')} THEN 'adverse' WHEN {HAS('qualified')} AND {HAS('opinion')} THEN 'qualified' ELSE 'unqualified' END AS opinion_type,
  ({HAS('going_concern')} AND {HAS('uncertainty')})::INT AS going_concern_uncertainty, ({HAS('emphasis')})::INT AS emphasis_of_matter, ({HAS('fraud')} AND {HAS('reported')})::INT AS fraud_reported FROM d""")
def auditor_flags(spark, sf_dir):
    flags = extract.auditor_flags(F.col("text"), WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", flags.alias("x")).select("doc_id", "x.*")


#: One report sentence for each customer.
REPORT_SQL = """reports AS (
  SELECT c_custkey AS k, CASE c_custkey % 6
    WHEN 0 THEN 'Statutory Auditor: Firm ' || c_custkey || ' for the year. Promoters and group: ' || (c_custkey % 90) || '.25 % held'
    WHEN 1 THEN 'M/s ' || c_mktsegment || ' and Co, Chartered Accountants. Related party dealings amount: ' || (c_custkey % 90) || ',' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '.5 in all'
    WHEN 2 THEN 'Contingent liabilities not provided, Rs. ' || (c_custkey % 9) || ',100 crore. 45.5 % of shares by promoter'
    WHEN 3 THEN '7,250.75 crore with related party units; 12 cr. contingent'
    WHEN 4 THEN NULL ELSE 'nothing to report' END AS text FROM customer)"""


def reports(spark, sf_dir):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    text = F.when(k % 6 == 0, F.concat(F.lit("Statutory Auditor: Firm "), s(k), F.lit(" for the year. Promoters and group: "), s(k % 90), F.lit(".25 % held")))
    text = text.when(k % 6 == 1, F.concat(F.lit("M/s "), "c_mktsegment", F.lit(" and Co, Chartered Accountants. Related party dealings amount: "), s(k % 90), F.lit(","), F.lpad(s(k % 1000), 3, "0"), F.lit(".5 in all")))
    text = text.when(k % 6 == 2, F.concat(F.lit("Contingent liabilities not provided, Rs. "), s(k % 9), F.lit(",100 crore. 45.5 % of shares by promoter")))
    text = text.when(k % 6 == 3, "7,250.75 crore with related party units; 12 cr. contingent").when(k % 6 == 5, "nothing to report")
    return table(spark, sf_dir, "customer").select(k.alias("k"), text.alias("text"))


#: What the sentences say, from how they are made. A line's first number with a unit counts before the subject.
AMOUNTS_SQL = {
    "promoter_pct": "CASE k % 6 WHEN 0 THEN k % 90 + 0.25::DOUBLE WHEN 2 THEN 45.5::DOUBLE END",
    "rpt_amount": "CASE k % 6 WHEN 1 THEN (k % 90) * 1000 + k % 1000 + 0.5::DOUBLE WHEN 3 THEN 7250.75::DOUBLE END",
    "contingent_amount": "CASE k % 6 WHEN 2 THEN (k % 9) * 1000 + 100.0::DOUBLE WHEN 3 THEN 7250.75::DOUBLE END",
}


def _amount(name: str) -> None:
    def run(spark, sf_dir):
        return reports(spark, sf_dir).select("k", getattr(extract, name)(F.col("text")).alias(name))

    run.__name__ = name
    query(f"WITH {REPORT_SQL} SELECT k, {AMOUNTS_SQL[name]} AS {name} FROM reports")(run)


for _name in AMOUNTS_SQL:
    _amount(_name)


@query(f"""WITH {REPORT_SQL} SELECT k, CASE k % 6 WHEN 0 THEN regexp_extract(text, ': (.*?) for ', 1) WHEN 1 THEN regexp_extract(text, 'M/s (.*?), Chartered', 1) END AS auditor_name FROM reports""")
def auditor_name(spark, sf_dir):
    return reports(spark, sf_dir).select("k", extract.auditor_name(F.col("text")).alias("auditor_name"))


LINK_SQL = """anchors AS (SELECT page_id, url, unnest(a) AS a, generate_subscripts(a, 1) - 1 AS place FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS a FROM pages)),
raw AS (SELECT page_id, place, url, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS h, trim(regexp_replace(lower(regexp_replace(a, '(?s)<[^>]*>', '', 'g')), '\\s+', ' ', 'g')) AS text FROM anchors),
absolute AS (SELECT page_id, place, CASE WHEN regexp_matches(h, '^[a-zA-Z]+://') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) || h ELSE regexp_replace(url, '[^/]*$', '') || h END AS href, text FROM raw),
links AS (SELECT * FROM absolute WHERE ends_with(regexp_replace(lower(href), '\\?.*$', ''), 'e') QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY place) = 1)"""


@query(f"""WITH {LINK_SQL}, f AS (SELECT *, string_split(regexp_replace(href, '\\?.*$', ''), '/')[-1] AS filename FROM links)
SELECT page_id, place::INT AS place, href, text, filename, regexp_replace(filename, '\\.[^.]*$', '') AS quarter FROM f""")
def extract_links(spark, sf_dir):
    return extract.extract_links(table(spark, sf_dir, "pages"), "e")


@query(f"""WITH {LINK_SQL}, t AS (SELECT page_id, href, CASE WHEN contains(lower(href), 'the') OR contains(text, 'the') THEN 1 WHEN contains(href, '/de') THEN 2 ELSE 3 END AS tier FROM links)
SELECT * FROM t QUALIFY tier = min(tier) OVER (PARTITION BY page_id)""")
def link_manifest_filter(spark, sf_dir):
    links = extract_links(spark, sf_dir).select("page_id", "href", "text")
    return cohorts.link_manifest_filter(links, ["the"], ["/de"]).select("page_id", "href", "tier")


#: Line items made from order lines: a company-year's lines in turn, with statement labels.
LABELS = ("Net Sales", "Net Profit / Loss", "Interest", "Depreciation", "Profit Before Tax", "Equity Capital", "Reserves", "Net Worth", "Other")
PATTERNS = [("revenue", 1, "sales"), ("revenue", 2, "revenue from operations"), ("pat", 1, "net profit"), ("interest_expense", 1, "interest"), ("depreciation", 1, "depreciation"), ("pbt", 1, "profit before tax"), ("equity_capital", 1, "equity capital"), ("reserves", 1, "reserves"), ("net_worth", 1, "net worth")]
ITEM_SQL = f"""items AS (
  SELECT o_custkey AS cin, year(o_orderdate)::INT AS financial_year, 0 AS table_pos, l_orderkey * 10 + l_linenumber AS row_pos, ['{"', '".join(LABELS)}'][1 + (l_partkey % {len(LABELS)})::INT] AS label,
    CASE WHEN l_quantity > 3 THEN l_extendedprice END AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
patterns AS (SELECT * FROM (VALUES {', '.join(str(x) for x in PATTERNS)}) v(field, rank, pattern)),
matched AS (
  SELECT cin, financial_year, field, first(value ORDER BY rank, row_pos, value) AS value FROM items JOIN patterns ON contains(lower(label), pattern) OR contains(pattern, lower(label))
  WHERE value IS NOT NULL GROUP BY ALL)"""


def items(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cin"), F.year("o_orderdate").alias("financial_year"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("l_partkey") % len(LABELS) + 1).cast("int"))
    value = F.when(F.col("l_quantity") > 3, F.col("l_extendedprice"))
    return lines.select("cin", "financial_year", F.lit(0).alias("table_pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_pos"), F.concat(F.lit(" "), F.upper(label)).alias("label"), value.alias("value"))


def matched(spark, sf_dir):
    return extract.match_line_items(items(spark, sf_dir), spark.createDataFrame(PATTERNS, "field string, rank int, pattern string"))


@query(f"WITH {ITEM_SQL} SELECT * FROM matched")
def match_line_items(spark, sf_dir):
    return matched(spark, sf_dir)


@query(f"""WITH {ITEM_SQL} SELECT cin, financial_year, field, first(value ORDER BY row_pos, value) * 0.01::DOUBLE AS value FROM items JOIN patterns ON contains(lower(label), pattern) WHERE value IS NOT NULL GROUP BY ALL""")
def match_report_items(spark, sf_dir):
    """The report variant: the first row of any pattern, amounts from lakhs to crores."""
    patterns = spark.createDataFrame(PATTERNS, "field string, rank int, pattern string")
    return extract.match_line_items(items(spark, sf_dir), patterns, "report", 0.01)


FIELDS = list(dict.fromkeys(x[0] for x in PATTERNS))


@query(f"""WITH {ITEM_SQL}, wide AS (SELECT cin, financial_year, {', '.join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in FIELDS)} FROM matched GROUP BY ALL)
SELECT *, pbt + interest_expense + depreciation AS ebitda, coalesce(equity_capital + reserves, equity_capital, net_worth) AS total_equity, reserves AS retained_earnings FROM wide""")
def assemble_company_year(spark, sf_dir):
    return extract.assemble_company_year(matched(spark, sf_dir), FIELDS)


@query("""WITH c AS (SELECT s_suppkey AS id, unnest([s_suppkey || '|' || s_name || '|x', '|no code', 'line without bars', 'B' || s_suppkey || '| ' || lower(s_name)]) AS line, unnest([0, 1, 2, 3]) AS place FROM supplier)
SELECT id, place, trim(string_split(line, '|')[1]) AS code, trim(string_split(line, '|')[2]) AS name FROM c WHERE contains(line, '|') AND trim(string_split(line, '|')[1]) <> ''""")
def parse_candidates(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    raw = F.concat_ws("\n", F.concat(k, F.lit("|"), "s_name", F.lit("|x")), F.lit("|no code"), F.lit("line without bars"), F.concat(F.lit("B"), k, F.lit("| "), F.lower("s_name")))
    return extract.parse_candidates(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), raw.alias("raw")))


@query("""SELECT c_nationkey::BIGINT AS table_id, c_custkey + 1 AS row_pos, c_name AS company_name, NULL::VARCHAR AS cin, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS bank_name, NULL::VARCHAR AS branch, NULL::VARCHAR AS state,
  c_custkey + 0.5::DOUBLE AS amount, CASE WHEN c_custkey % 2 = 0 THEN DATE '2016-03-05' END AS classification_date FROM customer""")
def normalize_published_table(spark, sf_dir):
    """Customers as published tables of cells, one table a nation, with a title row and headers of several spellings."""
    k, t = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    people = table(spark, sf_dir, "customer")
    cell = lambda col, value: F.struct(F.lit(col).alias("col_pos"), value.alias("value"))
    body = people.select(t.alias("table_id"), (k + 1).alias("row_pos"), F.explode(F.array(
        cell(0, F.concat(F.lit(" "), "c_name")), cell(1, F.when(k % 3 > 0, F.col("c_mktsegment"))), cell(2, F.concat(k.cast("string"), F.lit(".5"))), cell(3, F.when(k % 2 == 0, "05/03/2016").otherwise("n.a.")),
    )).alias("x"))
    heads = people.select(t.alias("table_id")).distinct().select("table_id", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("row_pos"), cell(0, F.lit("List of accounts")).alias("x")),
        *[F.struct(F.lit(0).cast("long").alias("row_pos"), cell(i, F.lit(h)).alias("x")) for i, h in enumerate(("Name of the  Borrower", "Bank", "Outstanding Amount", "Date of Classification"))],
    )).alias("y")).select("table_id", "y.row_pos", "y.x")
    return extract.normalize_published_table(body.unionByName(heads).select("table_id", "row_pos", "x.col_pos", "x.value"))


@query("""WITH t AS (SELECT c_nationkey::BIGINT AS table_id, c_custkey AS k, * FROM customer WHERE c_nationkey % 5 <> 4)
SELECT table_id, k AS row_pos, trim(c_name) AS company_name, CASE WHEN k % 4 > 0 THEN k + 0.5::DOUBLE WHEN table_id % 5 = 2 THEN k::DOUBLE END AS amount,
  CASE WHEN table_id % 5 = 1 THEN 'x' || k END AS column_3, CASE WHEN table_id % 5 = 0 THEN 'AAA' || k END AS pan, CASE WHEN table_id % 5 = 3 THEN c_mktsegment END AS remarks,
  'list-' || table_id || '.pdf' AS source_pdf, CASE WHEN table_id % 5 = 3 THEN k::VARCHAR END AS source_pdf_ FROM t""")
def union_published_tables(spark, sf_dir):
    """Tables with a PAN, without a header, with two amounts, with unknown headers, and ones that are no lists at all."""
    k, t = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    people, kind, text = table(spark, sf_dir, "customer"), F.col("c_nationkey") % 5, k.cast("string")
    cell = lambda col, head, value, when=F.lit(True): F.when(when, F.struct(F.lit(col).alias("col_pos"), F.lit(head).alias("head"), value.alias("value")))
    cells = F.filter(F.array(
        cell(0, "Name of the  Borrower", F.concat(F.lit(" "), "c_name"), kind != 4), cell(0, "Chapter", F.lit("7"), kind == 4), cell(1, "Outstanding Amount", F.when(k % 4 > 0, F.concat(text, F.lit(".5"))).otherwise(""), kind != 4),
        cell(2, "PAN", F.concat(F.lit("AAA"), text), kind == 0), cell(3, " ", F.concat(F.lit("x"), text), kind == 1), cell(2, "Amount", text, kind == 2), cell(2, "Remarks", F.col("c_mktsegment"), kind == 3), cell(3, "Source_PDF", text, kind == 3),
    ), lambda x: x.isNotNull())
    rows = people.select(t.alias("table_id"), k.cast("long").alias("row_pos"), F.explode(cells).alias("x"))
    heads = rows.groupBy("table_id", F.col("x.col_pos").alias("col_pos")).agg(F.min("x.head").alias("value")).select("table_id", F.lit(-1).cast("long").alias("row_pos"), "col_pos", "value")
    # a table of another kind has no row of a borrower's name: its header is row 0, so it is given as such
    heads = heads.withColumn("row_pos", F.when(F.col("table_id") % 5 == 4, 0).otherwise(F.col("row_pos")).cast("long"))
    origin = people.select(t.alias("table_id")).distinct().select("table_id", F.concat(F.lit("list-"), F.col("table_id").cast("string"), F.lit(".pdf")).alias("source_pdf"))
    return extract.union_published_tables(rows.select("table_id", "row_pos", "x.col_pos", "x.value").unionByName(heads), origin)


@query("""WITH c AS (SELECT o_custkey AS cin, year(o_orderdate)::INT AS y, o_orderkey AS k FROM orders)
SELECT cin, 'profit-loss' AS section, 0 AS table_pos, 1 AS row_pos, 'Sales' AS label, y AS financial_year, (1000 + k)::DOUBLE AS value FROM c
UNION ALL SELECT cin, 'profit-loss', 0, 2, 'Tax', y - 1, -5.5::DOUBLE FROM c""")
def parse_statement_tables(spark, sf_dir):
    """A statement page for each order, parsed back into line items."""
    y, k = F.year("o_orderdate"), F.col("o_orderkey")
    tr = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    amount = F.regexp_replace((1000 + k).cast("string"), "([0-9]{3})$", ",$1")
    page = F.concat(
        F.lit('<section id="profit-loss"><table>'), tr(F.lit(""), F.concat(F.lit("Mar "), (y - 1).cast("string")), F.concat(F.lit("Mar <b>"), F.substring(y.cast("string"), 3, 2), F.lit("</b>"))),
        tr(F.lit("Sales"), F.lit("--"), amount), tr(F.lit("Tax"), F.lit("-5.5"), F.lit("")), F.lit("</table></section>"),
    )
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cin"), page.alias("html"))
    found = extract.statement_items(extract.parse_statement_tables(pages))
    late = F.when(F.col("financial_year") > 2050, F.col("financial_year") - 100).otherwise(F.col("financial_year"))  # two digits of a year before 2000
    return found.select("cin", "section", "table_pos", "row_pos", "label", late.alias("financial_year"), "value")


@query("""WITH e AS (SELECT user_id AS cin, year(ts)::INT AS financial_year, min(event_id) AS event_id FROM events GROUP BY ALL)
SELECT cin, financial_year, CASE WHEN cin % 2 = 0 THEN -1 ELSE event_id END AS event_id, 1::BIGINT AS marks FROM e WHERE cin % 7 <> 0""")
def append_with_checkpoint(spark, sf_dir):
    """A job that had died between its two writes is started again, twice: every year once, every key marked once."""
    from ..sources import tables

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("cin"), F.year("ts").alias("financial_year"), "event_id")
    done = rows.filter("cin % 7 = 0").select("cin", "financial_year").distinct()
    out, marks = tables.new_path(spark, "appended"), tables.new_path(spark, "marks")
    rows.filter("cin % 2 = 0 and cin % 7 <> 0").select("cin", "financial_year", F.lit(-1).cast("long").alias("event_id")).distinct().write.parquet(out)
    for _ in range(2):
        tables.append_with_checkpoint(rows, done, out, marks)
    marked = spark.read.parquet(marks).groupBy("cin", "financial_year").agg(F.count(F.lit(1)).alias("marks"))
    return spark.read.parquet(out).join(marked, ["cin", "financial_year"])


@query("""SELECT count(*) AS n_rows, 0::BIGINT AS overlaps, count(DISTINCT o_custkey) AS n_keys FROM orders""")
def write_table_ordered(spark, sf_dir):
    """Orders written by customer in ranges: rows, customers, and pairs of neighbouring files that overlap by more than a tie."""
    from pyspark.sql import Window

    from ..sources import tables

    path = tables.new_path(spark, "ordered")
    tables.write_table(table(spark, sf_dir, "orders"), path, order=["o_custkey"], rows_per_file=2000)
    rows = spark.read.parquet(path).select("o_custkey", F.input_file_name().alias("file"))
    files = rows.groupBy("file").agg(F.min("o_custkey").alias("least"), F.max("o_custkey").alias("most"))  # one row a file
    before = F.lag("most").over(Window.orderBy("least", "most"))
    overlaps = files.withColumn("before", before).agg(F.count_if(F.col("least") < F.col("before")).alias("overlaps"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_keys"), F.lit(1).alias("one"))
    return sizes.join(overlaps.withColumn("one", F.lit(1)), "one").select("n_rows", "overlaps", "n_keys")


@query("""SELECT o_custkey AS cin, year(o_orderdate)::INT AS financial_year, (o_orderkey % 1000)::DOUBLE AS revenue FROM orders""")
def read_json_rows(spark, sf_dir):
    """Payloads of three forms written as JSON files, read back: objects, lists of objects, and objects with a list of rows."""
    from ..sources import tables

    row = F.to_json(F.struct(F.col("o_custkey").alias("cin"), F.year("o_orderdate").alias("financial_year"), (F.col("o_orderkey") % 1000).cast("double").alias("revenue")))
    k = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), row.alias("row")).groupBy("k").agg(F.array_join(F.collect_list("row"), ",").alias("rows"), F.count(F.lit(1)).alias("n"))
    body = F.when(F.col("n") == 1, F.col("rows")).when(F.col("k") % 2 == 0, F.concat(F.lit("["), "rows", F.lit("]"))).otherwise(F.concat(F.lit('{"rows": ['), "rows", F.lit("]}")))
    base = tables.new_path(spark, "payloads")
    rows.select(body.alias("value")).write.text(base)
    return tables.read_json_lines(spark, base, "cin bigint, financial_year int, revenue double")


@query(f"WITH {panel.SQL} SELECT company_name, financial_year, CASE WHEN promoter_holding_pct % 4 <> 0 THEN round(promoter_holding_pct, 2) END AS promoter_holding_pct, CASE WHEN financial_year % 5 <> 0 THEN sector END AS sector FROM company_year")
def read_company_years(spark, sf_dir):
    """Company-years as text with missing tokens and bad numbers, typed again."""
    from ..sources.tables import typed_company_years

    df = panel.company_years(spark, sf_dir)
    texts = df.select(
        "company_name", F.concat(F.col("financial_year").cast("string"), F.lit(" ")).alias("financial_year"),
        F.when(F.col("promoter_holding_pct") % 4 == 0, "12 percent").otherwise(F.col("promoter_holding_pct").cast("string")).alias("promoter_holding_pct"),
        F.when(F.col("financial_year") % 5 == 0, "N/A").otherwise(F.col("sector")).alias("sector"),
    )
    return typed_company_years(texts).select("company_name", "financial_year", "promoter_holding_pct", "sector")


def _score_sql() -> str:
    from .catalog import ORACLE_SQL

    return ORACLE_SQL["score_companies"]


@query(_score_sql())
def incremental_score(spark, sf_dir):
    """The incremental job over the company-years in two batches of files: its latest scores are those of one whole run."""
    from ..sources.tables import new_path
    from ..streaming import incremental
    from .queries_scores import THRESHOLD

    base = new_path(spark, "incremental")
    years = stored(panel.company_years(spark, sf_dir), "company-years")
    for batch in ("financial_year <= 1996", "financial_year > 1996"):
        years.filter(batch).write.mode("append").parquet(f"{base}/incoming")
        incremental.incremental_score(spark, f"{base}/incoming", years.schema, f"{base}/facts", f"{base}/scores", f"{base}/checkpoint", THRESHOLD).awaitTermination()
    schema = scoring.score_companies(spark.createDataFrame([], years.schema), THRESHOLD).schema
    rows = incremental.latest_scores(spark, f"{base}/scores", schema)
    return rows.select("cin", "latest_financial_year", "years_received", F.round("ml_probability", 9).alias("ml_probability"), "risk_band", "rule_flag_count")
