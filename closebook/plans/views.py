"""Ledgers, rates, rosters and catalogues derived from the test tables.

The tables hold no trial balances, so each order becomes a balanced pair of ledger rows of
its customer's nation, and customers, parts and documents stand in for clients, services and
prior letters. Every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTER_PERIOD = "202512"
STAMP = "2025-12-31 08:00 UTC"
LETTERS_DIR = "/close/letters"
RECIPIENTS = ["mail://close-desk", "mail://partner"]
TEMPLATE = (
    "{{ClientName}}, our number {{ClientID}}\n\n"
    "For the year {{FiscalYear}} we agreed on this work:\n"
    "{{ServiceSummary}}\n"
    "Written on {{GeneratedOn}}\n"
)


# Schemas of the test tables, so that reading one needs no look at its files first.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
               p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
                 o_orderdate timestamp_ntz, o_orderpriority string""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
                 props string""",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation, region and currency they are booked under.

    The ledger month lies twenty years after the order, as file names only speak of 20xx.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    booked = (
        orders.join(customer, F.expr("o_custkey = c_custkey"))
        .join(nation, F.expr("c_nationkey = n_nationkey"))
        .join(region, F.expr("n_regionkey = r_regionkey"))
    )
    return booked.selectExpr(
        "o_orderkey AS DocumentNo",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(20,4)) AS amt",
        "o_orderpriority AS priority",
        "o_orderstatus AS status",
        "n_nationkey AS nation",
        "r_name AS region",
        "upper(substr(r_name, 1, 3)) AS currency",
        f"{_MONTH} AS period",
    )


_MONTH = "CAST(CAST(date_format(o_orderdate, 'yyyyMM') AS INT) + 2000 AS STRING)"

CANONICAL = [
    "EntityCode",
    "AccountCode",
    "AccountName",
    "Debit",
    "Credit",
    "Period",
    "CurrencyCode",
]


def ledger(spark: SparkSession, sf_dir: str, slip: bool = False) -> DataFrame:
    """Canonical ledger, a receivable and a revenue row per order.

    ``slip`` books a cent too much revenue for the largest orders.
    """
    revenue = "amt + CASE WHEN amt > 499000 THEN 0.01 ELSE 0 END" if slip else "amt"
    legs = f"""inline(array(
        named_struct('AccountCode', 'AR', 'AccountName', 'Receivables',
                     'Debit', amt, 'Credit', CAST(0 AS DECIMAL(20,4))),
        named_struct('AccountCode', concat('REV-', substr(priority, 1, 1)), 'AccountName', NULL,
                     'Debit', CAST(0 AS DECIMAL(20,4)), 'Credit', CAST({revenue} AS DECIMAL(20,4)))))"""
    return postings(spark, sf_dir).selectExpr(
        "DocumentNo",
        "concat('N', nation) AS EntityCode",
        legs,
        "period AS Period",
        "currency AS CurrencyCode",
        "region",
        "status",
        "concat('TB_N', nation, '_', period, '.xlsx') AS file_name",
    )


def file_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows per file; ASIA files lack the entity, EUROPE files the period.

    Pending orders lack the entity everywhere, so files are also blank in part.
    """
    return ledger(spark, sf_dir).selectExpr(
        "DocumentNo",
        "file_name",
        "CASE WHEN region <> 'ASIA' AND status <> 'P' THEN EntityCode END AS EntityCode",
        "AccountCode",
        "AccountName",
        "Debit",
        "Credit",
        "CASE WHEN region = 'EUROPE' THEN '' ELSE Period END AS Period",
        "CurrencyCode",
    )


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_ledger`` as exported: other headers, text cells, blanks and junk."""
    return file_ledger(spark, sf_dir).selectExpr(
        "EntityCode AS company",
        "AccountCode AS `GL Account`",
        "AccountName AS AccountDesc",
        "CASE WHEN Debit = 0 THEN 'n/a' ELSE CAST(Debit AS STRING) END AS Dr",
        "CASE WHEN Credit = 0 THEN '' ELSE CAST(Credit AS STRING) END AS `CREDIT AMOUNT`",
        """CASE WHEN Period = '' THEN ''
           ELSE concat(substr(Period, 1, 4), '-', substr(Period, 5, 2)) END AS PostingPeriod""",
        "concat(' ', lower(CurrencyCode), ' ') AS curr",
        "DocumentNo AS Memo",
        "file_name",
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "upper(substr(r_name, 1, 3)) AS CurrencyCode",
        "CAST(1 + r_regionkey * 0.075 AS DECIMAL(17,10)) AS FXRate",
    )


def gappy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates file with an unreadable EUR rate and no AFR rate."""
    return table(spark, sf_dir, "region").filter("r_name <> 'AFRICA'").selectExpr(
        "lower(substr(r_name, 1, 3)) AS Currency",
        "CASE WHEN r_name = 'EUROPE' THEN 'n/a' ELSE '1.5' END AS Rate",
        "r_regionkey AS line_no",
    )


def rate_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate quotes, many per currency, the later one valid; quotes under 1 are unreadable."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat(lower(substr(event_type, 1, 3)), ' ') AS `ISO Currency`",
        "CASE WHEN value < 1 THEN 'n/a' ELSE CAST(value AS STRING) END AS FX",
        "date_format(ts, 'yyyy-MM') AS PeriodId",
        "'feed' AS Source",
        "event_id",
    )


def text_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as exported text: padded, signed, with currency sign, blank or junk."""
    cells = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "c_mktsegment AS segment",
        "c_acctbal AS bal",
        "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS text",
    )
    return cells.selectExpr(
        "c_custkey",
        """CASE WHEN segment = 'FURNITURE' AND bal < 0 THEN 'n/a'
                WHEN bal < -500 THEN ''
                WHEN segment = 'MACHINERY' THEN concat(' ', text, ' ')
                WHEN segment = 'BUILDING' AND bal > 0 THEN concat('+', text)
                WHEN segment = 'AUTOMOBILE' AND bal > 9000 THEN concat('$', text)
                WHEN segment = 'HOUSEHOLD' AND bal > 9000 THEN concat(text, 'd')
                ELSE text END AS Amount""",
    )


def _coded_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two service codes; the second one sometimes does not exist."""
    return table(spark, sf_dir, "customer").selectExpr(
        "*",
        "concat('brand#', c_nationkey + 1) AS code1",
        "concat('Brand#', CAST(floor(abs(c_acctbal) / 380) AS INT) + 1) AS code2",
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster records as JSON objects, with the key spelling differing by segment."""
    return _coded_customers(spark, sf_dir).selectExpr(
        "c_custkey",
        """parse_json(concat(
          CASE c_mktsegment WHEN 'BUILDING' THEN '{"client_id":"' WHEN 'FURNITURE' THEN '{"Id":"'
                            ELSE '{"ClientID":"' END,
          'C-', c_custkey,
          CASE c_mktsegment WHEN 'BUILDING' THEN '","client_name":"' WHEN 'FURNITURE' THEN '","Name":"'
                            ELSE '","ClientName":"' END,
          CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 0 THEN '' ELSE c_name END,
          '","FiscalYear":',
          CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '"2024"' WHEN c_mktsegment = 'MACHINERY' THEN 'null'
               WHEN c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 9000 THEN '"FY25"' ELSE '2025' END,
          ',"ServiceLineCodes":"',
          CASE WHEN c_acctbal < -900 THEN '' ELSE concat(code1, '; ', code2, ' ,') END,
          '"}')) AS record""",
    )


def nested_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster records whose service assignment has a different shape in each segment."""
    return _coded_customers(spark, sf_dir).selectExpr(
        "c_custkey",
        """parse_json(replace(replace(CASE c_mktsegment
          WHEN 'AUTOMOBILE' THEN '{"ServiceLines":["<a>"," <b> ","<a>",""]}'
          WHEN 'BUILDING' THEN
            '{"ServiceLines":[{"code":"<a>"},{"Code":" <b>"},{"ServiceLineCode":"<a>"},{"x":1}]}'
          WHEN 'FURNITURE' THEN '{"services":{"codes":["<a>","<b>;<a>"]}}'
          WHEN 'HOUSEHOLD' THEN '{"service_line_codes":"<b>;<a>, <b>,,"}'
          ELSE
            '{"ServiceLines":[],"ServiceAssignments":{"codes":[],"service_lines":[{"code":"<b>"},"<a>"]}}'
          END, '<a>', code1), '<b>', code2)) AS record""",
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service catalogue records, many per code; PROMO parts carry no rate."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        """to_variant_object(named_struct(
          'ServiceLineCode', concat(' ', lower(p_brand)), 'Description', p_type,
          'Rate', CASE WHEN p_type = 'PROMO' THEN '' ELSE CAST(p_retailprice AS STRING) END)) AS record""",
    )


def prior_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior letters as (file_name, text): whole documents with merge fields at the end."""
    return table(spark, sf_dir, "documents").selectExpr(
        """concat('Customer_', lpad(CAST(doc_id AS STRING), 9, '0'), '_EngagementLetter_FY',
                  CASE WHEN lang = 'en' THEN '2024' ELSE '2023' END, '.docx') AS file_name""",
        r"""CASE WHEN source = 'src0' THEN ''
                 WHEN source IN ('src1', 'src2', 'src3')
                 THEN concat(text, '\nFor {{ClientName}}\n{{ServiceSummary}}\n')
                 ELSE concat(text, '\nFor {{ClientName}}, FY{{FiscalYear}} \n\t') END AS text""",
    )


def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path templates and the period to put in."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        """CASE WHEN o_orderstatus = 'F' THEN '{fx}/FX_Rates_{period}.xlsx'
                ELSE '{tb}/Master_TB_{period}_{period}.xlsx' END AS template""",
        f"{_MONTH} AS period",
    )


def catalog_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue step per customer; some ids are UUIDs in loose spelling."""
    return table(spark, sf_dir, "customer").selectExpr(
        """CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN concat('urn:uuid:{', upper(md5(c_name)), '}')
                ELSE concat('step-', c_custkey) END AS id""",
        "c_name AS name",
        "c_mktsegment AS description",
    )


def catalog_toolsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('toolset-', c_custkey) AS id",
        "c_name AS name",
        """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'notebooks/1-URGENT.ipynb'
             WHEN 'BUILDING' THEN '2-HIGH.ipynb' ELSE './notebooks/legacy.ipynb' END AS tutorial""",
        "array(concat('Legacy ', c_mktsegment)) AS tools",
    )


def catalog_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations: each order registers a tutorial of its customer, each supplier a new step."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')) AS step_name",
        "concat('Order ', o_orderkey) AS description",
        "concat('notebooks/', o_orderpriority, '.ipynb') AS tutorial_path",
        """array(concat(o_orderstatus, ' mock API integration'),
                 concat('Desk  ', substr(o_orderpriority, 1, 1), ' Sandbox'), o_orderstatus) AS tools""",
        "date_format(o_orderdate, 'yyyyMMdd') AS day",
        "o_orderkey AS seq",
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_name AS step_name",
        "concat('Nation ', s_nationkey) AS description",
        "'notebooks//supply.ipynb' AS tutorial_path",
        "array('Portal Workflow v2') AS tools",
        "'20020101' AS day",
        "s_suppkey AS seq",
    )
    return orders.unionByName(suppliers)


FILE_PERIOD = "202112"
ORDERS_A_FILE = 20_000

# Header lines and rows of the trial-balance files: one of four by nation. {a} is the signed amount.
_DIALECTS = [
    ("EntityCode,AccountCode,AccountName,Debit,Credit,Period,CurrencyCode", "concat_ws(',', entity, account, name, debit, credit, month, currency)"),
    ("Entity,GL,AccountDesc,Dr,Cr,FiscalPeriod,Curr", "concat_ws(',', entity, account, name, debit, credit, regexp_replace(month, '^(....)', '$1-'), lower(currency))"),
    ("Company,Acct,Account Description,Amount,YYYYMM,ISO Currency", "concat_ws(',', entity, account, name, debit - credit, month, currency)"),
    ("Memo,LE,Account Number,GL Name,Debits,Credits,PostingPeriod,LCY", "concat_ws(',', concat('\"', DocumentNo, '\"'), entity, account, name, debit, credit, month, currency)"),
]


def tb_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """(output_path, letter_text): the ledger as CSV files with differing headers and names of two lines.

    A file has the orders of one nation whose numbers lie within ORDERS_A_FILE. Nations divisible by five lack
    the entity, EUROPE the period; both are in the file's name.
    """
    parted = postings(spark, sf_dir).withColumns({
        "file_name": F.expr(f"concat('TB_N', nation, 'P', DocumentNo div {ORDERS_A_FILE}, '_{FILE_PERIOD}.csv')"),
        "entity": F.expr("CASE WHEN nation % 5 = 0 THEN '' ELSE concat('N', nation) END"),
        "month": F.expr("CASE WHEN region = 'EUROPE' THEN '' ELSE period END"),
    })
    legs = """inline(array(
        named_struct('leg', 1, 'account', 'AR', 'name', concat('"Receivables\n""net"", ', priority, '"'), 'debit', amt, 'credit', CAST(0 AS DECIMAL(20,4))),
        named_struct('leg', 2, 'account', concat('REV-', substr(priority, 1, 1)), 'name', '', 'debit', CAST(0 AS DECIMAL(20,4)), 'credit', amt)))"""
    each = parted.selectExpr("file_name", "nation", "DocumentNo", "entity", "month", "currency", legs)
    line = F.expr("CASE nation % 4 " + " ".join(f"WHEN {i} THEN {row}" for i, (_, row) in enumerate(_DIALECTS)) + " END")
    header = F.expr("CASE nation % 4 " + " ".join(f"WHEN {i} THEN '{names}'" for i, (names, _) in enumerate(_DIALECTS)) + " END")
    rows = F.array_sort(F.collect_list(F.struct("DocumentNo", "leg", line.alias("line"))))
    files = each.groupBy("file_name", header.alias("header")).agg(rows.alias("rows"))
    text = F.concat("header", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    return files.select(F.concat(F.lit(f"{folder}/"), "file_name").alias("output_path"), text.alias("letter_text"), F.col("file_name").alias("client_id"))


def rates_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (payload): all rates as the JSON document that ``translate_fx`` takes. A rate for each region."""
    listed = F.collect_list(F.struct(F.lower("CurrencyCode"), F.col("FXRate").cast("string")))
    return rates(spark, sf_dir).agg(F.to_json(F.struct(F.map_from_entries(listed).alias("rates"))).alias("payload"))
