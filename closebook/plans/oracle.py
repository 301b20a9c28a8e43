"""SQL that gives, on the same tables, the result each registered query must have."""

from __future__ import annotations

# Building blocks, each a WITH item.

POSTINGS = """postings AS (
  SELECT o_orderkey AS doc, CAST(o_totalprice AS DECIMAL(18,2)) AS amt, o_orderpriority AS priority,
         o_orderstatus AS status, n_nationkey AS nation, r_name AS region,
         upper(substr(r_name, 1, 3)) AS currency,
         CAST(CAST(strftime(o_orderdate, '%Y%m') AS INT) + 2000 AS VARCHAR) AS period,
         'TB_N' || n_nationkey || '_' ||
           CAST(CAST(strftime(o_orderdate, '%Y%m') AS INT) + 2000 AS VARCHAR) || '.xlsx' AS file_name,
         CAST(1 + r_regionkey * 0.075 AS DECIMAL(17,10)) AS rate
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LEDGER = (
    POSTINGS
    + """,
ledger AS (
  SELECT doc, 'N' || nation AS entity, 'AR' AS account, 'Receivables' AS account_name,
         CAST(amt AS DECIMAL(20,4)) AS debit, CAST(0 AS DECIMAL(20,4)) AS credit,
         period, currency, region, status, file_name, rate FROM postings
  UNION ALL
  SELECT doc, 'N' || nation, 'REV-' || substr(priority, 1, 1), NULL,
         CAST(0 AS DECIMAL(20,4)), CAST(amt AS DECIMAL(20,4)),
         period, currency, region, status, file_name, rate FROM postings)"""
)

SLIPPED = (
    LEDGER
    + """,
slipped AS (
  SELECT entity, period, file_name, debit,
         CASE WHEN credit > 499000 THEN credit + 0.01 ELSE credit END AS credit FROM ledger)"""
)

TRANSLATED = (
    LEDGER
    + """,
translated AS (
  SELECT *, debit - credit AS local, round((debit - credit) * rate, 2) AS reported FROM ledger)"""
)

# Entity and period as the files hold them, and whether a whole file lacks them.
FILLED = (
    LEDGER
    + """,
held AS (
  SELECT *, CASE WHEN region = 'ASIA' OR status = 'P' THEN NULL ELSE entity END AS held_entity,
         CASE WHEN region = 'EUROPE' THEN '' ELSE period END AS held_period FROM ledger),
filled AS (
  SELECT *,
    CASE WHEN count(held_entity) OVER (PARTITION BY file_name) = 0
         THEN regexp_extract(file_name, 'TB_([^_.]+)', 1) ELSE held_entity END AS out_entity,
    CASE WHEN max(held_period) OVER (PARTITION BY file_name) = ''
         THEN regexp_extract(file_name, '20[0-9]{4}') ELSE held_period END AS out_period
  FROM held)"""
)

AMOUNTS = """amounts AS (
  SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS bal,
    (c_mktsegment = 'FURNITURE' AND c_acctbal < 0) OR c_acctbal < -500
      OR (c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 9000)
      OR (c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 9000) AS junk
  FROM customer)"""

INDEX = """idx AS (
  SELECT upper(p_brand) AS code, p_type AS description,
         CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_retailprice END AS rate
  FROM part QUALIFY row_number() OVER (PARTITION BY upper(p_brand) ORDER BY p_partkey DESC) = 1)"""

CODE_PAIR = """code_pair AS (
  SELECT *, 'BRAND#' || (c_nationkey + 1) AS code1,
         'BRAND#' || CAST(floor(abs(c_acctbal) / 380) + 1 AS BIGINT) AS code2 FROM customer)"""

FIELDS = (
    CODE_PAIR
    + """,
fields AS (
  SELECT *, 'C-' || c_custkey AS client_id,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 0 THEN NULL ELSE c_name END AS client_name,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '2024'
         WHEN c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 9000 THEN 'FY25' ELSE '2025' END AS fiscal_year,
    c_acctbal < -900 AS no_codes
  FROM code_pair),
missing AS (
  SELECT *, concat_ws('|', CASE WHEN client_name IS NULL THEN 'client_name' END,
                           CASE WHEN no_codes THEN 'service_lines' END) AS lacking
  FROM fields)"""
)

CHECKED = (
    FIELDS
    + ",\n"
    + INDEX
    + """,
items AS (
  SELECT c_custkey, 1 AS pos, code1 AS code FROM fields WHERE NOT no_codes
  UNION ALL
  SELECT c_custkey, 2, code2 FROM fields WHERE NOT no_codes AND code2 <> code1),
checked AS (
  SELECT c_custkey,
    coalesce(string_agg(items.code, '|' ORDER BY pos) FILTER (rate IS NULL), '') AS invalid,
    string_agg(items.code, '|' ORDER BY pos) AS codes,
    string_agg('- ' || items.code || ' (' || description || ') @ $' || format('{:,.2f}', rate),
               chr(10) ORDER BY pos) FILTER (rate IS NOT NULL) AS summary
  FROM items LEFT JOIN idx ON items.code = idx.code GROUP BY c_custkey)"""
)

PRIOR = """prior AS (
  SELECT 'Customer_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS slug,
    CASE WHEN lang = 'en' THEN '2024' ELSE '2023' END AS year,
    CASE WHEN source = 'src0' THEN ''
         WHEN source IN ('src1', 'src2', 'src3')
         THEN text || chr(10) || 'For {{ClientName}}' || chr(10) || '{{ServiceSummary}}' || chr(10)
         ELSE text || chr(10) || 'For {{ClientName}}, FY{{FiscalYear}} ' || chr(10) || chr(9) END AS text
  FROM documents)"""

ASSESSED = (
    CHECKED
    + ",\n"
    + PRIOR
    + """,
assessed AS (
  SELECT m.*, codes, coalesce(invalid, '') AS invalid, coalesce(summary, '') AS summary,
    prior.text AS prior_text,
    CASE WHEN coalesce(prior.text, '') <> '' THEN 'rolled_forward' ELSE 'template' END AS source,
    CASE WHEN lacking <> '' THEN 'missing_fields' WHEN coalesce(invalid, '') <> '' THEN 'bad_services'
         ELSE 'letter' END AS outcome
  FROM missing m LEFT JOIN checked USING (c_custkey)
  LEFT JOIN prior ON prior.slug = 'Customer_' || substr(m.client_name, 10)
    AND prior.year = CAST(TRY_CAST(m.fiscal_year AS INT) - 1 AS VARCHAR))"""
)

# Characters str.rstrip() would remove that occur in the texts.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

LETTERS = (
    ASSESSED
    + f""",
based AS (
  SELECT *, '/close/letters/Customer_' || substr(client_name, 10) || '_EngagementLetter_FY' ||
      fiscal_year || '.docx' AS output_path,
    CASE WHEN source = 'rolled_forward' THEN prior_text ELSE
      '{{{{ClientName}}}}, our number {{{{ClientID}}}}' || chr(10) || chr(10) ||
      'For the year {{{{FiscalYear}}}} we agreed on this work:' || chr(10) ||
      '{{{{ServiceSummary}}}}' || chr(10) || 'Written on {{{{GeneratedOn}}}}' || chr(10) END AS base
  FROM assessed WHERE outcome = 'letter'),
merged AS (
  SELECT *, replace(replace(replace(replace(replace(base, '{{{{ClientName}}}}', client_name),
    '{{{{ClientID}}}}', client_id), '{{{{FiscalYear}}}}', fiscal_year), '{{{{ServiceSummary}}}}', summary),
    '{{{{GeneratedOn}}}}', '2025-12-31 08:00 UTC') AS text1 FROM based),
summed AS (
  SELECT *, CASE WHEN contains(base, '{{{{ServiceSummary}}}}') THEN text1 ELSE rtrim(text1, {SPACES})
    || chr(10) || chr(10) || 'Service Summary:' || chr(10) || summary || chr(10) END AS text2 FROM merged),
drafts AS (
  SELECT *, CASE WHEN contains(text2, 'FY' || fiscal_year) THEN text2 ELSE rtrim(text2, {SPACES})
    || chr(10) || chr(10) || 'Fiscal Year: FY' || fiscal_year || chr(10) END AS letter_text FROM summed)"""
)

MANIFEST_COLUMNS = """client_id, client_name, fiscal_year, codes AS service_lines, output_path, source,
  '2025-12-31 08:00 UTC' AS generated_on"""

SUPPORT = (
    TRANSLATED
    + """,
support AS (
  SELECT 0 AS section, position, line FROM (
    SELECT row_number() OVER (ORDER BY period, entity, doc, account) AS position,
      concat_ws(' | ', entity, account, coalesce(account_name, ''), debit, credit, period, currency,
                CAST(reported AS DECIMAL(24,2))) AS line FROM translated)
  UNION ALL
  SELECT 1, position, line FROM (
    SELECT row_number() OVER (ORDER BY doc, account) AS position,
      concat_ws(' | ', entity, account, local, rate, CAST(reported AS DECIMAL(24,2)), '202112') AS line
      FROM translated))"""
)

# The close runs on collected rows, whose entity and period may still be blank.
CLOSED = (
    FILLED
    + """,
translated AS (
  SELECT *, debit - credit AS local, round((debit - credit) * rate, 2) AS reported,
    nullif(out_period, '') AS p FROM filled),
support AS (
  SELECT line FROM (
    SELECT row_number() OVER (ORDER BY p NULLS FIRST, out_entity NULLS FIRST, doc, account) AS position,
      concat_ws(' | ', coalesce(out_entity, ''), account, coalesce(account_name, ''), debit, credit,
                coalesce(p, ''), currency, CAST(reported AS DECIMAL(24,2))) AS line
    FROM translated)
  UNION ALL
  SELECT line FROM (
    SELECT row_number() OVER (ORDER BY doc, account) AS position,
      concat_ws(' | ', coalesce(out_entity, ''), account, local, rate, CAST(reported AS DECIMAL(24,2)),
                '202112') AS line FROM translated))"""
)


def _uuid(expr: str) -> str:
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({expr}, {start}, {n})" for start, n in parts)


CATALOG = f"""reg AS (
  SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, 'Order ' || o_orderkey AS description,
    o_orderpriority || '.ipynb' AS tutorial,
    o_orderstatus || '|Desk ' || substr(o_orderpriority, 1, 1) AS tools,
    strftime(o_orderdate, '%Y%m%d') AS day, o_orderkey AS seq FROM orders
  UNION ALL
  SELECT s_name, 'Nation ' || s_nationkey, 'supply.ipynb', 'Portal', '20020101', s_suppkey FROM supplier),
new_steps AS (
  SELECT name, description FROM reg
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY day DESC, seq DESC) = 1),
new_toolsets AS (
  SELECT name, tutorial, tools FROM reg
  QUALIFY row_number() OVER (PARTITION BY name, tutorial ORDER BY day DESC, seq DESC) = 1),
old_steps AS (
  SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN {_uuid("md5(c_name)")} ELSE 'step-' || c_custkey END AS id,
    c_name AS name, c_mktsegment AS description FROM customer),
old_toolsets AS (
  SELECT 'toolset-' || c_custkey AS id, c_name AS name,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1-URGENT.ipynb' WHEN 'BUILDING' THEN '2-HIGH.ipynb'
         ELSE 'legacy.ipynb' END AS tutorial, 'Legacy ' || c_mktsegment AS tools FROM customer),
steps AS (
  SELECT coalesce(o.id, {_uuid("md5(name)")}) AS step_id, name,
    coalesce(n.description, o.description) AS description
  FROM old_steps o FULL JOIN new_steps n USING (name)),
toolsets AS (
  SELECT coalesce(o.id, {_uuid("md5(name || chr(31) || tutorial)")}) AS toolset_id, name, tutorial,
    coalesce(n.tools, o.tools) AS tools
  FROM old_toolsets o FULL JOIN new_toolsets n USING (name, tutorial))"""


# The ledger as the files of ``views.tb_files`` give it, and the number of these files.
FROM_FILES = (
    LEDGER
    + """,
from_files AS (
  SELECT 'TB_N' || l.entity[2:] || 'P' || (l.doc // 20000) AS tb_file,
    CASE WHEN l.entity[2:]::INT % 5 = 0 THEN l.entity || 'P' || (l.doc // 20000) ELSE l.entity END AS entity, account,
    CASE WHEN account = 'AR' THEN 'Receivables' || chr(10) || '"net", ' || priority END AS account_name, debit, credit,
    CASE WHEN l.region = 'EUROPE' THEN '202112' ELSE l.period END AS period, l.currency, l.rate
  FROM ledger l JOIN postings p ON l.doc = p.doc)"""
)

ORACLE_SQL: dict[str, str] = {
    "tb_files": f"""WITH {FROM_FILES}
SELECT entity AS "EntityCode", account AS "AccountCode", account_name AS "AccountName", CAST(debit AS DOUBLE) AS "Debit",
  CAST(credit AS DOUBLE) AS "Credit", period AS "Period", currency AS "CurrencyCode" FROM from_files""",
    "close_files": f"""WITH {FROM_FILES},
n AS (SELECT count(*) AS rows, count(DISTINCT tb_file) AS files FROM from_files)
SELECT 'collect_tb' AS step, 'ok' AS status, rows, files, 1 AS inputs, 1 AS outputs, rows AS rows_hashed FROM n
UNION ALL SELECT 'translate_fx', 'ok', rows, NULL, 1, 2, 2 * rows FROM n
UNION ALL SELECT 'assemble_support', 'ok', NULL, NULL, 0, 1, 2 * rows + 2 FROM n""",
    "close_files_adjustments": f"""WITH {FROM_FILES}
SELECT entity AS "EntityCode", account AS "AccountCode", CAST(debit - credit AS DOUBLE) AS "LocalAmount", CAST(rate AS DOUBLE) AS "FXRate",
  CAST(round((debit - credit) * rate, 2) AS DOUBLE) AS "ReportingCurrencyAmount", '202112' AS "Period" FROM from_files""",
    "fx_translate": f"""WITH {TRANSLATED}
SELECT doc AS "DocumentNo", entity AS "EntityCode", account AS "AccountCode", period AS "Period",
  currency AS "CurrencyCode", CAST(local AS DOUBLE) AS "LocalAmount", CAST(rate AS DOUBLE) AS "FXRate",
  CAST(reported AS DOUBLE) AS "ReportingCurrencyAmount" FROM translated""",
    "fx_adjustments": f"""WITH {TRANSLATED}
SELECT entity AS "EntityCode", account AS "AccountCode", CAST(local AS DOUBLE) AS "LocalAmount",
  CAST(rate AS DOUBLE) AS "FXRate", CAST(reported AS DOUBLE) AS "ReportingCurrencyAmount",
  '202112' AS "Period" FROM translated""",
    "missing_fx": f"""WITH {POSTINGS},
codes AS (SELECT DISTINCT CASE WHEN region = 'MIDDLE EAST' AND status = 'P' THEN '<blank>' ELSE currency END
  AS code FROM postings)
SELECT code AS "CurrencyCode" FROM codes WHERE code NOT IN ('AME', 'ASI', 'MID') ORDER BY 1""",
    "fx_rates_clean": """SELECT upper(substr(event_type, 1, 3)) AS "CurrencyCode",
  CASE WHEN value < 1 THEN NULL ELSE value END AS "FXRate" FROM events
  QUALIFY row_number() OVER (PARTITION BY substr(event_type, 1, 3) ORDER BY event_id DESC) = 1""",
    "fx_rates_from_json": """SELECT event_id, upper(key) AS "CurrencyCode",
  CAST(json_extract_string(props, '$.' || key) AS DOUBLE) AS "FXRate"
  FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""",
    "balance_check": f"""WITH {SLIPPED}
SELECT entity AS "EntityCode", period AS "Period", CAST(sum(debit) AS DOUBLE) AS debit,
  CAST(sum(credit) AS DOUBLE) AS credit, sum(debit) = sum(credit) AS balanced
  FROM slipped GROUP BY ALL""",
    "tb_file_qa": f"""WITH {SLIPPED}
SELECT file_name, count(*) AS rows, CAST(sum(debit) AS DOUBLE) AS debit, CAST(sum(credit) AS DOUBLE) AS credit,
  CAST(0 AS BIGINT) AS odd_periods, sum(debit) = sum(credit) AS balanced FROM slipped GROUP BY file_name""",
    "tb_file_metrics": f"""WITH {FILLED},
per_file AS (SELECT file_name, count(*) AS n, count(held_entity) = 0 AS e, max(held_period) = '' AS p
  FROM filled GROUP BY file_name)
SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (e) AS entity_inferred_from_filename,
  count(*) FILTER (p) AS period_inferred_from_filename, 7 * count(*) AS aliased_columns FROM per_file""",
    "missing_columns": f"""WITH {POSTINGS}
SELECT DISTINCT file_name, CASE region WHEN 'AMERICA' THEN 'AccountName|' WHEN 'ASIA' THEN 'Debit|Credit|'
  ELSE '' END || 'CostCenter' AS missing FROM postings""",
    "coerce_numeric": f"""WITH {AMOUNTS}
SELECT c_custkey, CAST(CASE WHEN junk THEN 0 ELSE bal END AS DOUBLE) AS amount,
  CAST(CASE WHEN junk THEN NULL ELSE bal END AS DOUBLE) AS parsed FROM amounts""",
    "amount_split": f"""WITH {AMOUNTS}
SELECT c_custkey, CAST(CASE WHEN NOT junk AND bal > 0 THEN bal ELSE 0 END AS DOUBLE) AS "Debit",
  CAST(CASE WHEN NOT junk AND bal < 0 THEN -bal ELSE 0 END AS DOUBLE) AS "Credit" FROM amounts""",
    "period_normalize": """WITH p AS (
  SELECT o_orderkey, CASE
    WHEN o_orderpriority LIKE '4%' THEN strftime(o_orderdate, '%m%Y')
    WHEN o_orderpriority LIKE '5%' AND o_orderstatus = 'P' THEN NULL
    ELSE strftime(o_orderdate, '%Y%m') END AS period FROM orders)
SELECT o_orderkey, period, coalesce(period LIKE '20____'
  AND CAST(substr(period, 5, 2) AS INT) BETWEEN 1 AND 12, FALSE) AS real_month FROM p""",
    "infer_filename": f"""WITH {POSTINGS}
SELECT doc AS "DocumentNo", CASE WHEN priority = '4-NOT SPECIFIED' THEN NULL ELSE 'N' || nation END AS entity,
  CASE WHEN priority IN ('2-HIGH', '3-MEDIUM') THEN NULL ELSE period END AS period FROM postings""",
    "infer_fill": f"""WITH {FILLED}
SELECT doc AS "DocumentNo", account AS "AccountCode", file_name, out_entity AS "EntityCode",
  out_period AS "Period" FROM filled""",
    "resolve_alias": f"""WITH {FILLED}
SELECT held_entity AS "EntityCode", account AS "AccountCode", account_name AS "AccountName",
  CASE WHEN debit = 0 THEN 'n/a' ELSE CAST(debit AS VARCHAR) END AS "Debit",
  CASE WHEN credit = 0 THEN '' ELSE CAST(credit AS VARCHAR) END AS "Credit",
  CASE WHEN held_period = '' THEN '' ELSE substr(period, 1, 4) || '-' || substr(period, 5, 2) END AS "Period",
  ' ' || lower(currency) || ' ' AS "CurrencyCode", doc AS "Memo" FROM filled""",
    "resolve_fuzzy": """SELECT p_partkey, wanted, source FROM (
  SELECT p_partkey, 'AccountName' AS wanted, 'Account  Name' AS source FROM part
  UNION ALL SELECT p_partkey, 'Debit', 'Debit ' || p_type FROM part
  UNION ALL SELECT p_partkey, 'Credit', CASE WHEN p_type = 'PROMO' THEN 'credit' ELSE 'Credit Limit' END FROM part
  UNION ALL SELECT p_partkey, 'CurrencyCode', 'CurrencyCodes' FROM part WHERE p_type <> 'SMALL')""",
    "tb_normalize": f"""WITH {FILLED}
SELECT doc AS "DocumentNo", held_entity AS "EntityCode", account AS "AccountCode",
  account_name AS "AccountName", CAST(debit AS DOUBLE) AS "Debit", CAST(credit AS DOUBLE) AS "Credit",
  nullif(held_period, '') AS "Period", currency AS "CurrencyCode" FROM filled""",
    "tb_collect": f"""WITH {FILLED}
SELECT out_entity AS "EntityCode", account AS "AccountCode", account_name AS "AccountName",
  CAST(debit AS DOUBLE) AS "Debit", CAST(credit AS DOUBLE) AS "Credit",
  nullif(out_period, '') AS "Period", currency AS "CurrencyCode" FROM filled""",
    "client_fields": f"""WITH {FIELDS}
SELECT c_custkey, client_id, client_name, fiscal_year, lacking AS missing FROM missing""",
    "service_codes": f"""WITH {FIELDS}
SELECT c_custkey, CASE WHEN no_codes THEN '' WHEN code1 = code2 THEN code1 ELSE code1 || '|' || code2 END AS codes
  FROM fields""",
    "service_codes_nested": f"""WITH {CODE_PAIR}
SELECT c_custkey, CASE WHEN code1 = code2 THEN code1
  WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN code2 || '|' || code1
  ELSE code1 || '|' || code2 END AS codes FROM code_pair""",
    "service_index": f"WITH {INDEX} SELECT code, description, rate FROM idx",
    "service_validation": f"""WITH {CHECKED}
SELECT c_custkey, invalid FROM fields LEFT JOIN checked USING (c_custkey)""",
    "service_summary": f"""WITH {CHECKED}
SELECT c_custkey, summary AS service_summary FROM checked WHERE invalid = ''""",
    "rate_display": """SELECT p_partkey, CASE p_type
  WHEN 'ECONOMY' THEN '$' || format('{:,.2f}', CAST('10' || p_retailprice AS DOUBLE))
  WHEN 'MEDIUM' THEN '$' || format('{:,.2f}', CAST(p_retailprice || 'e2' AS DOUBLE))
  WHEN 'LARGE' THEN p_retailprice || 'd' WHEN 'SMALL' THEN '$-' || format('{:,.2f}', p_retailprice)
  WHEN 'PROMO' THEN 'TBD, $' ELSE '$' || format('{:,.2f}', p_retailprice) END AS shown FROM part""",
    "slugify": """WITH s AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'client'
    WHEN c_acctbal > 5000 THEN 'n_' || c_mktsegment || '_Co' ELSE replace(c_name, '#', '_') END AS slug
  FROM customer)
SELECT c_custkey, slug, slug || '_EngagementLetter_FY2025.docx' AS file_name FROM s""",
    "valid_clients": """SELECT c_custkey, 'C-' || c_custkey AS client_id FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
    "prior_letter_join": f"""WITH {ASSESSED}
SELECT c_custkey, prior_text FROM assessed WHERE client_name IS NOT NULL""",
    "template_merge": f"""WITH {PRIOR},
merged AS (
  SELECT slug || '_EngagementLetter_FY' || year || '.docx' AS file_name, text AS base,
    replace(replace(replace(text, '{{{{ClientName}}}}', slug || '_EngagementLetter_FY' || year || '.docx'),
      '{{{{FiscalYear}}}}', '2025'), '{{{{ServiceSummary}}}}',
      '- TAX (Tax, 2025-12-31 08:00 UTC) @ $180.00') AS text1 FROM prior),
summed AS (
  SELECT file_name, CASE WHEN contains(base, '{{{{ServiceSummary}}}}') THEN text1 ELSE rtrim(text1, {SPACES})
    || chr(10) || chr(10) || 'Service Summary:' || chr(10) || '- TAX (Tax, {{{{GeneratedOn}}}}) @ $180.00' ||
    chr(10) END AS text2 FROM merged)
SELECT file_name, CASE WHEN contains(text2, 'FY2025') THEN text2 ELSE rtrim(text2, {SPACES})
    || chr(10) || chr(10) || 'Fiscal Year: FY2025' || chr(10) END AS letter_text FROM summed""",
    "letters": f"WITH {LETTERS} SELECT {MANIFEST_COLUMNS}, letter_text FROM drafts",
    "letter_manifest": f"WITH {LETTERS} SELECT {MANIFEST_COLUMNS} FROM drafts",
    "client_exceptions": f"""WITH {ASSESSED}
SELECT client_id, CASE WHEN outcome = 'missing_fields' THEN
    'Record missing required fields [''' || replace(lacking, '|', ''', ''') || ''']: {{' ||
    concat_ws(',', CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN NULL ELSE
        '"ClientID":"' || client_id || '","ClientName":"' || coalesce(client_name, '') || '"' END,
      '"FiscalYear":' || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '"2024"'
        WHEN c_mktsegment = 'MACHINERY' THEN 'null' ELSE '2025' END,
      CASE WHEN c_mktsegment = 'FURNITURE' THEN '"Id":"' || client_id || '","Name":"' || client_name || '"' END,
      '"ServiceLineCodes":"' || CASE WHEN no_codes THEN '' ELSE lower(code1) || '; Brand' ||
        substr(code2, 6) || ' ,' END || '"',
      CASE WHEN c_mktsegment = 'BUILDING' THEN
        '"client_id":"' || client_id || '","client_name":"' || client_name || '"' END) || '}}'
  ELSE 'Service line validation failed for client ' || client_name || ' (' || client_id ||
    '): invalid or missing rate for [''' || replace(invalid, '|', ''', ''') || ''']' END AS reason
FROM assessed WHERE outcome <> 'letter'""",
    "notifications": f"""WITH {LETTERS}
SELECT 0 AS position, '2025-12-31 08:00 UTC | Draft engagement letters ready: ' || count(*) || ' clients' AS line
  FROM drafts
UNION ALL
SELECT 1, 'Notify mail://close-desk, mail://partner → ' || client_name || ' letter saved to ' ||
  output_path FROM drafts""",
    "letter_metrics": f"""WITH {ASSESSED},
counts AS (
  SELECT count(*) AS n, count(*) FILTER (outcome = 'letter') AS made,
    count(*) FILTER (outcome = 'letter' AND source = 'rolled_forward') AS rolled FROM assessed)
SELECT 'clients_processed' AS metric, n AS value FROM counts
UNION ALL SELECT 'letters_generated', made FROM counts
UNION ALL SELECT 'exceptions', n - made FROM counts
UNION ALL SELECT 'rolled_forward_letters', rolled FROM counts
UNION ALL SELECT 'notifications_prepared', 2 * made FROM counts
UNION ALL SELECT 'ok', CAST(n = made AND made > 0 AS BIGINT) FROM counts
UNION ALL SELECT 'service_lines_available', count(*) FROM idx""",
    "support_lines": f"""WITH {SUPPORT}
SELECT section, CAST(position AS INT) AS position, line FROM support""",
    "content_hash": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "path_expand": """WITH p AS (
  SELECT o_orderkey, o_orderstatus, CAST(CAST(strftime(o_orderdate, '%Y%m') AS INT) + 2000 AS VARCHAR) AS period
  FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '/data/fx/FX_Rates_' || period || '.xlsx'
  ELSE '/data/tb/Master_TB_' || period || '_' || period || '.xlsx' END AS path FROM p""",
    "tool_simplify": """SELECT p_partkey, p_name || '|' || p_brand || ' API|mock|' || p_brand AS tools FROM part""",
    "catalog_ref": """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_name || '.ipynb' WHEN 'LARGE' THEN p_name
  WHEN 'MEDIUM' THEN '' WHEN 'PROMO' THEN '/notebooks/' || p_name WHEN 'SMALL' THEN 'docs/notebooks/' || p_brand
  ELSE 'notebooks_old/' || p_brand END AS ref FROM part""",
    "catalog_uuid": f"""SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN {_uuid("md5(text)")} END AS id
  FROM documents""",
    "catalog_upsert": f"""WITH {CATALOG}
SELECT step_id, name, description, toolset_id, tutorial, tools FROM toolsets JOIN steps USING (name)""",
    "close_pipeline": f"""WITH {CLOSED}
SELECT 'collect' AS step, count(*) AS rows, CAST(sum(debit - credit) AS DOUBLE) AS amount FROM translated
UNION ALL
SELECT 'translate', count(rate), CAST(sum(abs(CAST(reported AS DECIMAL(24,2)))) AS DOUBLE) FROM translated
UNION ALL
SELECT 'support', count(*), CAST(sum(length(line)) AS DOUBLE) FROM support""",
}

# The jobs from files to files give what their operators give.
ORACLE_SQL |= {"letter_files": ORACLE_SQL["letters"], "catalog_files": ORACLE_SQL["catalog_upsert"]}
