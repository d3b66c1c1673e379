"""DuckDB SQL for the registered queries, written from the definitions of the operators.

The SQL shares only the fixed values (codes, names, thresholds, word lists) with the Spark code.
"""

from __future__ import annotations

from quarterlight import dims
from quarterlight.plans import derived
from quarterlight.plans.catalog import AMENDED_CODES, PAGE_KEYWORDS

SQL: dict[str, str] = {}


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    cells = lambda r: ", ".join(text(v) if isinstance(v, str) or v is None else str(v) for v in r)
    return ", ".join(f"({cells(r)})" for r in rows)


def listed(items) -> str:
    return "[" + ", ".join(text(i) for i in items) + "]"


# -- shared table expressions -------------------------------------------------------------------------
_cells = ", ".join(
    "{{'ix': {i}, 'schedule': '{s}', 'code': '{c}', 'num': CAST({f} AS BIGINT)}}".format(i=i, s=s, c=c, f=f.replace(" div ", " // "))
    for i, (s, c, f) in enumerate(derived.WIDE_CODES)
)
RAW = f"""
sums AS (
  SELECT l_suppkey AS supp, year(l_shipdate) AS y, quarter(l_shipdate) AS q,
    CAST(sum(cents) // 100 AS BIGINT) AS total,
    CAST(coalesce(sum(cents) FILTER (l_returnflag = 'A'), 0) // 100 AS BIGINT) AS flag_a,
    CAST(coalesce(sum(cents) FILTER (l_returnflag = 'N'), 0) // 100 AS BIGINT) AS flag_n,
    CAST(coalesce(sum(cents) FILTER (l_returnflag = 'R'), 0) // 100 AS BIGINT) AS flag_r,
    CAST(coalesce(sum(cents) FILTER (l_linestatus = 'O'), 0) // 100 AS BIGINT) AS open_,
    CAST(coalesce(sum(cents) FILTER (l_linestatus = 'F'), 0) // 100 AS BIGINT) AS filled,
    CAST(sum(cents * CAST(round(l_discount * 100) AS BIGINT)) // 10000 AS BIGINT) AS disc,
    CAST(sum(cents * CAST(round(l_tax * 100) AS BIGINT)) // 10000 AS BIGINT) AS tax,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS lines
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) GROUP BY ALL
),
named AS (SELECT *, unnest([{_cells}], recursive := true) FROM sums),
kinds AS (
  SELECT *, y * 4 + q AS qix, (supp * 7 + (y * 4 + q) * 5 + ix * 3) % 31 AS kind, CAST(num AS VARCHAR) AS t FROM named
),
raw AS (
  SELECT supp, y || '-Q' || q AS quarter_key, schedule, code, ix, lines,
    CASE WHEN (supp + qix) % 53 = 0 THEN ' ' WHEN (supp + qix) % 59 = 0 THEN 'nan' ELSE CAST(supp AS VARCHAR) END AS id,
    CASE kind WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'NA' WHEN 3 THEN 'ND' WHEN 4 THEN '(' || t || ')'
      WHEN 5 THEN format('{{:,}}', num) WHEN 6 THEN 'abc' WHEN 7 THEN '.' WHEN 8 THEN ' ' || t || ' '
      WHEN 9 THEN '$' || t WHEN 10 THEN 'conf' WHEN 11 THEN t || '%' ELSE t END AS cell
  FROM kinds
)"""
STRICT = RAW + """,
kept AS (
  SELECT *, trim(cell) AS tc FROM raw
  WHERE trim(cell) NOT IN ('', '.', 'NA', 'N/A') AND upper(trim(cell)) NOT IN ('ND', 'NR', 'CONF')
),
cleaned AS (
  SELECT *, CASE WHEN tc LIKE '(%' AND tc LIKE '%)' THEN '-' ELSE '' END || regexp_replace(tc, '[^0-9\\-.,]', '', 'g') AS amount
  FROM kept
),
strict AS (
  SELECT *, TRY_CAST(replace(amount, ',', '') AS DOUBLE) AS num FROM cleaned
  WHERE TRY_CAST(replace(amount, ',', '') AS DOUBLE) IS NOT NULL
)"""
DICTIONARY = """
dictionary AS (SELECT 'RCON' || CASE WHEN p_partkey < 10000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0')
  ELSE CAST(p_partkey AS VARCHAR) END AS dcode, p_name AS known FROM part)"""
LOOKUPS = f"""
mapping(ms, mc, item, pos) AS (VALUES {values(dims.line_item_rows())}),
info(sc, sname, sprefix, sdesc) AS (VALUES {values(dims.SCHEDULES)}),
words(wp, word) AS (VALUES {values(dims.PREFIX_WORDS.items())}),
{DICTIONARY}"""
_base = """CASE WHEN upper(schedule)[1:3] IN ('RCR', 'RCL', 'RCO', 'RCT', 'RCN') THEN upper(schedule)[1:3]
  ELSE regexp_replace(upper(schedule), '[0-9]+$', '') END"""
ITEM = f"""coalesce(
  (SELECT min_by(item, pos) FROM mapping WHERE ms = {_base} AND mc = code),
  (SELECT min_by(item, pos) FROM mapping WHERE ms = {_base} AND suffix(mc, code[5:])), '')"""
LONG = STRICT + "," + LOOKUPS + f""",
codes AS (
  SELECT schedule, code, {ITEM} AS line_item, coalesce(known, word || ' item - ' || coalesce(sname, schedule)) AS description
  FROM (SELECT DISTINCT schedule, code FROM raw)
  LEFT JOIN dictionary ON dcode = code LEFT JOIN info ON sc = schedule LEFT JOIN words ON wp = code[1:4]
),
long AS (
  SELECT id AS rssd_id, quarter_key, coalesce(s_name, 'Institution ' || id) AS name, strict.schedule AS schedule_code,
    line_item, description, strict.code AS mdrm_code, amount, num AS amount_num, ix AS code_seq,
    CASE strict.schedule WHEN 'RC' THEN 0 WHEN 'RCN' THEN 1 WHEN 'RCRI' THEN 2 ELSE 3 END AS schedule_seq
  FROM strict JOIN codes ON codes.code = strict.code
  LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = id AND s_suppkey % 10 <> 3
  WHERE trim(id) NOT IN ('', 'nan')
)"""


def _coalesced(codes) -> str:
    parts = [f"max(amount_num) FILTER (mdrm_code = '{c}')" for c in codes]
    return f"coalesce({', '.join(parts)}, 0)"


_metric_sql = {m: _coalesced(c) for m, c in dims.METRIC_CODES.items()}
_metric_sql["total_deposits"] = " + ".join(_coalesced(c) for c in dims.DEPOSIT_COMPONENTS)
BASE = LONG + ", base AS (SELECT rssd_id, quarter_key, " + ", ".join(
    f"{s} AS {m}" for m, s in _metric_sql.items()
) + " FROM long GROUP BY 1, 2)"
RATIOS = BASE + """,
step1 AS (SELECT *,
  CASE WHEN net_income <> 0 AND total_assets <> 0 THEN net_income * 4 / total_assets * 100 ELSE 0 END AS roa,
  CASE WHEN net_income <> 0 AND total_equity <> 0 THEN net_income * 4 / total_equity * 100 ELSE 0 END AS roe,
  CASE WHEN net_interest_income <> 0 AND total_assets <> 0 THEN net_interest_income * 4 / total_assets * 100 ELSE 0 END AS nim,
  CASE WHEN net_interest_income + noninterest_income > 0
    THEN noninterest_expense / (net_interest_income + noninterest_income) * 100 ELSE 0 END AS efficiency_ratio,
  CASE WHEN total_deposits <> 0 THEN total_loans / total_deposits * 100 ELSE 0 END AS loan_deposit_ratio,
  CASE WHEN total_loans <> 0 THEN (nonaccrual_loans + past_due_90) / total_loans * 100 ELSE 0 END AS npl_ratio,
  CASE WHEN rate_sensitive_assets <> 0 AND rate_sensitive_liabilities <> 0
    THEN rate_sensitive_assets / rate_sensitive_liabilities * 100 ELSE 0 END AS ir_sensitivity_ratio,
  CASE WHEN total_assets <> 0 THEN (cash_and_due + securities_available_for_sale + federal_funds_sold) / total_assets * 100
    ELSE 0 END AS liquid_assets_ratio,
  CASE WHEN total_assets <> 0 THEN (wholesale_funding + other_borrowed_money + large_time_deposits) / total_assets * 100
    ELSE 0 END AS wholesale_funding_ratio,
  CASE WHEN interest_income_loans <> 0 AND earning_assets <> 0 THEN interest_income_loans * 4 / earning_assets * 100
    ELSE 0 END AS earning_asset_yield,
  CASE WHEN interest_expense_deposits + interest_expense_borrowed <> 0 AND interest_bearing_liabilities <> 0
    THEN (interest_expense_deposits + interest_expense_borrowed) * 4 / interest_bearing_liabilities * 100 ELSE 0 END AS cost_of_funds,
  securities_held_to_maturity + commercial_loans * 0.7::DOUBLE AS mix,
  rate_sensitive_assets - rate_sensitive_liabilities AS interest_rate_gap,
  CASE WHEN total_deposits <> 0 THEN (total_deposits - large_time_deposits) / total_deposits * 100 ELSE 0 END AS deposit_stability_ratio,
  CASE WHEN total_assets > 0 THEN total_loans / total_assets * 100 ELSE 0 END AS loans_to_assets,
  CASE WHEN total_assets > 0 THEN (securities_available_for_sale + securities_held_to_maturity) / total_assets * 100 ELSE 0 END
    AS securities_to_assets,
  CASE WHEN total_assets > 0 THEN cash_and_due / total_assets * 100 ELSE 0 END AS cash_to_assets
  FROM base),
metrics AS (SELECT *, earning_asset_yield - cost_of_funds AS interest_rate_spread,
  CASE WHEN mix > 0 THEN securities_held_to_maturity / mix * 100 ELSE 0 END AS fixed_rate_asset_pct,
  CASE WHEN mix > 0 THEN commercial_loans * 0.7::DOUBLE / mix * 100 ELSE 0 END AS variable_rate_asset_pct,
  CASE WHEN total_assets <> 0 THEN interest_rate_gap / total_assets * 100 ELSE 0 END AS gap_ratio
  FROM step1)"""
PEERS = """
placed AS (
  SELECT s_suppkey, s_suppkey // 11 * 3 + CASE WHEN s_suppkey % 11 = 0 THEN 0 WHEN s_suppkey % 11 < 5 THEN 1 ELSE 2 END AS peer_group FROM supplier),
peers AS (
  SELECT peer_group, CAST(s_suppkey AS VARCHAR) AS pid,
    CAST(row_number() OVER (PARTITION BY peer_group ORDER BY s_suppkey) - 1 AS INTEGER) AS ordinal,
    CAST(count(*) OVER (PARTITION BY peer_group) AS INTEGER) AS set_size
  FROM placed
)"""
MEMBER_ROWS = LONG + "," + PEERS + ", rows AS (SELECT * FROM long JOIN peers ON pid = rssd_id)"
MEMBERS = RATIOS + "," + PEERS + """,
groups AS (SELECT DISTINCT quarter_key, peer_group, set_size FROM metrics JOIN peers ON pid = rssd_id),
members AS (
  SELECT g.quarter_key, g.peer_group, g.set_size, p.ordinal, p.pid, m.* EXCLUDE (quarter_key, rssd_id)
  FROM groups g JOIN peers p ON p.peer_group = g.peer_group
  LEFT JOIN metrics m ON m.rssd_id = p.pid AND m.quarter_key = g.quarter_key
)"""


def _matrix(rows, extra: str = "", where: str = "") -> str:
    """(item columns, value expression) rows over members, with one column per member."""
    parts = " UNION ALL ".join(
        f"SELECT quarter_key, peer_group, set_size, ordinal, {cols}, coalesce(CAST({expr} AS DOUBLE), 0) AS v, {has} AS has FROM members"
        for cols, expr, has in rows
    )
    return parts


ITEMS = ["primary", "peer_1", "peer_2", "peer_3", "peer_4", "peer_5"]
_shown = ", ".join(f"round(max(v) FILTER (ordinal = {i} AND has), 6) AS {m}" for i, m in enumerate(ITEMS))
PEER_AVG = "round(avg(v) FILTER (ordinal > 0 AND has), 6) AS peer_avg"
_ratio_rows = [(f"{i} AS row_ix, {text(l)} AS label, '{m}' AS metric", m, "true") for i, (l, m) in enumerate(dims.RATIO_TABLE)]
_section_rows = [
    (f"{s} AS section_ix, {text(t)} AS section, {r} AS row_ix, {text(l)} AS label", m or "0", "true" if m else "false")
    for s, (t, rows) in enumerate(dims.METRIC_SECTIONS)
    for r, (l, m) in enumerate(rows)
]
_stat_rows = [(f"{i} AS row_ix, {text(l)} AS label", f"{m} / {d}::DOUBLE", "true") for i, (l, m, d) in enumerate(dims.STATISTIC_METRICS)]


def _bands(metric: str, value: str) -> str:
    cases = ""
    for name, lo, hi, status in dims.RATIO_BANDS:
        condition = f"{metric} = '{name}'" + ("" if lo is None else f" AND {value} >= {lo}") + ("" if hi is None else f" AND {value} < {hi}")
        cases += f" WHEN {condition} THEN '{status}'"
    return f"CASE{cases} ELSE 'N/A' END"


# -- S -------------------------------------------------------------------------------------------------
_tokens = ", ".join(text(t) for t in dims.NULL_TOKENS)
SQL["S1_read_wide_schedule"] = f"""WITH {RAW} SELECT CASE WHEN id = 'nan' THEN NULL ELSE id END AS "IDRSSD", quarter_key,
  code AS mdrm_code, cell AS raw FROM raw WHERE schedule = 'RC' AND cell NOT IN ({_tokens})"""
SQL["S2_read_wide_schedule_strict"] = f"""WITH {LONG} SELECT rssd_id, quarter_key, schedule_code,
  'Consolidated Balance Sheet' AS schedule_name, mdrm_code, line_item, amount FROM long WHERE schedule_code = 'RC'"""
SQL["S3_process_directory"] = f"""WITH {LONG} SELECT rssd_id, quarter_key, name, schedule_code, schedule_seq, mdrm_code,
  line_item, description, amount FROM long"""
SQL["S4_read_large_file"] = f"WITH {LONG} SELECT rssd_id, quarter_key, mdrm_code, amount FROM long WHERE schedule_code = 'RI'"

FILES = f"""
named AS (
  SELECT o_orderkey AS k, ({listed(dims.EXPECTED_SCHEDULES)})[CASE
      WHEN (o_orderkey % 39 + year(o_orderdate) * 4 + quarter(o_orderdate)) % 6 = 0 THEN (o_orderkey % 39 + 1) % 39
      ELSE o_orderkey % 39 END + 1] AS code, strftime(o_orderdate, '%m%d%Y') AS mdy,
    CASE WHEN o_orderkey % 11 = 0 THEN '(' || (o_orderkey % 2 + 1) || ' of 2)' ELSE '' END AS part_text, *
  FROM orders
),
listing AS (
  SELECT *, CASE
    WHEN k % 41 = 0 THEN 'Readme_' || k || '.txt'
    WHEN k % 43 = 0 THEN 'FFIEC CDR Call Schedule RC 1331' || year(o_orderdate) || '.txt'
    WHEN k % 47 = 0 THEN lower('FFIEC CDR Call ' || CASE code WHEN 'POR' THEN 'Bulk' ELSE 'Schedule' END || ' ' || code || ' ' || mdy || part_text || '.txt')
    ELSE 'FFIEC CDR Call ' || CASE code WHEN 'POR' THEN 'Bulk' ELSE 'Schedule' END || ' ' || code || ' ' || mdy || part_text || '.txt' END AS filename,
    k % 41 <> 0 AND k % 43 <> 0 AS is_bulk, CAST(round(o_totalprice) AS BIGINT) AS file_size
  FROM named
),
inv AS (
  SELECT *, '/bulk/' || (k % 20) || '/' || k || '/' || filename AS filepath,
    code || CASE WHEN part_text <> '' THEN CAST(k % 2 + 1 AS VARCHAR) ELSE '' END AS schedule_code,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
    year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter_key,
    sha256(CAST(k AS VARCHAR)) AS hash
  FROM listing WHERE is_bulk
),
ledger AS (
  SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN '/old' || filepath ELSE filepath END AS filepath), CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN k % 7 = 0 THEN '0000' ELSE hash END AS file_hash, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp,
    o_orderstatus = 'F' AS done,
    CASE WHEN o_orderstatus = 'F' THEN file_size % 1000 END AS row_count,
    CASE WHEN o_orderstatus = 'F' THEN file_size % 100 END AS institution_count,
    CASE WHEN o_orderstatus = 'P' THEN 'error ' || k END AS err,
    CASE WHEN o_orderstatus = 'P' THEN k % 3 ELSE 0 END AS retries
  FROM inv
)"""
SQL["S5_file_inventory"] = f"""WITH {FILES} SELECT filepath, schedule_code, mdy AS report_date, year, quarter, quarter_key,
  CASE WHEN part_text <> '' THEN k % 2 + 1 END AS part, file_size FROM inv"""
SQL["S6_content_fingerprint"] = "SELECT doc_id, sha256(text) AS file_hash FROM documents"
SQL["S6_merkle_fingerprint"] = """WITH RECURSIVE d AS (SELECT doc_id, encode(text) AS b FROM documents WHERE text <> ''),
  f AS (SELECT doc_id, 0 AS edition, hex(b) AS h FROM d UNION ALL SELECT doc_id, 1, hex(b)[1:-3] || '7E' FROM d),
  l AS (SELECT doc_id, edition, i AS ix, sha256(unhex('4C' || h[i * 128 + 1:i * 128 + 128])) AS hash, 1 AS leaves
    FROM (SELECT *, unnest(range((length(h) + 127) // 128)) AS i FROM f)),
  n AS (SELECT doc_id, edition, 0 AS height, ix, hash, count(*) OVER (PARTITION BY doc_id, edition) AS n_leaves, count(*) OVER (PARTITION BY doc_id, edition) AS width FROM l
    UNION ALL
    SELECT doc_id, edition, height + 1, ix // 4, sha256('N' || string_agg(hash, '' ORDER BY ix)), any_value(n_leaves), (any_value(width) + 3) // 4
    FROM n WHERE width > 1 GROUP BY doc_id, edition, height, ix // 4)
  SELECT doc_id, edition, n_leaves, hash AS root FROM n WHERE width = 1"""
SQL["S7_code_dictionary"] = "SELECT 'RCON' || p_partkey AS mdrm_code, p_name AS description FROM part"
SQL["S8_institution_lookup"] = "SELECT CAST(s_suppkey AS VARCHAR) AS rssd_id, s_name AS name FROM supplier"
COMPANIES = """companies AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CAST(c_custkey AS VARCHAR) AS cik_raw,
  c_mktsegment[1:2] || c_custkey AS ticker, c_name AS name FROM customer)"""
SQL["S9_company_tickers"] = f"WITH {COMPANIES} SELECT * FROM companies"
FILINGS = f"""filings AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_orderkey AS k,
    (o_orderkey // 4096) * 4294967296 + row_number() OVER (PARTITION BY o_custkey, o_orderkey // 4096 ORDER BY o_orderdate DESC, o_orderkey) - 1 AS seq,
    CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '8-K' ELSE '10-K/A' END AS form,
    CAST(o_orderdate AS DATE) AS filing_date, '0000' || o_orderkey AS accession_number, 'doc' || o_orderkey || '.htm' AS primary_document,
    '{dims.FILING_ARCHIVE}/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '/0000' || o_orderkey || '/doc' || o_orderkey || '.htm' AS url
  FROM orders)"""
SQL["S10_filing_index"] = f"WITH {FILINGS} SELECT * EXCLUDE (k) FROM filings"
DELIMITED = """lines AS (
  SELECT o_orderkey AS k, o_orderkey // 128 AS doc_id, CAST(o_orderkey % 128 AS INTEGER) AS line_no, o_orderkey % 23 = 0 AS blank,
    o_orderkey % 23 <> 0 AND o_orderkey % 37 = 0 AS heads, CAST(round(o_totalprice) AS BIGINT) AS amt FROM orders)"""
SQL["S11_delimited_documents"] = f"""WITH {DELIMITED} SELECT doc_id, line_no, CASE WHEN blank THEN ''
  WHEN heads THEN 'Schedule RC-' || k || '¦x' ELSE 'item, ' || k || '¦' || amt || '¦' END AS cells FROM lines"""

SQL["S11_quoted_records"] = """WITH lines AS (
  SELECT o_orderkey AS k, o_orderkey // 128 AS d, CAST(round(o_totalprice) AS BIGINT) AS amt FROM orders),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k) - 1 AS record_no, k = max(k) OVER (PARTITION BY d) AS is_last FROM lines)
  SELECT CASE WHEN d % 4 <> 0 THEN d END AS doc_id, record_no, CASE WHEN k % 23 = 0 THEN '' WHEN k % 7 = 0
    THEN 'first' || CASE d % 3 WHEN 0 THEN chr(9) WHEN 1 THEN '|' ELSE ',' END || 'line' || chr(10) || chr(10) || 'of "' || k || '"¦' || chr(10) || '¦'
    ELSE k || '¦' || amt || chr(13) || chr(10) || 'end' END AS cells
  FROM numbered WHERE NOT (is_last AND k % 23 = 0 AND d % 2 <> 0)"""
_SPANNED = """t AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey // 2 END AS doc_id, 0 AS table_ix, o_orderkey AS k, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS amt FROM orders)"""
SQL["S12_spanned_cells"] = f"""WITH {_SPANNED}, g AS (SELECT doc_id, table_ix, CASE k % 4
    WHEN 0 THEN [['Item', 'Amounts', ''], ['', 'New', 'Old'], ['No ' || k, amt, '5']]
    WHEN 1 THEN [['Group ' || k, 'first'], ['', 'second'], ['', 'third']]
    WHEN 2 THEN [['left', amt, 'right', ''], ['', '', 'wide', ''], ['under', '', 'last', '']]
    ELSE [['only ' || k]] END AS rows FROM t),
  r AS (SELECT doc_id, table_ix, unnest(rows) AS row, generate_subscripts(rows, 1) - 1 AS row_ix FROM g)
  SELECT doc_id, table_ix, CAST(row_ix AS INTEGER) AS row_ix, CAST(generate_subscripts(row, 1) - 1 AS INTEGER) AS col_ix, unnest(row) AS text FROM r"""
SQL["S12_merged_cells"] = f"""WITH {_SPANNED}, m AS (SELECT doc_id, table_ix, unnest(CASE k % 4
    WHEN 0 THEN [{{'row_ix': 0, 'col_ix': 0, 'colspan': 1, 'rowspan': 2, 'value': 'Item'}}, {{'row_ix': 0, 'col_ix': 1, 'colspan': 2, 'rowspan': 1, 'value': 'Amounts'}}]
    WHEN 1 THEN [{{'row_ix': 0, 'col_ix': 0, 'colspan': 1, 'rowspan': 3, 'value': 'Group ' || k}}]
    WHEN 2 THEN [{{'row_ix': 0, 'col_ix': 0, 'colspan': 1, 'rowspan': 2, 'value': 'left'}}, {{'row_ix': 0, 'col_ix': 1, 'colspan': 1, 'rowspan': 3, 'value': amt}},
      {{'row_ix': 1, 'col_ix': 2, 'colspan': 2, 'rowspan': 1, 'value': 'wide'}}] END, recursive := true) FROM t)
  SELECT * FROM m"""
HTML = """rows AS (
  SELECT o_orderkey AS k, o_orderkey // 256 AS doc_id, CAST(o_orderkey // 32 % 8 AS INTEGER) AS table_ix,
    CAST(o_orderkey % 32 + 1 AS INTEGER) AS row_ix, CAST(round(o_totalprice) AS BIGINT) AS amt,
    format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS g FROM orders),
widths AS (SELECT doc_id, table_ix, max(CASE WHEN k % 3 = 0 THEN 4 ELSE 3 END) AS width, count(*) + 1 AS n_rows FROM rows GROUP BY 1, 2),
grid AS (
  SELECT doc_id, table_ix, row_ix, ['Total loans & leases' || (k % 4), '$' || g,
    CASE WHEN k % 5 = 0 THEN CASE WHEN amt < 1000 THEN '' ELSE '-' || g END ELSE (k % 100) || '%' END, ''] AS c FROM rows
  UNION ALL SELECT doc_id, table_ix, 0, ['Year 2023 vs 2024', 'Amount', 'Share', ''] FROM widths),
cells AS (SELECT g.doc_id, g.table_ix, g.row_ix, CAST(i AS INTEGER) AS col_ix, c[i + 1] AS text
  FROM grid g JOIN widths w ON w.doc_id = g.doc_id AND w.table_ix = g.table_ix, LATERAL (SELECT unnest(range(w.width)) AS i))"""
SQL["S12_html_tables"] = f"WITH {HTML} SELECT doc_id, table_ix, row_ix, col_ix, text FROM cells"
FACTS = """facts AS (
  SELECT o_orderkey // 64 AS doc_id, CAST(o_orderkey % 64 AS INTEGER) AS fact_ix, o_orderkey // 64 % 5 = 0 AS plain,
    CASE o_orderkey % 3 WHEN 0 THEN 'us-gaap:assets' WHEN 1 THEN 'call:rcon2170' ELSE 'us-gaap:item' || (o_orderkey % 32) END AS tag,
    CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS value, 'c' || (o_orderkey % 2) AS context FROM orders),
tagged AS (SELECT doc_id, fact_ix, CASE WHEN plain THEN 'NumericValue' ELSE tag END AS name,
    CASE WHEN plain THEN 'numeric_data' ELSE split_part(tag, ':', 2) END AS category, value,
    CASE WHEN plain THEN '' ELSE context END AS context, CASE WHEN plain THEN '' ELSE 'USD' END AS unit,
    CASE WHEN plain THEN '' ELSE '0' END AS decimals FROM facts)"""
SQL["S13_tagged_facts"] = f"WITH {FACTS} SELECT * FROM tagged"
SQL["S14_report_period"] = """SELECT o_orderkey // 64 AS doc_id, CASE WHEN o_orderkey // 64 % 5 <> 0
  THEN strftime(min_by(o_orderdate, o_orderkey), '%Y-%m-%d') END AS period_end FROM orders GROUP BY o_orderkey // 64"""
SQL["document_tables"] = f"""WITH {HTML}, {FACTS}, {DELIMITED},
  h AS (SELECT doc_id, table_ix, row_ix, string_agg(text, '¦' ORDER BY col_ix) AS line FROM cells GROUP BY 1, 2, 3),
  t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, category) AS n FROM tagged),
  p AS ({SQL["S14_report_period"]}),
  s AS (SELECT *, sum(CAST(blank OR heads AS INTEGER)) OVER w AS section_no,
    last_value(CASE WHEN heads THEN 'Schedule RC-' || k END IGNORE NULLS) OVER w AS title FROM lines
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, section_no) AS n FROM s WHERE NOT blank)
  SELECT doc_id * 3 AS doc_id, 'Company ' || doc_id AS company, 'html' AS kind, NULL AS period_end, 'TABLE_' || CASE table_ix % 4 WHEN 0 THEN 'consolidated_balance_sheets'
    WHEN 3 THEN 'deposits' ELSE 'segment_information' END || '_' || (table_ix + 1) AS table_name, row_ix, line AS cells FROM h
  UNION ALL SELECT doc_id * 3 + 1, 'Company ' || doc_id, 'xbrl', period_end, 'CallReport_' || category, fact_ix,
    category || '¦' || value || '¦' || context || '¦' || unit FROM t JOIN p USING (doc_id) WHERE n > 3
  UNION ALL SELECT doc_id * 3 + 2, 'Company ' || doc_id, 'delimited', NULL,
    'SDF_' || replace(regexp_replace(coalesce(title, 'Call_Report_Data'), '[^\\w\\s]', '', 'g'), ' ', '_')[1:40] || '_' || CAST(section_no AS BIGINT), line_no,
    CASE WHEN heads THEN 'Schedule RC-' || k || '¦x' ELSE 'item, ' || k || '¦' || amt || '¦' END FROM c WHERE n >= 2"""
TEXT_ROWS = """lines AS (
  SELECT o_orderkey AS k, o_orderkey // 400 AS doc_id, o_orderkey // 40 % 10 AS page_num, o_orderkey % 40 AS row_ix,
    CAST(o_orderkey % 30 + 1 AS VARCHAR) AS n, lpad(CAST(o_orderkey % 2000 AS VARCHAR), 4, '0') AS c,
    format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS amt, o_orderkey % 8 AS kind FROM orders),
printed AS (SELECT *, CASE kind WHEN 0 THEN n || '. Loans and leases RCFD' || c || ' ' || amt
  WHEN 1 THEN n || '.a. Total deposits ..... RCON' || c || ' -' || amt WHEN 2 THEN '(1) Net income item RCFN' || c || ' ' || amt
  WHEN 3 THEN 'Other assets RCON' || c || ' ' || amt WHEN 4 THEN n || '. Cash and balances group ' || k
  WHEN 5 THEN 'Schedule RC Dollar amounts in thousands ' || k WHEN 6 THEN n || '. Subtotal (net) RCON' || c || ' ' || amt || ' ' || n || '.'
  ELSE n || ' . RCON' || c || ' ' || amt END AS row_text FROM lines)"""
SQL["S15_word_rows"] = f"WITH {TEXT_ROWS} SELECT doc_id, page_num, CAST(row_ix * 12 AS DOUBLE) AS row_top, row_text FROM printed"
SQL["S16_document_routing"] = """SELECT o_custkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 3 THEN 'xbrl' WHEN o_orderkey % 5 = 0 THEN 'pdf'
  WHEN o_orderkey % 5 = 4 THEN 'html' ELSE 'delimited' END AS kind, count(*) AS documents FROM orders GROUP BY 1, 2"""

# -- K -------------------------------------------------------------------------------------------------
SQL["K1_long_by_schedule"] = f"WITH {LONG} SELECT rssd_id, quarter_key, schedule_code, mdrm_code, amount, amount_num AS amount_value FROM long"
SQL["K2_csv_per_table"] = f"""WITH {HTML},
  q AS (SELECT doc_id, table_ix, row_ix, col_ix, CASE WHEN text LIKE '%,%' THEN '"' || text || '"' ELSE text END AS t FROM cells)
  SELECT doc_id, 'TABLE_section_1_statement_of_Condition__' || doc_id || '_' || (table_ix + 1) || '.csv' AS file,
    string_agg(t, ',' ORDER BY col_ix) AS line, (SELECT count(*) FROM widths) AS table_count FROM q GROUP BY doc_id, table_ix, row_ix"""
SQL["K2_csv_files"] = SQL["K2_csv_per_table"]
SQL["K3_nested_json"] = f"""WITH {HTML}, r AS (SELECT doc_id, table_ix, row_ix, string_agg(text, '¦' ORDER BY col_ix) AS row FROM cells GROUP BY 1, 2, 3)
  SELECT w.doc_id, w.table_ix,
  'TABLE_section_1_statement_of_Condition__' || w.doc_id || '_' || (w.table_ix + 1) AS name, w.n_rows AS rows, w.width AS columns, row_ix, row
  FROM widths w JOIN r ON r.doc_id = w.doc_id AND r.table_ix = w.table_ix"""
COMPARED = MEMBER_ROWS + """, compared AS (SELECT quarter_key, peer_group, schedule_code, line_item, mdrm_code,
  any_value(description) AS description, any_value(set_size) AS set_size, """ + ", ".join(
    f"CASE WHEN any_value(set_size) > {i} THEN coalesce(max(amount) FILTER (ordinal = {i}), '—') END AS {m}" for i, m in enumerate(ITEMS)
) + " FROM rows GROUP BY 1, 2, 3, 4, 5)"
SQL["K4_comparison_tables"] = f"WITH {COMPARED} SELECT quarter_key, peer_group, schedule_code, line_item, mdrm_code, " + ", ".join(
    f"TRY_CAST(replace(\"{m}\", ',', '') AS DOUBLE) AS {m}_value" for m in ITEMS
) + " FROM compared"
SQL["K5_table_names"] = """WITH t AS (SELECT *, p_brand || ': [' || p_name || '] / ' || p_type || ' sheet?' AS title FROM part)
  SELECT p_partkey, CASE WHEN length(title) > 31 THEN translate(title, ':\\/?*[]', '_______')[1:27] || '_' || p_size
    ELSE translate(title, ':\\/?*[]', '_______') END AS sheet_name,
  'TABLE_' || replace(regexp_replace(title, '[^\\w\\s]', '', 'g'), ' ', '_')[1:40] || '_' || (p_size + 1) AS table_name,
  regexp_replace(regexp_replace(title, '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g') || '.csv' AS csv_name FROM t"""

# -- P -------------------------------------------------------------------------------------------------
RAW_IDS = 'id AS "IDRSSD", quarter_key, code AS mdrm_code'
SQL["P1_unpivot_codes"] = f"WITH {RAW} SELECT {RAW_IDS}, cell AS amount FROM raw WHERE cell IS NOT NULL AND trim(cell) <> ''"
SQL["P2_code_columns"] = f"WITH {RAW} SELECT " + ", ".join(
    f"count(cell) FILTER (code = '{c}') AS {c}" for _, c, _ in derived.WIDE_CODES
) + " FROM raw"
SQL["P3_institution_filter"] = f"WITH {LONG} SELECT rssd_id, quarter_key, mdrm_code, amount FROM long WHERE rssd_id IN ('1', '7', '9')"
SQL["P4_strict_amounts"] = f"WITH {STRICT} SELECT {RAW_IDS}, amount, round(num, 6) AS amount_num FROM strict"
SQL["P5_blank_ids"] = f"WITH {RAW} SELECT id AS rssd_id, count(*) // 36 AS n_rows FROM raw WHERE trim(id) NOT IN ('', 'nan') GROUP BY 1"
SQL["P6_fallback_description"] = f"WITH {LONG} SELECT schedule_code, mdrm_code, description, count(*) AS n_rows FROM long GROUP BY ALL"
SQL["P7_schedule_from_name"] = f"""WITH {FILES} SELECT k AS order_key,
  CASE WHEN k % 41 = 0 OR (code = 'POR' AND k % 43 <> 0) THEN NULL WHEN k % 43 = 0 THEN 'RC' ELSE code END AS schedule_code,
  CASE WHEN k % 3 = 0 THEN 'RCN' WHEN k % 3 = 1 THEN 'RCE'
    WHEN k % 41 = 0 OR (code = 'POR' AND k % 43 <> 0) THEN NULL WHEN k % 43 = 0 THEN 'RC' ELSE code END AS odd_code FROM listing"""
SQL["P8_base_schedule"] = f"""WITH {FILES} SELECT k AS order_key, CASE WHEN schedule_code[1:3] IN ('RCR', 'RCL', 'RCO', 'RCT', 'RCN')
  THEN schedule_code[1:3] ELSE code END AS base_schedule FROM inv"""
SQL["P9_quarter_from_name"] = f"""WITH {FILES} SELECT year, quarter, CASE WHEN part_text <> '' THEN k % 2 + 1 END AS part,
  count(*) AS files FROM inv GROUP BY ALL"""
_paren = "CASE WHEN {0} LIKE '(%' AND {0} LIKE '%)' THEN '-' || {0}[2:-2] ELSE {0} END"
SQL["P10_report_amounts"] = f"""WITH {RAW}, p AS (SELECT *, {_paren.format('trim(cell)')} AS s FROM raw)
  SELECT {RAW_IDS}, CASE WHEN cell IS NULL OR cell = '' THEN '' WHEN regexp_full_match(s, '-?[0-9]+') THEN format('{{:,}}', CAST(s AS BIGINT))
    ELSE s END AS amount FROM p"""
SQL["P11_format_amounts"] = f"""WITH {RAW}, p AS (SELECT *, trim(cell) AS t, replace(replace(trim(cell), ',', ''), '$', '') AS u FROM raw),
  n AS (SELECT *, TRY_CAST({_paren.format('u')} AS DOUBLE) AS v FROM p)
  SELECT {RAW_IDS}, CASE WHEN cell IS NULL OR t = '' THEN '' WHEN upper(t) IN ('NA', 'N/A', '-') THEN t
    WHEN v IS NULL THEN t ELSE format('{{:,}}', CAST(trunc(v) AS BIGINT)) END AS amount FROM n"""
_clean = "trim(regexp_replace(text, '[\\s\\x0b\\x85\\p{Z}]+', ' ', 'g'))"
for pattern in (r"\s*\([a-z]\)", r"\s*\(\d+\)", r"\s*\*+"):
    _clean = f"regexp_replace({_clean}, '{pattern}', '', 'g')"
SQL["P12_clean_cells"] = f"""WITH a AS (SELECT doc_id, {_clean} AS t FROM documents),
  b AS (SELECT doc_id, CASE WHEN regexp_full_match(t, '\\s*\\(\\s*[\\d,]+\\.?\\d*\\s*\\)\\s*') THEN '-' || regexp_replace(t, '[^\\d,.]', '', 'g') ELSE t END AS t FROM a)
  SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '\\$\\s+', '$', 'g'), '\\s+%', '%', 'g'))) AS clean_md5 FROM b"""
SQL["P13_numeric_test"] = f"""WITH {RAW} SELECT code AS mdrm_code,
  count(*) FILTER (cell <> '' AND TRY_CAST(trim(translate(cell, ',$%.()', '')) AS DOUBLE) IS NOT NULL) AS numeric, count(*) AS cells FROM raw GROUP BY 1"""
SQL["P14_cell_flags"] = f"""WITH {HTML} SELECT doc_id, col_ix, count(*) FILTER (text LIKE '%$%' OR lower(text) LIKE '%usd%') AS is_currency,
  count(*) FILTER (text LIKE '%$%' OR lower(text) LIKE '%usd%' OR text LIKE '%\\%%' ESCAPE '\\'
    OR regexp_full_match(replace(text, ' ', ''), '[\\(\\-]?[\\d,]+\\.?\\d*\\)?')) AS is_number,
  count(*) FILTER (text LIKE '%\\%%' ESCAPE '\\') AS is_percentage,
  count(*) FILTER (regexp_matches(text, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}')) AS is_date,
  count(*) FILTER (regexp_matches(text, '^(RCFD|RCON|RIAD|RCFN)[A-Z0-9]+$')) AS is_code FROM cells GROUP BY 1, 2"""
SQL["P15_financial_tables"] = f"""WITH {HTML}, body AS (
  SELECT doc_id, table_ix, lower('Year 2023 vs 2024AmountShare' || string_agg('Total loans & leases (a)' || (k % 4) || '$ ' || g ||
    CASE WHEN k % 5 = 0 THEN '(' || g || ')' ELSE (k % 100) || ' %' END, chr(10) ORDER BY k)) AS t, count(*) AS n FROM rows GROUP BY 1, 2),
  s AS (SELECT *, len(list_filter({listed(dims.FINANCIAL_WORDS)}, lambda w: contains(t, w))) AS i,
    len(regexp_extract_all(t, '{dims.NUMERIC_PATTERN}')) AS m, len(regexp_extract_all(t, '{dims.YEAR_PATTERN}')) AS yr FROM body)
  SELECT doc_id, table_ix, n + 1 AS n_rows, (n + 1) * 3 AS n_cells,
    n + 1 >= 3 AND length(trim(t)) >= 20 AND (n + 1) * 3 >= 6 AND ((i >= 3 AND m >= 5) OR (yr >= 2 AND m >= 10) OR i >= 5) AS is_financial FROM s"""
_entities = "p"
_strip_tags = "regexp_replace(piece, '<[^>]*>', '', 'g')"
for entity, char in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _strip_tags = f"replace({_strip_tags}, '{entity}', {text(char)})"
SQL["P15_mixed_tables"] = """WITH t(kind, table_ix, n_rows, is_financial, has_numbers, header_rows) AS (VALUES
    (0, 0, 6, true, true, '0,1'), (1, 0, 3, false, false, '0,1,2'), (2, 0, 2, false, true, ''), (3, 0, 2, false, false, ''), (3, 1, 2, false, true, ''))
  SELECT p_partkey AS doc_id, table_ix, n_rows, is_financial, has_numbers, header_rows FROM part JOIN t ON p_partkey % 4 = kind"""
SQL["P16_section_headings"] = f"""WITH a AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g'),
    '(?is)<style\\b.*?</style\\s*>', '', 'g') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<(h[1-6]|p|div|span)(?:\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'g'),
    '(?i)</(?:h[1-6]|p|div|span)\\s*>', chr(1), 'g') AS h FROM a),
  c AS (SELECT page_id, unnest(string_split(h, chr(1))) AS x FROM b),
  d AS (SELECT page_id, lower(split_part(x, chr(2), 1)) AS tag, x[strpos(x, chr(2)) + 1:] AS piece FROM c WHERE contains(x, chr(2))),
  e AS (SELECT page_id, tag, trim({_strip_tags}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS t FROM d),
  f AS (SELECT page_id, tag, t, list_filter({listed((*dims.SECTION_KEYWORDS, *PAGE_KEYWORDS))}, lambda w: contains(lower(t), w))[1] AS keyword FROM e)
  SELECT page_id, tag, lower(t) AS shown_text, keyword, length(t) <= 300 AS is_heading, 10 AS priority FROM f WHERE keyword IS NOT NULL"""
SQL["P16_table_sections"] = f"""WITH {HTML} SELECT doc_id, table_ix, CASE table_ix % 4 WHEN 0 THEN 'consolidated balance sheets'
  WHEN 3 THEN 'deposits' ELSE 'segment information' END AS keyword, CASE table_ix % 4 WHEN 0 THEN 2 ELSE 10 END AS priority FROM widths"""
SQL["P17_header_rows"] = f"WITH {HTML} SELECT doc_id, table_ix, '0' AS header_rows FROM widths"
SQL["P18_tables_with_numbers"] = f"""WITH {HTML}, t AS (SELECT doc_id, table_ix, bool_or(regexp_matches(text, '\\d')) AS has FROM cells GROUP BY 1, 2)
  SELECT doc_id, count(*) FILTER (has) AS with_numbers, count(*) AS tables FROM t GROUP BY 1"""

GRIDS = f"""{DICTIONARY},
g AS (SELECT o_orderkey AS k, o_orderkey // 64 AS doc_id, o_orderkey % 64 AS row_ix, o_orderkey % 7 AS kind,
  CAST(o_orderkey % 20 + 1 AS VARCHAR) AS n, lpad(CAST(o_orderkey % 2000 AS VARCHAR), 4, '0') AS c,
  format('{{:,}}', CAST(round(o_totalprice) AS BIGINT)) AS amt FROM orders),
rep AS (SELECT k, doc_id, row_ix, kind,
  CASE WHEN kind IN (0, 1, 5) THEN 'RCON' || c WHEN kind = 2 THEN 'RIAD' || c ELSE '' END AS code,
  CASE WHEN kind IN (0, 2) OR (kind = 5 AND k % 2 = 0) THEN amt ELSE '' END AS amount,
  CASE kind WHEN 0 THEN n || '. Cash and due' WHEN 1 THEN n || '.a (' || amt || ')' WHEN 2 THEN 'a. Net income  of   banks'
    WHEN 3 THEN '(1) Trading total RCFD' || c || ' ' || amt || ' RCON' || c || ' -12,345' WHEN 4 THEN 'Assets Total assets'
    WHEN 5 THEN CASE WHEN k % 2 = 0 THEN coalesce((SELECT any_value(known) FROM dictionary WHERE dcode = 'RCON' || c), '') ELSE '-' END
    ELSE 'Dollar amounts ' || k || ' (ii) lower x y' END AS description FROM g WHERE kind <> 4 OR k % 2 = 0),
report AS (SELECT *, CASE WHEN kind = 2 THEN 1 WHEN kind = 3 THEN 2 WHEN kind = 5 AND regexp_matches(description, '^[a-z]') THEN 1 ELSE 0 END AS indent,
  kind = 0 AS is_section_header,
  len(list_filter({listed(dims.REPORT_TOTAL_WORDS)}, lambda w: contains(upper(description), w))) > 0 AS is_total FROM rep)"""
_balance_total = f"len(list_filter({listed(dims.BALANCE_TOTAL_WORDS)}, lambda w: contains(upper(description), w))) > 0"
SQL["P19_report_rows"] = f"WITH {GRIDS} SELECT doc_id, row_ix, code, amount, description, indent, is_section_header, is_total FROM report"
SQL["P20_balance_rows"] = f"""WITH {GRIDS}, b AS (
  SELECT doc_id, row_ix, CASE kind WHEN 1 THEN n || '.a' WHEN 4 THEN 'Assets' ELSE '' END AS line_item,
    CASE kind WHEN 4 THEN 'Total assets' ELSE coalesce((SELECT any_value(known) FROM dictionary WHERE dcode = 'RCON' || c), '') END AS description,
    CASE kind WHEN 4 THEN '' ELSE 'RCON' || c END AS code,
    CASE kind WHEN 1 THEN '-' || amt WHEN 4 THEN '' ELSE CASE WHEN k % 2 = 0 THEN amt ELSE '-' END END AS amount
  FROM g WHERE kind IN (1, 5) OR (kind = 4 AND k % 2 = 0))
  SELECT *, code = '' AS is_section_header, {_balance_total} AS is_total FROM b"""
_known = "coalesce((SELECT any_value(known) FROM dictionary WHERE dcode = 'RCON' || c), {0})"
SQL["P21_word_row_patterns"] = f"""WITH {TEXT_ROWS}, {DICTIONARY}, r AS (
  SELECT doc_id, page_num, row_ix, kind = 4 AS is_section_header,
    CASE WHEN kind IN (0, 4, 6) THEN n || '.' WHEN kind = 1 THEN n || '.a.' WHEN kind = 7 THEN n ELSE '' END AS line_item,
    CASE kind WHEN 0 THEN 'Loans and leases' WHEN 1 THEN 'Total deposits' WHEN 2 THEN '(1) Net income item' WHEN 3 THEN 'Other assets'
      WHEN 4 THEN 'Cash and balances group ' || k WHEN 6 THEN 'Subtotal (net)' ELSE {_known.format("''")} END AS description,
    CASE kind WHEN 0 THEN 'RCFD' || c WHEN 2 THEN 'RCFN' || c WHEN 4 THEN '' ELSE 'RCON' || c END AS code,
    CASE kind WHEN 1 THEN '-' || amt WHEN 4 THEN '' ELSE amt END AS amount
  FROM lines WHERE kind <> 5)
  SELECT *, NOT is_section_header AND {_balance_total} AS is_total FROM r"""
SQL["P21_text_row_patterns"] = f"""WITH {TEXT_ROWS}, r AS (
  SELECT doc_id, page_num, row_ix, kind = 4 AS is_section_header,
    CASE WHEN kind IN (0, 4, 6) THEN n WHEN kind = 1 THEN n || '.a' WHEN kind = 2 THEN '(1)' ELSE '' END AS line_item,
    CASE kind WHEN 0 THEN 'Loans and leases' WHEN 1 THEN 'Total deposits' WHEN 2 THEN 'Net income item' WHEN 3 THEN 'Other assets'
      WHEN 4 THEN 'Cash and balances group ' || k WHEN 6 THEN 'Subtotal' ELSE n END AS description,
    CASE kind WHEN 0 THEN 'RCFD' || c WHEN 2 THEN 'RCFN' || c WHEN 4 THEN '' ELSE 'RCON' || c END AS code,
    CASE kind WHEN 1 THEN '-' || amt WHEN 4 THEN '' ELSE amt END AS amount
  FROM lines WHERE kind <> 5)
  SELECT *, NOT is_section_header AND {_balance_total} AS is_total FROM r"""
SQL["P22_split_collapsed_cells"] = f"""WITH {GRIDS}, b AS (
  SELECT doc_id, row_ix, 0 AS pair_ix, '' AS line_item, '(1) Trading total' AS description, 'RCFD' || c AS code, amt AS amount FROM g WHERE kind = 3
  UNION ALL SELECT doc_id, row_ix, 1, '', {_known.format("'Line item for RCON' || c")}, 'RCON' || c, '-12,345' FROM g WHERE kind = 3)
  SELECT *, {_balance_total} AS is_total FROM b"""
PAGES = """pg AS (SELECT o_orderkey // 16 AS doc_id, o_orderkey % 16 AS page_num,
  CASE o_orderkey % 9 WHEN 0 THEN 'RC' WHEN 3 THEN 'RC-R Part II' WHEN 5 THEN 'RI' WHEN 7 THEN 'RC-N' END AS code,
  CASE o_orderkey % 9 WHEN 0 THEN 'Consolidated Balance Sheet' WHEN 3 THEN 'Risk weighted assets' WHEN 5 THEN 'Income statement'
    WHEN 7 THEN 'Past due loans' END AS t FROM orders),
carried AS (SELECT doc_id, page_num, last_value(code IGNORE NULLS) OVER w AS schedule_code, last_value(t IGNORE NULLS) OVER w AS title
  FROM pg WINDOW w AS (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SQL["P23_page_schedules"] = f"WITH {PAGES} SELECT doc_id, page_num, code AS schedule_code, t AS title FROM pg"
SQL["P24_clean_grid"] = f"""WITH {GRIDS} SELECT doc_id, row_ix, CASE kind WHEN 0 THEN n || '. Cash and due¦RCON' || c || '¦' || amt || '¦'
  WHEN 1 THEN n || '.a¦¦RCON' || c || '¦(' || amt || ')' WHEN 2 THEN 'a. Net income of banks ...¦¦RIAD' || c || '¦' || amt
  WHEN 3 THEN '(1) Trading total¦RCFD' || c || ' ' || amt || ' RCON' || c || ' -12,345' WHEN 4 THEN 'Assets¦Total assets¦¦'
  WHEN 5 THEN '¦¦RCON' || c || '¦' || CASE WHEN k % 2 = 0 THEN amt ELSE '-' END ELSE 'Dollar amounts ' || k || '¦(ii) lower¦x¦y' END AS cells
  FROM g WHERE kind <> 4 OR k % 2 = 0"""
SQL["P25_schedule_titles"] = f"""WITH {PAGES} SELECT schedule_code, CASE schedule_code WHEN 'RC' THEN 'Consolidated Balance Sheet'
  WHEN 'RC-R Part II' THEN 'Risk-Weighted Assets' WHEN 'RI' THEN 'Income Statement' ELSE 'Past Due and Nonaccrual' END AS proper_name,
  count(*) AS pages FROM carried WHERE schedule_code IS NOT NULL GROUP BY 1"""
SQL["P26_numeric_amounts"] = f"WITH {RAW} SELECT {RAW_IDS}, TRY_CAST(trim(replace(cell, ',', '')) AS DOUBLE) AS amount_value FROM raw"
SQL["P27_folder_check"] = f"""WITH {FILES}, f AS (SELECT '/bulk/' || (k % 20) AS folder,
  count(*) FILTER (contains(filename, 'FFIEC') AND contains(filename, 'Schedule')) AS bulk_files FROM listing GROUP BY 1)
  SELECT *, bulk_files >= 10 AS is_valid FROM f"""
SQL["P28_report_layout"] = f"""WITH {GRIDS} SELECT doc_id, row_ix, CASE WHEN doc_id % 2 = 0 THEN CAST(row_ix AS VARCHAR) END AS printed_item,
  CASE WHEN doc_id % 2 = 0 THEN description ELSE repeat('    ', indent) || description END AS printed_description, code,
  amount AS printed_amount FROM report"""

# -- J -------------------------------------------------------------------------------------------------
SQL["J1_institution_names"] = f"WITH {LONG} SELECT rssd_id, name, count(*) AS n_rows FROM long GROUP BY 1, 2"
SQL["J2_code_descriptions"] = f"WITH {GRIDS} SELECT doc_id, row_ix, code, description FROM report"
SQL["J3_schedule_info"] = f"""WITH {FILES}, {LOOKUPS} SELECT schedule_code, coalesce(sname, schedule_code) AS schedule_name,
  sprefix AS schedule_prefix, count(*) AS files FROM inv LEFT JOIN info ON sc = schedule_code GROUP BY ALL"""
SQL["J4_line_items"] = f"""WITH {LOOKUPS}, p AS (SELECT (['RC', 'RI', 'RCN', 'RCRI', 'RCO2'])[p_partkey % 5 + 1] AS schedule,
    (['RCON', 'RCFD', 'RIAD', 'RCOA'])[p_partkey % 4 + 1] || lpad(CAST(p_partkey * 7 % 10000 AS VARCHAR), 4, '0') AS code FROM part),
  d AS (SELECT schedule, code, count(*) AS n_rows FROM p GROUP BY 1, 2)
  SELECT schedule AS schedule_code, code AS mdrm_code, {ITEM} AS line_item, n_rows FROM d"""
_listed_codes = [(m, c, i) for m, codes in dims.METRIC_CODES.items() if m != "total_deposits" for i, c in enumerate(codes)]
SQL["J5_metric_lookup"] = f"""WITH {LONG}, lists(metric, c, rank) AS (VALUES {values(_listed_codes)})
  SELECT rssd_id, quarter_key, metric, round(min_by(amount_num, schedule_seq * 100 + rank), 6) AS value,
    min_by(mdrm_code, schedule_seq * 100 + rank) AS mdrm_code FROM long JOIN lists ON c = mdrm_code GROUP BY 1, 2, 3"""
SQL["J6_institution_search"] = """WITH i AS (SELECT CASE WHEN s_suppkey % 10 = 3 THEN 'old-' ELSE '' END || s_suppkey AS rssd_id, s_name AS name FROM supplier)
  SELECT term, rssd_id, name, lower(name) = lower(term) AS is_exact FROM i, (VALUES ('#00000001'), ('supplier#000000005')) t(term)
    WHERE contains(lower(name), lower(term))
  UNION ALL SELECT term, term, coalesce((SELECT name FROM i WHERE rssd_id = term), 'Institution ' || term), true FROM (VALUES ('9'), ('13')) t(term)"""
SQL["J7_company_search"] = f"""WITH {COMPANIES} SELECT cik, ticker, name, 'ticker' AS search FROM companies WHERE lower(ticker) = 'au17'
  UNION ALL SELECT cik, ticker, name, 'name' FROM companies WHERE contains(lower(name), 'customer#00000001')
  UNION ALL SELECT cik, ticker, name, 'cik' FROM companies WHERE cik_raw = '21' OR cik = '0000000022'"""
SQL["J6_institution_terms"] = """WITH i AS (SELECT CAST(c_custkey AS VARCHAR) AS rssd_id, c_name || ' ' || c_mktsegment AS name FROM customer),
  k AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS n FROM supplier),
  t AS (SELECT '#' || lpad(n, 8, '0') AS term FROM k UNION SELECT 'R#' || lpad(n, 9, '0') || ' b' FROM k UNION SELECT n || ' m' FROM k
    UNION SELECT 'no such' UNION SELECT '#' UNION SELECT upper(c_mktsegment[2:2]) || lower(c_mktsegment[3:6]) FROM customer
    UNION SELECT c_mktsegment[1:2] FROM customer),
  ids AS (SELECT n AS term FROM k UNION SELECT CAST(k + 1000000 AS VARCHAR) FROM k)
  SELECT term, rssd_id, name, lower(name) = lower(term) AS is_exact FROM i, t WHERE contains(lower(name), lower(term))
  UNION ALL SELECT term, term, coalesce(name, 'Institution ' || term), true FROM ids LEFT JOIN i ON rssd_id = term"""
SQL["J7_company_requests"] = f"""WITH {COMPANIES}, k AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS n FROM supplier),
  asked AS (SELECT 'ticker' AS search, 'au' || n AS query FROM k UNION SELECT 'cik', n FROM k
    UNION SELECT 'cik', lpad(CAST(3 * k AS VARCHAR), 10, '0') FROM k UNION SELECT 'name', 'R#' || lpad(n, 8, '0') FROM k)
  SELECT search, query, cik, ticker, name FROM asked, companies WHERE CASE search WHEN 'ticker' THEN lower(ticker) = lower(query)
    WHEN 'cik' THEN query IN (cik, cik_raw) ELSE contains(lower(name), lower(query)) END"""
SQL["J8_filing_as_of"] = f"""WITH {FILINGS} SELECT cik, filing_date, accession_number, url FROM filings
  WHERE form = '10-Q' AND filing_date <= DATE '1998-06-30' QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, seq) = 1"""
SQL["J8_filings_for_requests"] = f"""WITH {FILINGS}, daily AS (SELECT cik, filing_date, min_by(accession_number, seq) AS accession_number
    FROM filings WHERE form = '10-K' GROUP BY 1, 2),
  requests AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderdate AS DATE) AS as_of, o_orderkey AS request FROM orders)
  SELECT r.cik, r.request, d.filing_date, d.accession_number FROM requests r ASOF LEFT JOIN daily d ON r.cik = d.cik AND r.as_of >= d.filing_date"""
SQL["J9_aligned_amounts"] = f"WITH {COMPARED} SELECT quarter_key, peer_group, schedule_code, count(*) AS items, " + ", ".join(
    f"count(*) FILTER (\"{m}\" <> '—') AS {m}_items" for m in ITEMS
) + " FROM compared GROUP BY 1, 2, 3"
FOUND = FILES + f""", found AS (SELECT DISTINCT year, quarter, schedule_code, code FROM inv),
  wanted AS (SELECT year, quarter, e AS expected FROM (SELECT DISTINCT year, quarter FROM found), (SELECT unnest({listed(dims.EXPECTED_SCHEDULES)}) AS e)),
  missing AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.year = w.year AND f.quarter = w.quarter AND starts_with(f.schedule_code, w.expected)))"""
SQL["J10_missing_schedules"] = f"WITH {FOUND} SELECT year, quarter, expected AS schedule_code FROM missing"
SQL["J11_pending_batch"] = f"WITH {FILES} SELECT filepath, schedule_code FROM ledger WHERE status IN ('pending', 'failed') AND k % 5 <> 0"
SQL["J11_skip_finished"] = f"""WITH {FILES} SELECT year, quarter, count(*) AS files FROM inv
  WHERE filepath NOT IN (SELECT filepath FROM ledger WHERE done) GROUP BY 1, 2"""
SQL["J12_peer_rejection"] = """SELECT CAST(s_suppkey // 2 AS VARCHAR) AS rssd_id, min(s_suppkey) AS seq FROM supplier
  WHERE s_suppkey // 2 <> 3 GROUP BY 1"""

# -- A -------------------------------------------------------------------------------------------------
SQL["A1_base_metrics"] = f"WITH {BASE} SELECT rssd_id, quarter_key, " + ", ".join(f"round({m}, 6) AS {m}" for m in dims.METRIC_CODES) + " FROM base"
SQL["K1_bucketed_metrics"] = SQL["A1_base_metrics"]
SQL["A1_base_metrics_from_wide"] = SQL["A1_base_metrics"]
SQL["A2_total_deposits"] = f"WITH {BASE} SELECT rssd_id, quarter_key, round(total_deposits, 6) AS total_deposits FROM base"


def _metric_columns(*columns: str) -> str:
    return f"WITH {RATIOS} SELECT rssd_id, quarter_key, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns) + " FROM metrics"


SQL["A3_profitability_ratios"] = _metric_columns("roa", "roe", "nim", "efficiency_ratio", "loan_deposit_ratio", "npl_ratio")
SQL["A4_asset_liability_ratios"] = _metric_columns(
    "ir_sensitivity_ratio", "liquid_assets_ratio", "wholesale_funding_ratio", "earning_asset_yield", "cost_of_funds",
    "interest_rate_spread", "fixed_rate_asset_pct", "variable_rate_asset_pct", "interest_rate_gap", "gap_ratio", "deposit_stability_ratio",
)
SQL["A5_balance_sheet_mix"] = _metric_columns("loans_to_assets", "securities_to_assets", "cash_to_assets")
SQL["A6_peer_average"] = f"WITH {MEMBERS}, m AS ({_matrix(_ratio_rows)}) SELECT quarter_key, peer_group, label, {PEER_AVG} FROM m GROUP BY 1, 2, 3"
SQL["A7_peer_statistics"] = f"""WITH {MEMBERS}, m AS ({_matrix(_stat_rows)}),
  p AS (SELECT quarter_key, peer_group, row_ix, max(v) FILTER (ordinal = 0) AS pv FROM m GROUP BY 1, 2, 3)
  SELECT m.quarter_key, m.peer_group, m.row_ix, m.label, round(avg(v), 8) AS mean, round(median(v), 8) AS median,
    round(stddev_pop(v), 8) AS std_dev, round(100.0 * count(*) FILTER (v <= pv) / count(*), 8) AS primary_percentile
  FROM m JOIN p ON p.quarter_key = m.quarter_key AND p.peer_group = m.peer_group AND p.row_ix = m.row_ix GROUP BY 1, 2, 3, 4"""
_ONE_GROUP = "s_suppkey // 11 * 3 + CASE WHEN s_suppkey % 11 = 0 THEN 0 WHEN s_suppkey % 11 < 5 THEN 1 ELSE 2 END", "0"
SQL["A7_one_large_group"] = SQL["A7_peer_statistics"].replace(*_ONE_GROUP)
SQL["A8_amounts_per_schedule"] = f"WITH {LONG} SELECT quarter_key, schedule_code, count(*) AS amounts FROM long GROUP BY 1, 2"
SQL["A9_report_summary"] = f"""WITH {LONG} SELECT quarter_key, schedule_code, coalesce(any_value(sname), schedule_code) AS schedule_name, count(*) AS n_rows,
  count(DISTINCT rssd_id) AS institutions FROM long LEFT JOIN info ON sc = schedule_code GROUP BY 1, 2"""
SQL["A9_comparison_summary"] = f"""WITH {MEMBER_ROWS} SELECT quarter_key, peer_group, ordinal, rssd_id, count(DISTINCT schedule_code) AS schedules,
  count(*) AS n_rows FROM rows GROUP BY 1, 2, 3, 4"""
SQL["A10_file_counts"] = f"""WITH {LONG} SELECT schedule_code || ' ' || quarter_key AS source_file, count(*) AS row_count,
  count(DISTINCT rssd_id) AS institution_count FROM long GROUP BY 1"""
_levels = {"file": "schedule_code || ' ' || quarter_key", "schedule": "schedule_code", "quarter": "quarter_key", "year": "quarter_key[1:4]"}
SQL["A10_distinct_institutions"] = f"WITH {LONG} " + " UNION ALL ".join(
    f"SELECT '{level}' AS level, '{level} ' || {key} AS files, count(DISTINCT rssd_id) AS institutions FROM long GROUP BY 1, 2" for level, key in _levels.items()
) + " UNION ALL SELECT 'all', 'all', count(DISTINCT rssd_id) FROM long"
SQL["A11_ledger_statistics"] = f"""WITH {FILES} SELECT year, quarter, quarter_key, count(*) AS total, count(*) FILTER (done) AS processed
  FROM ledger GROUP BY 1, 2, 3"""
SQL["A11_ledger_totals"] = f"WITH {FILES} SELECT count(*) AS total_files, count(*) FILTER (done) AS processed_files FROM ledger"
SQL["A12_quarter_completeness"] = f"""WITH {FOUND}, n AS (SELECT year, quarter, count(*) AS found_count FROM (SELECT DISTINCT year, quarter, schedule_code FROM found) GROUP BY 1, 2),
  m AS (SELECT year, quarter, string_agg(expected, ',' ORDER BY list_position({listed(dims.EXPECTED_SCHEDULES)}, expected)) AS missing_schedules FROM missing GROUP BY 1, 2)
  SELECT n.year, n.quarter, found_count, 39 AS expected_count, coalesce(missing_schedules, '') AS missing_schedules,
    missing_schedules IS NULL AS is_complete, round(found_count / 39.0::DOUBLE * 100, 6) AS completeness_pct
  FROM n LEFT JOIN m ON m.year = n.year AND m.quarter = n.quarter"""
SQL["A13_files_by_quarter"] = f"WITH {FILES} SELECT quarter_key, filepath, count(*) OVER (PARTITION BY quarter_key) AS files_in_quarter FROM inv"
SQL["A14_available_quarters"] = f"WITH {FILES} SELECT DISTINCT year, quarter, quarter_key FROM inv"
SQL["A15_fact_groups"] = f"""WITH {FACTS} SELECT doc_id, 'CallReport_' || category AS table_name, fact_ix, value,
  count(*) OVER (PARTITION BY doc_id, category) AS n_facts FROM tagged QUALIFY count(*) OVER (PARTITION BY doc_id, category) > 3"""
SQL["A16_table_summary"] = f"""WITH {HTML} SELECT doc_id, table_ix, n_rows, width AS n_cols, true AS has_numbers,
  'Year 2023 vs 2024 | Amount | Share' AS preview, n_rows AS codes FROM widths"""
SQL["A16_section_totals"] = f"""WITH {HTML} SELECT doc_id, CASE table_ix % 4 WHEN 0 THEN 'consolidated balance sheets' WHEN 3 THEN 'deposits'
  ELSE 'segment information' END AS keyword, count(*) AS tables, CAST(sum(n_rows) AS BIGINT) AS total_rows, max(width) AS max_cols FROM widths GROUP BY 1, 2"""
SQL["A17_rows_by_schedule"] = f"WITH {LONG} SELECT schedule_code, count(*) AS n_rows FROM long GROUP BY 1"
SQL["A18_cleaning_statistics"] = f"""WITH {RAW}, s AS (SELECT code, CASE WHEN cell IS NULL OR trim(cell) IN ('', '.', 'NA', 'N/A') THEN 'skipped'
    WHEN upper(trim(cell)) IN ('ND', 'NR', 'CONF') THEN 'withheld' WHEN cell = 'abc' OR cell LIKE '(-%' THEN 'invalid' ELSE 'ok' END AS st FROM raw)
  SELECT code AS mdrm_code, count(*) AS cells, count(*) FILTER (st = 'skipped') AS skipped, count(*) FILTER (st = 'withheld') AS withheld,
    count(*) FILTER (st = 'invalid') AS invalid, count(*) FILTER (st = 'ok') AS ok FROM s GROUP BY 1"""

# -- Q -------------------------------------------------------------------------------------------------
SQL["Q1_quality_report"] = f"""WITH {RAW}, c AS (SELECT quarter_key, count(*) FILTER (ix = 0) AS n_rows, count(DISTINCT id) AS institutions,
    count(cell) FILTER (regexp_matches(code, '^(RCON|RCFD|RIAD|RCFN)')) AS filled_cells,
    count(*) FILTER (regexp_matches(code, '^(RCON|RCFD|RIAD|RCFN)')) AS total FROM raw GROUP BY 1)
  SELECT quarter_key, n_rows, institutions, filled_cells, round(filled_cells / CAST(total AS DOUBLE) * 100, 6) AS density_pct,
    CASE WHEN filled_cells * 10 < total THEN 'Low' ELSE '' END AS issues FROM c"""
SQL["Q1_quality_issues"] = """WITH r AS (SELECT o_orderkey % 4 AS part, o_custkey, CASE o_orderkey % 4 WHEN 1 THEN CAST(o_orderkey % 12 = 1 AS INTEGER)
    WHEN 2 THEN CAST(o_orderkey % 160 = 2 AS INTEGER) ELSE 8 END AS filled FROM orders),
  c AS (SELECT CAST(part AS INTEGER) AS part, count(*) AS n_rows, count(DISTINCT CASE WHEN part <> 3 THEN o_custkey END) AS institutions,
    CAST(sum(filled) AS BIGINT) AS filled_cells, sum(filled) / (8.0::DOUBLE * count(*)) * 100 AS d FROM r GROUP BY 1)
  SELECT part, n_rows, institutions, filled_cells, round(d, 6) AS density_pct, CASE WHEN institutions = 0 THEN 'No valid institution IDs found'
    WHEN d < 1 THEN 'Very low data density: ' || printf('%.1f%%', d) WHEN d < 10 THEN 'Low data density: ' || printf('%.1f%%', d) ELSE '' END AS issues FROM c"""
SQL["Q2_available_ids"] = f"""WITH {RAW} SELECT id AS "IDRSSD", count(*) FILTER (ix = 0) AS n_rows FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
SQL["Q3_peer_validation"] = f"""WITH {MEMBERS}, c AS (SELECT quarter_key, peer_group, any_value(set_size) AS members,
    max(total_assets) FILTER (total_assets > 0) AS largest, min(total_assets) FILTER (total_assets > 0) AS smallest,
    count(*) FILTER (total_assets > 0) AS n FROM members GROUP BY 1, 2)
  SELECT quarter_key, peer_group, members, round(largest, 6) AS largest, round(smallest, 6) AS smallest, members BETWEEN 2 AND 4 AS is_valid,
    CASE WHEN n >= 2 AND largest > smallest * 100 THEN 'large' WHEN n >= 2 AND largest > smallest * 50 THEN 'significant' ELSE 'none' END AS size_warning FROM c"""
SQL["Q3_size_gaps"] = f"""WITH {MEMBERS}, a AS (SELECT quarter_key, peer_group, set_size,
    total_assets * CASE CAST(pid AS BIGINT) % 11 WHEN 2 THEN 60.0::DOUBLE WHEN 7 THEN 500.0::DOUBLE ELSE 1.0::DOUBLE END AS t FROM members),
  c AS (SELECT quarter_key, peer_group, any_value(set_size) AS members, max(t) FILTER (t > 0) AS largest, min(t) FILTER (t > 0) AS smallest,
    count(*) FILTER (t > 0) AS n FROM a GROUP BY 1, 2)
  SELECT quarter_key, peer_group, members, round(largest, 6) AS largest, round(smallest, 6) AS smallest, members BETWEEN 2 AND 4 AS is_valid,
    CASE WHEN n >= 2 AND largest > smallest * 100 THEN 'large' WHEN n >= 2 AND largest > smallest * 50 THEN 'significant' ELSE 'none' END AS size_warning FROM c"""
_rated = " UNION ALL ".join(
    f"SELECT rssd_id, quarter_key, {text(l)} AS label, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM metrics" for l, m in dims.RATIO_TABLE
)
SQL["Q4_ratio_ratings"] = f"WITH {RATIOS}, r AS ({_rated}) SELECT rssd_id, quarter_key, label, metric, round(value, 6) AS value, {_bands('metric', 'value')} AS status FROM r"
SQL["Q5_credit_quality"] = f"""WITH {RATIOS} SELECT rssd_id, quarter_key, round(npl_ratio, 6) AS npl_ratio,
  CASE WHEN npl_ratio < 1 THEN 'Excellent' WHEN npl_ratio < 2 THEN 'Good' ELSE 'Needs Attention' END AS npl_status FROM metrics"""
SQL["Q6_rate_gap"] = f"""WITH {RATIOS} SELECT rssd_id, quarter_key, round(ir_sensitivity_ratio, 6) AS ir_sensitivity_ratio, round(gap_ratio, 6) AS gap_ratio,
  CASE WHEN abs(gap_ratio) > 20 THEN 'high' WHEN abs(gap_ratio) > 10 THEN 'moderate' ELSE 'normal' END AS gap_flag,
  round(earning_asset_yield, 6) AS earning_asset_yield, round(cost_of_funds, 6) AS cost_of_funds FROM metrics"""
SQL["Q7_liquidity_flags"] = f"""WITH {RATIOS} SELECT rssd_id, quarter_key,
  CASE WHEN liquid_assets_ratio < 10 THEN 'low' WHEN liquid_assets_ratio < 20 THEN 'moderate' ELSE 'good' END AS liquidity_flag,
  CASE WHEN wholesale_funding_ratio > 30 THEN 'high' WHEN wholesale_funding_ratio > 20 THEN 'moderate' ELSE 'normal' END AS wholesale_flag,
  CASE WHEN deposit_stability_ratio < 70 THEN 'low' WHEN deposit_stability_ratio < 80 THEN 'moderate' ELSE 'good' END AS stability_flag FROM metrics"""
_bench = " UNION ALL ".join(
    f"SELECT rssd_id, quarter_key, {text(l)} AS label, round(CAST({m} AS DOUBLE), 6) AS value, {text(b)} AS benchmark, {text(n)} AS note FROM metrics"
    for l, m, b, n in dims.BENCHMARKS
)
SQL["Q8_benchmarks"] = f"WITH {RATIOS} {_bench}"

# -- W, O ----------------------------------------------------------------------------------------------
SQL["W1_share_of_largest"] = f"""WITH {BASE}, t AS (SELECT rssd_id, quarter_key, total_assets, max(total_assets) OVER (PARTITION BY quarter_key) AS largest FROM base)
  SELECT rssd_id, quarter_key, round(total_assets, 6) AS total_assets, round(largest, 6) AS largest,
    round(total_assets / nullif(largest, 0) * 100, 6) AS pct_of_largest FROM t"""
SQL["W2_first_reported"] = f"WITH {LONG} SELECT rssd_id, quarter_key, schedule_seq, mdrm_code, round(amount_num, 6) AS value FROM long"
SQL["W3_delimited_sections"] = f"""WITH {DELIMITED}, n AS (SELECT *, sum(CAST(blank OR heads AS INTEGER)) OVER w AS section_no,
    last_value(CASE WHEN heads THEN 'Schedule RC-' || k END IGNORE NULLS) OVER w AS s FROM lines
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, section_no) AS n_lines FROM n WHERE NOT blank)
  SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, coalesce(s, 'Call_Report_Data') AS section,
    'SDF_' || replace(regexp_replace(coalesce(s, 'Call_Report_Data'), '[^\\w\\s]', '', 'g'), ' ', '_')[1:40] || '_' || CAST(section_no AS BIGINT) AS table_name, line_no, n_lines
  FROM c WHERE n_lines >= 2"""
SQL["W4_section_ranges"] = f"""WITH {GRIDS}, n AS (SELECT *, sum(CAST(is_section_header AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY row_ix) AS s FROM report)
  SELECT doc_id, CAST(s AS BIGINT) AS section_no, min(row_ix) AS start_ix, max(row_ix) AS end_ix, min_by(description, row_ix) AS title
  FROM n WHERE s > 0 GROUP BY doc_id, s"""
SQL["W5_carried_schedules"] = f"WITH {PAGES} SELECT doc_id, page_num, schedule_code, title FROM carried"
SQL["W6_table_width"] = f"WITH {HTML} SELECT doc_id, table_ix, n_rows, width AS n_cols, n_rows * width AS padded_cells FROM widths"
_ranks = " UNION ALL ".join(
    f"SELECT quarter_key, peer_group, rssd_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM metrics JOIN peers ON pid = rssd_id"
    for m in ("total_assets", "roa", "npl_ratio")
)
SQL["W7_percentile_ranks"] = f"""WITH {RATIOS}, {PEERS}, r AS ({_ranks}) SELECT quarter_key, peer_group, rssd_id, metric, round(v, 6) AS value,
  round(cume_dist() OVER (PARTITION BY quarter_key, peer_group, metric ORDER BY v) * 100, 6) AS percentile FROM r"""
SQL["W7_one_large_group"] = SQL["W7_percentile_ranks"].replace(*_ONE_GROUP)
SQL["O1_top_items"] = f"""WITH {LONG} SELECT rssd_id, quarter_key, CAST(rk AS INTEGER) AS rank, line_item, description, mdrm_code,
  round(amount_num, 6) AS amount_num FROM (SELECT *, row_number() OVER (PARTITION BY rssd_id, quarter_key ORDER BY amount_num DESC, code_seq) AS rk
    FROM long WHERE schedule_code = 'RC') WHERE rk <= 5"""
SQL["O2_line_item_order"] = f"""WITH {LONG}, i AS (SELECT schedule_code, line_item, count(*) AS n_rows, string_split(line_item, '.') AS p FROM long GROUP BY 1, 2)
  SELECT schedule_code, line_item, n_rows, CASE WHEN line_item <> '' AND len(p) >= 2 THEN 0 ELSE 999 END AS grp,
    CASE WHEN line_item <> '' AND len(p) >= 2 THEN coalesce(TRY_CAST(p[2] AS INTEGER), 999) ELSE 0 END AS main,
    CASE WHEN line_item <> '' AND len(p) >= 3 THEN coalesce(TRY_CAST(p[3] AS INTEGER), 0) ELSE 0 END AS sub,
    CASE WHEN len(p) >= 3 AND TRY_CAST(p[3] AS INTEGER) IS NULL THEN p[3] WHEN len(p) < 2 THEN line_item ELSE '' END AS letter FROM i"""
SQL["O3_ledger_order"] = f"WITH {FILES} SELECT year, quarter, schedule_code, filepath FROM ledger"
SQL["O4_recent_filings"] = f"""WITH {FILINGS} SELECT cik, CAST(rk AS INTEGER) AS rank, filing_date, accession_number FROM
  (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY seq) AS rk FROM filings WHERE form = '8-K') WHERE rk <= 3"""
SQL["O5_latest_quarter"] = f"WITH {FILES} SELECT max(quarter_key) AS quarter_key FROM inv"

# -- U, R ----------------------------------------------------------------------------------------------
SQL["U1_union_of_schedules"] = f"WITH {LONG} SELECT rssd_id, quarter_key, schedule_code, mdrm_code, amount FROM long"
SQL["U2_schedules_in_use"] = f"WITH {MEMBER_ROWS} SELECT DISTINCT quarter_key, peer_group, schedule_code FROM rows"
SQL["U3_expected_minus_found"] = f"""WITH {FOUND} SELECT year, quarter, expected AS schedule_code FROM wanted w
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.year = w.year AND f.quarter = w.quarter AND f.code = w.expected)"""
SECTIONS = f"""WITH {MEMBERS}, m AS ({_matrix(_section_rows)}),
  s AS (SELECT quarter_key, peer_group, section_ix, section, row_ix, label, any_value(set_size) AS set_size, {_shown}, {PEER_AVG} FROM m GROUP BY 1, 2, 3, 4, 5, 6)"""
SQL["R2_metric_sections"] = f"{SECTIONS} SELECT * FROM s"
SQL["R3_comparison"] = f"WITH {COMPARED} SELECT quarter_key, peer_group, schedule_code, line_item, mdrm_code, description, " + ", ".join(
    f"CASE WHEN \"{m}\" = '—' THEN '—' ELSE '9' || \"{m}\" END AS {m}" for m in ITEMS
) + " FROM compared"
SQL["K1_bucketed_comparison"] = SQL["R3_comparison"]
SQL["R4_ratio_table"] = f"""WITH {MEMBERS}, m AS ({_matrix(_ratio_rows)})
  SELECT quarter_key, peer_group, row_ix, label, metric, {_shown}, {PEER_AVG} FROM m GROUP BY 1, 2, 3, 4, 5"""
SQL["R5_dashboard"] = f"""WITH {RATIOS}, {PEERS}, t AS (SELECT metrics.*, peer_group, max(total_assets) OVER (PARTITION BY quarter_key, peer_group) AS largest
    FROM metrics JOIN peers ON pid = rssd_id)
  SELECT rssd_id, quarter_key, peer_group, round(total_assets, 6) AS total_assets, round(total_assets / nullif(largest, 0) * 100, 6) AS pct_of_largest,
    round(npl_ratio, 6) AS npl_ratio, CASE WHEN npl_ratio < 1 THEN 'Excellent' WHEN npl_ratio < 2 THEN 'Good' ELSE 'Needs Attention' END AS npl_status,
    round(ir_sensitivity_ratio, 6) AS ir_sensitivity_ratio, round(gap_ratio, 6) AS gap_ratio,
    CASE WHEN abs(gap_ratio) > 20 THEN 'high' WHEN abs(gap_ratio) > 10 THEN 'moderate' ELSE 'normal' END AS gap_flag,
    round(earning_asset_yield, 6) AS earning_asset_yield, round(cost_of_funds, 6) AS cost_of_funds,
    round(liquid_assets_ratio, 6) AS liquid_assets_ratio,
    CASE WHEN liquid_assets_ratio < 10 THEN 'low' WHEN liquid_assets_ratio < 20 THEN 'moderate' ELSE 'good' END AS liquidity_flag,
    round(wholesale_funding_ratio, 6) AS wholesale_funding_ratio,
    CASE WHEN wholesale_funding_ratio > 30 THEN 'high' WHEN wholesale_funding_ratio > 20 THEN 'moderate' ELSE 'normal' END AS wholesale_flag,
    round(deposit_stability_ratio, 6) AS deposit_stability_ratio,
    CASE WHEN deposit_stability_ratio < 70 THEN 'low' WHEN deposit_stability_ratio < 80 THEN 'moderate' ELSE 'good' END AS stability_flag FROM t"""
SQL["R5_key_metrics"] = f"{SECTIONS} SELECT * EXCLUDE (set_size, peer_4, peer_5) FROM s"

_cell = "SELECT '{t}' AS \"table\", quarter_key, {g} AS peer_group, {r} AS rssd_id, {i} AS item, {m} AS member, round({v}, 6) AS value, {c} AS content FROM {f}"
_metric_cells = _cell.format(t="metrics", g="CAST(NULL AS BIGINT)", r="rssd_id", i="item", m="CAST(NULL AS VARCHAR)", v="v", c="CAST(NULL AS VARCHAR)",
    f="(SELECT rssd_id, quarter_key, CAST(COLUMNS(* EXCLUDE (rssd_id, quarter_key, mix)) AS DOUBLE) FROM metrics)"
      " UNPIVOT INCLUDE NULLS (v FOR item IN (COLUMNS(* EXCLUDE (rssd_id, quarter_key))))")  # fmt: skip


def _member_rows(table: str, item: str, source: str) -> str:
    """A group's members and their average, of rows (quarter_key, peer_group, ordinal, item columns, v)."""
    each = _cell.format(t=table, g="peer_group", r="NULL", i=item, m="CASE ordinal WHEN 0 THEN 'primary' ELSE 'peer_' || ordinal END", v="v", c="NULL", f=source)
    mean = _cell.format(t=table, g="peer_group", r="NULL", i=item, m="'peer_avg'", v="avg(v) FILTER (ordinal > 0)", c="NULL", f=source)
    return f"{each} UNION ALL {mean} GROUP BY quarter_key, peer_group, {item}"


_risk_text = {
    "npl_status": "CASE WHEN npl_ratio < 1 THEN 'Excellent' WHEN npl_ratio < 2 THEN 'Good' ELSE 'Needs Attention' END",
    "gap_flag": "CASE WHEN abs(gap_ratio) > 20 THEN 'high' WHEN abs(gap_ratio) > 10 THEN 'moderate' ELSE 'normal' END",
    "liquidity_flag": "CASE WHEN liquid_assets_ratio < 10 THEN 'low' WHEN liquid_assets_ratio < 20 THEN 'moderate' ELSE 'good' END",
    "wholesale_flag": "CASE WHEN wholesale_funding_ratio > 30 THEN 'high' WHEN wholesale_funding_ratio > 20 THEN 'moderate' ELSE 'normal' END",
    "stability_flag": "CASE WHEN deposit_stability_ratio < 70 THEN 'low' WHEN deposit_stability_ratio < 80 THEN 'moderate' ELSE 'good' END",
}
_risk_numbers = ("npl_ratio", "ir_sensitivity_ratio", "gap_ratio", "earning_asset_yield", "cost_of_funds", "liquid_assets_ratio",
                 "wholesale_funding_ratio", "deposit_stability_ratio")
_risk_cells = " UNION ALL ".join(
    [_cell.format(t="risk_flags", g="NULL", r="rssd_id", i=text(c), m="NULL", v=f"CAST({c} AS DOUBLE)", c="NULL", f="metrics") for c in _risk_numbers]
    + [_cell.format(t="risk_flags", g="NULL", r="rssd_id", i=text(c), m="NULL", v="NULL::DOUBLE", c=e, f="metrics") for c, e in _risk_text.items()]
)
_asset_cells = " UNION ALL ".join(
    _cell.format(t="total_assets", g="peer_group", r="rssd_id", i=text(c), m="NULL", v=e, c="NULL", f="shares")
    for c, e in (("total_assets", "total_assets"), ("pct_of_largest", "total_assets / nullif(largest, 0) * 100"))
)
_status_cells = _cell.format(t="ratios", g="peer_group", r="NULL", i="label", m="'status'", v="NULL::DOUBLE",
    c=f"CASE WHEN set_size = 1 THEN {_bands('metric', 'v')} END", f="ratio_rows WHERE ordinal = 0")
_top_cells = _cell.format(t="top_items", g="NULL", r="rssd_id", i="mdrm_code", m="CAST(rk AS VARCHAR)", v="amount_num", c="line_item", f="top WHERE rk <= 5")
SQL["R5_dashboard_rows"] = f"""WITH {MEMBERS}, ratio_rows AS ({_matrix(_ratio_rows)}),
  shares AS (SELECT metrics.*, peer_group, max(total_assets) OVER (PARTITION BY quarter_key, peer_group) AS largest FROM metrics JOIN peers ON pid = rssd_id),
  top AS (SELECT *, row_number() OVER (PARTITION BY rssd_id, quarter_key ORDER BY amount_num DESC, code_seq) AS rk FROM long WHERE schedule_code = 'RC')
  {_metric_cells} UNION ALL {_asset_cells} UNION ALL {_member_rows('ratios', 'label', 'ratio_rows')} UNION ALL {_status_cells}
  UNION ALL {_risk_cells} UNION ALL {_top_cells}"""
_statistic = {"mean": "avg(v)", "median": "median(v)", "std_dev": "stddev_pop(v)", "primary_percentile": "100.0 * count(*) FILTER (v <= pv) / count(*)"}
_statistic_cells = " UNION ALL ".join(
    _cell.replace("round({v}, 6)", "round({v}, 8)").format(t="statistics", g="peer_group", r="NULL", i="label", m=text(n), v=e, c="NULL", f="stat_rows GROUP BY quarter_key, peer_group, label")
    for n, e in _statistic.items()
)
SQL["R5_key_metric_rows"] = f"""WITH {MEMBERS}, section_rows AS (SELECT *, section || ': ' || label AS title FROM ({_matrix(_section_rows)}) WHERE has),
  stat_rows AS (SELECT *, max(v) FILTER (ordinal = 0) OVER (PARTITION BY quarter_key, peer_group, label) AS pv FROM ({_matrix(_stat_rows)}))
  {_metric_cells} UNION ALL {_member_rows('sections', 'title', 'section_rows')} UNION ALL {_statistic_cells}"""

# -- I -------------------------------------------------------------------------------------------------
NOW = "'2001-01-01 00:00:00'"
_state = """filepath, file_hash, done AS is_processed, CASE WHEN done THEN stamp END AS processed_date, row_count, institution_count,
  stamp AS updated_at, status AS processing_status, err AS error_message, retries AS retry_count, NULL AS last_retry_date"""
SQL["I1_ledger_upsert"] = f"""WITH {FILES}
  SELECT filepath, CASE WHEN k % 5 = 0 THEN file_hash ELSE hash END AS file_hash, done AND NOT fresh AS is_processed,
    CASE WHEN done THEN stamp END AS processed_date, row_count, institution_count,
    CASE WHEN fresh THEN {NOW} ELSE stamp END AS updated_at, CASE WHEN fresh THEN 'pending' ELSE status END AS processing_status,
    err AS error_message, retries AS retry_count, CAST(NULL AS VARCHAR) AS last_retry_date
  FROM (SELECT *, k % 7 = 0 AND k % 5 <> 0 AS fresh FROM ledger)
  UNION ALL SELECT filepath, hash, false, NULL, NULL, NULL, {NOW}, 'pending', NULL, 0, NULL FROM inv WHERE k % 5 = 0"""
SQL["I2_ledger_by_directory"] = f"""WITH {FILES} SELECT filepath, quarter_key, status AS processing_status FROM ledger WHERE starts_with(filepath, '/bulk/1/')"""
SQL["I3_mark_processed"] = f"""WITH {FILES} SELECT filepath, file_hash, done OR status = 'pending' AS is_processed,
  CASE WHEN status = 'pending' THEN {NOW} WHEN done THEN stamp END AS processed_date,
  CASE WHEN status = 'pending' THEN length(filename) ELSE row_count END AS row_count,
  CASE WHEN status = 'pending' THEN 2 ELSE institution_count END AS institution_count,
  CASE WHEN status = 'pending' THEN {NOW} ELSE stamp END AS updated_at, status AS processing_status, err AS error_message,
  retries AS retry_count, CAST(NULL AS VARCHAR) AS last_retry_date FROM ledger"""
SQL["I4_status_transitions"] = f"""WITH {FILES}, t AS (SELECT *, NOT done AS hit, NOT done AND starts_with(schedule_code, 'RC') AS bad FROM ledger)
  SELECT filepath, file_hash, done AS is_processed, CASE WHEN done THEN stamp END AS processed_date, row_count, institution_count,
  CASE WHEN hit THEN {NOW} ELSE stamp END AS updated_at, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS processing_status,
  CASE WHEN bad THEN 'bad file' ELSE err END AS error_message, CAST(retries + CAST(bad AS INTEGER) AS INTEGER) AS retry_count,
  CASE WHEN bad THEN {NOW} END AS last_retry_date FROM t"""
SQL["I5_pending_files"] = f"""WITH {FILES} SELECT filepath, schedule_code, status AS processing_status FROM ledger
  WHERE status <> 'completed' AND quarter_key = '1997-Q2'"""
SQL["I5_failed_files"] = f"WITH {FILES} SELECT filepath, err AS error_message FROM ledger WHERE status = 'failed'"
SQL["I5_status_counts"] = f"""WITH {FILES} SELECT count(*) FILTER (status <> 'completed') AS pending, count(*) FILTER (status = 'failed') AS failed FROM ledger"""
SQL["I6_reset_failed"] = f"""WITH {FILES}, r AS (SELECT *, quarter_key = '1998-Q1' AND status = 'failed' AS hit FROM ledger)
  SELECT year, quarter, CASE WHEN hit THEN 'pending' ELSE status END AS processing_status, count(*) AS files,
    count(CASE WHEN NOT hit THEN err END) AS errors FROM r GROUP BY 1, 2, 3"""
SQL["I7_purge_old"] = f"""WITH {FILES} SELECT filepath, status AS processing_status FROM ledger
  WHERE NOT (done AND o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 1000 DAY)"""
_day = lambda n: f"strftime(TIMESTAMP {NOW} + INTERVAL {n} DAY, '%Y-%m-%d %H:%M:%S')"
SQL["I1_ledger_log"] = f"""WITH {FILES},
  s0 AS (SELECT filepath, filename, schedule_code, quarter_key, file_hash, done, CASE WHEN done THEN stamp END AS done_at, row_count,
    institution_count, stamp AS updated, status, err, retries, CAST(NULL AS VARCHAR) AS retried, k FROM ledger),
  s1 AS (SELECT * EXCLUDE (fresh) REPLACE (CASE WHEN fresh THEN sha256(CAST(k AS VARCHAR)) ELSE file_hash END AS file_hash, done AND NOT fresh AS done,
      CASE WHEN fresh THEN 'pending' ELSE status END AS status, CASE WHEN fresh THEN {_day(0)} ELSE updated END AS updated)
      FROM (SELECT *, k % 7 = 0 AND k % 5 <> 0 AS fresh FROM s0)
    UNION ALL SELECT filepath, filename, schedule_code, quarter_key, hash, false, NULL, NULL, NULL, {_day(0)}, 'pending', NULL, 0, NULL, k
      FROM inv WHERE k % 5 = 0),
  s2 AS (SELECT * EXCLUDE (hit, bad) REPLACE (CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 'bad file' ELSE err END AS err,
      CASE WHEN hit THEN {_day(1)} ELSE updated END AS updated, CAST(retries + CAST(bad AS INTEGER) AS INTEGER) AS retries,
      CASE WHEN bad THEN {_day(1)} END AS retried)
    FROM (SELECT *, status <> 'completed' AS hit, status <> 'completed' AND starts_with(schedule_code, 'RC') AS bad FROM s1)),
  s3 AS (SELECT * EXCLUDE (hit) REPLACE (done OR hit AS done, CASE WHEN hit THEN {_day(2)} ELSE done_at END AS done_at,
      CASE WHEN hit THEN length(filename) ELSE row_count END AS row_count, CASE WHEN hit THEN 2 ELSE institution_count END AS institution_count,
      CASE WHEN hit THEN {_day(2)} ELSE updated END AS updated) FROM (SELECT *, status = 'completed' AND NOT done AS hit FROM s2)),
  s4 AS (SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN NOT hit THEN err END AS err)
    FROM (SELECT *, status = 'failed' AND quarter_key = '1998-Q1' AS hit FROM s3)),
  s5 AS (SELECT * FROM s4 WHERE NOT (done AND CAST(done_at AS TIMESTAMP) < TIMESTAMP {NOW} - INTERVAL 996 DAY))
  SELECT CAST(v AS INTEGER) AS version, filepath, file_hash, done AS is_processed, done_at AS processed_date, row_count, institution_count,
    updated AS updated_at, status AS processing_status, err AS error_message, retries AS retry_count, retried AS last_retry_date
  FROM (SELECT 0 AS v, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3
    UNION ALL SELECT 4, * FROM s4 UNION ALL SELECT 5, * FROM s5)"""
SQL["I8_batch_run"] = f"""WITH {LONG}, f AS (SELECT DISTINCT schedule AS schedule_code, y, q FROM raw JOIN (SELECT DISTINCT supp AS s2, y, q FROM sums) t
    ON t.s2 = raw.supp AND t.y || '-Q' || t.q = raw.quarter_key)
  SELECT CAST(y AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter, f.schedule_code, 'completed' AS processing_status,
    count(*) AS row_count, count(DISTINCT rssd_id) AS institution_count
  FROM f JOIN long ON long.schedule_code = f.schedule_code AND long.quarter_key = y || '-Q' || q GROUP BY 1, 2, 3"""
SQL["I8_batch_retries"] = f"""WITH {LONG}, f AS (SELECT DISTINCT schedule AS schedule_code, quarter_key AS qk FROM raw WHERE schedule IN ('RC', 'RI', 'RCRI')),
  n AS (SELECT schedule_code AS s, quarter_key AS k, count(*) AS n_rows, count(DISTINCT rssd_id) AS ids FROM long WHERE schedule_code <> 'RCRI' GROUP BY 1, 2)
  SELECT CAST(qk[1:4] AS INTEGER) AS year, CAST(qk[7:7] AS INTEGER) AS quarter, schedule_code,
    CASE schedule_code WHEN 'RCRI' THEN 'failed' ELSE 'completed' END AS processing_status,
    CASE schedule_code WHEN 'RCRI' THEN 'no IDRSSD column' END AS error_message, CASE schedule_code WHEN 'RCRI' THEN 2 ELSE 0 END AS retry_count,
    n_rows AS row_count, ids AS institution_count, n_rows AS stored_rows FROM f LEFT JOIN n ON s = schedule_code AND k = qk"""
SQL["stream_new_files"] = f"WITH {LONG} SELECT rssd_id, quarter_key, schedule_code, mdrm_code, line_item, amount FROM long"
SQL["stream_amended_filings"] = f"""WITH {LONG}, again AS (
    SELECT rssd_id, quarter_key, schedule_code, mdrm_code, amount_num, 1 AS batch FROM long WHERE mdrm_code IN ({", ".join(map(text, AMENDED_CODES))})
      AND TRY_CAST(rssd_id AS INTEGER) % 9 = 0
    UNION ALL SELECT DISTINCT id, quarter_key, 'RC', 'RCON9999', CAST(lines AS DOUBLE), 1 FROM raw WHERE TRY_CAST(id AS INTEGER) % 9 = 0),
  now AS (SELECT rssd_id, quarter_key, schedule_code, mdrm_code, amount_num, 0 AS batch FROM long
      WHERE schedule_code = 'RCN' OR schedule_code = 'RC' AND TRY_CAST(rssd_id AS INTEGER) % 9 <> 0
    UNION ALL SELECT * FROM again)
  SELECT rssd_id, quarter_key, schedule_code, count(*) AS cells, sum(amount_num) AS total,
    count(*) FILTER (mdrm_code = 'RCON9999') AS new_cells, CAST(max(batch) AS INTEGER) AS batch FROM now GROUP BY 1, 2, 3"""
