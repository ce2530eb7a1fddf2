"""Plain SQL for the queries, written from the rules and not from the Spark code.

Each text runs on the same tables in another engine and must give the same rows.
"""

from __future__ import annotations

# --- sales: tax, party leg, refunds --------------------------------------------------------------
_SALES = """
WITH li AS (SELECT *, row_number() OVER () AS source_row FROM lineitem),
src AS (
  SELECT li.source_row, CAST(l_orderkey AS VARCHAR) AS voucher_key, CAST(o_orderdate AS DATE) AS d, c_name, n_name,
    c_custkey, c_mktsegment, l_returnflag = 'R' AS ret,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amt,
    CAST(CAST(l_tax AS DECIMAL(6,2)) * 100 AS DECIMAL(6,0)) AS rate
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey),
taxed AS (SELECT *, n_name = 'NATION_0' AS intra, CAST(round(amt * rate * CAST(0.01 AS DECIMAL(2,2)), 2) AS DECIMAL(18,2)) AS tax FROM src),
split AS (
  SELECT *, CASE WHEN intra THEN CAST(round(tax * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) ELSE 0 END AS cgst FROM taxed),
hdr AS (
  SELECT voucher_key, min(source_row) AS first_row, any_value(d) AS d, any_value(c_name) AS party,
    bool_or(ret) AS refund, sum(amt + tax) AS total,
    sum(1 + CASE WHEN cgst <> 0 THEN 1 ELSE 0 END + CASE WHEN intra AND tax - cgst <> 0 THEN 1 ELSE 0 END
        + CASE WHEN NOT intra AND tax <> 0 THEN 1 ELSE 0 END) + 1 AS n_lines,
    CASE WHEN any_value(c_mktsegment) = 'MACHINERY' THEN
      lpad(CAST(any_value(c_custkey) % 38 + 1 AS VARCHAR), 2, '0') || 'ABCDE' ||
      lpad(CAST(any_value(c_custkey) % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gstin
  FROM split GROUP BY voucher_key),
legs AS (
  SELECT voucher_key, 0 AS section, source_row, 0 AS seq, 'Sales' AS ledger_name, false AS dr, amt AS amount FROM split
  UNION ALL SELECT voucher_key, 0, source_row, 1, 'Output CGST', false, cgst FROM split WHERE cgst <> 0
  UNION ALL SELECT voucher_key, 0, source_row, 2, 'Output SGST', false, tax - cgst FROM split WHERE intra AND tax - cgst <> 0
  UNION ALL SELECT voucher_key, 0, source_row, 3, 'Output IGST', false, tax FROM split WHERE NOT intra AND tax <> 0
  UNION ALL SELECT voucher_key, 1, first_row, 0, party, true, total FROM hdr),
lines AS (
  SELECT legs.voucher_key, section, legs.source_row, seq, ledger_name, dr <> refund AS is_debit, amount, hdr.d, hdr.party,
    hdr.first_row, hdr.gstin, refund
  FROM legs JOIN hdr USING (voucher_key)),
heads AS (
  SELECT voucher_key, first_row, voucher_key AS reference, CASE WHEN refund THEN 'Credit Note' ELSE 'Sales' END AS voucher_type,
    strftime(d, '%Y-%m-%d') AS date, CASE WHEN refund THEN 'Refund of order ' || voucher_key END AS narration,
    party AS party_ledger, gstin AS party_gstin, CAST(n_lines AS BIGINT) AS n_lines,
    CAST(total AS DOUBLE) AS debit_total, CAST(total AS DOUBLE) AS credit_total
  FROM hdr)
"""

_RETAIL = _SALES + """,
retail AS (SELECT * FROM lines WHERE NOT refund AND gstin IS NULL),
tot AS (SELECT d, ledger_name, is_debit, sum(amount) AS amount FROM retail WHERE ledger_name <> party GROUP BY ALL),
days AS (SELECT d, sum(CASE WHEN is_debit THEN -amount ELSE amount END) AS gap, count(*) AS legs,
    sum(CASE WHEN is_debit THEN 0 ELSE amount END) AS cr, sum(CASE WHEN is_debit THEN amount ELSE 0 END) AS dr FROM tot GROUP BY d)
"""

# --- journals with planted faults ------------------------------------------------------------------
_JOURNAL = """
WITH o AS (SELECT *, row_number() OVER () AS r FROM orders),
base AS (
  SELECT r, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS voucher_key, CAST(o_orderdate AS DATE) AS d, c_name,
    CAST(o_totalprice AS DECIMAL(18,2)) AS total
  FROM o JOIN customer ON o_custkey = c_custkey),
rows AS (
  SELECT r * 2 - 1 AS source_row, k, voucher_key, CASE WHEN k % 13 = 2 THEN NULL ELSE d END AS d, k % 13 = 2 AS bad_date,
    'Journal' AS vtype, c_name AS ledger, true AS dr, total AS amt,
    CASE WHEN k % 23 = 5 THEN 'bad_decimal' WHEN total = 0 THEN 'required_missing' END AS problem, 'debit' AS col, c_name AS party FROM base
  UNION ALL
  SELECT r * 2, k, voucher_key, CASE WHEN k % 13 = 2 THEN NULL WHEN k % 29 = 6 THEN DATE '2001-01-01' ELSE d END, k % 13 = 2,
    CASE WHEN k % 31 = 7 THEN 'Payment' ELSE 'Journal' END, 'Sales', false,
    CASE WHEN k % 11 = 0 THEN total + 5 WHEN k % 11 = 1 THEN total + CAST(0.50 AS DECIMAL(3,2)) ELSE total END,
    CASE WHEN k % 17 = 3 THEN 'ledger' WHEN k % 19 = 4 THEN 'required_missing' END, 'credit',
    CASE WHEN k % 37 = 8 THEN 'Someone else' ELSE c_name END FROM base),
kept AS (SELECT * FROM rows WHERE problem IS NULL),
agg AS (
  SELECT voucher_key, min(source_row) AS first_row, min(d) AS dl, max(d) AS dh, count(DISTINCT vtype) AS nt,
    arg_min(vtype, source_row) AS vtype, arg_min(party, source_row) AS party, count(DISTINCT party) AS np,
    sum(CASE WHEN dr THEN amt ELSE 0 END) AS dr, sum(CASE WHEN dr THEN 0 ELSE amt END) AS cr, count(*) AS n
  FROM kept GROUP BY voucher_key),
closed AS (
  SELECT *, CASE WHEN dr <> cr AND abs(cr - dr) <= 0.99 THEN cr - dr END AS ro FROM agg),
verdict AS (
  SELECT *, dl IS NULL AS no_date, dl <> dh AS two_dates, nt > 1 AS two_types,
    dr + greatest(coalesce(ro, 0), 0) AS debit, cr + greatest(coalesce(-ro, 0), 0) AS credit,
    n + CASE WHEN ro IS NULL THEN 0 ELSE 1 END AS n_lines FROM closed),
judged AS (
  SELECT *, CASE WHEN no_date THEN 'd0' WHEN two_dates THEN 'd2' WHEN two_types THEN 't2' END AS blocking,
    n_lines >= 2 AND debit > 0 AND debit = credit AS balanced FROM verdict)
"""
_JOURNAL_ERRORS = _JOURNAL + """,
found AS (
  SELECT source_row, CASE problem WHEN 'ledger' THEN 'required_missing' ELSE problem END AS code, 'error' AS severity,
    CASE problem WHEN 'ledger' THEN 'ledger_name' ELSE col END AS source_column FROM rows WHERE problem IS NOT NULL
  UNION ALL SELECT source_row, 'bad_date', 'error', 'date' FROM kept WHERE bad_date
  UNION ALL SELECT first_row, CASE blocking WHEN 'd0' THEN 'required_missing' ELSE 'voucher_conflict' END, 'error',
    CASE blocking WHEN 't2' THEN 'voucher_type' ELSE 'date' END FROM judged WHERE blocking IS NOT NULL
  UNION ALL SELECT first_row, 'voucher_conflict', 'warning', 'party_ledger' FROM judged WHERE blocking IS NULL AND np > 1
  UNION ALL SELECT first_row, 'voucher_unbalanced', 'error', 'amount' FROM judged WHERE blocking IS NULL AND NOT balanced)
"""

# --- invoices with stock lines ----------------------------------------------------------------------
_INVOICE = """
WITH li AS (SELECT *, row_number() OVER () AS r FROM lineitem),
base AS (
  SELECT r, l_orderkey AS k, l_partkey AS p, CAST(l_orderkey AS VARCHAR) || '-' || CAST(r AS VARCHAR) AS voucher_key,
    CAST(l_shipdate AS DATE) AS d, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt, CAST(l_quantity AS DECIMAL(10,0)) AS qty FROM li),
priced AS (
  -- price / quantity rounded half up to cents, in whole cents to stay exact
  SELECT *, CAST(floor((2 * CAST(amt * 100 AS BIGINT) + CAST(qty AS BIGINT)) // (2 * CAST(qty AS BIGINT))) AS BIGINT) AS cents FROM base)
"""

# --- ledgers with planted faults ----------------------------------------------------------------------
_LEDGERS = """
WITH rows AS (
  SELECT c_custkey AS k, c_custkey + 1 AS source_row,
    CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN 'Customer#same' ELSE c_name END AS name,
    CASE WHEN c_custkey % 30 = 1 THEN 'MACHINRY' WHEN c_custkey % 61 = 4 THEN NULL ELSE c_mktsegment END AS parent,
    CAST(c_acctbal AS DECIMAL(18,2)) AS bal, c_mktsegment,
    CASE WHEN c_custkey % 40 = 3 THEN 'abc' WHEN c_custkey % 41 = 5 THEN 'paren' ELSE 'plain' END AS kind,
    CASE WHEN c_custkey % 7 = 0 THEN 'BAD' WHEN c_mktsegment = 'MACHINERY' THEN
      lpad(CAST(c_custkey % 38 + 1 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gstin
  FROM customer)
"""
_LEDGER_FINDINGS = _LEDGERS + """,
found AS (
  SELECT source_row, 'required_missing' AS code, 'error' AS severity, 'name' AS source_column, '' AS suggestion FROM rows WHERE name IS NULL
  UNION ALL SELECT source_row, 'required_missing', 'error', 'parent', '' FROM rows WHERE parent IS NULL
  UNION ALL SELECT source_row, 'duplicate_in_file', 'error', 'name', '' FROM rows
    WHERE name IN (SELECT name FROM rows WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1)
  UNION ALL SELECT source_row, 'unknown_group', 'error', 'parent', 'Did you mean ''MACHINERY''?' FROM rows WHERE parent = 'MACHINRY'
  UNION ALL SELECT source_row, 'bad_decimal', 'warning', 'opening_balance', '' FROM rows WHERE kind <> 'plain'
  UNION ALL SELECT source_row, 'bad_decimal', 'warning', 'credit_limit', '' FROM rows WHERE k % 33 = 9
  UNION ALL SELECT source_row, 'bad_gstin', 'warning', 'gstin', '' FROM rows
    WHERE NOT regexp_matches(gstin, '^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$')
  UNION ALL SELECT source_row, 'value_not_allowed', 'warning', 'pincode', '' FROM rows WHERE k % 45 = 2)
"""
_LEDGER_CONVERTED = _LEDGERS + """,
good AS (SELECT *, CASE WHEN k % 33 = 9 THEN NULL ELSE 1000.0 END AS lim,
    CASE WHEN k % 21 = 8 THEN NULL WHEN k % 2 = 0 THEN true ELSE false END AS bill
  FROM rows WHERE name IS NOT NULL AND parent IS NOT NULL AND kind <> 'abc'),
bad AS (
  SELECT source_row, 'required_missing' AS code, 'error' AS severity, CASE WHEN name IS NULL THEN 'name' ELSE 'parent' END AS source_column
    FROM rows WHERE name IS NULL OR parent IS NULL
  UNION ALL SELECT source_row, 'validation_error', 'error', 'name' FROM rows WHERE name IS NOT NULL AND parent IS NOT NULL AND kind = 'abc'
  UNION ALL SELECT source_row, 'bad_decimal', 'error', 'credit_limit' FROM rows WHERE name IS NOT NULL AND parent IS NOT NULL AND k % 33 = 9
  UNION ALL SELECT source_row, 'value_not_allowed', 'error', 'is_billwise' FROM rows WHERE name IS NOT NULL AND parent IS NOT NULL AND k % 21 = 8)
"""

# --- resolution -----------------------------------------------------------------------------------------
_RESOLVE = """
WITH inc AS (
  SELECT c_custkey AS source_row,
    CASE c_custkey % 4 WHEN 0 THEN lower(c_name) WHEN 1 THEN lower(c_name)
      WHEN 2 THEN lower(substr(c_name, 1, 4) || substr(c_name, 6)) ELSE 'vendor ' || CAST(c_custkey AS VARCHAR) END AS name,
    lower(c_mktsegment) AS parent FROM customer),
ex AS (SELECT c_custkey AS ex_id, c_name AS label, lower(c_name) AS name, lower(c_mktsegment) AS parent, 'g' || CAST(c_custkey AS VARCHAR) AS guid FROM customer),
pairs AS (
  SELECT source_row, ex_id, label, guid, ex.name = inc.name AS exact, jaro_winkler_similarity(inc.name, ex.name) AS jw,
    ex.parent = inc.parent AS same_parent
  FROM inc JOIN ex ON substr(inc.name, 1, 4) = substr(ex.name, 1, 4)),
scored AS (SELECT *, round(0.60 * exact::INT + 0.30 * jw + 0.10 * same_parent::INT, 10) AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY score DESC, ex_id) AS rk FROM scored),
top AS (
  SELECT source_row, max(score) FILTER (rk = 1) AS s1, max(score) FILTER (rk = 2) AS s2, max(jw) FILTER (rk = 1) AS jw1,
    bool_or(exact) FILTER (rk = 1) AS exact1, max(label) FILTER (rk = 1) AS matched_name, max(guid) FILTER (rk = 1) AS matched_guid,
    string_agg(guid, '|' ORDER BY rk) FILTER (rk <= 3) AS candidates
  FROM ranked WHERE rk <= 3 GROUP BY source_row),
judged AS (
  SELECT inc.source_row, inc.name, top.*,
    coalesce(s2 >= 0.85 AND round(s1 - s2, 10) < 0.05, false) AS amb FROM inc LEFT JOIN top USING (source_row)),
verdict AS (
  SELECT *, CASE WHEN s1 IS NULL THEN 'create' WHEN (exact1 OR s1 >= 0.95) AND NOT amb THEN 'update'
    WHEN amb OR s1 >= 0.85 OR round(jw1, 10) >= 0.90 THEN 'conflict' ELSE 'create' END AS decision FROM judged)
"""

_RESPONSES = """
WITH r AS (
  SELECT o_orderkey AS job_id,
    CASE WHEN o_orderkey % 41 = 1 THEN 'malformed' WHEN o_orderkey % 43 = 2 THEN 'doctype' ELSE '' END AS rejected FROM orders),
p AS (
  SELECT job_id, rejected, CAST(CASE WHEN rejected = '' THEN job_id % 7 ELSE 0 END AS INT) AS created,
    CAST(CASE WHEN rejected = '' THEN job_id % 3 ELSE 0 END AS INT) AS altered,
    CAST(CASE WHEN rejected = '' AND job_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS errors,
    CAST(CASE WHEN rejected = '' THEN job_id ELSE 0 END AS INT) AS last_master_id,
    CASE WHEN rejected = '' AND job_id % 5 = 0 THEN 'Order ' || CAST(job_id AS VARCHAR) || ' <refused>' ELSE '' END AS line_errors FROM r)
"""

_BODY = """'<CREATED>' || CAST(k % 7 AS VARCHAR) || '</CREATED><altered> ' || CAST(k % 3 AS VARCHAR) || ' </altered><ERRORS>' ||
    CASE WHEN k % 5 = 0 THEN '1' ELSE '0' END || '</ERRORS><LASTMID>' || CAST(k AS VARCHAR) || '</LASTMID>' ||
    CASE WHEN k % 5 = 0 THEN '<LINEERROR>Order ' || CAST(k AS VARCHAR) || ' &lt;refused&gt;</LINEERROR>' ELSE '' END"""

_PROFILE_TAIL = """,
keyed AS (SELECT col, source_row, v, regexp_replace(trim(lower(v)), '\\s+', ' ', 'g') AS key FROM cells WHERE v IS NOT NULL),
vals AS (SELECT * FROM keyed WHERE key <> ''),
per AS (
  SELECT col, count(*) AS n, count(DISTINCT key) AS nd,
    avg(CASE WHEN TRY_CAST(replace(key, ',', '') AS DECIMAL(38,6)) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS num,
    avg(CASE WHEN key IN ('yes','no','true','false','1','0','y','n') THEN 1.0 ELSE 0.0 END) AS boo FROM vals GROUP BY col),
total AS (SELECT count(*) AS t FROM src),
firsts AS (SELECT col, key, min(source_row) AS fr, arg_min(v, source_row) AS v FROM vals GROUP BY col, key),
three AS (SELECT col, fr, v, row_number() OVER (PARTITION BY col ORDER BY fr) AS rk FROM firsts),
samples AS (SELECT col, string_agg(v, '|' ORDER BY rk) AS samples FROM three WHERE rk <= 3 GROUP BY col)
SELECT per.col AS "column", t AS row_count, CAST({ncol} AS INT) AS column_count, n, nd AS n_distinct,
  CASE WHEN boo >= 0.8 THEN 'boolean' WHEN num >= 0.8 THEN 'numeric' ELSE 'string' END AS inferred_type,
  round(1.0::DOUBLE - n::DOUBLE / t, 4) AS null_pct, round(nd::DOUBLE / n, 4) AS distinct_pct,
  nd::DOUBLE / n >= 0.99 AND 1.0::DOUBLE - n::DOUBLE / t <= 0.01 AS is_candidate_key{samples}
FROM per, total{join}
"""


def _unpivot(columns) -> str:
    parts = [f"SELECT '{name}' AS col, source_row, {expr} AS v FROM src" for name, expr in columns.items()]
    return ",\ncells AS (" + "\n UNION ALL ".join(parts) + ")"


_CUSTOMER_PROFILE = (
    "WITH src AS (SELECT *, row_number() OVER () AS source_row FROM customer)"
    + _unpivot({
        "Ledger Name": "c_name", "Under": "c_mktsegment", "Opening Bal": "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)",
        "Billwise": "CASE WHEN c_custkey % 4 <> 0 THEN 'Yes' END", "Random Notes": "CAST(c_nationkey AS VARCHAR)",
    })
    + _PROFILE_TAIL.format(ncol=5, samples=", samples", join=" JOIN samples USING (col)").replace("FROM per, total JOIN", "FROM total, per JOIN")
)
_DOCUMENT_PROFILE = (
    "WITH src AS (SELECT *, row_number() OVER () AS source_row FROM documents)"
    + _unpivot({c: f"CAST({c} AS VARCHAR)" for c in ("doc_id", "text", "lang", "source", "n_chars")})
    + _PROFILE_TAIL.format(ncol=5, samples="", join="")
)

_MESSAGE = "'<TALLYMESSAGE xmlns:UDF=\"TallyUDF\">'"

ORACLES: dict[str, str] = {
    "voucher_lines_gst": _SALES + "SELECT voucher_key, section, source_row, seq, ledger_name, is_debit, CAST(amount AS DOUBLE) AS amount, strftime(d, '%Y-%m-%d') AS date FROM lines",
    "voucher_headers": _SALES + "SELECT * FROM heads",
    "refunds_credit_notes": _SALES + "SELECT * FROM heads WHERE voucher_type = 'Credit Note'",
    "b2c_daily": _RETAIL + """
SELECT 'b2c-' || strftime(d, '%Y-%m-%d') AS voucher_key, strftime(d, '%Y-%m-%d') AS date, ledger_name, is_debit, CAST(amount AS DOUBLE) AS amount FROM tot WHERE amount > 0
UNION ALL SELECT 'b2c-' || strftime(d, '%Y-%m-%d'), strftime(d, '%Y-%m-%d'), 'B2C Sales', gap > 0, CAST(abs(gap) AS DOUBLE) FROM days WHERE gap <> 0""",
    "b2c_daily_headers": _RETAIL + """
SELECT voucher_key, reference, voucher_type, date, party_ledger, n_lines, debit_total FROM heads WHERE voucher_type <> 'Sales' OR party_gstin IS NOT NULL
UNION ALL SELECT 'b2c-' || strftime(d, '%Y-%m-%d'), 'B2C-' || strftime(d, '%Y-%m-%d'), 'Sales', strftime(d, '%Y-%m-%d'), 'B2C Sales',
  CAST(legs + CASE WHEN gap <> 0 THEN 1 ELSE 0 END AS BIGINT), CAST(greatest(dr, cr) AS DOUBLE) FROM days""",
    "control_totals": _SALES + "SELECT count(*) AS vouchers, CAST(sum(n_lines) AS BIGINT) AS voucher_lines, CAST(sum(total) AS DOUBLE) AS debit_total, CAST(sum(total) AS DOUBLE) AS credit_total FROM hdr",
    "preview_100": _SALES + """, first100 AS (SELECT * FROM heads ORDER BY first_row LIMIT 100)
SELECT reference, f.date, voucher_type, party_ledger, debit_total, credit_total, section, source_row, seq, ledger_name,
  CASE WHEN is_debit THEN 'Dr' ELSE 'Cr' END AS dr_cr, CAST(amount AS DOUBLE) AS amount FROM first100 f JOIN lines USING (voucher_key)""",
    "journal_vouchers": _JOURNAL + """
SELECT voucher_key, first_row, voucher_key AS reference, vtype AS voucher_type, strftime(dl, '%Y-%m-%d') AS date, CAST(NULL AS VARCHAR) AS narration,
  party AS party_ledger, CAST(NULL AS VARCHAR) AS party_gstin, CAST(n_lines AS BIGINT) AS n_lines, CAST(debit AS DOUBLE) AS debit_total, CAST(credit AS DOUBLE) AS credit_total
FROM judged WHERE blocking IS NULL AND balanced""",
    "journal_lines": _JOURNAL + """, ok AS (SELECT * FROM judged WHERE blocking IS NULL AND balanced)
SELECT voucher_key, 0 AS section, source_row, 0 AS seq, ledger AS ledger_name, kept.dr AS is_debit, CAST(amt AS DOUBLE) AS amount, strftime(dl, '%Y-%m-%d') AS date
FROM kept JOIN ok USING (voucher_key)
UNION ALL SELECT voucher_key, 2, first_row, 0, 'Round Off', ro > 0, CAST(abs(ro) AS DOUBLE), strftime(dl, '%Y-%m-%d') FROM ok WHERE ro IS NOT NULL""",
    "journal_errors": _JOURNAL_ERRORS + "SELECT * FROM found",
    "journal_error_summary": _JOURNAL_ERRORS + "SELECT code, arg_min(severity, source_row * 2 + CASE WHEN severity = 'error' THEN 0 ELSE 1 END) AS severity, count(*) AS n FROM found GROUP BY code",
    "invoice_lines": _INVOICE + """
SELECT voucher_key, r * 2 - 1 AS source_row, 'Sales' AS ledger_name, false AS is_debit, CAST(amt AS DOUBLE) AS amount, 'Part ' || CAST(p AS VARCHAR) AS stock_item,
  CAST(qty AS DOUBLE) AS quantity, cents / 100 AS rate, CASE WHEN k % 70 <> 11 THEN 'Nos' END AS unit, strftime(d, '%Y-%m-%d') AS date FROM priced WHERE k % 40 <> 9
UNION ALL SELECT voucher_key, r * 2, 'Customer', true, CAST(amt AS DOUBLE), NULL, NULL, NULL, NULL, strftime(d, '%Y-%m-%d') FROM priced WHERE k % 40 <> 9""",
    "invoice_errors": _INVOICE + """
SELECT r * 2 - 1 AS source_row, 'inventory_mismatch' AS code, 'warning' AS severity, 'amount' AS source_column FROM priced
  WHERE k % 40 <> 9 AND abs(cents * CAST(qty AS BIGINT) - CAST(amt * 100 AS BIGINT)) > 1
UNION ALL SELECT r * 2 - 1, 'inventory_mismatch', 'error', 'unit' FROM priced WHERE k % 40 <> 9 AND k % 70 = 11
UNION ALL SELECT r * 2 - 1, 'inventory_mismatch', 'error', 'quantity' FROM priced WHERE k % 40 = 9
UNION ALL SELECT r * 2, 'voucher_unbalanced', 'error', 'amount' FROM priced WHERE k % 40 = 9""",
    "settlements": """
WITH o AS (SELECT *, row_number() OVER () AS r, CAST(o_totalprice AS DECIMAL(18,2)) AS g FROM orders),
f AS (SELECT *, CASE WHEN o_orderkey % 50 = 3 THEN g * 2 ELSE round(g * CAST(0.10 AS DECIMAL(3,2)), 2) END AS a,
    round(g * CAST(0.02 AS DECIMAL(3,2)), 2) AS b, round(g * CAST(0.01 AS DECIMAL(3,2)), 2) AS c FROM o),
ok AS (SELECT *, g - a - b - c AS net FROM f WHERE g > 0 AND o_orderkey % 60 <> 7 AND a + b + c <= g),
legs AS (
  SELECT r, o_orderkey, o_orderdate, 0 AS seq, o_orderpriority AS ledger_name, false AS is_debit, g AS amount FROM ok
  UNION ALL SELECT r, o_orderkey, o_orderdate, 1, 'HDFC Bank', true, net FROM ok
  UNION ALL SELECT r, o_orderkey, o_orderdate, 2, 'Commission', true, a FROM ok
  UNION ALL SELECT r, o_orderkey, o_orderdate, 3, 'Marketplace Fees', true, b FROM ok
  UNION ALL SELECT r, o_orderkey, o_orderdate, 4, 'TCS Receivable', true, c FROM ok)
SELECT CAST(o_orderkey AS VARCHAR) || '@' || CAST(r AS VARCHAR) AS voucher_key, 0 AS section, r AS source_row, seq, ledger_name, is_debit,
  CAST(amount AS DOUBLE) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date FROM legs WHERE amount > 0""",
    "settlement_errors": """
WITH o AS (SELECT *, row_number() OVER () AS r, CAST(o_totalprice AS DECIMAL(18,2)) AS g FROM orders),
f AS (SELECT *, CASE WHEN o_orderkey % 50 = 3 THEN g * 2 ELSE round(g * CAST(0.10 AS DECIMAL(3,2)), 2) END
    + round(g * CAST(0.02 AS DECIMAL(3,2)), 2) + round(g * CAST(0.01 AS DECIMAL(3,2)), 2) AS fees FROM o)
SELECT r AS source_row, CASE WHEN g <= 0 OR o_orderkey % 60 = 7 THEN 'required_missing' ELSE 'validation_error' END AS code, 'error' AS severity,
  CASE WHEN g <= 0 THEN 'amount' WHEN o_orderkey % 60 = 7 THEN 'date' ELSE 'amount' END AS source_column
FROM f WHERE g <= 0 OR o_orderkey % 60 = 7 OR fees > g""",
    "cutover_opening_balances": """
WITH src AS (
  SELECT c_mktsegment AS ledger, c_name AS party, CAST(o_totalprice AS DECIMAL(18,2)) AS amt, o_orderkey % 3 = 0 AS dr,
    o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey % 90 <> 5 AS counted FROM orders JOIN customer ON o_custkey = c_custkey),
post AS (
  SELECT ledger AS name, CASE WHEN dr THEN amt ELSE -amt END AS ch, false AS party FROM src WHERE counted
  UNION ALL SELECT party, CASE WHEN NOT counted THEN 0 WHEN dr THEN -amt ELSE amt END, true FROM src),
net AS (SELECT name, sum(ch) AS net, bool_or(party) AS party FROM post GROUP BY name HAVING sum(ch) <> 0)
SELECT name, CASE WHEN party THEN 'Sundry Debtors' ELSE 'Primary' END AS parent, CAST(abs(net) AS DOUBLE) AS opening_balance, net > 0 AS opening_is_debit FROM net""",
    "cutover_split": """
SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'before' ELSE 'after' END AS part, count(*) AS n,
  CAST(sum(CASE WHEN o_orderkey % 90 <> 5 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "coerce_amounts": """
WITH b AS (SELECT c_custkey, c_custkey % 9 AS m, abs(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer)
SELECT c_custkey, CAST(CASE WHEN m IN (6, 7) THEN NULL WHEN m IN (1, 5) THEN -v ELSE v END AS DOUBLE) AS amount, m = 6 AS bad,
  CASE WHEN m IN (2, 6, 7) THEN false WHEN m IN (1, 5) THEN v = 0 ELSE true END AS is_debit FROM b""",
    "coerce_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 8 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 10 = 8 AS bad FROM orders",
    "gst_components": """
WITH s(i, name) AS (VALUES (1,'Jammu and Kashmir'),(2,'Himachal Pradesh'),(3,'Punjab'),(4,'Chandigarh'),(5,'Uttarakhand'),(6,'Haryana'),(7,'Delhi'),(8,'Rajasthan'),
  (9,'Uttar Pradesh'),(10,'Bihar'),(11,'Sikkim'),(12,'Arunachal Pradesh'),(13,'Nagaland'),(14,'Manipur'),(15,'Mizoram'),(16,'Tripura'),(17,'Meghalaya'),(18,'Assam'),
  (19,'West Bengal'),(20,'Jharkhand'),(21,'Odisha'),(22,'Chhattisgarh'),(23,'Madhya Pradesh'),(24,'Gujarat'),(25,'Daman and Diu'),(26,'Dadra and Nagar Haveli'),
  (27,'Maharashtra'),(28,'Andhra Pradesh'),(29,'Karnataka'),(30,'Goa'),(31,'Lakshadweep'),(32,'Kerala'),(33,'Tamil Nadu'),(34,'Puducherry'),
  (35,'Andaman and Nicobar Islands'),(36,'Telangana'),(37,'Andhra Pradesh'),(38,'Ladakh')),
b AS (SELECT name AS buyer, 'Maharashtra' AS home, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(CAST(l_tax AS DECIMAL(6,2)) * 100 AS DECIMAL(6,0)) * CAST(0.01 AS DECIMAL(2,2)), 2) AS DECIMAL(18,2)) AS tax
  FROM lineitem JOIN s ON l_suppkey % 38 + 1 = i),
c AS (SELECT *, buyer = home AS intra, CASE WHEN buyer = home THEN CAST(round(tax * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) ELSE 0 END AS cgst FROM b)
SELECT buyer, home, intra, count(*) AS n, CAST(sum(amt) AS DOUBLE) AS taxable, CAST(sum(cgst) AS DOUBLE) AS cgst,
  CAST(sum(CASE WHEN intra THEN tax - cgst ELSE 0 END) AS DOUBLE) AS sgst, CAST(sum(CASE WHEN intra THEN 0 ELSE tax END) AS DOUBLE) AS igst,
  CAST(sum(CASE WHEN intra THEN (cgst <> 0)::INT + (tax - cgst <> 0)::INT ELSE (tax <> 0)::INT END) AS BIGINT) AS legs
FROM c GROUP BY buyer, home, intra""",
    "profile_customer": _CUSTOMER_PROFILE,
    "profile_documents": _DOCUMENT_PROFILE,
    "apply_mapping": """
SELECT row_number() OVER () AS source_row, c_name AS name, c_mktsegment AS parent, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS opening_balance,
  c_name AS mailing_name, 'India' AS country, 'Dr' AS opening_balance_drcr FROM customer""",
    "best_template": """
WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS upload, c_nationkey AS org,
    list_filter(['Name', CASE WHEN c_custkey % 2 = 0 THEN 'Group' END, CASE WHEN c_custkey % 3 = 0 THEN 'Opening' END, CASE WHEN c_custkey % 5 = 0 THEN 'State' END], lambda x: x IS NOT NULL) AS cols FROM customer),
t(name, wanted) AS (VALUES ('b full', ['Name','Group','Opening']), ('a pair', ['Name','Group']), ('c wide', ['Name','State','Opening','Group','Pan'])),
s AS (SELECT upload, name, len(list_intersect(wanted, cols))::DOUBLE / len(wanted) AS score FROM u JOIN nation ON org = n_nationkey, t),
r AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY score DESC, name) AS rk FROM s WHERE score >= 0.6)
SELECT upload, name, round(score, 4) AS score FROM r WHERE rk = 1""",
    "upsert_templates": """
WITH old AS (SELECT CAST(c_custkey AS VARCHAR) AS template_id, CAST(c_nationkey AS VARCHAR) AS org_id, c_name AS name, 'Old' AS mapped_name, 1 AS n_mapping, 1 AS n_constants, 'Old' AS source_columns, c_custkey AS k FROM customer),
after AS (
  SELECT template_id, org_id, name, mapped_name, n_mapping, n_constants, source_columns FROM old WHERE NOT (k % 3 = 0 AND k % 2 = 1)
  UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'n' ELSE '' END || CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR),
    c_name || CASE WHEN c_custkey % 2 = 0 THEN ' new' ELSE '' END, c_mktsegment, 1, 0, c_mktsegment || '|x' FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM after WHERE NOT (org_id = '1' AND template_id = '1')""",
    "validate_ledgers": _LEDGER_FINDINGS + "SELECT * FROM found",
    "error_summary": _LEDGER_FINDINGS + "SELECT code, any_value(severity) AS severity, count(*) AS n, any_value(suggestion) AS suggestion FROM found GROUP BY code",
    "error_counts": _LEDGER_FINDINGS + "SELECT count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count, count(*) FILTER (severity = 'error') = 0 AS ok FROM found",
    "resolve_customers": _RESOLVE + """
SELECT source_row, decision, CASE decision WHEN 'update' THEN 'Alter' WHEN 'create' THEN 'Create' END AS action, matched_name, matched_guid,
  round(coalesce(s1, 0.0::DOUBLE), 4) AS score, coalesce(candidates, '') AS candidates FROM verdict""",
    "apply_verdicts": _RESOLVE + """
SELECT source_row, decision = 'conflict' AS held, CASE decision WHEN 'update' THEN 'Alter' WHEN 'create' THEN 'Create' END AS _action,
  CASE decision WHEN 'update' THEN matched_guid END AS guid, CAST(NULL AS VARCHAR) AS old_name FROM verdict""",
    "ordered_groups": """
WITH RECURSIVE g AS (
  SELECT lower(r_name) AS name, 'primary' AS parent FROM region
  UNION ALL SELECT lower(n_name), lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT lower(n_name || '/' || c_mktsegment), lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT lower(c_name), lower(n_name || '/' || c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (
  SELECT name, 0 AS depth, name AS path FROM g WHERE parent = 'primary'
  UNION ALL SELECT g.name, t.depth + 1, t.path || '>' || g.name FROM g JOIN t ON g.parent = t.name)
SELECT name AS name_key, depth, path FROM t""",
    "group_cycles": """
WITH n AS (SELECT max(c_custkey) AS top FROM customer)
SELECT c_custkey AS source_row, 'group ' || CAST(c_custkey AS VARCHAR) AS name_key FROM customer, n
WHERE (c_custkey // 10) % 10 = 0 AND (c_custkey // 10) * 10 + 9 <= top""",
    "convert_ledgers": _LEDGER_CONVERTED + """
SELECT source_row, trim(name) AS name, 'Create' AS action, parent, CAST(abs(bal) AS DOUBLE) AS opening_balance, bal >= 0 AS opening_is_debit, gstin,
  CASE WHEN k % 45 = 2 THEN '12a' ELSE '560068' END AS pincode, 'India' AS country, coalesce(bill, false) AS is_billwise, CAST(lim AS DOUBLE) AS credit_limit FROM good""",
    "convert_ledger_errors": _LEDGER_CONVERTED + "SELECT * FROM bad",
    "conversion_counts": _LEDGER_CONVERTED + """
SELECT (SELECT count(*) FROM good) AS generated, CAST(0 AS BIGINT) AS held, (SELECT count(*) FROM rows) - (SELECT count(*) FROM good) AS skipped,
  (SELECT count(*) FROM bad) AS errors, true AS ok""",
    "convert_stock_items": """
SELECT p_partkey + 1 AS source_row, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE 'Primary' END AS parent,
  'Nos' AS base_units, CAST(p_partkey % 90000000 + 1000 AS VARCHAR) AS hsn_code, CAST(p_size AS DOUBLE) AS opening_qty, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS opening_rate,
  CASE WHEN p_partkey % 30 = 1 THEN NULL ELSE CAST(p_size * CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS opening_value, p_partkey % 2 = 0 AS gst_applicable
FROM part WHERE p_partkey % 25 <> 3""",
    "convert_units": """
SELECT p_partkey + 1 AS source_row, 'U' || CAST(p_partkey AS VARCHAR) AS name, p_partkey % 3 <> 0 AS is_simple, CAST(p_partkey % 4 AS INT) AS decimal_places,
  CASE WHEN p_partkey % 3 = 0 THEN 'Pcs' END AS base_units, CASE WHEN p_partkey % 3 = 0 THEN 'Box' END AS additional_units,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS conversion FROM part""",
    "convert_groups": """
WITH g AS (
  SELECT CAST(r_regionkey AS BIGINT) AS source_row, r_name AS name, 'Primary' AS parent FROM region
  UNION ALL SELECT n_nationkey + 100, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT min(c_custkey) + 1000, n_name || '/' || c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment
  UNION ALL SELECT c_custkey + 1000000000, c_name, n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT source_row, name, parent, source_row % 2 = 0 AS is_revenue FROM g""",
    "emit_ledger_xml": _LEDGER_CONVERTED + f"""
SELECT source_row AS row, {_MESSAGE} || '<LEDGER NAME="' || name || '" ACTION="Create"><NAME>' || name || '</NAME><PARENT>' || parent || '</PARENT>' ||
  CASE WHEN bill THEN '<ISBILLWISEON>Yes</ISBILLWISEON>' WHEN NOT bill THEN '<ISBILLWISEON>No</ISBILLWISEON>' ELSE '' END ||
  coalesce('<PARTYGSTIN>' || gstin || '</PARTYGSTIN>', '') || '<COUNTRYNAME>India</COUNTRYNAME><OPENINGBALANCE>' ||
  CAST(bal AS VARCHAR) || '</OPENINGBALANCE><PINCODE>' || CASE WHEN k % 45 = 2 THEN '12a' ELSE '560068' END || '</PINCODE>' ||
  CASE WHEN lim IS NULL THEN '' ELSE '<CREDITLIMIT>1000.00</CREDITLIMIT>' END || '</LEDGER></TALLYMESSAGE>' AS xml FROM good""",
    "emit_stock_item_xml": f"""
WITH p AS (SELECT *, p_partkey AS k, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part WHERE p_partkey % 25 <> 3)
SELECT k + 1 AS row, {_MESSAGE} || '<STOCKITEM NAME="' || name || '" ACTION="Create"><NAME>' || name || '</NAME>' ||
  CASE WHEN k % 4 <> 0 THEN '<PARENT>' || p_brand || '</PARENT>' ELSE '' END || '<BASEUNITS>Nos</BASEUNITS><HSNCODE>' || CAST(k % 90000000 + 1000 AS VARCHAR) || '</HSNCODE>' ||
  CASE WHEN k % 2 = 0 THEN '<GSTAPPLICABLE>&#4; Applicable</GSTAPPLICABLE><GSTTYPEOFSUPPLY>Goods</GSTTYPEOFSUPPLY>' ELSE '<GSTAPPLICABLE>&#4; Not Applicable</GSTAPPLICABLE>' END ||
  '<OPENINGBALANCE>' || CAST(p_size AS VARCHAR) || ' Nos</OPENINGBALANCE><OPENINGRATE>' || CAST(price AS VARCHAR) || '/Nos</OPENINGRATE>' ||
  CASE WHEN k % 30 = 1 THEN '' ELSE '<OPENINGVALUE>' || CAST(CAST(p_size * price AS DECIMAL(18,2)) AS VARCHAR) || '</OPENINGVALUE>' END || '</STOCKITEM></TALLYMESSAGE>' AS xml FROM p""",
    "emit_voucher_xml": _SALES + f"""
SELECT voucher_key, -1 AS part, CAST(0 AS BIGINT) AS row, 0 AS seq, {_MESSAGE} || '<VOUCHER VCHTYPE="' || voucher_type || '" ACTION="Create" OBJVIEW="Accounting Voucher View"><DATE>' ||
  replace(date, '-', '') || '</DATE><EFFECTIVEDATE>' || replace(date, '-', '') || '</EFFECTIVEDATE><VOUCHERTYPENAME>' || voucher_type || '</VOUCHERTYPENAME><VOUCHERNUMBER>' ||
  reference || '</VOUCHERNUMBER><PARTYLEDGERNAME>' || party_ledger || '</PARTYLEDGERNAME>' || coalesce('<NARRATION>' || narration || '</NARRATION>', '') AS xml FROM heads
UNION ALL SELECT voucher_key, 9, 0, 0, '</VOUCHER></TALLYMESSAGE>' FROM heads
UNION ALL SELECT voucher_key, section, source_row, seq, '<ALLLEDGERENTRIES.LIST><LEDGERNAME>' || ledger_name || '</LEDGERNAME><ISDEEMEDPOSITIVE>' ||
  CASE WHEN is_debit THEN 'Yes' ELSE 'No' END || '</ISDEEMEDPOSITIVE><AMOUNT>' || CASE WHEN is_debit THEN '-' ELSE '' END || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) ||
  '</AMOUNT></ALLLEDGERENTRIES.LIST>' FROM lines""",
    "parse_responses": _RESPONSES + "SELECT * FROM p",
    "import_outcome": _RESPONSES + """,
q AS (SELECT *, rejected = '' AND errors = 0 AND line_errors = '' AS good FROM p)
SELECT CASE WHEN good THEN 'pushed' WHEN created + altered = 0 THEN 'push_failed' ELSE 'pushed_partial' END AS status, count(*) AS n,
  count(*) FILTER (good) AS n_success FROM q GROUP BY 1""",
    "pending_artifacts": "SELECT o_orderkey AS job_id, o_orderkey % 3 <> 1 AS intact FROM orders WHERE o_orderkey % 7 <> 0",
    "stage_records": """
SELECT 'org' || CAST(user_id % 3 AS VARCHAR) AS org_id, event_type AS job_id, CAST(event_id AS VARCHAR) AS order_id,
  '{"order_id":"' || CAST(event_id AS VARCHAR) || '","event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user_id":"' ||
  CAST(user_id AS VARCHAR) || '","ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '"}' AS data, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events""",
    "tenant_scan": "SELECT 'org1' AS org_id, event_type AS job_id, count(*) AS n FROM events WHERE user_id % 3 = 1 GROUP BY event_type",
    "expire_staged": """
SELECT count(*) FILTER (date_trunc('second', ts) >= TIMESTAMP '2024-01-11 00:00:00') AS kept,
  count(*) FILTER (date_trunc('second', ts) < TIMESTAMP '2024-01-11 00:00:00') AS deleted FROM events""",
}
