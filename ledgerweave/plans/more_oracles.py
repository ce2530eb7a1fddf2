"""Plain SQL for the queries of `more_queries`, written from the rules."""

from __future__ import annotations

from ledgerweave.plans.oracles import _INVOICE, _JOURNAL, _MESSAGE, _RESOLVE

_NUMBER = r"regexp_replace(CAST(CAST({} AS DECIMAL(18,6)) AS VARCHAR), '\.?0+$', '')"
_ENTRY = """'<LEDGERNAME>' || {0} || '</LEDGERNAME><ISDEEMEDPOSITIVE>' || CASE WHEN {1} THEN 'Yes' ELSE 'No' END || '</ISDEEMEDPOSITIVE><AMOUNT>' ||
  CASE WHEN {1} THEN '-' ELSE '' END || CAST(CAST({2} AS DECIMAL(18,2)) AS VARCHAR) || '</AMOUNT>'"""

_UNITS = f"""
WITH p AS (SELECT p_partkey AS k, 'U&lt;' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_size + 10 AS VARCHAR) || '.5' AS conv FROM part),
units AS (SELECT k + 1 AS row, {_MESSAGE} || '<UNIT NAME="' || name || '" ACTION="Create"><NAME>' || name || '</NAME>' ||
  CASE WHEN k % 3 = 0 THEN '<ISSIMPLEUNIT>No</ISSIMPLEUNIT><BASEUNITS>Pcs</BASEUNITS><ADDITIONALUNITS>Box</ADDITIONALUNITS><CONVERSION>' || conv || '</CONVERSION>'
    ELSE '<ISSIMPLEUNIT>Yes</ISSIMPLEUNIT><DECIMALPLACES>' || CAST(k % 4 AS VARCHAR) || '</DECIMALPLACES>' END || '</UNIT></TALLYMESSAGE>' AS xml FROM p)
"""

# parts of the envelopes with vouchers
_PLACED = "lpad(CAST(first_row AS VARCHAR), 20, '0') AS place, strftime(dl, '%Y%m%d') AS day"
_OUTER = """
  (-1, '', -9, '<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY>'), (99, chr(1114111), 99, '</BODY></ENVELOPE>')"""
_REQUEST = "'<IMPORTDATA><REQUESTDESC><REPORTNAME>{}</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>A &amp; B</SVCURRENTCOMPANY>{}</STATICVARIABLES></REQUESTDESC><REQUESTDATA>'"
_VOUCHERS = f"(6, '', -9, {_REQUEST.format('Vouchers', '')}), (6, chr(1114111), 99, '</REQUESTDATA></IMPORTDATA>')"
_MASTERS = f"(0, '', -9, {_REQUEST.format('All Masters', '<IMPORTDUPS>@@DupModify</IMPORTDUPS>')}), (5, chr(1114111), 99, '</REQUESTDATA></IMPORTDATA>')"
_VOUCHER_ROWS = f"""UNION ALL SELECT ok.chunk, 6, place, -1, 0, 0, {_MESSAGE} || '<VOUCHER VCHTYPE="' || vtype || '" ACTION="Create" OBJVIEW="Accounting Voucher View"><DATE>' || day || '</DATE><EFFECTIVEDATE>' || day ||
  '</EFFECTIVEDATE><VOUCHERTYPENAME>' || vtype || '</VOUCHERTYPENAME><VOUCHERNUMBER>' || voucher_key || '</VOUCHERNUMBER><PARTYLEDGERNAME>' || party || '</PARTYLEDGERNAME>' FROM ok
UNION ALL SELECT ok.chunk, 6, place, 9, 0, 0, '</VOUCHER></TALLYMESSAGE>' FROM ok
UNION ALL SELECT ok.chunk, 6, place, 0, source_row, 0, '<ALLLEDGERENTRIES.LIST>' || {_ENTRY.format('ledger', 'kept.dr', 'amt')} || '</ALLLEDGERENTRIES.LIST>' FROM kept JOIN ok USING (voucher_key)
UNION ALL SELECT ok.chunk, 6, place, 2, first_row, 0, '<ALLLEDGERENTRIES.LIST>' || {_ENTRY.format("'Round Off'", 'ro > 0', 'abs(ro)')} || '</ALLLEDGERENTRIES.LIST>' FROM ok WHERE ro IS NOT NULL"""

ORACLES: dict[str, str] = {
    # a name of n letters that lost one shares 2n - 2 of 2n - 1 letters with itself, and no other part name comes closer
    "did_you_mean": """
WITH k AS (SELECT DISTINCT p_name, substr(p_name, 1, 2) || substr(p_name, 4) AS value FROM part)
SELECT value, min(p_name) AS suggestion, any_value(round(200.0::DOUBLE * (length(p_name) - 1) / (2 * length(p_name) - 1), 4)) AS score
FROM k WHERE value NOT IN (SELECT p_name FROM k) GROUP BY value""",
    # all customers share the first four letters, so the sound block adds no pair
    "resolve_summary": _RESOLVE + "SELECT decision, count(*) AS n FROM verdict GROUP BY decision",
    "delimited_customers": """
SELECT CAST(c_custkey AS VARCHAR) AS "Key", CASE WHEN c_custkey % 3 <> 1 THEN c_name END AS "Name", c_mktsegment AS "Under",
  CASE WHEN c_custkey % 3 <> 0 THEN 'say "' || c_name || '", or; not' END AS "Note" FROM customer""",
    "delimited_encodings": """
SELECT CAST(c_custkey AS VARCHAR) AS "Key", c_name AS "Name", 'Café' || chr(10) || c_name || chr(10) || '"' || c_mktsegment || '", or; not' AS "Note"
FROM customer""",
    "validate_stock_items": """
WITH r AS (SELECT p_partkey AS k, p_partkey + 1 AS source_row, p_brand,
    CASE WHEN p_partkey % 40 = 7 THEN 'long' WHEN p_partkey % 41 = 8 THEN 'twice' WHEN p_partkey % 43 = 9 THEN 'blank' ELSE 'plain' END AS kind FROM part),
b AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0)
SELECT source_row, 'name_too_long' AS code, 'error' AS severity, 'name' AS source_column FROM r WHERE kind = 'long'
UNION ALL SELECT source_row, 'required_missing', 'error', 'name' FROM r WHERE kind = 'blank'
UNION ALL SELECT source_row, 'duplicate_in_file', 'error', 'name' FROM r WHERE kind = 'twice' AND (SELECT count(*) FROM r WHERE kind = 'twice') > 1
UNION ALL SELECT source_row, 'unknown_unit', 'error', 'base_units' FROM r WHERE k % 25 = 3
UNION ALL SELECT source_row, 'required_missing', 'error', 'base_units' FROM r WHERE k % 25 <> 3 AND k % 47 = 10
UNION ALL SELECT source_row, 'value_not_allowed', 'warning', 'parent' FROM r WHERE p_brand NOT IN (SELECT p_brand FROM b)
UNION ALL SELECT source_row, 'bad_hsn', 'warning', 'hsn' FROM r WHERE k % 17 = 4
UNION ALL SELECT source_row, 'bad_decimal', 'warning', 'opening_qty' FROM r WHERE k % 19 = 5""",
    "validate_units": """
SELECT p_partkey + 1 AS source_row, 'bad_unit_name' AS code, 'error' AS severity, 'name' AS source_column FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey + 1, 'bad_decimal', 'warning', 'decimal_places' FROM part WHERE p_partkey % 9 = 1""",
    "validate_suppliers": """
SELECT s_suppkey + 1 AS source_row, 'bad_pan' AS code, 'warning' AS severity, 'pan' AS source_column FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey + 1, 'value_not_allowed', 'warning', 'email' FROM supplier WHERE s_suppkey % 7 = 1
UNION ALL SELECT s_suppkey + 1, 'value_not_allowed', 'warning', 'state' FROM supplier WHERE s_suppkey % 11 = 2
UNION ALL SELECT s_suppkey + 1, 'value_not_allowed', 'warning', 'opening_balance_drcr' FROM supplier WHERE s_suppkey % 13 = 3
UNION ALL SELECT NULL, 'missing_column', 'error', 'parent'""",
    "emit_unit_xml": _UNITS + "SELECT row, xml FROM units",
    "emit_group_xml": f"""
WITH g AS (
  SELECT CAST(r_regionkey AS BIGINT) AS source_row, r_name AS name, 'Primary' AS parent FROM region
  UNION ALL SELECT n_nationkey + 100, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT min(c_custkey) + 1000, n_name || '/' || c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment
  UNION ALL SELECT c_custkey + 1000000000, c_name, n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT source_row AS row, {_MESSAGE} || '<GROUP NAME="' || name || '" ACTION="Create"><NAME>' || name || '</NAME><PARENT>' || parent || '</PARENT>' ||
  CASE WHEN source_row % 2 = 0 THEN '<ISREVENUE>Yes</ISREVENUE>' WHEN source_row % 3 = 0 THEN '<ISREVENUE>No</ISREVENUE>' ELSE '' END || '</GROUP></TALLYMESSAGE>' AS xml FROM g""",
    "emit_renamed_xml": f"""
WITH g AS (SELECT c_custkey AS k, 'Caf&#233; &amp; ' || c_name AS name, c_name FROM customer)
SELECT k AS row, {_MESSAGE} || '<GROUP NAME="' || name || '" ACTION="Alter"><GUID>g' || CAST(k AS VARCHAR) || '</GUID>' ||
  CASE WHEN k % 2 = 0 THEN '<NAME.LIST TYPE="String"><NAME>' || name || '</NAME><NAME>Old ' || c_name || '</NAME></NAME.LIST>' ELSE '<NAME>' || name || '</NAME>' END ||
  '<PARENT>&#8377; Group</PARENT></GROUP></TALLYMESSAGE>' AS xml FROM g""",
    "emit_invoice_xml": _INVOICE + f""", ok AS (SELECT *, k % 70 <> 11 AS has_unit FROM priced WHERE k % 40 <> 9),
texts AS (SELECT *, CASE WHEN has_unit THEN CAST(CAST(cents / 100 AS DECIMAL(18,2)) AS VARCHAR) || '/Nos' ELSE {_NUMBER.format('cents / 100')} END AS rate_text,
    {_NUMBER.format('qty')} || CASE WHEN has_unit THEN ' Nos' ELSE '' END AS qty_text, strftime(d, '%Y%m%d') AS day FROM ok)
SELECT voucher_key, -1 AS part, CAST(0 AS BIGINT) AS row, 0 AS seq, {_MESSAGE} || '<VOUCHER VCHTYPE="Sales" ACTION="Create" OBJVIEW="Invoice Voucher View"><DATE>' || day ||
  '</DATE><EFFECTIVEDATE>' || day || '</EFFECTIVEDATE><VOUCHERTYPENAME>Sales</VOUCHERTYPENAME><VOUCHERNUMBER>' || voucher_key || '</VOUCHERNUMBER>' AS xml FROM texts
UNION ALL SELECT voucher_key, 9, 0, 0, '</VOUCHER></TALLYMESSAGE>' FROM texts
UNION ALL SELECT voucher_key, 0, r * 2 - 1, 0, '<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>Part ' || CAST(p AS VARCHAR) || '</STOCKITEMNAME><ISDEEMEDPOSITIVE>No</ISDEEMEDPOSITIVE><RATE>' ||
  rate_text || '</RATE><AMOUNT>' || CAST(amt AS VARCHAR) || '</AMOUNT><ACTUALQTY>' || qty_text || '</ACTUALQTY><BILLEDQTY>' || qty_text || '</BILLEDQTY><ACCOUNTINGALLOCATIONS.LIST>' ||
  {_ENTRY.format("'Sales'", 'false', 'amt')} || '</ACCOUNTINGALLOCATIONS.LIST></ALLINVENTORYENTRIES.LIST>' FROM texts
UNION ALL SELECT voucher_key, 0, r * 2, 0, '<LEDGERENTRIES.LIST>' || {_ENTRY.format("'Customer'", 'true', 'amt')} || '</LEDGERENTRIES.LIST>' FROM texts""",
    "voucher_envelope": _JOURNAL + f""", ok AS (SELECT *, 0 AS chunk, {_PLACED} FROM judged WHERE blocking IS NULL AND balanced), frames(section, place, part, xml) AS (VALUES {_OUTER}, {_VOUCHERS})
SELECT 0 AS chunk, section, place, part, CAST(0 AS BIGINT) AS row, 0 AS seq, xml FROM frames
""" + _VOUCHER_ROWS,
    # vouchers in the order of their first rows, 200 to an envelope; units go before the vouchers of the first
    "unified_chunks": _UNITS.replace("WITH p", _JOURNAL + ", p", 1) + f""", ok AS (
  SELECT *, CAST((row_number() OVER (ORDER BY first_row) - 1) // 200 AS INTEGER) AS chunk, {_PLACED} FROM judged WHERE blocking IS NULL AND balanced),
frames(section, place, part, xml) AS (VALUES {_OUTER}, {_VOUCHERS}),
mframes(section, place, part, xml) AS (VALUES {_MASTERS})
SELECT chunk, section, place, part, CAST(0 AS BIGINT) AS row, 0 AS seq, xml FROM frames, (SELECT DISTINCT chunk FROM ok)
UNION ALL SELECT 0, section, place, part, 0, 0, xml FROM mframes
UNION ALL SELECT 0, 1, lpad(CAST(row AS VARCHAR), 20, '0'), 0, row, 0, xml FROM units
""" + _VOUCHER_ROWS,
    "unreadable_cells": """
WITH o AS (SELECT o_orderkey % 9 AS m, row_number() OVER () AS r FROM orders)
SELECT r * 2 - 1 AS source_row, CASE WHEN m = 4 THEN 'value_not_allowed' ELSE 'bad_decimal' END AS code, 'error' AS severity,
  CASE m WHEN 1 THEN 'quantity' WHEN 2 THEN 'rate' WHEN 3 THEN 'gst_rate' END AS source_column FROM o WHERE m IN (1, 2, 3, 4)
UNION ALL SELECT r * 2, 'voucher_unbalanced', 'error', 'amount' FROM o WHERE m IN (1, 2, 3, 4)""",
    "vouchers_beside_unreadable_cells": """
WITH o AS (SELECT *, row_number() OVER () AS r FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS voucher_key, r * 2 - 1 AS first_row, CAST(2 AS BIGINT) AS n_lines, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS debit_total
FROM o WHERE o_orderkey % 9 NOT IN (1, 2, 3, 4)""",
    "responses_with_cdata": """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'pushed_partial' ELSE 'pushed' END AS status, CAST(1 AS BIGINT) AS created,
  o_orderkey + 3000000000 AS last_vch_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'bad <' || CAST(o_orderkey AS VARCHAR) || '>' WHEN 1 THEN 'café A ' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS line_errors FROM orders""",
    "profile_shares": """
WITH c AS (SELECT c_custkey, c_name FROM customer), n AS (SELECT count(*)::DOUBLE AS n FROM c),
v(col, x) AS (SELECT 'c_name', lower(c_name) FROM c UNION ALL SELECT 'flag', 'yes' FROM c WHERE c_custkey % 4 <> 0
  UNION ALL SELECT 'mixed', CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'x' END FROM c)
SELECT col AS "column", round(count(*) FILTER (regexp_matches(x, '^[0-9]+$'))::DOUBLE / count(*), 6) AS numeric_share,
  round(count(*) FILTER (x IN ('yes', 'no', 'true', 'false', 'y', 'n', '0', '1'))::DOUBLE / count(*), 6) AS boolish_share,
  round(count(DISTINCT x)::DOUBLE / count(*), 6) AS distinct_share, round(1 - count(*) / any_value(n), 6) AS null_share FROM v, n GROUP BY col""",
    # the longest code of the table that begins the item's own
    "hsn_enrichment": """
WITH p AS (SELECT p_partkey AS k, lpad(CAST(p_partkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS whole FROM part),
i AS (SELECT k, CASE k % 5 WHEN 0 THEN whole WHEN 1 THEN substr(whole, 1, 6) WHEN 2 THEN substr(whole, 1, 4) WHEN 3 THEN substr(whole, 1, 2) END AS code FROM p),
e AS (SELECT substr(whole, 1, CAST(2 + 2 * (k % 4) AS INTEGER)) AS code, min(k % 5 * 6) AS rate FROM p WHERE k % 3 = 0 GROUP BY 1),
r AS (SELECT i.k, e.code, e.rate, row_number() OVER (PARTITION BY i.k ORDER BY length(e.code) DESC NULLS LAST) AS n FROM i LEFT JOIN e ON starts_with(i.code, e.code))
SELECT k + 1 AS source_row, code AS hsn_matched, CAST(rate AS DECIMAL(20,6)) AS hsn_gst_rate, 'HSN ' || code AS hsn_description FROM r WHERE n = 1""",
    "trial_balance": """
WITH c AS (SELECT c_custkey AS k, CAST(c_acctbal AS DECIMAL(20,2)) AS ours,
    CASE WHEN c_custkey % 11 <> 4 THEN CAST(c_acctbal AS DECIMAL(20,2)) + CASE c_custkey % 7 WHEN 3 THEN 1.5 WHEN 5 THEN 0.01 ELSE 0 END END AS theirs FROM customer)
SELECT CASE WHEN theirs IS NULL THEN 'only_ours' WHEN abs(ours - theirs) <= 0.01 THEN 'equal' ELSE 'different' END AS status,
  CASE WHEN theirs IS NULL THEN NULL WHEN k % 9 <> 8 AND k % 5 <> 0 THEN 'code' ELSE 'name' END AS matched_by,
  coalesce(CASE WHEN k % 9 <> 8 THEN CAST(k AS VARCHAR) END, CASE WHEN theirs IS NOT NULL AND k % 5 <> 0 THEN CAST(k AS VARCHAR) END) AS code,
  CAST(ours AS DECIMAL(38,6)) AS our_amount, CAST(theirs AS DECIMAL(38,6)) AS their_amount, CAST(ours - coalesce(theirs, 0) AS DECIMAL(38,6)) AS difference,
  CAST(2 AS BIGINT) AS our_postings, CAST(CASE WHEN theirs IS NULL THEN 0 ELSE 1 END AS BIGINT) AS their_postings FROM c
UNION ALL SELECT 'only_theirs', NULL, 'S' || CAST(s_suppkey AS VARCHAR), NULL, CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS DECIMAL(38,6)),
  CAST(-CAST(s_acctbal AS DECIMAL(20,2)) AS DECIMAL(38,6)), 0, 1 FROM supplier""",
    # the headers are labels or synonyms of their fields, so the scores that count are 1; tests hold all others against a plain version
    "suggest_mapping": """
SELECT * FROM (VALUES
  ('address', false, NULL, 0.0::DOUBLE, 'unmapped', 'fuzzy', 'Under|Ledger Name|Random Notes'),
  ('country', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Under|Random Notes|Opening Bal'),
  ('credit_limit', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Opening Bal|Random Notes|Ledger Name'),
  ('email', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Billwise|Ledger Name|Opening Bal'),
  ('gst_registration_type', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Random Notes|Ledger Name|Opening Bal'),
  ('gstin', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Ledger Name|Random Notes|Under'),
  ('is_billwise', false, 'Billwise', 1.0, 'auto_accept', 'fuzzy', 'Opening Bal|Ledger Name|Random Notes'),
  ('mailing_name', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Ledger Name|Opening Bal|Billwise'),
  ('name', true, 'Ledger Name', 1.0, 'needs_confirm', 'fuzzy', 'Opening Bal|Under|Random Notes'),
  ('opening_balance', false, 'Opening Bal', 1.0, 'auto_accept', 'fuzzy', 'Random Notes|Billwise|Ledger Name'),
  ('opening_balance_drcr', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Opening Bal|Under|Ledger Name'),
  ('pan', false, NULL, round(10 / 18.0, 4), 'unmapped', 'fuzzy', 'Opening Bal|Ledger Name|Under'),
  ('parent', true, 'Under', 1.0, 'needs_confirm', 'fuzzy', 'Ledger Name|Random Notes|Opening Bal'),
  ('phone', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Billwise|Under|Opening Bal'),
  ('pincode', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Under|Opening Bal|Random Notes'),
  ('state', false, NULL, 0.0, 'unmapped', 'fuzzy', 'Billwise|Ledger Name|Opening Bal')
) AS x (target_field, required, source_column, confidence, status, method, alternatives)""",
    # the template names mailing_name, state, and a column that is gone; 'Ledger Name' then feeds two fields
    "overlay_template": """
SELECT * FROM (VALUES
  ('address', NULL, 0.0::DOUBLE, 'unmapped', 'fuzzy', false), ('country', NULL, 0.0, 'unmapped', 'fuzzy', false),
  ('credit_limit', NULL, 0.0, 'unmapped', 'fuzzy', false), ('email', NULL, 0.0, 'unmapped', 'fuzzy', false),
  ('gst_registration_type', NULL, 0.0, 'unmapped', 'fuzzy', false), ('gstin', NULL, 0.0, 'unmapped', 'fuzzy', false),
  ('is_billwise', 'Billwise', 1.0, 'auto_accept', 'fuzzy', false), ('mailing_name', 'Ledger Name', 0.99, 'auto_accept', 'template', true),
  ('name', 'Ledger Name', 1.0, 'needs_confirm', 'fuzzy', true), ('opening_balance', 'Opening Bal', 1.0, 'auto_accept', 'fuzzy', false),
  ('opening_balance_drcr', NULL, 0.0, 'unmapped', 'fuzzy', false), ('pan', NULL, round(10 / 18.0, 4), 'unmapped', 'fuzzy', false),
  ('parent', 'Under', 1.0, 'needs_confirm', 'fuzzy', false), ('phone', NULL, 0.0, 'unmapped', 'fuzzy', false),
  ('pincode', NULL, 0.0, 'unmapped', 'fuzzy', false), ('state', 'Random Notes', 0.99, 'auto_accept', 'template', false)
) AS x (target_field, source_column, confidence, status, method, shared)""",
    # 'opening' is 7 letters of 'opening bal' (11) and all of a synonym of the side field; its values are no numbers, so the balance field loses
    "mapping_plan": """
SELECT * FROM (VALUES
  ('nameless', 'Billwise', 'is_billwise', 1.0::DOUBLE, 'fuzzy'), ('nameless', 'Under', 'parent', 1.0, 'fuzzy'),
  ('plain', 'GSTIN', 'gstin', 1.0, 'fuzzy'), ('plain', 'Ledger Name', 'name', 1.0, 'fuzzy'), ('plain', 'Opening Bal', 'opening_balance', 1.0, 'fuzzy'),
  ('plain', 'Under', 'parent', 1.0, 'fuzzy'), ('twofold', 'Group Name', 'parent', 1.0, 'fuzzy'),
  ('twofold', 'Opening Bal', 'opening_balance_drcr', round(14 / 18.0, 4), 'fuzzy'), ('twofold', 'Party', 'name', 1.0, 'fuzzy'),
  ('twofold', 'Pin Code', 'pincode', 1.0, 'fuzzy')
) AS x (upload, source_column, target_field, confidence, method)""",
    # required fields are never accepted without a look
    "mapping_stats": """
SELECT * FROM (VALUES ('nameless', 1::BIGINT, 1::BIGINT, 1::BIGINT), ('plain', 2, 2, 0), ('twofold', 1, 3, 0)
) AS x (upload, auto_accepted, needs_confirm, unmapped_required)""",
    "mapping_leftovers": """
SELECT * FROM (VALUES ('nameless', 'column', 'Foobar'), ('nameless', 'required', 'name'), ('plain', 'column', 'Random Notes')) AS x (upload, kind, name)""",
}
