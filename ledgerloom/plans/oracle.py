"""SQL twins of the registered queries, for DuckDB over the same tables.

Common parts are named CTEs; each query lists those it needs, in order.
"""

from __future__ import annotations

from ledgerloom.functions.text import BELOW_TWENTY, TENS


def r2(x: str) -> str:
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def company_of(k: str) -> str:
    return f"(CASE WHEN {k} % 3 = 0 THEN 0 ELSE {k} // 15 END)"


def digits(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


def supplier_phone(k: str) -> str:
    return f"('9' || {digits(f'(({k}) * 7919) % 1000000000', 9)})"


def number(x: str) -> str:
    """Finite number, NaN or NULL of a stripped text."""
    pattern = (
        "[+-]?([0-9]+(_[0-9]+)*(\\.([0-9]+(_[0-9]+)*)?)?|\\.[0-9]+(_[0-9]+)*)"
        "([eE][+-]?[0-9]+(_[0-9]+)*)?"
    )
    return (
        f"(CASE WHEN regexp_full_match({x}, '{pattern}') "
        f"THEN TRY_CAST(replace({x}, '_', '') AS DOUBLE) "
        f"WHEN lower({x}) IN ('nan', '+nan', '-nan') THEN CAST('nan' AS DOUBLE) END)"
    )


def label(kind: str, ts: str, num: str) -> str:
    short = f"(year({ts}) % 100)"
    return (
        f"(CASE WHEN {kind} = 'Invoice' THEN 'INV' ELSE 'EST' END || '-' || "
        f"CASE WHEN month({ts}) > 3 THEN concat({short}, '/', {short} + 1) "
        f"ELSE concat({short} - 1, '/', {short}) END || "
        f"format('-{{:02d}}-{{:06d}}', month({ts}), {num}))"
    )


def issue_label(kind: str, ts: str, num: str) -> str:
    start = f"(year({ts}) - CASE WHEN month({ts}) < 4 THEN 1 ELSE 0 END)"
    return (
        f"(CASE WHEN {kind} = 'Invoice' THEN 'INV' ELSE 'EST' END || "
        f"format('-{{:02d}}/{{:02d}}-{{:02d}}-{{:06d}}', {start} % 100, ({start} + 1) % 100, "
        f"month({ts}), {num}))"
    )


def issue_date(kind: str, ts: str) -> str:
    return (
        f"CASE WHEN {kind} = 'Invoice' THEN strftime({ts}, '%d-%m-%Y') "
        f"ELSE strftime({ts}, '%d/%m/%Y') END"
    )


def inr(x: str) -> str:
    return f"CASE WHEN {x} <> 0 THEN format('₹{{:,.2f}}', CAST({x} AS DOUBLE)) END"


def join_blank(sep: str, *parts: str) -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"nullif({p}, '')" for p in parts) + ")"


def address(p: str) -> str:
    names = "addrBnm addrBno addrFlno addrSt addrLoc addrDist addrPncd addrState"
    return join_blank(" ", *[p + n for n in names.split()])


def phones(p: str) -> str:
    return join_blank(", ", p + "phno1", p + "phno2")


_SMALL = list(BELOW_TWENTY)
for _ten in TENS:
    _SMALL += [_ten] + [f"{_ten}-{u}" for u in BELOW_TWENTY[1:10]]
SMALL = "[" + ", ".join(f"'{w}'" for w in _SMALL) + "]"


def words(n: str) -> str:
    """Whole rupees in words by list concatenation of the non-empty groups."""
    def small(x: str) -> str:
        return f"{SMALL}[CAST({x} AS INTEGER) + 1]"

    def number_words(n: str, crore_levels: int) -> str:
        groups = []
        if crore_levels:
            crore = f"({n} // 10000000)"
            groups.append(
                f"CASE WHEN {crore} > 0 THEN {number_words(crore, crore_levels - 1)} || ' Crore' END"
            )
        for size, mod, name in ((100000, 100, "Lakh"), (1000, 100, "Thousand"), (100, 10, "Hundred")):
            part = f"({n} // {size} % {mod})"
            groups.append(f"CASE WHEN {part} > 0 THEN {small(part)} || ' {name}' END")
        high = "concat_ws(', ', " + ", ".join(groups) + ")"
        return (
            f"(CASE WHEN {n} < 100 THEN {small(f'{n} % 100')} "
            f"WHEN {n} % 100 > 0 THEN {high} || ' And ' || {small(f'{n} % 100')} ELSE {high} END)"
        )

    return (
        f"({number_words(n, 2)} "
        f"|| CASE WHEN {n} = 1 THEN ' Rupee' ELSE ' Rupees' END || ', Zero Paise Only')"
    )


CTES: dict[str, str] = {}

CTES["places"] = """
SELECT n_nationkey, n_name AS dist, r_name AS state
FROM nation JOIN region ON n_regionkey = r_regionkey"""

CTES["companies"] = f"""
SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS addrBnm,
  CAST(s_suppkey % 200 + 1 AS VARCHAR) AS addrBno,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Floor ' || (s_suppkey % 9) END AS addrFlno,
  'Street ' || (s_suppkey % 40) AS addrSt, 'Locality ' || (s_suppkey % 25) AS addrLoc,
  dist AS addrDist, state AS addrState,
  {digits('100000 + (s_suppkey % 1000003) * 104729 % 900000', 6)} AS addrPncd,
  {supplier_phone('s_suppkey')} AS phno1,
  CASE WHEN s_suppkey % 4 = 0 THEN {supplier_phone('s_suppkey + 1')} END AS phno2,
  CASE WHEN s_suppkey % 5 <> 0 THEN 's' || s_suppkey || '@example.com' END AS email,
  CASE WHEN s_suppkey % 2 = 0 THEN 'www.s' || s_suppkey || '.example' END AS website,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || {digits('s_suppkey', 14)} END AS gstin,
  s_name AS bnkAcnm,
  CASE WHEN s_suppkey % 6 <> 0 THEN {digits('s_suppkey * 37', 12)} END AS bnkAcno,
  'Bank ' || (s_suppkey % 9) AS bnkNm, 'BANK0' || {digits('s_suppkey % 1000000', 6)} AS bnkIfsc,
  CASE WHEN s_suppkey % 2 = 0 THEN 'NET 30' END AS custTerms, s_suppkey AS created_by
FROM supplier JOIN places ON s_nationkey = n_nationkey"""

CTES["users"] = f"""
SELECT s_suppkey AS id, s_name AS username,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'u' || s_suppkey || '@example.com' END AS email,
  CASE WHEN s_suppkey % 3 <> 0 THEN {supplier_phone('s_suppkey')} END AS phno,
  'admin' AS type, CASE WHEN s_suppkey % 10 <> 9 THEN s_suppkey END AS company_id
FROM supplier"""

CTES["clients"] = f"""
SELECT c_custkey AS id, c_name AS name,
  CASE WHEN c_custkey % 7 <> 0 THEN
    CAST(5000000000 + ((c_custkey % 1000003) * 7919000003) % 5000000000 AS VARCHAR) END AS phno1,
  CASE WHEN c_custkey % 5 = 0 THEN {supplier_phone('c_custkey')} END AS phno2,
  CASE WHEN c_custkey % 4 <> 0 THEN 'C' || {digits('c_custkey', 14)} END AS gstin,
  CAST(NULL AS VARCHAR) AS addrBnm, CAST(c_custkey % 500 + 1 AS VARCHAR) AS addrBno,
  CASE WHEN c_custkey % 6 = 0 THEN 'Floor ' || (c_custkey % 7) END AS addrFlno,
  'Street ' || (c_custkey % 50) AS addrSt, c_mktsegment AS addrLoc, dist AS addrDist,
  state AS addrState, {digits('(c_custkey % 1000003) * 104729 % 1000000', 6)} AS addrPncd,
  {company_of('c_custkey')} AS company_id,
  CASE WHEN c_custkey % 17 = 0 THEN -1 ELSE {company_of('c_custkey')} END AS added_by,
  strftime(DATE '1995-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') || ' 00:00:00'
    AS added_at
FROM customer JOIN places ON c_nationkey = n_nationkey"""

CTES["bills"] = f"""
SELECT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 1000000000000
    + o_orderkey AS id,
  o_orderkey AS k, o_custkey AS custkey, {company_of('o_custkey')} AS company_id,
  CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE {company_of('o_custkey')} END AS user_id,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 'Invoice' ELSE 'Quotation' END AS type,
  o_orderdate AS ts, CASE WHEN o_orderkey % 19 <> 0 THEN o_custkey END AS billed_to,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey + 1 ELSE o_custkey END
  END AS shipped_to,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority END AS transport,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN
    CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'CASH' ELSE 'UPI' END END AS payment,
  CASE WHEN o_orderkey % 5 = 0 THEN ''
    ELSE strftime(CAST(o_orderdate AS DATE) + 7, '%d-%m-%Y') END AS eta
FROM orders"""

CTES["lines"] = f"""
SELECT b.id AS history_id, b.k, b.company_id, b.user_id, b.type, b.ts,
  row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line_no,
  p_name AS descp, p_brand AS hsn_sac, p_type AS uom, l_quantity AS qty,
  {r2('l_extendedprice / l_quantity')} AS rate, round(l_tax * 100) AS gst,
  {r2('l_extendedprice / l_quantity')} * l_quantity AS amount
FROM lineitem JOIN bills b ON l_orderkey = b.k JOIN part ON l_partkey = p_partkey"""

CTES["priced"] = f"""
SELECT *, {r2('rate_wo_gst * qty')} AS amount_wo_gst,
  {r2('(cgst_percent / 100) * amount')} AS cgst_amount
FROM (SELECT *, {r2('rate * (1 - gst / 100)')} AS rate_wo_gst,
  {r2('(gst / 100) * amount')} AS gst_amount, {r2('gst / 2')} AS cgst_percent FROM lines)"""

_SUMS = """
  CAST(round_even(sum(CAST(qty AS DECIMAL(24,6))), 3) AS DOUBLE) AS total_qty,
  CAST(round_even(sum(CAST(amount AS DECIMAL(24,6))), 2) AS DECIMAL(24,2)) AS total,
  CAST(sum(CAST(amount_wo_gst AS DECIMAL(18,2))) AS DOUBLE) AS total_amount_wo_gst,
  CAST(sum(CAST(gst_amount AS DECIMAL(18,2))) AS DOUBLE) AS sum_gst,
  CAST(sum(CAST(cgst_amount AS DECIMAL(18,2))) AS DOUBLE) AS sum_cgst"""

_GRAND = """
  CAST(total AS DOUBLE) AS total_amount, CAST(round_even(total, 0) AS BIGINT) AS grand_total,
  CAST(CAST(CAST(round_even(total, 0) AS BIGINT) AS DECIMAL(24,2)) - total AS DOUBLE)
    AS round_off"""

# Bills without lines have totals of 0.
CTES["totals"] = f"""
SELECT *, {_GRAND} FROM (
  SELECT b.company_id, b.id AS history_id, b.type, coalesce(total_qty, 0) AS total_qty,
    coalesce(total, 0) AS total, coalesce(total_amount_wo_gst, 0) AS total_amount_wo_gst,
    coalesce(sum_gst, 0) AS sum_gst, coalesce(sum_cgst, 0) AS sum_cgst
  FROM bills b LEFT JOIN (SELECT history_id, {_SUMS} FROM priced GROUP BY history_id) s
    ON b.id = s.history_id)"""

CTES["amounts"] = """
SELECT id, coalesce(grand_total, 0) AS amount
FROM bills LEFT JOIN totals ON id = history_id"""

# Sequential rule as a gaps-and-islands query: a restart begins a segment.
CTES["numbers"] = """
SELECT id, company_id, type, ts, row_number() OVER (
    PARTITION BY company_id, type, seg ORDER BY id) AS bill_num
FROM (SELECT *, sum(restart) OVER (PARTITION BY company_id, type ORDER BY id
    ROWS UNBOUNDED PRECEDING) AS seg
  FROM (SELECT *, CASE WHEN month(ts) >= 4 AND lag(month(ts)) OVER (
      PARTITION BY company_id, type ORDER BY id) < 4 THEN 1 ELSE 0 END AS restart FROM bills))"""

CTES["first_goods"] = """
SELECT company_id, descp, hsn_sac, uom, rate, gst, user_id AS added_by,
  history_id AS first_bill, line_no AS first_line
FROM lines
QUALIFY row_number() OVER (PARTITION BY company_id, descp ORDER BY history_id, line_no) = 1"""

CTES["goods"] = """
SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY first_bill, first_line) AS id
FROM first_goods"""

CTES["headers"] = f"""
SELECT b.company_id, b.id, b.type, {label('b.type', 'b.ts', 'n.bill_num')} AS bill_label,
  strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS bill_timestamp, coalesce(c1.name, '') AS billed_to,
  coalesce(c2.name, '') AS shipped_to, coalesce(b.transport, '') AS transport,
  coalesce(b.payment, '') AS payment, coalesce(b.eta, '') AS eta, a.amount
FROM bills b JOIN numbers n USING (id) JOIN amounts a USING (id)
LEFT JOIN clients c1 ON b.billed_to = c1.id LEFT JOIN clients c2 ON b.shipped_to = c2.id"""

CTES["history"] = """
SELECT h.*, l.line_no, g.descp, coalesce(g.hsn_sac, '') AS hsn_sac, coalesce(g.uom, '') AS uom,
  g.rate, g.gst, l.qty, l.amount AS good_amount
FROM headers h LEFT JOIN lines l ON h.id = l.history_id
LEFT JOIN first_goods g ON l.company_id = g.company_id AND l.descp = g.descp"""

CTES["nested"] = """
SELECT company_id, id, type, bill_label, bill_timestamp, billed_to, shipped_to, transport,
  payment, eta, amount, count(*) AS n_goods,
  coalesce(string_agg(concat_ws(':', line_no, descp, qty), ';' ORDER BY line_no), '')
    AS list_of_goods
FROM history GROUP BY ALL"""

_LEDGER = ["places", "clients", "bills", "lines", "priced", "totals", "amounts", "numbers",
           "first_goods", "headers", "history"]

# --- posted documents ----------------------------------------------------------------

CTES["posted"] = """
SELECT b.id, b.k, b.k % 97 AS d, b.company_id, b.user_id, b.type, b.ts,
  CASE b.k % 97 WHEN 18 THEN '' WHEN 19 THEN ' ' || c.name || ' ' ELSE c.name END AS name,
  CASE b.k % 97 WHEN 18 THEN '' WHEN 16 THEN '123' ELSE coalesce(c.phno1, '') END AS phno1,
  coalesce(c.phno1, '') AS own_phone,
  CASE WHEN b.k % 97 = 14 THEN '12345' ELSE coalesce(c.phno2, '') END AS phno2,
  coalesce(c.gstin, '') AS gstin, coalesce(c.addrBnm, '') AS addrBnm, c.addrBno,
  coalesce(c.addrFlno, '') AS addrFlno, c.addrSt, c.addrLoc, c.addrDist,
  CASE WHEN b.k % 97 = 17 THEN '' ELSE c.addrState END AS addrState,
  CASE WHEN b.k % 97 = 13 THEN '060001' ELSE c.addrPncd END AS addrPncd,
  CASE WHEN b.k % 97 = 2 THEN NULL WHEN b.k % 97 = 15 THEN '2024-02-30'
    WHEN b.k % 97 = 16 THEN '2024-13-01' WHEN b.k % 5 = 0 THEN ''
    ELSE strftime(CAST(b.ts AS DATE) + 7, '%Y-%m-%d') END AS eta,
  b.transport, b.payment
FROM bills b JOIN clients c ON b.custkey = c.id"""

_SAME = "k % 4 >= 2"
_OTHER = "k % 4 = 1"
CTES["invoices"] = f"""
SELECT id, k, d, company_id, user_id, ts, eta, transport, payment,
  {strip('name')} AS bname, phno1 AS bphno1, phno2 AS bphno2, gstin AS bgstin, addrBnm, addrBno,
  addrFlno, CASE WHEN d = 1 THEN NULL ELSE addrSt END AS addrSt, addrLoc, addrDist, addrState,
  addrPncd,
  {strip(f"CASE WHEN {_SAME} THEN name WHEN {_OTHER} THEN 'Ship ' || name ELSE '' END")} AS sname,
  CASE WHEN {_SAME} THEN name WHEN {_OTHER} THEN 'Ship ' || name ELSE '' END AS raw_sname,
  CASE WHEN {_SAME} THEN phno1 WHEN {_OTHER} THEN own_phone ELSE '' END AS sphno1,
  CASE WHEN {_SAME} THEN phno2 ELSE '' END AS sphno2, {_SAME} AS same
FROM posted WHERE type = 'Invoice'"""


def _fault(value: str, **faults: str) -> str:
    cases = " ".join(f"WHEN {d[1:]} THEN '{text}'" for d, text in faults.items())
    return f"CASE CASE WHEN line_no = 1 THEN k % 97 END {cases} ELSE {value} END"


CTES["posted_lines"] = f"""
SELECT history_id, type, company_id, user_id, k, line_no,
  {strip(_fault("CASE WHEN line_no = 1 AND k % 97 = 19 THEN '  ' || descp || chr(9) "
                "ELSE descp END", d3=''))} AS descp,
  hsn_sac, uom,
  {_fault('CAST(qty AS VARCHAR)', d4='abc', d5='0.0009', d8='nan', d10='1d', d11='1e2',
          d20='2.5005')} AS qty,
  {_fault("format('{:.2f}', rate)", d6='0.009', d9='inf', d16='', d22='1_0',
          d23='10.005')} AS rate,
  CASE WHEN k % 29 = 0 THEN '1.00' ELSE format('{{:.2f}}', amount) END AS posted_amount,
  {_fault('CAST(gst AS VARCHAR)', d7='-1', d21='150', d24='')} AS gst
FROM lines"""


def _passes(x: str, minimum: str) -> str:
    return f"count(*) FILTER (WHERE {x} >= {minimum} AND NOT isnan({x}))"


CTES["line_flags"] = f"""
SELECT history_id, count(*) AS n,
  count(*) - CASE WHEN any_value(k) % 97 = 12 THEN 1 ELSE 0 END AS n_hsn,
  concat_ws(', ', CASE WHEN bool_or(descp = '') THEN 'descp' END,
    CASE WHEN bool_or(qty = '') THEN 'qty' END, CASE WHEN bool_or(rate = '') THEN 'rate' END,
    CASE WHEN bool_or(gst = '') THEN 'gst' END) AS blank_line_fields,
  bool_or(qn IS NULL OR rn IS NULL OR gn IS NULL) AS bad_number,
  {_passes('qn', '0.001')} AS qs, {_passes('rn', '0.01')} AS rs, {_passes('gn', '0')} AS gs
FROM (SELECT *, {number('qty')} AS qn, {number('rate')} AS rn, {number('gst')} AS gn
  FROM posted_lines) GROUP BY history_id"""

_BAD_PHONE = "(coalesce({0}, '') <> '' AND NOT regexp_full_match({0}, '[6-9][0-9]{{9}}'))"
_BAD_PIN = "(coalesce({0}, '') <> '' AND NOT regexp_full_match({0}, '[1-9][0-9]{{5}}'))"
# All posted dates but the two faulty ones are real; blank is not refused.
_BAD_ETA = "coalesce(eta <> '' AND TRY_CAST(eta AS DATE) IS NULL, false)"

_ARRAYS_ABSENT = """CASE WHEN n IS NULL THEN 'serialNumber, descp, hsn_sac, qty, uom, rate, amount, gst'
  WHEN n_hsn = 0 THEN 'hsn_sac' END"""

CTES["checked_invoices"] = f"""
SELECT i.*, n,
  concat_ws(', ', CASE WHEN addrSt IS NULL THEN 'baddrSt' END,
    CASE WHEN same AND addrSt IS NULL THEN 'saddrSt' END, {_ARRAYS_ABSENT},
    CASE WHEN eta IS NULL THEN 'eta' END) AS missing,
  concat_ws(', ', CASE WHEN addrSt IS NULL THEN 'baddrSt' END, {_ARRAYS_ABSENT},
    CASE WHEN eta IS NULL THEN 'eta' END) AS raw_missing,
  blank_line_fields, bad_number, NOT (n = n_hsn AND n = qs AND n = rs AND n = gs) AS bad_length,
  {_BAD_PIN.format('addrPncd')} AS bad_pincode,
  {_BAD_PHONE.format('bphno1')} OR {_BAD_PHONE.format('bphno2')}
    OR {_BAD_PHONE.format('sphno1')} OR {_BAD_PHONE.format('sphno2')} AS bad_phone,
  {_BAD_ETA} AS bad_eta
FROM invoices i LEFT JOIN line_flags f ON i.id = f.history_id"""

CTES["checked_quotations"] = f"""
SELECT * REPLACE ({strip('name')} AS name), n,
  concat_ws(', ', CASE WHEN d = 1 THEN 'phno1' END, {_ARRAYS_ABSENT},
    CASE WHEN eta IS NULL THEN 'eta' END) AS missing,
  blank_line_fields, bad_number, NOT (n = n_hsn AND n = qs AND n = rs AND n = gs) AS bad_length,
  {_BAD_PHONE.format('phno1')} AS bad_phone, {_BAD_ETA} AS bad_eta
FROM posted LEFT JOIN line_flags f ON id = f.history_id WHERE type = 'Quotation'"""

_LINE_ERRORS = """
  WHEN missing <> '' THEN missing || ' not provided'
  WHEN blank_line_fields <> '' THEN blank_line_fields || ' not provided'
  WHEN bad_number THEN 'Invalid values in qty or rate or gst'
  WHEN bad_length THEN 'All fields in the list of goods must have the same length and '
    || 'qty, rate, gst fields must be higher than their minimum values'"""

CTES["invoice_errors"] = f"""
SELECT *, CASE {_LINE_ERRORS} WHEN bad_pincode THEN 'Invalid Pincode'
  WHEN bad_phone THEN 'Invalid Phone Number' WHEN bad_eta THEN 'Invalid values in ETA'
  END AS error_message FROM checked_invoices"""

CTES["quotation_errors"] = f"""
SELECT *, CASE {_LINE_ERRORS} WHEN bad_phone THEN 'Invalid mobile number'
  WHEN bad_eta THEN 'Invalid values in ETA' END AS error_message FROM checked_quotations"""

_POSTED = ["places", "clients", "bills", "lines", "posted", "invoices", "posted_lines",
           "line_flags", "checked_invoices", "checked_quotations"]

# --- parties of posted invoices --------------------------------------------------------


def mentions(source: str) -> str:
    return f"""
SELECT id AS bill_id, 1 AS role, company_id, user_id, ts, bname AS name,
  nullif(bphno1, '') AS phno1, nullif(bgstin, '') AS gstin, nullif(addrState, '') AS addrState
FROM {source} WHERE bname <> ''
UNION ALL
SELECT id, 2, company_id, user_id, ts, sname, nullif(sphno1, ''), NULL,
  CASE WHEN same THEN nullif(addrState, '') END
FROM {source} WHERE sname <> '' AND NOT (bname = sname AND bphno1 = sphno1)"""


CTES["mentions"] = mentions("invoices") + f"""
UNION ALL
SELECT id, 1, company_id, user_id, ts, {strip('name')}, nullif(CASE WHEN d <> 1 THEN phno1 END, ''),
  NULL, NULL
FROM posted WHERE type = 'Quotation' AND {strip('name')} <> ''"""

FIRST_PARTIES = """
SELECT * FROM {0} WHERE phno1 IS NULL
UNION ALL
SELECT * FROM {0} WHERE phno1 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY company_id, name, phno1 ORDER BY bill_id, role) = 1"""

CTES["parties"] = f"""
SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY bill_id, role) AS id
FROM ({FIRST_PARTIES.format('mentions')})"""

PARTY_OF = """
SELECT m.bill_id, m.role, coalesce(own.id, known.id) AS party_id
FROM {0} m
LEFT JOIN {1} own ON m.phno1 IS NULL AND own.bill_id = m.bill_id AND own.role = m.role
LEFT JOIN {1} known ON m.company_id = known.company_id AND m.name = known.name
  AND m.phno1 = known.phno1"""
CTES["party_of"] = PARTY_OF.format("mentions", "parties")

# --- registrations ---------------------------------------------------------------------


def own_phone(k: str) -> str:
    return f"('8' || {digits(f'({k}) % 1000000007', 9)})"


CTES["company_posts"] = f"""
SELECT c_custkey AS arrival,
  CASE WHEN c_custkey % 41 <> 7 THEN c_name END AS company_name,
  CASE WHEN c_custkey % 59 <> 8 THEN 'State' END AS addrState,
  CASE WHEN c_custkey % 31 = 10 THEN '12345'
    WHEN c_custkey % 25 = 3 THEN {supplier_phone('c_custkey // 15')}
    WHEN c_custkey % 10 = 1 THEN {own_phone('c_custkey - 1')}
    ELSE {own_phone('c_custkey')} END AS phno1,
  CASE WHEN c_custkey % 37 = 12 THEN 'not a mail' WHEN c_custkey % 6 = 0 THEN NULL
    WHEN c_custkey % 14 = 2 THEN 'r' || (c_custkey - 1) || '@example.com'
    ELSE 'r' || c_custkey || '@example.com' END AS email,
  CASE WHEN c_custkey % 45 = 4 THEN 'S' || {digits('c_custkey // 15', 14)}
    WHEN c_custkey % 3 = 1 THEN 'C00000000000000' WHEN c_custkey % 4 = 0 THEN NULL
    ELSE 'C' || {digits('c_custkey', 14)} END AS gstin,
  CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 22 = 5 THEN {digits('c_custkey - 1', 12)}
    ELSE {digits('c_custkey', 12)} END AS bnkAcno,
  CASE WHEN c_custkey % 9 = 0 THEN 'SHORT' ELSE 'BANK0000001' END AS bnkIfsc
FROM customer"""

CTES["account_posts"] = f"""
SELECT c_custkey AS arrival,
  CASE WHEN c_custkey % 29 = 3 THEN 'abc' WHEN c_custkey % 17 = 4 THEN 'user' || (c_custkey - 1)
    WHEN c_custkey % 33 = 5 THEN 'Supplier#' || {digits('c_custkey // 15', 9)}
    ELSE 'user' || c_custkey END AS username,
  CASE WHEN c_custkey % 37 = 6 THEN 'bad@mail' WHEN c_custkey % 3 = 1 THEN 'info@example.com'
    WHEN c_custkey % 8 = 0 THEN NULL ELSE 'a' || c_custkey || '@example.com' END AS email,
  CASE WHEN c_custkey % 53 = 7 THEN NULL WHEN c_custkey % 11 = 0 THEN NULL
    WHEN c_custkey % 13 = 2 THEN '123'
    WHEN c_custkey % 19 = 9 THEN {supplier_phone('c_custkey // 15')}
    ELSE '7' || {digits('c_custkey // 2', 9)} END AS phno
FROM customer"""


def unpivot(source: str, key: str, fields: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {key} AS arrival, '{f}' AS field, {f} AS value FROM {source} "
        f"WHERE {f} IS NOT NULL"
        for f in fields
    )


def conflicts(entity: str, posts: str, stored: str, fields: list[str]) -> str:
    return f"""
SELECT arrival, field, value, first_arrival,
  EXISTS (SELECT 1 FROM ({unpivot(stored, 'id', fields)}) s
    WHERE s.field = v.field AND s.value = v.value) AS in_store,
  first_arrival < arrival AS in_batch, '{entity}' AS entity
FROM (SELECT *, min(arrival) OVER (PARTITION BY field, value) AS first_arrival
  FROM ({unpivot(posts, 'arrival', fields)})) v"""


# --- the queries ------------------------------------------------------------------------


def query(ctes: list[str], select: str) -> str:
    parts = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ctes)
    return f"WITH {parts}\n{select.strip()}" if ctes else select.strip()


ORACLES: dict[str, str] = {}

ORACLES["tenant_bills"] = query(["bills", "users"], """
SELECT u.username AS viewer, b.company_id, b.type, b.id, b.billed_to
FROM bills b JOIN users u ON u.company_id = b.company_id""")

ORACLES["document_lookup"] = query(["bills", "numbers"], f"""
SELECT r.id, r.company_id, CASE WHEN n.id IS NULL THEN 404 ELSE 200 END AS status,
  {label('n.type', 'n.ts', 'n.bill_num')} || '.pdf' AS file_name,
  right({label('n.type', 'n.ts', 'n.bill_num')}, 6) || '.pdf' AS link_text,
  CASE WHEN n.id IS NULL THEN 'PDF not found' END AS error_message
FROM (SELECT id, company_id + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS company_id FROM bills) r
LEFT JOIN numbers n ON r.id = n.id AND r.company_id = n.company_id""")

_PRINT = """SELECT history_id, count(*) AS n_lines, string_agg(concat_ws(':', line_no, descp,
    hsn_sac, uom, format('{:.2f}', rate_wo_gst), format('{:.2f}', amount_wo_gst),
    CASE WHEN p.type = 'Quotation' OR c.addrState <> coalesce(x.addrState, '')
      THEN format('{:.2f}', gst_amount)
      ELSE format('{:.2f}:{:.2f}', cgst_amount, cgst_amount) END), ';'
    ORDER BY line_no) AS lines_text
  FROM priced p JOIN bills b ON b.id = p.history_id JOIN companies c ON c.id = p.company_id
  LEFT JOIN clients x ON x.id = b.billed_to GROUP BY history_id"""
ORACLES["bill_document_flat"] = query(
    ["places", "companies", "users", "clients", "bills", "lines", "priced", "totals", "numbers"],
    f"""
SELECT b.id AS bill_id, c.name AS company_name, {address('c.')} AS company_addr,
  {phones('c.')} AS company_phno, c.email AS company_email, c.website AS company_website,
  c.gstin AS company_gstin, c.bnkAcnm AS bank_account_name, c.bnkAcno AS bank_account,
  c.bnkNm AS bank_name, c.bnkIfsc AS bank_ifsc, c.custTerms AS terms,
  {issue_label('b.type', 'b.ts', 'n.bill_num')} AS issue_label,
  {issue_date('b.type', 'b.ts')} AS issue_date, u.username AS issued_by,
  u.type AS issued_by_role, coalesce(x.name, '') AS buyer_name, {address('x.')} AS buyer_addr,
  {phones('x.')} AS buyer_phno, coalesce(x.gstin, '') AS buyer_gstin,
  coalesce(y.name, '') AS ship_name, {address('y.')} AS ship_addr, {phones('y.')} AS ship_phno,
  coalesce(y.gstin, '') AS ship_gstin, coalesce(b.transport, '') AS transport,
  coalesce(b.payment, '') AS payment, b.eta, coalesce(p.n_lines, 0) AS n_lines,
  coalesce(p.lines_text, '') AS lines_text, t.total_qty,
  t.total_amount_wo_gst,
  CASE WHEN b.type = 'Quotation' OR c.addrState <> coalesce(x.addrState, '') THEN t.sum_gst END
    AS total_gst_amount,
  CASE WHEN b.type = 'Invoice' AND c.addrState = coalesce(x.addrState, '') THEN t.sum_cgst END
    AS total_cgst_amount,
  CASE WHEN b.type = 'Invoice' AND c.addrState = coalesce(x.addrState, '') THEN t.sum_cgst END
    AS total_sgst_amount,
  t.total_amount, t.round_off, {inr('t.grand_total')} AS grand_total_text,
  {words('t.grand_total')} AS total_amount_words
FROM bills b JOIN totals t ON b.id = t.history_id
LEFT JOIN ({_PRINT}) p ON b.id = p.history_id
JOIN numbers n ON b.id = n.id JOIN companies c ON b.company_id = c.id
LEFT JOIN users u ON b.user_id = u.id LEFT JOIN clients x ON b.billed_to = x.id
LEFT JOIN clients y ON b.shipped_to = y.id""")

_REQUIRED = """concat_ws(', ', CASE WHEN company_name IS NULL THEN 'company-name' END,
    CASE WHEN addrState IS NULL THEN 'addrState' END)"""
ORACLES["dq_missing_fields"] = query([*_POSTED, "company_posts"], f"""
SELECT 'Invoice' AS source, id AS arrival, raw_missing AS absent, '' AS blank FROM checked_invoices
UNION ALL SELECT 'Quotation', id, missing, '' FROM checked_quotations
UNION ALL SELECT 'Company', arrival, CASE WHEN arrival % 53 = 13 THEN 'website' ELSE '' END,
  {_REQUIRED} FROM company_posts""")

ORACLES["dq_line_rejects"] = query(
    ["bills", "lines", "posted_lines", "line_flags"], """
SELECT id AS submission_id, type AS kind, coalesce(blank_line_fields, '') AS blank_line_fields,
  coalesce(bad_number, false) AS bad_number,
  coalesce(NOT (n = n_hsn AND n = qs AND n = rs AND n = gs), false) AS bad_length
FROM bills LEFT JOIN line_flags ON id = history_id""")

_EMAIL = "[0-9A-Za-z_!#$%&''*+/=?^`{|}~.-]{1,64}@[a-zA-Z0-9.-]{1,255}\\.[a-zA-Z]{2,}"
ORACLES["dq_contact_rules"] = query([*_POSTED, "company_posts", "account_posts"], f"""
SELECT 'Invoice' AS source, id, bad_pincode, bad_phone, false AS bad_email FROM checked_invoices
UNION ALL SELECT 'Quotation', id, false, coalesce(d <> 1 AND bad_phone, false), false
FROM checked_quotations
UNION ALL SELECT 'Company', arrival, arrival % 47 = 9,
  {_BAD_PHONE.format('phno1')} OR arrival % 43 = 11,
  coalesce(NOT regexp_full_match(email, '{_EMAIL}'), false) FROM company_posts
UNION ALL SELECT 'Account', arrival, false, {_BAD_PHONE.format('phno')},
  coalesce(NOT regexp_full_match(email, '{_EMAIL}'), false) FROM account_posts""")

ORACLES["dq_identifier_lengths"] = query(["company_posts", "account_posts"], """
SELECT 'Company' AS source, arrival, coalesce(length(gstin) = 15, true) AS gstin_ok,
  length(bnkIfsc) = 11 AS ifsc_ok, true AS username_ok FROM company_posts
UNION ALL SELECT 'Account', arrival, true, true, length(username) >= 5 FROM account_posts""")


def _off(x: str, digits: int, maximum: str = "") -> str:
    """Numbers with more decimals, as posted, than ``digits``."""
    n, plain = number(x), f"lower(replace({x}, '_', ''))"
    fraction = f"rtrim(regexp_extract({plain}, '\\.([0-9]*)', 1), '0')"
    whole = f"regexp_extract({plain}, '^[+-]?([0-9]*)', 1)"
    exponent = f"coalesce(TRY_CAST(regexp_extract({plain}, 'e([+-]?[0-9]+)$', 1) AS INTEGER), 0)"
    places = (
        f"(CASE WHEN {fraction} <> '' THEN length({fraction}) "
        f"ELSE length(rtrim({whole}, '0')) - length({whole}) END - {exponent})"
    )
    over = f" OR {n} > {maximum}" if maximum else ""
    return (
        f"count(*) FILTER (WHERE {n} IS NOT NULL AND NOT isnan({n}) AND "
        f"(({n} <> 0 AND {places} > {digits}){over}))"
    )


ORACLES["dq_numeric_steps"] = query(["bills", "lines", "posted_lines"], f"""
SELECT b.id AS submission_id, {_off('qty', 3)} AS qty_off_step,
  {_off('rate', 2)} AS rate_off_step, {_off('gst', 2, '100')} AS gst_off_step
FROM bills b LEFT JOIN posted_lines p ON p.history_id = b.id GROUP BY b.id""")

_ERROR = """error_message, CASE WHEN error_message IS NOT NULL THEN 403 END AS error_status,
  error_message IS NULL AS accepted"""
ORACLES["dq_first_error"] = query([*_POSTED, "invoice_errors", "quotation_errors"], f"""
SELECT id AS submission_id, 'Invoice' AS kind, {_ERROR} FROM invoice_errors
UNION ALL SELECT id, 'Quotation', {_ERROR} FROM quotation_errors""")

ORACLES["ship_to_defaults"] = query(["places", "clients", "bills", "posted", "invoices"], f"""
SELECT id AS submission_id, raw_sname AS sname, sphno1, sphno2,
  CASE WHEN same THEN {address('')} ELSE '' END AS saddr FROM invoices""")

ORACLES["eta_normalised"] = query(["places", "clients", "bills", "posted"], f"""
SELECT id AS submission_id, eta AS posted,
  CASE WHEN eta = '' THEN '' ELSE strftime(TRY_CAST(eta AS DATE), '%d-%m-%Y') END AS eta_text,
  {_BAD_ETA} AS refused FROM posted""")

ORACLES["history_lines"] = query(_LEDGER, "SELECT * FROM history")
ORACLES["history_nested"] = query([*_LEDGER, "nested"], "SELECT * FROM nested")
ORACLES["latest_bills"] = query([*_LEDGER, "nested"], """
SELECT * FROM nested QUALIFY row_number() OVER (PARTITION BY company_id, type ORDER BY id DESC) <= 5
""")

ORACLES["bills_by_kind"] = query(["bills", "numbers"], f"""
SELECT company_id, id,
  CASE WHEN type = 'Invoice' THEN 'invoice_list' ELSE 'quotation_list' END AS list_name,
  {label('type', 'ts', 'bill_num')} AS bill_label FROM numbers""")

ORACLES["all_bills_union"] = query(["bills"], """
SELECT id, company_id, type, billed_to, eta, shipped_to, transport FROM bills
WHERE type = 'Invoice'
UNION ALL SELECT id, company_id, type, billed_to, eta, NULL, NULL FROM bills
WHERE type <> 'Invoice'""")

ORACLES["inventory_goods"] = query(["bills", "lines", "first_goods", "goods", "users"], f"""
SELECT g.company_id, g.id,
  row_number() OVER (PARTITION BY g.company_id ORDER BY g.id DESC) AS s_no, descp, hsn_sac, uom,
  {inr('rate')} AS rate_text, CAST(gst AS VARCHAR) || '%' AS gst_text, b.ts AS added_at,
  u.username AS added_by
FROM goods g JOIN users u ON g.added_by = u.id JOIN bills b ON b.id = g.first_bill""")

ORACLES["inventory_clients"] = query(["places", "clients", "users"], f"""
SELECT c.company_id, c.id,
  row_number() OVER (PARTITION BY c.company_id ORDER BY c.id DESC) AS s_no, c.name,
  {address('c.')} AS addr, {phones('c.')} AS phno, coalesce(c.gstin, '') AS gstin, c.added_at,
  u.username AS added_by
FROM clients c JOIN users u ON c.added_by = u.id""")

ORACLES["line_pricing"] = query(["bills", "lines", "priced"], """
SELECT history_id, line_no, qty, rate, gst, amount, rate_wo_gst, amount_wo_gst, gst_amount,
  cgst_percent, cgst_amount FROM priced""")

_PLACED = """SELECT b.id, c.addrState AS company_state, x.addrState AS client_state,
  c.addrState <> coalesce(x.addrState, '') AS inter_state
FROM bills b JOIN companies c ON b.company_id = c.id LEFT JOIN clients x ON b.billed_to = x.id"""
ORACLES["place_of_supply"] = query(["places", "companies", "clients", "bills"], _PLACED)

ORACLES["bill_totals"] = query(["bills", "lines", "priced", "totals"], """
SELECT company_id, history_id, total_qty, total_amount, grand_total, round_off,
  total_amount_wo_gst FROM totals""")

ORACLES["bill_tax_split"] = query(
    ["places", "companies", "clients", "bills", "lines", "priced", "totals"], f"""
SELECT p.id, inter_state, CASE WHEN inter_state THEN sum_gst END AS total_gst_amount,
  CASE WHEN NOT inter_state THEN sum_cgst END AS total_cgst_amount,
  CASE WHEN NOT inter_state THEN sum_cgst END AS total_sgst_amount
FROM totals t JOIN ({_PLACED}) p ON t.history_id = p.id WHERE t.type = 'Invoice'""")

ORACLES["quotation_totals"] = query(["bills", "lines", "priced", "totals"], """
SELECT history_id, total_qty, total_amount, grand_total, round_off, total_amount_wo_gst,
  sum_gst AS total_gst_amount FROM totals WHERE type = 'Quotation'""")

ORACLES["preview_vs_billed_total"] = query(["bills", "lines"], f"""
SELECT company_id, history_id, nullif(preview, 0) AS preview_total, total_amount,
  preview = total_amount AS same_total
FROM (SELECT company_id, id AS history_id, coalesce(preview, 0) AS preview,
  coalesce(total_amount, 0) AS total_amount
FROM bills LEFT JOIN (SELECT history_id,
  CAST(sum(CAST(CASE WHEN (qty * rate) % 2 = 1 THEN floor((qty / 8) * rate * 100 + 0.5) / 100
    ELSE {r2('(qty / 8) * rate')} END AS DECIMAL(18,2))) AS DOUBLE) AS preview,
  CAST(round_even(sum(CAST(rate * (qty / 8) AS DECIMAL(24,6))), 2) AS DOUBLE) AS total_amount
  FROM lines GROUP BY history_id) ON id = history_id)""")

_LAST = """SELECT company_id, type, bill_num, ts FROM numbers
QUALIFY row_number() OVER (PARTITION BY company_id, type ORDER BY id DESC) = 1"""
ORACLES["last_bill"] = query(["bills", "numbers"], f"""
SELECT company_id, type, bill_num, strftime(ts, '%Y-%m-%d %H:%M:%S') AS bill_timestamp
FROM ({_LAST})""")

ORACLES["next_bill_number"] = query(["bills", "numbers"], f"""
SELECT s_suppkey AS company_id, t.type, coalesce(bill_num + 1, 1) AS in_winter,
  CASE WHEN month(ts) < 4 THEN 1 ELSE coalesce(bill_num + 1, 1) END AS in_autumn
FROM supplier CROSS JOIN (VALUES ('Invoice'), ('Quotation')) t(type)
LEFT JOIN ({_LAST}) l ON l.company_id = s_suppkey AND l.type = t.type""")

ORACLES["bill_numbers"] = query(
    ["bills", "numbers"], "SELECT company_id, type, id, bill_num FROM numbers")
ORACLES["bill_numbers_incremental"] = query(["bills", "numbers"], """
SELECT company_id, type, id, bill_num FROM numbers WHERE ts >= TIMESTAMP '1999-01-01'""")
CTES["keyed"] = "SELECT k AS id, company_id, type, ts FROM bills"
ORACLES["bill_numbers_by_id"] = query(["bills", "keyed"], f"""
SELECT company_id, type, id, bill_num
FROM ({CTES["numbers"].strip().replace("FROM bills)", "FROM keyed)")})""")
ORACLES["bill_numbers_fiscal_year"] = query(["bills"], """
SELECT company_id, type, id, row_number() OVER (PARTITION BY company_id, type,
  year(ts) - CASE WHEN month(ts) < 4 THEN 1 ELSE 0 END ORDER BY id) AS bill_num FROM bills""")

ORACLES["bill_labels"] = query(["bills", "numbers"], f"""
SELECT id, {label('type', 'ts', 'bill_num')} AS bill_label,
  {issue_label('type', 'ts', 'bill_num')} AS issue_label, {issue_date('type', 'ts')} AS issue_date
FROM numbers""")

ORACLES["sql_functions"] = query(["places", "clients", "bills", "numbers"], f"""
SELECT 'bill' AS source, id, {label('type', 'ts', 'bill_num')} AS text_value,
  {inr('bill_num * 1.5')} AS amount_text, CAST(NULL AS BOOLEAN) AS phone_ok,
  CAST(NULL AS BOOLEAN) AS pin_ok FROM numbers
UNION ALL SELECT 'client', id, name, NULL, regexp_full_match(phno1, '[6-9][0-9]{{9}}'),
  regexp_full_match(addrPncd, '[1-9][0-9]{{5}}') FROM clients""")

_AMOUNTS = ["bills", "lines", "priced", "totals", "amounts"]
ORACLES["bill_amount_text"] = query(
    _AMOUNTS, f"SELECT id, amount, {inr('amount')} AS amount_text FROM amounts")
ORACLES["bill_amount_words"] = query(_AMOUNTS, f"""
SELECT id, {words('amount')} AS words, {words('(amount * 7919023757 % 1000000000000000)')} AS spread_words,
  {words('(id % 1200)')} AS small_words FROM amounts""")

_GOODS = ["bills", "lines", "first_goods", "goods"]
ORACLES["goods_master"] = query(_GOODS, """
SELECT company_id, id, descp, hsn_sac, uom, rate, gst, added_by FROM goods""")
# The first bill of a good decides whether it is new; ids go on where the stored ones end.
ORACLES["new_goods"] = query(_GOODS, """
SELECT company_id, id, descp, rate, gst, first_bill, first_line FROM goods
WHERE first_bill // 1000000000000 >= date_diff('day', DATE '1990-01-01', DATE '1999-01-01')""")
ORACLES["line_goods_ids"] = query(_GOODS, """
SELECT l.history_id, l.line_no, g.id AS goods_id
FROM lines l JOIN goods g USING (company_id, descp)""")

_PARTIES = ["places", "clients", "bills", "posted", "invoices", "mentions", "parties"]
ORACLES["client_master"] = query(_PARTIES, """
SELECT company_id, id, name, phno1, gstin, addrState, user_id AS added_by, bill_id AS first_bill,
  role AS first_role FROM parties""")
ORACLES["new_clients"] = query(_PARTIES, """
SELECT company_id, id, name, phno1, bill_id AS first_bill, role AS first_role FROM parties
WHERE ts >= TIMESTAMP '1999-01-01'""")

_ROLES = """
LEFT JOIN party_of p1 ON p1.bill_id = i.id AND p1.role = 1
LEFT JOIN party_of p2 ON p2.bill_id = i.id AND p2.role = 2"""
_SHIP = "CASE WHEN bname = sname AND bphno1 = sphno1 THEN p1.party_id ELSE p2.party_id END"
ORACLES["bill_party_roles"] = query([*_PARTIES, "party_of"], f"""
SELECT i.id, p1.party_id AS billed_to, {_SHIP} AS shipped_to FROM invoices i {_ROLES}
UNION ALL
SELECT q.id, p1.party_id, NULL FROM posted q
LEFT JOIN party_of p1 ON p1.bill_id = q.id AND p1.role = 1 WHERE q.type = 'Quotation'""")

_COMPANY_FIELDS = ["phno1", "email", "gstin", "bnkAcno"]
_ACCOUNT_FIELDS = ["username", "email", "phno"]
ORACLES["registry_conflicts"] = query(
    ["places", "companies", "users", "company_posts", "account_posts"],
    conflicts("company", "company_posts", "companies", _COMPANY_FIELDS)
    + " UNION ALL "
    + conflicts("account", "account_posts", "users", _ACCOUNT_FIELDS))



def registrations(posts: str, stored: str, fields: list[str], rules: list[tuple[str, str, int]],
                  ctes: list[str], rounds: int = 12) -> str:
    """Registrations taken one by one, as a fixed number of settling rounds.

    Should any registration still be open after the last round, it shows as unsettled.
    """
    def cases(pick) -> str:
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {pick(r)}" for r in rules) + " END"

    def taken(held: str) -> str:
        return ", ".join(
            f"EXISTS (SELECT 1 FROM {held} h WHERE h.field = '{f}' AND h.value = p.{f} "
            f"AND h.arrival < p.arrival) AS taken_{f}" for f in fields
        )

    named = [(n, CTES[n]) for n in ctes]
    named += [
        ("stored_values", " UNION ALL ".join(
            f"SELECT -1 AS arrival, '{f}' AS field, {f} AS value FROM {stored}" for f in fields)),
        ("static_check", f"SELECT *, {cases(lambda r: r[1])} AS err FROM "
                         f"(SELECT p.*, {taken('stored_values')} FROM {posts} p)"),
        ("open_0", unpivot("(SELECT * FROM static_check WHERE err IS NULL)", "arrival", fields)),
    ]
    for i in range(rounds):
        named += [
            (f"win_{i}", f"SELECT arrival FROM (SELECT arrival, arrival = min(arrival) OVER "
                         f"(PARTITION BY field, value) AS f FROM open_{i}) GROUP BY arrival "
                         f"HAVING bool_and(f)"),
            (f"open_{i + 1}", f"SELECT * FROM open_{i} WHERE arrival NOT IN (SELECT arrival FROM "
                              f"open_{i} WHERE (field, value) IN (SELECT (field, value) FROM "
                              f"open_{i} WHERE arrival IN (SELECT arrival FROM win_{i})))"),
        ]
    winners = " UNION ALL ".join(f"SELECT arrival FROM win_{i}" for i in range(rounds))
    named += [
        ("held", f"SELECT * FROM stored_values UNION ALL SELECT * FROM open_0 WHERE arrival IN "
                 f"({winners})"),
        ("flagged", f"SELECT p.*, {taken('held')} FROM {posts} p"),
    ]
    body = ",\n".join(f"{n} {'AS MATERIALIZED' if n[:4] in ('open', 'win_') else 'AS'} ({q.strip()})"
                      for n, q in named)
    return (
        f"WITH {body}\nSELECT arrival, CASE WHEN arrival IN (SELECT arrival FROM open_{rounds}) "
        f"THEN 'unsettled' ELSE {cases(lambda r: r[1])} END AS error_message, "
        f"{cases(lambda r: str(r[2]))} AS error_status FROM flagged"
    )


def _bad(pattern: str, column: str) -> str:
    return f"NOT regexp_full_match({column}, '{pattern}')"


_PHONE = "[6-9][0-9]{9}"
ORACLES["company_registrations"] = registrations(
    "company_posts", "companies", _COMPANY_FIELDS,
    [
        ("arrival % 53 = 13", "'website not provided'", 403),
        (f"{_REQUIRED} <> ''", f"{_REQUIRED} || ' not provided'", 403),
        ("arrival % 47 = 9", "'Invalid Pincode'", 403),
        (_bad(_PHONE, "phno1"), "'Invalid mobile number'", 403),
        ("taken_phno1", "'Mobile number already registered'", 409),
        ("arrival % 43 = 11", "'Invalid phone number'", 400),
        (_bad(_EMAIL, "email"), "'Invalid email'", 400),
        ("taken_email", "'Email already registered'", 409),
        ("taken_gstin", "'GSTIN already registered'", 409),
        ("taken_bnkAcno", "'Bank account number already registered'", 409),
    ],
    ["places", "companies", "company_posts"])

ORACLES["account_registrations"] = registrations(
    "account_posts", "users", _ACCOUNT_FIELDS,
    [
        ("arrival % 53 = 7", "'phno not provided'", 403),
        ("length(username) < 5", "'Username must be at least 5 characters'", 403),
        ("taken_username", "'Username already exists'", 409),
        (_bad(_EMAIL, "email"), "'Invalid email address'", 403),
        ("taken_email", "'Email already registered'", 409),
        (_bad(_PHONE, "phno"), "'Invalid phone number'", 403),
        ("taken_phno", "'Phone number already registered'", 409),
    ],
    ["users", "account_posts"])

def _appended(name: str, posts: str, select: str) -> str:
    """Accepted registrations with ids following the stored ones."""
    body, result = ORACLES[name].rsplit("\nSELECT arrival, CASE", 1)
    return (
        f"{body},\nresult AS (SELECT arrival, CASE{result})\n"
        f"SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY arrival) AS id, "
        f"{select} FROM result JOIN {posts} USING (arrival) WHERE error_message IS NULL"
    )


ORACLES["company_registry"] = _appended(
    "company_registrations", "company_posts",
    "company_name AS name, phno1, email, gstin, bnkAcno, arrival AS created_by")
ORACLES["account_registry"] = _appended(
    "account_registrations", "account_posts",
    "username, email, phno, 'admin' AS type, CAST(NULL AS BIGINT) AS company_id")

ORACLES["registration_run"] = ORACLES["company_registry"]
ORACLES["registration_rejects"] = " UNION ALL ".join(
    f"""(SELECT '{kind}' AS kind, arrival, error_message, error_status
FROM ({ORACLES[f"{kind}_registrations"]}) WHERE error_message IS NOT NULL)"""
    for kind in ("company", "account")
)
ORACLES["accounts_after_runs"] = f"""
SELECT u.id, u.username, coalesce(c.id, u.company_id) AS company_id
FROM (SELECT id, username, company_id FROM ({query(["users"], "SELECT * FROM users")})
  UNION ALL SELECT id, username, company_id FROM ({ORACLES["account_registry"]})) u
LEFT JOIN ({ORACLES["company_registry"]}) c ON c.created_by = u.id"""

ORACLES["company_terms_effective"] = query(["places", "companies"], f"""
SELECT id, coalesce(terms, custTerms) AS custTerms, 'NET 30' AS default_terms
FROM companies LEFT JOIN (
  SELECT {company_of('c_custkey')} AS cid, arg_max(CASE WHEN c_custkey % 5 = 0 THEN ''
    ELSE 'NET ' || (c_custkey % 60 + 1) END, c_custkey) AS terms
  FROM customer WHERE c_custkey % 23 <> 0 GROUP BY 1) u ON u.cid = id""")

ORACLES["terms_after_runs"] = f"""
SELECT id, custTerms FROM ({ORACLES["company_terms_effective"]})"""

ORACLES["account_company_link"] = query(["users"], """
SELECT id, username, type, id AS company_id FROM users""")

# Whole runs: the accepted documents, priced from their posted texts.
_RUN_LINES = f"""
SELECT p.*, {r2('rate_wo_gst * qty')} AS amount_wo_gst,
  {r2('(cgst_percent / 100) * amount')} AS cgst_amount
FROM (SELECT *, {r2('rate * (1 - gst / 100)')} AS rate_wo_gst,
  {r2('(gst / 100) * amount')} AS gst_amount, {r2('gst / 2')} AS cgst_percent
  FROM (SELECT l.history_id, l.company_id, l.user_id, line_no, descp, hsn_sac, uom, posted_amount,
      {number('qty')} AS qty, {number('rate')} AS rate, {number('gst')} AS gst,
      {number('qty')} * {number('rate')} AS amount
    FROM posted_lines l JOIN accepted a ON l.history_id = a.id)) p"""

_RUN_TOTALS = f"""
SELECT *, {_GRAND} FROM (SELECT history_id, count(*) AS n_lines,
  count(*) FILTER (WHERE CAST(posted_amount AS DOUBLE) <> {r2('amount')}) AS posted_mismatches,
  {_SUMS} FROM run_lines GROUP BY history_id)"""

_RUN_GOODS = """
SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY history_id, line_no) AS id
FROM (SELECT company_id, descp, history_id, line_no FROM run_lines
  QUALIFY row_number() OVER (PARTITION BY company_id, descp ORDER BY history_id, line_no) = 1)"""

_RUN_LINKS = """
SELECT l.history_id, string_agg(concat_ws(':', l.line_no, g.id), ';' ORDER BY l.line_no)
  AS goods_links
FROM run_lines l JOIN run_goods g USING (company_id, descp) GROUP BY l.history_id"""


def _numbers(kind: str) -> str:
    return CTES["numbers"].replace(
        "FROM bills)", f"FROM (SELECT *, '{kind}' AS type FROM accepted))")


def run_query(kind: str, base: list[str], accepted: str, parts: list[tuple[str, str]],
              select: str) -> str:
    named = [*[(n, CTES[n]) for n in base], ("accepted", accepted), ("run_lines", _RUN_LINES),
             ("run_totals", _RUN_TOTALS), ("run_goods", _RUN_GOODS), ("run_links", _RUN_LINKS),
             ("run_numbers", _numbers(kind)), *parts]
    return "WITH " + ",\n".join(f"{n} AS ({q.strip()})" for n, q in named) + "\n" + select.strip()


_RUN_COLUMNS = f"""i.id, i.company_id, n.bill_num, {label('n.type', 'i.ts', 'n.bill_num')} AS bill_label,
  {issue_label('n.type', 'i.ts', 'n.bill_num')} AS issue_label,
  CASE WHEN i.eta = '' THEN '' ELSE strftime(CAST(i.eta AS DATE), '%d-%m-%Y') END AS eta,
  t.n_lines, t.posted_mismatches, t.total_qty, t.total_amount, t.grand_total, t.round_off,
  t.total_amount_wo_gst, {words('t.grand_total')} AS total_amount_words, g.goods_links"""

_RUN_JOINS = """JOIN run_totals t ON t.history_id = i.id JOIN run_numbers n ON n.id = i.id
JOIN run_links g ON g.history_id = i.id"""

ORACLES["invoice_run"] = run_query(
    "Invoice",
    ["places", "companies", "clients", "bills", "lines", "posted", "invoices", "posted_lines",
     "line_flags", "checked_invoices", "invoice_errors"],
    "SELECT * EXCLUDE (bad_eta) FROM invoice_errors WHERE error_message IS NULL",
    [("mentions", mentions("accepted")), ("parties", CTES["parties"]),
     ("party_of", CTES["party_of"])],
    f"""
SELECT {_RUN_COLUMNS}, p1.party_id AS billed_to, {_SHIP} AS shipped_to,
  CASE WHEN c.addrState <> i.addrState THEN t.sum_gst END AS total_gst_amount,
  CASE WHEN c.addrState = i.addrState THEN t.sum_cgst END AS total_cgst_amount,
  CASE WHEN c.addrState = i.addrState THEN t.sum_cgst END AS total_sgst_amount,
  c.addrState <> i.addrState AS inter_state, i.transport AS transport_mode,
  i.payment AS payment_mode
FROM accepted i {_RUN_JOINS} JOIN companies c ON i.company_id = c.id {_ROLES}""")

ORACLES["quotation_run"] = run_query(
    "Quotation",
    ["places", "clients", "bills", "lines", "posted", "posted_lines", "line_flags",
     "checked_quotations", "quotation_errors"],
    "SELECT * FROM quotation_errors WHERE error_message IS NULL",
    [("mentions", """
SELECT id AS bill_id, 1 AS role, company_id, user_id, ts, name, nullif(phno1, '') AS phno1
FROM accepted WHERE name <> ''"""), ("parties", CTES["parties"]), ("party_of", CTES["party_of"])],
    f"""
SELECT {_RUN_COLUMNS}, p1.party_id AS billed_to, CAST(NULL AS BIGINT) AS shipped_to, t.sum_gst AS total_gst_amount
FROM accepted i {_RUN_JOINS} LEFT JOIN party_of p1 ON p1.bill_id = i.id""")

ORACLES["tenant_scan"] = query(["bills", "numbers"], """
SELECT b.id, b.company_id, b.type, n.bill_num, b.billed_to, b.eta
FROM bills b JOIN numbers n USING (id) WHERE b.company_id = 0 AND b.type = 'Invoice'""")
ORACLES["tenant_history"] = query(["bills", "numbers"], """
SELECT b.id, b.type, n.bill_num, b.shipped_to
FROM bills b JOIN numbers n USING (id) WHERE b.company_id = 0 ORDER BY b.id DESC""")
ORACLES["entity_lookup"] = query(["places", "clients", "bills"], """
SELECT k.id, c.name, c.phno1 FROM (SELECT billed_to AS id FROM bills WHERE billed_to IS NOT NULL
  UNION SELECT shipped_to FROM bills WHERE shipped_to IS NOT NULL) k
LEFT JOIN clients c ON c.id = k.id""")


def _accounting(kind: str, source: str) -> str:
    """Outcomes counted from the documents as posted once and the faults added to them."""
    return f"""
SELECT '{kind}' AS kind, outcome, documents FROM (
  SELECT count(*) + sum(again) + sum(keyless) + sum(nameless) AS arrived,
    count(*) FILTER (WHERE error_message IS NULL) AS accepted,
    count(*) FILTER (WHERE error_message IS NOT NULL) AS refused,
    sum(again) AS repeated, sum(keyless) + sum(nameless) AS keyless
  FROM (SELECT error_message, CAST(k % 53 = 0 AS BIGINT) AS again,
    CAST(k % 59 = 0 AS BIGINT) AS keyless, CAST(k % 61 = 0 AS BIGINT) AS nameless FROM {source})
) UNPIVOT (documents FOR outcome IN (arrived, accepted, refused, repeated, keyless))
WHERE documents > 0"""


ORACLES["run_accounting"] = query(
    [*_POSTED, "invoice_errors", "quotation_errors"],
    f"""SELECT kind, outcome, CAST(documents AS BIGINT) AS documents FROM (
{_accounting("Invoice", "invoice_errors")} UNION ALL {_accounting("Quotation", "quotation_errors")})""",
)

_WHOLE_RUN, _RUN_SELECT = ORACLES["invoice_run"].rsplit("\nSELECT i.id", 1)
ORACLES["invoice_run_incremental"] = (
    ORACLES["invoice_run"] + "\nWHERE i.ts >= TIMESTAMP '1999-01-01'"
)
ORACLES["ledger_lines"] = _WHOLE_RUN + """
SELECT l.company_id, l.history_id, l.line_no, g.id AS goods_id, l.descp, l.qty, l.amount,
  strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS added_at
FROM run_lines l JOIN run_goods g USING (company_id, descp) JOIN bills f ON f.id = g.history_id"""
ORACLES["rejects_sink"] = query([*_POSTED, "invoice_errors"], """
SELECT id AS submission_id, company_id, error_message, 403 AS error_status
FROM invoice_errors WHERE error_message IS NOT NULL""")
ORACLES["form_rejects"] = ORACLES["rejects_sink"]
ORACLES["document_lookup_indexed"] = ORACLES["document_lookup"]
ORACLES["table_functions"] = query(["bills", "numbers"], f"""
SELECT 'scan' AS source, id, type, bill_num FROM numbers WHERE company_id = 0
UNION ALL SELECT * FROM (SELECT 'newest', id, type, bill_num FROM numbers WHERE company_id = 0
  QUALIFY row_number() OVER (PARTITION BY type ORDER BY id DESC) <= 5)
UNION ALL SELECT 'next', NULL, type,
  CASE WHEN type = 'Invoice' AND month(ts) < 4 THEN 1 ELSE bill_num + 1 END
FROM ({_LAST}) WHERE company_id = 0""")
ORACLES["documents_sink"] = _WHOLE_RUN + f"""
SELECT i.id, {issue_label('n.type', 'i.ts', 'n.bill_num')} AS issue_label,
  {address('i.')} AS buyer_addr, {join_blank(', ', 'i.bphno1', 'i.bphno2')} AS buyer_phno,
  t.grand_total, {words('t.grand_total')} AS total_amount_words, t.n_lines
FROM accepted i {_RUN_JOINS}"""

# A stream numbers and stores what the batch run does.
ORACLES["stream_bill_numbers"] = ORACLES["bill_numbers"]

# Invoices are ingested before quotations, so parties of invoices come first.
_STREAM_MENTIONS = f"""
SELECT *, 1 AS phase FROM ({mentions('accepted')})
UNION ALL
SELECT id, 1, company_id, user_id, ts, name, nullif(phno1, ''), NULL, NULL, 2
FROM accepted_quotations WHERE name <> ''"""

_STREAM_PARTIES = """
SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY phase, late, bill_id, role) AS id
FROM (
  SELECT * FROM mentions WHERE phno1 IS NULL
  UNION ALL
  SELECT * FROM mentions WHERE phno1 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY company_id, name, phno1
    ORDER BY phase, late, bill_id, role) = 1)"""


def _stream_number(kind: str, source: str) -> str:
    return CTES["numbers"].replace("FROM bills)", f"FROM (SELECT *, '{kind}' AS type FROM {source}))")


_STREAM_PARTS = [
    *[(n, CTES[n]) for n in _POSTED],
    ("invoice_errors", CTES["invoice_errors"]),
    ("quotation_errors", CTES["quotation_errors"]),
    ("accepted", "SELECT * EXCLUDE (bad_eta) FROM invoice_errors WHERE error_message IS NULL"),
    ("accepted_quotations", "SELECT * FROM quotation_errors WHERE error_message IS NULL"),
    ("accepted_all", "SELECT id FROM accepted UNION ALL SELECT id FROM accepted_quotations"),
    ("mentions", f"SELECT *, ts >= TIMESTAMP '1999-01-01' AS late FROM ({_STREAM_MENTIONS})"),
    ("parties", _STREAM_PARTIES),
    ("party_of", CTES["party_of"]),
    ("bill_numbers", f"SELECT * FROM ({_stream_number('Invoice', 'accepted')}) UNION ALL "
                     f"SELECT * FROM ({_stream_number('Quotation', 'accepted_quotations')})"),
    ("bill_amounts", f"""
SELECT history_id, CAST(round_even(round_even(sum(CAST({number('qty')} * {number('rate')}
  AS DECIMAL(24,6))), 2), 0) AS BIGINT) AS amount
FROM posted_lines WHERE history_id IN (SELECT id FROM accepted_all) GROUP BY history_id"""),
]
_ETA_STORED = "CASE WHEN i.eta = '' THEN '' ELSE strftime(CAST(i.eta AS DATE), '%d-%m-%Y') END"
ORACLES["stream_ingest_bills"] = (
    "WITH " + ",\n".join(f"{n} AS ({q.strip()})" for n, q in _STREAM_PARTS) + f"""
SELECT i.id, i.company_id, n.type, n.bill_num, p1.party_id AS billed_to, {_SHIP} AS shipped_to,
  {_ETA_STORED} AS eta, a.amount
FROM accepted i JOIN bill_numbers n ON n.id = i.id JOIN bill_amounts a ON a.history_id = i.id
{_ROLES}
UNION ALL
SELECT i.id, i.company_id, n.type, n.bill_num, p1.party_id, NULL, {_ETA_STORED}, a.amount
FROM accepted_quotations i JOIN bill_numbers n ON n.id = i.id
JOIN bill_amounts a ON a.history_id = i.id
LEFT JOIN party_of p1 ON p1.bill_id = i.id AND p1.role = 1""")
