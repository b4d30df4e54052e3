"""DuckDB twins of the text queries, and the fixtures both engines read. Where damage was planted, the twin knows the value before it."""

from __future__ import annotations

from ..functions import fixed
from .policy_sql import CASES, SORTED_FLAGS

VOCAB = (("species_code", "SPECIES", "OS", "05"), ("home_world", "WORLDS", "0", "O"), ("declared_purpose", "PURPOSES", "u", "v"))
ACCENTS = "".join(chr(c) for c in [*range(0xC0, 0x180)]) + "«»’“”–—…°"

#: Line items as the fixtures use them: one row a number of an order.
ITEMS = "(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount FROM lineitem GROUP BY l_orderkey, l_linenumber) items"

# readings and what they resolve to
VISA_READINGS = [("XW 2", "XW-2"), ("TRANSIT 7", "TRANSIT-7"), ("XW-9", None), ("WED-3", "MED-3"), ("MEO-3", "MED-3"), ("XVV-2", "XW-2"), ("D1P-1", "DIP-1"), ("ZZ-1", None), ("DIP-1", "DIP-1"), ("MED-3", "MED-3")]
FEE_READINGS = [("unpad", "unpaid"), ("vnpaid", "unpaid"), ("unpaic", "unpaid"), ("pac", "paid"), ("pald", "paid"), ("waivec", "waived"), ("unknovn", "unknown"), ("paid.", "paid"), ("Waived", "waived"), ("zz", None)]
FLAG_READINGS = [("llegible_biometrics", "illegible_biometrics"), ("biohazard_rcd", "biohazard_red"), ("active warrant", "active_warrant"), ("none", None), ("weather", None)]
NAME_READINGS = [("Mirequell Qcrul", "Miraquell Qorul"), ("Zavoss lxomora", "Zavoss Ixomora"), ("Home Europa", None), ("Zavoss", None), ("Aridane Nexix", "Aridane Nexix"), ("Europa Station", None)]
FUSED = [("FeeStatuspaid", "fee_status", "paid"), ("Statuswaived", "fee_status", "waived"), ("VisaClassMED3", "visa_class", "MED-3"), ("SpeciesCodeARCTURIAN", "species_code", "ARCTURIAN"), ("HomeWorldLuytenb", "home_world", "Luyten-b"), ("completely", None, None)]

NOTES = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Correction: visa class is MED-3.' WHEN 1 THEN 'Manual correction, fee status is waived.' WHEN 2 THEN 'Correction: sponsor is SPN-1O42' WHEN 3 THEN 'no note' END AS note FROM orders"
TAGS = "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'x [SPONSOR ID BLANK] y [NAME CUT OUT]' WHEN 1 THEN '[VISA CLASS TORN]' WHEN 2 THEN '[SEE NOTE]' WHEN 3 THEN '[ARRIVAL DATE LOST] [FEE STATUS OBSCURED]' ELSE 'none' END AS note FROM orders"
RECEIPTS = "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Amount: $809.00' WHEN 1 THEN 'Waiver code: HX-99 Hardship waiver' WHEN 2 THEN 'Waiver code: N/A Received: 2026-04-17' WHEN 3 THEN 'Amount: $ 8090' ELSE 'DIP-WAIVER' END AS note FROM orders"
DATES = "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' noon' WHEN 1 THEN '17 Apr 2026' WHEN 2 THEN 'Apr 17, 2026' WHEN 3 THEN '2026-99-99' WHEN 4 THEN '31 Feb 2020' ELSE '5 september 1999' END AS written FROM orders"
SPONSORS = "SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 5 WHEN 0 THEN 'SPN 1O42' WHEN 1 THEN 'SFN-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') WHEN 2 THEN '4O4O' WHEN 3 THEN 'Attestation Letter' ELSE '5PM-7E31' END AS reading FROM orders"
DRAWINGS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0.8 ELSE 0.1 END AS red, CASE WHEN l_returnflag = 'A' THEN 0.6 ELSE 0.1 END AS green, CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 1 THEN 0.9 ELSE 0.2 END AS blue, CAST(l_quantity AS DOUBLE) AS x0, 100.0 AS y0, CAST(l_quantity AS DOUBLE) + CASE WHEN l_linenumber % 3 = 0 THEN 60.0 ELSE 20.0 END AS x1, CASE WHEN l_linenumber % 3 = 0 THEN 102.0 ELSE 120.0 END AS y1 FROM " + ITEMS
SPANS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN ' ' ELSE l_returnflag || CAST(l_linenumber AS STRING) END AS text, l_quantity / 5 AS size, CAST(l_partkey % 700 AS INT) AS x0, 10 AS y0, CAST(l_partkey % 700 + 40 AS INT) AS x1, 22 AS y1, CAST(l_suppkey % 2 AS INT) AS flags, CAST(l_partkey % 4 AS INT) AS render_mode, CAST(100 + l_partkey % 156 AS INT) AS alpha, CAST((l_partkey * 7919) % 16777216 AS INT) AS color FROM " + ITEMS
VOTES = "SELECT l_orderkey, l_returnflag AS parsed, CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'intake' WHEN 1 THEN 'biometric' WHEN 2 THEN 'registry' WHEN 3 THEN 'sponsor' ELSE 'unknown' END AS kind, l_linenumber AS ordinal FROM " + ITEMS
TSV = "SELECT l_orderkey, l_linenumber, 'level' || chr(10) || '5' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || '2' || chr(9) || CAST(CAST(l_quantity AS INT) AS STRING) || chr(9) || '5' || chr(9) || '9' || chr(9) || '9' || chr(9) || CAST(CAST(l_partkey % 90 AS INT) AS STRING) || chr(9) || 'alpha' || chr(10) || '5' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || '25' || chr(9) || '5' || chr(9) || '9' || chr(9) || '9' || chr(9) || '-1' || chr(9) || 'beta' || chr(10) || '5' || chr(9) || '1' || chr(9) || '2' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || '7' || chr(9) || '5' || chr(9) || '9' || chr(9) || '9' || chr(9) || '60' || chr(9) || 'gamma' AS tsv FROM " + ITEMS
ATTEMPTS = "SELECT CAST(l_orderkey AS STRING) AS case_id, 1 AS page_no, l_linenumber AS attempt, CASE l_returnflag WHEN 'R' THEN 'VISA CLASS' WHEN 'A' THEN 'VISA APPLICANT SPONSOR' ELSE 'noise' END AS text, l_quantity AS confidence, CASE WHEN l_linenumber > 5 THEN 90 ELSE 0 END AS rotation FROM " + ITEMS
_WORDS = [("Fee", 10, 100), ("Stafus", 40, 101), ("paid", 80, 102), ("now", 110, 102), ("Visa", 10, 200), ("Class", 40, 209), ("Home", 10, 300), ("World", 45, 300), ("Luyten-b", 90, 301), ("far", 600, 300)]
WORDS = "SELECT o_orderkey AS k, 1 AS page_no, w.word_no, w.text, CAST(w.x0 + o_orderkey % 7 AS DOUBLE) AS x0, CAST(w.y0 AS DOUBLE) AS y0, CAST(w.x0 + 25 + o_orderkey % 7 AS DOUBLE) AS x1, CAST(w.y0 + 8 AS DOUBLE) AS y1 FROM orders CROSS JOIN (VALUES " + ", ".join(f"({i}, '{t}', {x}, {y})" for i, (t, x, y) in enumerate(_WORDS)) + ") AS w(word_no, text, x0, y0)"


def literal(value) -> str:
    return "NULL" if value is None else "'" + str(value) + "'"


def given(pairs, *names) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(f'CAST({literal(x)} AS VARCHAR)' for x in row) + ')' for row in pairs)}) t({', '.join(names)})"


SEEN = f"WITH {CASES}, v AS (SELECT * FROM cases)"


def worn(column: str) -> str:
    return f"CASE WHEN k % 5 = 1 THEN translate({column}, 'OS', '05') ELSE {column} END"


#: The three pages of a case as the fixture writes them, without the lines that instruct.
PAGE_TEXTS = (
    f"concat_ws(chr(10), 'PRIMARY INTAKE RECORD', 'Applicant Name' || chr(10) || applicant_name, 'Species Code: ' || {worn('species_code')}, 'Home World: ' || home_world, 'Visa Class: ' || visa_class, CASE WHEN k % 5 = 2 THEN 'Sponser ID: ' ELSE 'Sponsor ID: ' END || translate(sponsor_id, '0', 'O'), 'Arrival Date: ' || arrival_date, 'Declared Purpose: ' || {worn('declared_purpose')})",
    "concat_ws(chr(10), 'FEE RECEIPT', 'Fee Status: ' || fee_status, 'RECEIVED: ' || receipt_date, 'Registry Status: ' || registry_status)",
    f"concat_ws(chr(10), 'BIOMETRIC SLIP', 'Observed flags: ' || {SORTED_FLAGS}, 'FINDING: ' || manual_finding)",
)
PAGES = "p AS (" + " UNION ALL ".join(f"SELECT case_id, {n}::BIGINT AS page_no, {t} AS t FROM v" for n, t in enumerate(PAGE_TEXTS, 1)) + ")"
_LABELLED = {"species_code": worn("species_code"), "home_world": "home_world", "visa_class": "visa_class", "sponsor_id": "replace(sponsor_id, '0', 'O')", "arrival_date": "arrival_date", "declared_purpose": worn("declared_purpose"), "applicant_name": "applicant_name", "fee_status": "fee_status", "risk_flags": SORTED_FLAGS}
_ANCHORS = " + ".join(f"contains(t, '{a}')::BIGINT" for a in fixed.ANCHORS)
BODY = "regexp_replace(text, '(?i)Packet\\s+MIB-\\d+.*|Synthetic hiring.*', '', 'g')"
_KIND = "CASE " + " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(f'contains(t, {literal(w)})' for w in ws) + ')' for ws in ways)} THEN '{kind}'" for kind, ways in fixed.PAGE_CLASSES) + " ELSE 'unknown' END"
INK = "CASE WHEN red > 0.6 AND green < 0.4 AND blue < 0.4 THEN 'RED' WHEN green > 0.35 AND red < 0.4 AND blue < 0.4 THEN 'GREEN' WHEN blue > 0.6 AND red < 0.4 AND green < 0.4 THEN 'BLUE' END"
MARKS = f"m AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_linenumber::BIGINT AS mark_no, ink, CASE ink WHEN 'GREEN' THEN 'APPROVED' WHEN 'BLUE' THEN 'NEEDS_REVIEW' ELSE 'DENIED' END AS verdict, y1 - y0 < 3 AND x1 - x0 >= 40 AS is_strike, x0, y0, x1, y1 FROM (SELECT *, {INK} AS ink FROM ({DRAWINGS}) d) e WHERE ink IS NOT NULL)"
LIVE = "live AS (SELECT * FROM m s WHERE NOT is_strike AND NOT EXISTS (SELECT 1 FROM m k WHERE k.is_strike AND k.case_id = s.case_id AND least(k.x1, s.x1) > greatest(k.x0, s.x0) AND least(k.y1, s.y1) > greatest(k.y0, s.y0)))"
_OVERLAP = "greatest(0, least(x1, 612) - greatest(x0, 0)) * greatest(0, least(y1, 792) - greatest(y0, 0))"
_CONTRAST = "(255 - (0.2126::DOUBLE * ((color >> 16) & 255) + 0.7152::DOUBLE * ((color >> 8) & 255) + 0.0722::DOUBLE * (color & 255))) * (alpha / 255.0::DOUBLE)"
VISIBLE = f"(trim(text) <> '' AND size >= 4.5 AND {_OVERLAP} >= 0.75 * greatest(1, (x1 - x0) * (y1 - y0)) AND {_OVERLAP} > 0 AND NOT (flags <> 0 AND render_mode = 3) AND {_CONTRAST} >= 28)"


def votes(ranks, order="-n, -authority") -> str:
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " END"
    return f"SELECT case_id, arg_min(parsed, ({order}, first)) AS value FROM (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, parsed, count(*) AS n, max({rank}) AS authority, min(ordinal) AS first FROM ({VOTES}) v GROUP BY 1, 2) c GROUP BY 1"


_DATE = "CASE k % 6 WHEN 0 THEN substr(written, 4, 10) WHEN 1 THEN '2026-04-17' WHEN 2 THEN '2026-04-17' WHEN 5 THEN '1999-09-05' END"
_SPLIT_FIELDS = "CASE k % 5 WHEN 0 THEN 'applicant_name|sponsor_id' WHEN 1 THEN 'visa_class' WHEN 3 THEN 'arrival_date|fee_status' ELSE '' END"
_SCORE = f"confidence + 14.0 * ({_ANCHORS}) + least(18.0, length(text) / 30.0)"
LADDER = f"""WITH RECURSIVE a AS (SELECT case_id, attempt, rotation, {_SCORE} AS score, ({_ANCHORS}) AS anchors, length(regexp_replace(text, '\\W', '', 'g')) AS body
   FROM (SELECT *, regexp_replace(upper(text), '[^A-Z ]+', ' ', 'g') AS t FROM ({ATTEMPTS}) x) y),
n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY attempt) AS i FROM a),
r AS (SELECT case_id, attempt, score, anchors, body, i FROM n WHERE i = 1
  UNION ALL SELECT n.case_id, CASE WHEN up THEN n.attempt ELSE r.attempt END, CASE WHEN up THEN n.score ELSE r.score END, CASE WHEN up THEN n.anchors ELSE r.anchors END, CASE WHEN up THEN n.body ELSE r.body END, n.i
  FROM r JOIN n ON n.case_id = r.case_id AND n.i = r.i + 1, LATERAL (SELECT (CASE WHEN n.rotation <> 0 THEN r.anchors < 1 AND r.body < 100 ELSE r.anchors < 2 END) AND n.score > r.score AS up) u)
SELECT case_id, arg_max(attempt, i)::BIGINT AS attempt, round(arg_max(score, i), 6) AS score FROM r GROUP BY 1"""

ORACLES = {
    "page_class": f"{SEEN} SELECT case_id, p AS page_no, CASE p WHEN 1 THEN 'intake' WHEN 2 THEN 'fee' ELSE CASE WHEN manual_finding IS NOT NULL THEN 'manual' ELSE 'biometric' END END AS kind FROM v, (VALUES (1::BIGINT), (2), (3)) t(p)",
    "anchor_score": f"SELECT doc_id, {_ANCHORS} AS anchors, round(50 + 14.0 * ({_ANCHORS}) + least(18.0, length({BODY}) / 30.0), 6) AS score FROM (SELECT *, regexp_replace(upper({BODY}), '[^A-Z ]+', ' ', 'g') AS t FROM documents) d",
    "scrub_lines": f"{SEEN}, {PAGES} SELECT case_id, page_no, t AS visible_native FROM p",
    "injection_flag": "SELECT doc_id, doc_id % 7 = 0 AS seen FROM documents",
    "manual_finding": f"{SEEN} SELECT case_id, p AS page_no, CASE WHEN p = 3 THEN manual_finding END AS finding FROM v, (VALUES (1::BIGINT), (2), (3)) t(p)",
    "damage_tags": f"SELECT k, {_SPLIT_FIELDS} AS fields FROM ({TAGS}) t",
    "registry_status": f"{SEEN} SELECT case_id, p AS page_no, CASE WHEN p = 2 THEN registry_status END AS status FROM v, (VALUES (1::BIGINT), (2), (3)) t(p)",
    "receipt_fee": f"SELECT k, CASE k % 5 WHEN 0 THEN 'paid' WHEN 1 THEN 'waived' END AS fee, CASE k % 5 WHEN 2 THEN '2026-04-17' END AS received, k % 5 IN (1, 4) AS waiver FROM ({RECEIPTS}) t",
    "corrections": f"SELECT k, CASE k % 4 WHEN 0 THEN 'MED-3' END AS visa_class, CASE k % 4 WHEN 1 THEN 'waived' END AS fee_status, CASE k % 4 WHEN 2 THEN 'SPN-1042' END AS sponsor_id FROM ({NOTES}) t",
    "parse_date": f"SELECT k, {_DATE} AS parsed FROM ({DATES}) t",
    "repair_sponsor": f"SELECT k, CASE k % 5 WHEN 0 THEN 'SPN-1042' WHEN 1 THEN 'SPN-' || lpad((c % 10000)::VARCHAR, 4, '0') WHEN 2 THEN 'SPN-4040' END AS parsed FROM ({SPONSORS}) t",
    "canon": f"SELECT doc_id, md5(trim(regexp_replace(upper(translate(text, '{ACCENTS}', '')), '[^A-Z0-9]+', ' ', 'g'))) AS canon FROM documents",
    "loose_value": "SELECT doc_id, contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'all rights reserved.') AS found FROM documents",
    "page_kinds": f"SELECT doc_id, {_KIND} AS kind FROM (SELECT doc_id, regexp_replace(upper(text || CASE WHEN doc_id % 5 = 0 THEN ' Fee Status Amount' ELSE '' END), '[^A-Z0-9]+', ' ', 'g') AS t FROM documents) d",
    "scanned_page": f"SELECT doc_id, length(trim({BODY})) < 40 AS scanned FROM documents",
    "snap_vocab": f"WITH {CASES} " + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS field, translate({c}, '{a}', '{b}') AS reading, {c} AS parsed FROM cases WHERE {c} IS NOT NULL" for c, _, a, b in VOCAB),
    "snap_visa": given(VISA_READINGS, "reading", "parsed"),
    "snap_fee": given(FEE_READINGS, "reading", "parsed"),
    "snap_flag": given(FLAG_READINGS, "reading", "parsed"),
    "snap_name": given(NAME_READINGS, "reading", "parsed"),
    "split_fused": given(FUSED, "reading", "field", "value"),
    "label_values": f"{SEEN} " + " UNION ALL ".join(f"SELECT case_id, '{f}' AS field, {x} AS value FROM v WHERE {f if f != 'risk_flags' else 'case_id'} IS NOT NULL" for f, x in _LABELLED.items())
    + " UNION ALL SELECT case_id, 'arrival_date', split_part(applicant_name, ' ', 2) FROM v WHERE applicant_name LIKE 'Ariul %'",  # near enough to ARRIVAL to be a label
    "next_line_value": f"{SEEN} SELECT case_id, applicant_name AS value FROM v WHERE applicant_name IS NOT NULL",
    "consensus": votes(fixed.PAGE_RANK),
    "consensus_identity": votes(fixed.IDENTITY_RANK),
    "consensus_authority": votes(fixed.PAGE_RANK, "-authority, -n"),
    "first_parsed": f"SELECT CAST(l_orderkey AS VARCHAR) AS case_id, arg_min(parsed, ordinal) AS value FROM ({VOTES}) v WHERE kind <> 'unknown' GROUP BY 1",
    "evidence": f"{SEEN} SELECT case_id, applicant_name, species_code, home_world, visa_class, sponsor_id, arrival_date, declared_purpose, fee_status, {SORTED_FLAGS} AS risk_flags, receipt_date, registry_status, manual_finding, true AS risk_flags_known, injection_detected, 3::INTEGER AS pages FROM v",
    "span_visible": f"SELECT l_orderkey, l_linenumber, {VISIBLE} AS visible FROM ({SPANS}) s",
    "native_text": f"WITH s AS (SELECT l_orderkey AS case_id, l_linenumber % 2 AS line_no, l_linenumber, trim(text) AS t, {VISIBLE} AS v FROM ({SPANS}) x WHERE trim(text) <> ''), l AS (SELECT case_id, line_no, string_agg(t, ' ' ORDER BY l_linenumber) FILTER (v) AS v, string_agg(t, ' ' ORDER BY l_linenumber) FILTER (NOT v) AS h FROM s GROUP BY 1, 2) SELECT case_id, coalesce(string_agg(v, chr(10) ORDER BY line_no), '') AS visible, coalesce(string_agg(h, chr(10) ORDER BY line_no), '') AS hidden FROM l GROUP BY 1",
    "tsv_lines": "SELECT l_orderkey AS case_id, l_linenumber::BIGINT AS page_no, CASE WHEN l_quantity::INT < 25 OR l_quantity::INT = 25 THEN 'alpha beta' ELSE 'beta alpha' END || chr(10) || 'gamma' AS text, round((l_partkey % 90 + 60) / 2.0, 6) AS confidence FROM " + ITEMS,
    "ocr_best_attempt": LADDER,
    "recognizer_lines": "SELECT l_orderkey AS case_id, string_agg(l_returnflag, chr(10) ORDER BY l_linenumber) AS rapid_text FROM " + ITEMS + " WHERE l_discount * 10 > 0.4 GROUP BY 1",
    "marks": f"WITH {MARKS} SELECT case_id, mark_no, ink, verdict, is_strike FROM m",
    "struck_stamps": f"WITH {MARKS}, {LIVE} SELECT case_id, mark_no FROM live",
    "stamp_verdict": f"WITH {MARKS}, {LIVE}, g AS (SELECT case_id, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) END AS v FROM live GROUP BY 1) SELECT c.case_id, v AS stamp_verdict, CASE WHEN v = 'DENIED' THEN 0.85::DOUBLE WHEN v IS NOT NULL THEN 0.97::DOUBLE END AS stamp_weight, v IS NULL AS stamp_contested FROM (SELECT DISTINCT case_id FROM m WHERE NOT is_strike) c LEFT JOIN g USING (case_id)",
    "find_label": "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, f AS field, (10 + o_orderkey % 7)::DOUBLE AS x0, (x + o_orderkey % 7)::DOUBLE AS x1 FROM orders, (VALUES ('fee_status', 65), ('home_world', 70)) t(f, x)",
    "cell_value": "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, f AS field, v AS value FROM orders, (VALUES ('fee_status', 'paid now'), ('home_world', 'Luyten-b')) t(f, v)",
}
