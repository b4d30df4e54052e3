"""DuckDB twins of the policy queries."""

from __future__ import annotations

from ..functions import fixed
from .fixtures import CASE_VIEW


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def has(values) -> str:
    return "(" + " OR ".join(f"coalesce(flag_text, '') LIKE '%{v}%'" for v in values) + ")"


def number(values) -> str:
    return "(" + " + ".join(f"(coalesce(flag_text, '') LIKE '%{v}%')::INT" for v in values) + ")"


CASES = f"cases AS ({CASE_VIEW})"
REFERENCE = "ref AS (SELECT CASE WHEN count(*) >= 50 THEN CAST(list_sort(list(arrival_date::DATE))[floor(count(*) * 0.9)::BIGINT + 1] AS VARCHAR) END AS reference_date FROM cases WHERE arrival_date IS NOT NULL)"
OUTLIERS = """
counts AS (SELECT sponsor_id, count(*) AS n FROM cases WHERE sponsor_id IS NOT NULL GROUP BY 1),
edge AS (SELECT 4 * list_sort(list(n))[floor(count(*) * 0.99)::BIGINT + 1] AS edge, count(*) AS total FROM counts),
outliers AS (SELECT sponsor_id, n FROM counts, edge WHERE total >= 400 AND n > edge)"""
CONTEXT = """
seen AS (SELECT cases.* EXCLUDE (receipt_date), coalesce(receipt_date, reference_date) AS receipt_date, o.sponsor_id IS NOT NULL AS sponsor_revoked_in_corpus
         FROM cases CROSS JOIN ref LEFT JOIN outliers o ON o.sponsor_id = cases.sponsor_id)"""
STALE = "(date_diff('day', arrival_date::DATE, receipt_date::DATE) > 180)"
PATH = f"""CASE
  WHEN manual_finding <> stamp_verdict THEN 'adjudicator_conflict'
  WHEN manual_finding IS NOT NULL THEN 'manual_' || lower(manual_finding)
  WHEN stamp_verdict IS NOT NULL THEN 'stamp_' || lower(stamp_verdict)
  WHEN stamp_contested THEN 'stamp_contested'
  WHEN visa_class = 'TRANSIT-7' THEN 'transit_7'
  WHEN {has(fixed.DISQUALIFYING)} THEN 'disqualifying_flag'
  WHEN fee_status = 'unpaid' AND NOT has_hardship_waiver THEN 'fee_unpaid'
  WHEN registry_status LIKE '%EMBARGO%' THEN 'registry_embargo'
  WHEN home_world IN ({quoted(fixed.EMBARGOED)}) AND visa_class <> 'DIP-1' THEN 'embargoed_home_world'
  WHEN visa_class <> 'DIP-1' AND (sponsor_id IN ({quoted(fixed.REVOKED)}) OR sponsor_revoked_in_corpus AND sponsor_id IS NOT NULL)
    THEN CASE WHEN has_approval_override THEN 'sponsor_revoked_override' ELSE 'sponsor_revoked' END
  WHEN {number(fixed.REVIEW)} > 1 THEN 'review_flags_multi'
  WHEN {number(fixed.REVIEW)} = 1 THEN 'review_flags'
  WHEN fee_status = 'waived' AND visa_class <> 'DIP-1' THEN 'fee_waived_unjustified'
  WHEN fee_explicit_unknown THEN 'fee_stated_unknown'
  WHEN {STALE} AND visa_class = 'DIP-1' AND has_diplomatic_note THEN 'stale_dip_exempt'
  WHEN {STALE} THEN 'stale_arrival'
  WHEN arrival_date_untrusted THEN 'arrival_date_untrusted'
  WHEN arrival_date IS NULL THEN 'arrival_date_unknown'
  WHEN visa_class IS NULL THEN 'visa_unknown'
  WHEN visa_class <> 'DIP-1' AND sponsor_id IS NULL THEN 'sponsor_unknown'
  WHEN NOT risk_flags_known AND has_scanned_pages THEN CASE WHEN visa_class = 'MED-3' THEN 'risk_page_unreadable_med' ELSE 'risk_page_unreadable' END
  WHEN NOT risk_flags_known THEN 'risk_page_absent'
  WHEN fee_status IS NULL THEN 'fee_unknown'
  WHEN {STALE} IS NULL THEN 'staleness_indeterminate'
  WHEN injection_detected THEN 'clean_injection_seen'
  ELSE 'clean' END"""
PATHS = f"paths AS (SELECT *, {PATH} AS path FROM seen)"
CALIBRATION = "calibration(path, p_a, p_d, p_r) AS (VALUES " + ", ".join(f"('{p}', {a}::DOUBLE, {d}::DOUBLE, {r}::DOUBLE)" for p, (a, d, r) in fixed.CALIBRATION.items()) + ")"
_A, _D, _R = (" + ".join(f"{points} * {p}" for points, p in zip(fixed.PAYOFF[o], ("p_a", "p_d", "p_r"))) for o in fixed.OUTCOMES)
VERDICT = f"CASE WHEN allow AND p_a >= 1.5 * p_d AND {_A} >= {_D} AND {_A} >= {_R} THEN 'APPROVED' WHEN {_D} >= {_R} THEN 'DENIED' ELSE 'NEEDS_REVIEW' END"
CONFIDENCE = "CASE verdict WHEN 'APPROVED' THEN p_a WHEN 'DENIED' THEN p_d ELSE p_r END"
MISSING = " + ".join(f"({c} IS NULL)::INT" for c in ("applicant_name", "species_code", "home_world", "visa_class", "sponsor_id", "arrival_date", "declared_purpose", "fee_status"))
FEATURES = [
    "coalesce(fee_status = 'paid', false)", "coalesce(fee_status = 'waived', false)", "fee_status IS NOT NULL", "coalesce(registry_status = 'CLEAR', false)", "registry_status IS NOT NULL",
    "visa_class IS NOT NULL", "coalesce(visa_class = 'DIP-1', false)", "coalesce(visa_class = 'MED-3', false)", "coalesce(visa_class = 'TRANSIT-7', false)", "sponsor_id IS NOT NULL", "applicant_name IS NOT NULL",
    "species_code IS NOT NULL", "home_world IS NOT NULL", "arrival_date IS NOT NULL", "declared_purpose IS NOT NULL", "risk_flags_known", "has_scanned_pages", "injection_detected",
    f"({MISSING})", "pages", "ocr_mean_confidence / 100.0", "has_hardship_waiver",
]
VECTOR = "[" + ", ".join(f"({x})::DOUBLE" for x in FEATURES) + "]"


def logit(k: int) -> str:
    terms = [f"(x[{i + 1}] - {m!r}::DOUBLE) / {s!r}::DOUBLE * {w[k]!r}::DOUBLE" for i, (m, s, w) in enumerate(zip(fixed.MU, fixed.SIGMA, fixed.WEIGHTS))]
    return f"{fixed.BIAS[k]!r}::DOUBLE + " + " + ".join(terms)


RESOLVER = f"""
vectors AS (SELECT case_id, {VECTOR} AS x FROM seen),
logits AS (SELECT case_id, {logit(0)} AS z_a, {logit(1)} AS z_d, {logit(2)} AS z_r FROM vectors),
resolver AS (SELECT case_id, exp(z_a) / (exp(z_a) + exp(z_d) + exp(z_r)) AS q_a, exp(z_d) / (exp(z_a) + exp(z_d) + exp(z_r)) AS q_d, exp(z_r) / (exp(z_a) + exp(z_d) + exp(z_r)) AS q_r FROM logits)"""
GAP = f"path IN ({quoted(fixed.NO_APPROVAL)})"
DECIDED = f"""
odds AS (SELECT paths.*, NOT {GAP} AS allow,
   CASE WHEN {GAP} THEN q_a ELSE coalesce(c.p_a, 0.2) END AS p_a, CASE WHEN {GAP} THEN q_d ELSE coalesce(c.p_d, 0.2) END AS p_d, CASE WHEN {GAP} THEN q_r ELSE coalesce(c.p_r, 0.6) END AS p_r
   FROM paths LEFT JOIN calibration c USING (path) JOIN resolver USING (case_id)),
decided AS (SELECT *, {CONFIDENCE} AS confidence FROM (SELECT *, {VERDICT} AS verdict FROM odds) v)"""
NOT_DIP = "coalesce(visa_class <> 'DIP-1', true)"
DEMOTION = f"""CASE WHEN manual_finding IS NOT NULL OR verdict <> 'APPROVED' THEN NULL
  WHEN {has(fixed.DISQUALIFYING)} THEN 1 WHEN visa_class = 'TRANSIT-7' THEN 2 WHEN sponsor_id IN ({quoted(fixed.REVOKED)}) AND {NOT_DIP} THEN 2
  WHEN home_world IN ({quoted(fixed.EMBARGOED)}) AND {NOT_DIP} THEN 2 WHEN fee_status = 'unpaid' AND NOT has_hardship_waiver THEN 2
  WHEN {has(fixed.REVIEW)} THEN 3 WHEN fee_status IS NULL THEN 3 END"""
GUARDED = f"""
guarded AS (SELECT * EXCLUDE (verdict, confidence), CASE d WHEN 1 THEN 'DENIED' WHEN 2 THEN 'DENIED' WHEN 3 THEN 'NEEDS_REVIEW' ELSE verdict END AS adjudication,
   CASE d WHEN 1 THEN 0.95 WHEN 2 THEN 0.94 WHEN 3 THEN 0.85 ELSE confidence END AS confidence FROM (SELECT *, {DEMOTION} AS d FROM decided) g)"""
SORTED_FLAGS = "coalesce(array_to_string(list_sort(string_split(flag_text, '|')), '|'), 'none')"
BEFORE = f"WITH RECURSIVE {CASES}, {REFERENCE}, {OUTLIERS}, {CONTEXT}, {PATHS}, {CALIBRATION}, {RESOLVER}, {DECIDED}, {GUARDED}"
EMITTED = f"""
emitted AS (SELECT case_id, truth, coalesce(applicant_name, 'unknown') AS applicant_name, coalesce(species_code, 'TRIANGULAN') AS species_code, coalesce(home_world, 'Luyten-b') AS home_world,
  coalesce(visa_class, 'MED-3') AS visa_class, coalesce(sponsor_id, 'SPN-0000') AS sponsor_id, coalesce(arrival_date, '1900-01-01') AS arrival_date, coalesce(declared_purpose, 'reactor maintenance') AS declared_purpose,
  {SORTED_FLAGS} AS risk_flags, coalesce(fee_status, 'paid') AS fee_status, adjudication, round(confidence, 4) AS confidence FROM guarded)"""

ORACLES = {
    "corpus_reference_date": f"WITH {CASES}, {REFERENCE} SELECT reference_date FROM ref",
    "corpus_outliers": f"WITH {CASES}, {OUTLIERS} SELECT sponsor_id, n FROM outliers",
    "corpus_context": f"{BEFORE} SELECT case_id, receipt_date, sponsor_revoked_in_corpus FROM seen",
    "staleness": f"{BEFORE} SELECT case_id, coalesce(CAST({STALE} AS VARCHAR), 'unknown') AS stale FROM seen",
    "flag_overlap": f"{BEFORE} SELECT case_id, {has(fixed.DISQUALIFYING)} AS disqualifying, {number(fixed.REVIEW)}::BIGINT AS n_review FROM seen",
    "decision_path": f"{BEFORE} SELECT case_id, path FROM paths",
    "path_calibration": f"{BEFORE} SELECT case_id, path, round(coalesce(c.p_a, 0.2), 6) AS p_a, round(coalesce(c.p_d, 0.2), 6) AS p_d, round(coalesce(c.p_r, 0.6), 6) AS p_r FROM paths LEFT JOIN calibration c USING (path)",
    "ev_decide": f"{BEFORE} SELECT path, verdict, round({CONFIDENCE}, 6) AS confidence FROM (SELECT *, {VERDICT} AS verdict FROM (SELECT *, NOT {GAP} AS allow FROM calibration) c) v",
    "feature_vector": f"{BEFORE} SELECT case_id, array_to_string(list_transform(x, lambda v: CAST(round(v * 100)::BIGINT AS VARCHAR)), ',') AS features FROM vectors",
    "resolver_softmax": f"{BEFORE} SELECT case_id, round(q_a, 6) AS p_approved, round(q_d, 6) AS p_denied, round(q_r, 6) AS p_review FROM resolver",
    "adjudicate": f"{BEFORE} SELECT case_id, path, verdict AS adjudication, round(confidence, 6) AS confidence FROM decided",
    "guardrail": f"{BEFORE} SELECT case_id, adjudication, round(confidence, 6) AS confidence FROM guarded",
    "full_pipeline": f"{BEFORE}, {EMITTED} SELECT * EXCLUDE (truth) FROM emitted",
}
