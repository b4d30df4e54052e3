"""Cascade order, decision and guardrail invariants on hand-built evidence."""

import itertools

import pytest
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.operators import emit, policy
from docketry.sources.tables import EVIDENCE

CLEAN = dict(
    case_id="MIB-000001", applicant_name="Nexix Qorul", species_code="ARCTURIAN", home_world="Luyten-b", visa_class="XW-1", sponsor_id="SPN-0100", arrival_date="2026-01-01",
    declared_purpose="research", fee_status="paid", risk_flags=[], receipt_date="2026-02-01", registry_status=None, manual_finding=None, stamp_verdict=None, has_hardship_waiver=False,
    has_diplomatic_note=False, stamp_contested=False, has_approval_override=False, arrival_date_untrusted=False, fee_explicit_unknown=False, injection_detected=False, documented_damage=False,
    risk_flags_known=True, has_scanned_pages=False, sponsor_revoked_in_corpus=False, manual_finding_score=None, missing_fields=[], ocr_mean_confidence=90.0, pages=3,
)

PATHS = {
    "adjudicator_conflict": dict(manual_finding="APPROVED", stamp_verdict="DENIED"),
    "manual_approved": dict(manual_finding="APPROVED", visa_class="TRANSIT-7"),
    "manual_denied": dict(manual_finding="DENIED"),
    "manual_needs_review": dict(manual_finding="NEEDS_REVIEW", stamp_verdict="NEEDS_REVIEW"),
    "stamp_approved": dict(stamp_verdict="APPROVED"),
    "stamp_denied": dict(stamp_verdict="DENIED"),
    "stamp_needs_review": dict(stamp_verdict="NEEDS_REVIEW"),
    "stamp_contested": dict(stamp_contested=True, visa_class="TRANSIT-7"),
    "transit_7": dict(visa_class="TRANSIT-7", risk_flags=["biohazard_red"]),
    "disqualifying_flag": dict(risk_flags=["biohazard_red", "identity_conflict"], fee_status="unpaid"),
    "fee_unpaid": dict(fee_status="unpaid", registry_status="EMBARGO REVIEW"),
    "registry_embargo": dict(registry_status="EMBARGO REVIEW", visa_class="DIP-1"),
    "embargoed_home_world": dict(home_world="Wolf-1061c"),
    "sponsor_revoked_override": dict(sponsor_id="SPN-0007", has_approval_override=True),
    "sponsor_revoked": dict(sponsor_revoked_in_corpus=True, risk_flags=["identity_conflict"]),
    "review_flags_multi": dict(risk_flags=["identity_conflict", "sponsor_mismatch"]),
    "review_flags": dict(risk_flags=["sponsor_mismatch"], fee_status="waived"),
    "fee_waived_unjustified": dict(fee_status="waived"),
    "fee_stated_unknown": dict(fee_status=None, fee_explicit_unknown=True),
    "stale_dip_exempt": dict(visa_class="DIP-1", arrival_date="2025-01-01", has_diplomatic_note=True),
    "stale_arrival": dict(arrival_date="2025-01-01"),
    "arrival_date_untrusted": dict(arrival_date_untrusted=True),
    "arrival_date_unknown": dict(arrival_date=None),
    "visa_unknown": dict(visa_class=None),
    "sponsor_unknown": dict(sponsor_id=None),
    "risk_page_unreadable_med": dict(visa_class="MED-3", risk_flags_known=False, has_scanned_pages=True),
    "risk_page_unreadable": dict(risk_flags_known=False, has_scanned_pages=True),
    "risk_page_absent": dict(risk_flags_known=False),
    "fee_unknown": dict(fee_status=None),
    "staleness_indeterminate": dict(receipt_date=None),
    "clean_injection_seen": dict(injection_detected=True),
    "clean": dict(),
}


def frame(spark, rows):
    return spark.createDataFrame([{**CLEAN, **row} for row in rows], EVIDENCE)


@pytest.fixture(scope="module")
def decided(spark):
    rows = [{**change, "case_id": f"MIB-{k:06d}"} for k, change in enumerate(PATHS.values())]
    out = policy.guardrail(policy.adjudicate(frame(spark, rows), policy.calibration_frame(spark)))
    return {r["case_id"]: r for r in out.collect()}


def test_all_paths(decided):
    assert [decided[f"MIB-{k:06d}"]["path"] for k in range(len(PATHS))] == list(PATHS)


def test_gaps_never_approve(decided):
    assert all(r["adjudication"] != "APPROVED" for r in decided.values() if r["path"] in fixed.NO_APPROVAL)


def test_verdicts(decided):
    by_path = {r["path"]: r["adjudication"] for r in decided.values()}
    assert by_path["clean"] == "APPROVED" and by_path["transit_7"] == "DENIED" and by_path["manual_approved"] == "APPROVED" and by_path["stamp_approved"] == "NEEDS_REVIEW"


def test_guardrail_only_demotes(spark):
    changes = [dict(risk_flags=f, visa_class=v, fee_status=p) for f, v, p in itertools.product(([], ["biohazard_red"], ["identity_conflict"]), ("XW-1", "TRANSIT-7"), ("paid", "unpaid", None))]
    df = frame(spark, changes).withColumn("adjudication", F.lit("APPROVED")).withColumn("confidence", F.lit(0.9))
    out = policy.guardrail(df).collect()
    kept = [r for r in out if r["adjudication"] == "APPROVED"]
    assert len(out) == 18 and all(r["risk_flags"] == [] and r["visa_class"] == "XW-1" and r["fee_status"] == "paid" for r in kept) and len(kept) == 1
    denied = policy.guardrail(df.withColumn("adjudication", F.lit("DENIED"))).select("adjudication").distinct().collect()
    assert [r[0] for r in denied] == ["DENIED"]


def test_each_value_is_computed_once(spark):
    plan = policy.adjudicate(frame(spark, [{}]), policy.calibration_frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") <= 3 and "aggregate(" not in plan and "zip_with(" not in plan


def test_margin_for_approval(spark):
    df = spark.createDataFrame([(0.5, 0.4, 0.1), (0.65, 0.25, 0.1)], "a double, d double, r double")
    out = [r["adjudication"] for r in policy.with_choice(df, ("a", "d", "r"), F.lit(True)).collect()]
    assert out == ["DENIED", "APPROVED"]


def test_priors_and_clamp(spark):
    df = emit.output_rows(frame(spark, [dict(fee_status=None, visa_class=None), dict(case_id="x")]).withColumns({"adjudication": F.lit("APPROVED"), "confidence": F.lit(7.0)}))
    rows = emit.clamp(emit.apply_priors(df)).collect()
    assert len(rows) == 1 and rows[0]["fee_status"] == "paid" and rows[0]["visa_class"] == "MED-3" and rows[0]["sponsor_id"] == "SPN-0100" and rows[0]["confidence"] == 1.0


def test_gates_are_brute_force(spark, monkeypatch):
    import random

    from docketry.operators import fit
    from docketry.plans import fit_queries

    rng, cases = random.Random(4), []
    for k in range(120):
        row = dict(fee_status=rng.choice(["paid", None]), visa_class=rng.choice(["DIP-1", "MED-3", None]), sponsor_id=rng.choice(["SPN-0100", None]), has_scanned_pages=rng.random() < 0.5, ocr_mean_confidence=rng.choice([60.0, 90.0]), pages=rng.choice([3, 6]), registry_status=rng.choice(["CLEAR", None]))
        # denied with good OCR too; never where fee, sponsor and a short packet meet
        safe = row["fee_status"] and row["sponsor_id"] and row["pages"] == 3
        cases.append(dict(row, case_id=f"MIB-{k:06d}", truth=rng.choice(["APPROVED", "NEEDS_REVIEW"] if safe else ["APPROVED", "DENIED", "DENIED"])))
    truths = spark.createDataFrame([(c["case_id"], c["truth"], "clean" if k % 10 == 0 else "fee_unknown") for k, c in enumerate(cases)], "case_id string, truth string, path string")
    pool = frame(spark, [{k: v for k, v in c.items() if k != "truth"} for c in cases]).join(truths, "case_id")
    monkeypatch.setattr(fit_queries, "labelled", lambda s, d: pool)
    names = sorted(fit.signals())
    held = [r for r in pool.where("path <> 'clean'").select("truth", *[c.alias(n) for n, c in fit.signals().items()]).collect()]
    want = {}
    for size in (1, 2, 3):
        for combo in itertools.combinations(names, size):
            own = [r["truth"] for r in held if all(r[n] for n in combo)]
            if len(own) >= 12 and "DENIED" not in own:
                want[" AND ".join(combo)] = (own.count("APPROVED"), len(own), own.count("NEEDS_REVIEW"))
    got = {r["gate"]: (r["approved"], r["covered"], r["review"]) for r in fit_queries.gates(spark, "").collect()}
    assert got == want and any(g.count(" AND ") == 2 and "good_ocr" not in g for g in want)
