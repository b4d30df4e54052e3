"""Evidence against labels, triage, scores of held-out decisions, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import fit, policy, review
from .fit_queries import _COUNTS, _FOLDS, _HELD, _HIT, _PAY, _SCORE, ORACLES as FIT_ORACLES, folded, held_out, labelled, score_rows
from .fixtures import _FLAGS, case_frame, pick, text_of
from .policy_queries import decided, emitted, in_context, r6
from .policy_sql import BEFORE, CASES, CONFIDENCE, EMITTED, VERDICT
from .text_queries import documents, pages_frame, sql_frame
from .text_sql import ITEMS, PAGES, SEEN

_LABEL_FLAGS = ", ".join(f"CASE WHEN {when} THEN '{flag}' END" for flag, when in sorted(_FLAGS) if "n_returned" not in when)
#: What a reviewer wrote down for each case, for both engines.
LABELS = f"""SELECT 'MIB-' || {text_of('o_orderkey', 6)} AS case_id, {pick(fixed.NAMES[:24], 'o_orderkey % 24')} || ' ' || {pick(fixed.NAMES[60:84], 'o_custkey % 24')} AS applicant_name,
  {pick(fixed.SPECIES, 'o_orderkey % 12')} AS species_code, {pick(fixed.WORLDS, 'c_nationkey % 13')} AS home_world, {pick(fixed.VISAS, "CAST(substr(o_orderpriority, 1, 1) AS INT) - 1")} AS visa_class,
  'SPN-' || {text_of('o_custkey % 10000', 4)} AS sponsor_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS arrival_date, CASE WHEN o_orderkey % 2 = 0 THEN upper({pick(fixed.PURPOSES, 'o_orderkey % 10')}) ELSE {pick(fixed.PURPOSES, 'o_orderkey % 10')} END AS declared_purpose,
  coalesce(nullif(concat_ws('|', {_LABEL_FLAGS}), ''), 'none') AS risk_flags, CASE WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderstatus = 'O' THEN 'paid' WHEN o_orderstatus = 'F' THEN 'unpaid' ELSE 'waived' END AS fee_status,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'APPROVED' WHEN c_mktsegment = 'MACHINERY' THEN 'NEEDS_REVIEW' ELSE 'DENIED' END AS adjudication
  FROM orders JOIN customer ON o_custkey = c_custkey"""
MARGINS = f"SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS x FROM {ITEMS}"


def labels(spark, sf_dir):
    return sql_frame(spark, sf_dir, LABELS.replace("JOIN customer", "JOIN (SELECT * FROM customer) c"), "orders", "customer")


def missing(spark, sf_dir):
    return review.missing_values(review.against_labels(case_frame(spark, sf_dir), labels(spark, sf_dir)))


def triaged(spark, sf_dir):
    number = F.substr("case_id", F.lit(5)).cast("long")
    pages = pages_frame(spark, sf_dir).select("case_id", "page_no", F.col("visible_native").alias("visible"), (number % 4 == 0).alias("has_image"))
    return review.triage(review.distinct_misses(case_frame(spark, sf_dir), labels(spark, sf_dir)), pages)


def extraction(spark, sf_dir):
    joined = review.against_labels(emitted(spark, sf_dir), labels(spark, sf_dir)).withColumn("truth", F.col("truth_adjudication"))
    return score_rows(fit.score(joined, fields=fixed.FIELD_WEIGHTS))


def align(spark, sf_dir):
    cases = case_frame(spark, sf_dir).where("home_world is not null")
    seen = F.array(F.translate("home_world", "ae", "o"), F.coalesce("species_code", F.lit("")), F.lit("noise"))
    found = review.nearest_lines(cases.select("case_id", F.col("home_world").alias("truth")), cases.select("case_id", F.explode(seen).alias("line")))
    return found.select("case_id", "truth", "seen", *r6("ratio"))


def jumps(spark, sf_dir):
    margins = sql_frame(spark, sf_dir, MARGINS, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("y"), "x")
    return review.margin_jumps(margins, boundaries=2).select("case_id", "jumps", "shredded")


def oof_total(spark, sf_dir):
    return review.weighted_total(fit.score(held_out(spark, sf_dir), "fold")).select("n", F.round("total", 4).alias("total"), "catastrophic")


def oof_resolver(spark, sf_dir):
    """Held-out scores where cases on paths that rest on gaps take the odds of a resolver fitted on the other folds."""
    scored = folded(spark, sf_dir)
    features = policy.feature_columns()
    pool = in_context(spark, sf_dir).withColumn("path", policy.decision_path()).where(F.col("path").isin(*fixed.NO_APPROVAL))
    pool = pool.select("case_id", *[((c - m) / sd).alias(n) for c, n, m, sd in zip(features, fixed.FEATURES, fixed.MU, fixed.SIGMA)])
    odds = fit.held_out_resolver(scored.select("case_id", "fold", "truth").join(pool, "case_id"), fixed.FEATURES)
    final = fit.with_held_out_odds(scored, fit.fold_calibration(scored), odds)
    return score_rows(fit.score(final, "fold").withColumn("fold", F.col("fold").cast("long")), "fold")


QUERIES = {
    "labelled_misses": missing,
    "triage_damage": triaged,
    "triage_tallies": lambda s, d: review.tallies(triaged(s, d)),
    "score_extraction": extraction,
    "wrong_decisions": lambda s, d: review.wrong_decisions(policy.guardrail(decided(s, d))).select("folder", "case_id", "adjudication", *r6("confidence"), "truth"),
    "policy_on_gold": lambda s, d: score_rows(review.policy_on_gold(labelled(s, d).drop("path"))),
    "align_truth": align,
    "margin_jumps": jumps,
    "oof_total": oof_total,
    "oof_resolver": oof_resolver,
    "page_clean": lambda s, d: pages_frame(s, d).select("case_id", F.col("page_no").cast("long").alias("page_no"), review.is_clean(F.col("visible_native")).alias("clean")),
    "find_value": lambda s, d: documents(s, d, review.find_value(F.col("text"), F.lit("All  rights RESERVED")).alias("line")),
    "top_gates": lambda s, d: fit.top_gates(fit.gate_search(labelled(s, d).where(F.col("path").isin(*fixed.NO_APPROVAL)))),
    "top_confusions": lambda s, d: fit.top_confusions(fit.confusion_rates(case_frame(s, d).where("species_code is not null").select(F.col("species_code").alias("truth"), F.translate("species_code", "OS", "05").alias("seen")))),
}

_MISSES = " UNION ALL ".join(f"SELECT c.case_id, '{f}' AS field, trim(l.{f}) AS want FROM cases c JOIN lab l USING (case_id) WHERE trim(l.{f}) <> '' AND lower(coalesce(c.{f}, 'unknown')) <> lower(trim(l.{f}))" for f in review.SOUGHT)
MISSES = f"lab AS ({LABELS}), miss AS ({_MISSES} UNION ALL SELECT c.case_id, 'risk_flags', trim(l.risk_flags) FROM cases c JOIN lab l USING (case_id) WHERE NOT risk_flags_known AND trim(l.risk_flags) <> '')"
TRIAGE = f"""{PAGES}, j AS (SELECT case_id, page_no, t, length(trim(t)) > 60 AS clean, CAST(substr(case_id, 5) AS BIGINT) % 4 = 0 AS has_image FROM p),
m AS (SELECT miss.*, page_no, clean, has_image, CASE WHEN clean THEN trim(list_filter(string_split(t, chr(10)), lambda x: contains(lower(x), lower(want)))[1]) END AS line FROM miss JOIN j USING (case_id)),
tri AS (SELECT case_id, field, want, CASE WHEN count(line) > 0 THEN 'parser_gap' WHEN bool_or(NOT clean AND has_image) THEN 'damage_critical' ELSE 'redundant' END AS class, min(page_no) FILTER (line IS NOT NULL)::INTEGER AS page_no, arg_min(line, page_no) FILTER (line IS NOT NULL) AS line FROM m GROUP BY 1, 2, 3)"""
_EXTRACTED = " + ".join(f"CASE WHEN lower(e.{f}) = coalesce(nullif(lower(trim(l.{f})), ''), 'none') THEN {w} ELSE 0 END" for f, w in fixed.FIELD_WEIGHTS.items())
_GOLD = f"""g AS (SELECT p.*, true AS allow, (a + 1.0) / (n + 3) AS p_a, (d + 1.0) / (n + 3) AS p_d, (r + 1.0) / (n + 3) AS p_r FROM paths p JOIN c USING (path)),
h AS (SELECT *, verdict AS adjudication, {CONFIDENCE} AS confidence FROM (SELECT *, {VERDICT} AS verdict FROM g) v)"""
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

ORACLES = {
    "labelled_misses": f"WITH {CASES}, {MISSES} SELECT * FROM miss",
    "triage_damage": f"{SEEN}, {MISSES}, {TRIAGE} SELECT * FROM tri",
    "triage_tallies": f"{SEEN}, {MISSES}, {TRIAGE} SELECT class, count(*) AS n FROM tri GROUP BY 1",
    "score_extraction": f"{BEFORE}, {EMITTED}, lab AS ({LABELS}), d AS (SELECT e.*, {_EXTRACTED} AS w FROM emitted e JOIN lab l USING (case_id)) SELECT count(*) AS n, round(50.0 * sum(w) / ({sum(fixed.FIELD_WEIGHTS.values())} * count(*)), 6) AS extraction, round(10.0 * avg({_PAY}), 6) AS classification, round(20.0 * greatest(0, 1 - 2 * avg(pow(confidence - {_HIT}, 2))), 6) AS calibration, round(50.0 * sum(w) / ({sum(fixed.FIELD_WEIGHTS.values())} * count(*)) + 10.0 * avg({_PAY}) + 20.0 * greatest(0, 1 - 2 * avg(pow(confidence - {_HIT}, 2))), 6) AS total, round(avg({_HIT}), 6) AS accuracy, round(avg(pow(confidence - {_HIT}, 2)), 6) AS brier, count(*) FILTER (truth = 'DENIED' AND adjudication = 'APPROVED') AS catastrophic FROM d",
    "wrong_decisions": f"{BEFORE} SELECT CASE WHEN adjudication = 'APPROVED' AND truth = 'DENIED' THEN 'cfa' ELSE 'confident' END AS folder, case_id, adjudication, round(confidence, 6) AS confidence, truth FROM guarded WHERE adjudication <> truth AND (adjudication = 'APPROVED' AND truth = 'DENIED' OR confidence >= 0.7)",
    "policy_on_gold": f"{BEFORE}, {_COUNTS}, {_GOLD} SELECT {_SCORE} FROM h",
    "align_truth": f"WITH {CASES}, s AS (SELECT case_id, home_world AS truth, unnest([translate(home_world, 'ae', 'o'), coalesce(species_code, ''), 'noise']) AS seen FROM cases WHERE home_world IS NOT NULL), b AS (SELECT case_id, truth, arg_min(seen, (levenshtein(truth, seen) / length(truth), seen)) AS seen, min(levenshtein(truth, seen) / length(truth)) AS ratio FROM s WHERE seen <> '' GROUP BY 1, 2) SELECT case_id, truth, seen, round(ratio, 6) AS ratio FROM b WHERE ratio <= 0.35",
    "margin_jumps": f"WITH m AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, x - lag(x) OVER w AS step, l_linenumber = lag(l_linenumber) OVER w + 1 AS touching FROM ({MARGINS}) q WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)), j AS (SELECT case_id, count(*) FILTER (touching AND abs(step) > 5 AND abs(step) < 150) AS jumps FROM m GROUP BY 1) SELECT *, jumps >= 2 AS shredded FROM j",
    "oof_total": f"{BEFORE}, {_FOLDS}, {_HELD}, z AS (SELECT fold, {_SCORE} FROM h GROUP BY fold) SELECT sum(n)::BIGINT AS n, round(sum(total * n) / sum(n), 4) AS total, sum(catastrophic)::BIGINT AS catastrophic FROM z",
    "page_clean": f"{SEEN}, {PAGES} SELECT case_id, page_no, length(trim(t)) > 60 AS clean FROM p",
    "find_value": f"SELECT doc_id, trim(list_filter(string_split_regex(text, '{_LINES}'), lambda x: contains(lower(regexp_replace(x, '\\s+', ' ', 'g')), 'all rights reserved'))[1]) AS line FROM documents",
    "top_confusions": FIT_ORACLES["confusion_rates"] + " ORDER BY n DESC, a, b LIMIT 25",
}
