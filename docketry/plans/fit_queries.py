"""Fitting, scoring and output queries over the derived cases, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import emit, fit, policy
from ..session import table
from .fixtures import case_frame
from .policy_queries import decided, in_context, r6
from .policy_sql import BEFORE, CASES, CONFIDENCE, FEATURES, GAP, VERDICT
from .text_queries import sql_frame


def labelled(spark, sf_dir):
    return in_context(spark, sf_dir).withColumn("path", policy.decision_path())


def folded(spark, sf_dir):
    return fit.folds(labelled(spark, sf_dir).select("case_id", "path", "truth"))


def held_out(spark, sf_dir):
    scored = folded(spark, sf_dir)
    return fit.held_out_decisions(scored, fit.fold_calibration(scored))


def score_rows(df, *group):
    names = ("extraction", "classification", "calibration", "total", "accuracy", "brier")
    return df.select(*group, "n", *r6(*names), "catastrophic")


def modes(spark, sf_dir):
    cases = case_frame(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("species_code", "home_world", "visa_class", "fee_status")])
    values = cases.select("k", F.explode(kinds).alias("v")).where("v.value is not null").select("v.field", "v.value", F.col("k").alias("ordinal"))
    return fit.prior_modes(values)


def gates(spark, sf_dir):
    return fit.gate_search(labelled(spark, sf_dir).where(F.col("path").isin(*fixed.NO_APPROVAL)))


def moments(spark, sf_dir):
    vectors = in_context(spark, sf_dir).select(*[c.alias(n) for c, n in zip(policy.feature_columns(), fixed.FEATURES)])
    return fit.standardize(vectors, fixed.FEATURES).select("feature", *r6("mu", "sigma"))


def raw_rows(spark, sf_dir):
    return sql_frame(spark, sf_dir, RAW, "orders")


def first_lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("o"))
    return emit.first_per_case(items, "o").select("case_id", F.col("o.l_partkey").alias("part"))


def tail_fit(spark, sf_dir):
    provisional = spark.createDataFrame([("clean", 0.5, 0.25, 0.25), ("nowhere", 0.2, 0.2, 0.6)], "path string, p_a double, p_d double, p_r double")
    return fit.with_provisional(fit.fit_calibration(labelled(spark, sf_dir).select("path", "truth")), provisional)


RAW = "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE ' MIB-' || lpad(CAST(o_orderkey AS STRING), 6, '0') END AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Nexix Qorul ' END AS applicant_name, '' AS species_code, 'Luyten-b' AS home_world, CAST(NULL AS STRING) AS visa_class, CASE WHEN o_orderkey % 3 = 0 THEN 'SPN-12' ELSE 'SPN-0012' END AS sponsor_id, CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE '2026-01-02' END AS arrival_date, 'research' AS declared_purpose, CASE WHEN o_orderkey % 5 = 0 THEN 'biohazard_red| active_warrant|zz|biohazard_red' END AS risk_flags, CASE WHEN o_orderkey % 6 = 0 THEN 'PAID' ELSE 'paid' END AS fee_status, CASE WHEN o_orderkey % 7 = 0 THEN 'approved' ELSE 'maybe' END AS adjudication, CASE WHEN o_orderkey % 8 = 0 THEN 'x' WHEN o_orderkey % 8 = 1 THEN '7' ELSE '0.25' END AS confidence FROM orders"
TOKENS = "(VALUES " + ", ".join(f"('{t}')" for t in fixed.NAMES) + ") t(token)"

QUERIES = {
    "clamp_rows": lambda s, d: emit.clamp(raw_rows(s, d)),
    "apply_priors": lambda s, d: emit.apply_priors(raw_rows(s, d)).select("case_id", "species_code", "visa_class", "fee_status", "risk_flags"),
    "dedup_first": first_lines,
    "calibration_fit": lambda s, d: fit.fit_calibration(labelled(s, d).select("path", "truth")).select("path", *r6("p_a", "p_d", "p_r")),
    "calibration_provisional": lambda s, d: tail_fit(s, d).select("path", *r6("p_a", "p_d", "p_r")),
    "path_histogram": lambda s, d: labelled(s, d).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "path").limit(10),
    "confusion_matrix": lambda s, d: decided(s, d).groupBy("truth", "adjudication").agg(F.count("*").alias("n")),
    "score_summary": lambda s, d: score_rows(fit.score(decided(s, d))),
    "oof_folds": lambda s, d: folded(s, d).select("case_id", F.col("fold").cast("long").alias("fold")),
    "oof_score": lambda s, d: score_rows(fit.score(held_out(s, d), "fold").withColumn("fold", F.col("fold").cast("long")), "fold"),
    "prior_modes": modes,
    "standardize": moments,
    "gate_search": gates,
    "name_factor": lambda s, d: fit.name_factors(s.createDataFrame([(t,) for t in fixed.NAMES], "token string")),
    "confusion_rates": lambda s, d: fit.confusion_rates(case_frame(s, d).where("species_code is not null").select(F.col("species_code").alias("truth"), F.translate("species_code", "OS", "05").alias("seen"))),
    "resolver_fit": lambda s, d: fit.fit_resolver(fit.folds(in_context(s, d).select("case_id", "truth", *[((c - m) / sd).alias(n) for c, n, m, sd in zip(policy.feature_columns(), fixed.FEATURES, fixed.MU, fixed.SIGMA)])), fixed.FEATURES),
}

_COUNTS = "c AS (SELECT path, count(*) FILTER (truth = 'APPROVED') AS a, count(*) FILTER (truth = 'DENIED') AS d, count(*) FILTER (truth = 'NEEDS_REVIEW') AS r, count(*) AS n FROM paths GROUP BY 1)"
_FIT = "fitted AS (SELECT path, (a + 1.0) / (n + 3) AS p_a, (d + 1.0) / (n + 3) AS p_d, (r + 1.0) / (n + 3) AS p_r FROM c WHERE n >= 8)"
_R6 = "round(p_a, 6) AS p_a, round(p_d, 6) AS p_d, round(p_r, 6) AS p_r"
_PAY = "CASE adjudication " + " ".join(f"WHEN '{o}' THEN CASE truth " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in zip(fixed.OUTCOMES, points)) + " END" for o, points in fixed.PAYOFF.items()) + " END"
_HIT = "(adjudication = truth)::INT"
_SCORE = f"count(*) AS n, 0.0::DOUBLE AS extraction, round(10.0 * avg({_PAY}), 6) AS classification, round(20.0 * greatest(0, 1 - 2 * avg(pow(confidence - {_HIT}, 2))), 6) AS calibration, round(10.0 * avg({_PAY}) + 20.0 * greatest(0, 1 - 2 * avg(pow(confidence - {_HIT}, 2))), 6) AS total, round(avg({_HIT}), 6) AS accuracy, round(avg(pow(confidence - {_HIT}, 2)), 6) AS brier, count(*) FILTER (truth = 'DENIED' AND adjudication = 'APPROVED') AS catastrophic"
_FOLDS = "f AS (SELECT case_id, path, truth, (row_number() OVER (ORDER BY case_id) - 1) % 5 AS fold FROM paths)"
_HELD = f"""t AS (SELECT k.fold, f.path, count(*) FILTER (truth = 'APPROVED') AS a, count(*) FILTER (truth = 'DENIED') AS d, count(*) FILTER (truth = 'NEEDS_REVIEW') AS r, count(*) AS n FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY 1, 2),
o AS (SELECT f.*, NOT {GAP.replace('path', 'f.path', 1)} AS allow, coalesce((a + 1.0) / (n + 3), 0.2) AS p_a, coalesce((d + 1.0) / (n + 3), 0.2) AS p_d, coalesce((r + 1.0) / (n + 3), 0.6) AS p_r FROM f LEFT JOIN t ON t.fold = f.fold AND t.path = f.path AND n >= 8),
h AS (SELECT *, verdict AS adjudication, {CONFIDENCE} AS confidence FROM (SELECT *, {VERDICT} AS verdict FROM o) v)"""
_FIELDS = ("species_code", "home_world", "visa_class", "fee_status")
_CUT = "cuts AS (SELECT token, c AS cut, lower(substr(token, 1, c)) AS stem, lower(substr(token, c + 1)) AS suffix FROM toks, (VALUES (2), (3), (4), (5)) v(c) WHERE length(token) > c)"
_MOMENTS = " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg(x[{i + 1}]), 6) AS mu, round(CASE WHEN stddev_pop(x[{i + 1}]) < 1e-9 THEN 1.0 ELSE stddev_pop(x[{i + 1}]) END, 6) AS sigma FROM vectors" for i, n in enumerate(fixed.FEATURES))
assert len(FEATURES) == len(fixed.FEATURES)

ORACLES = {
    "clamp_rows": f"SELECT trim(case_id) AS case_id, coalesce(nullif(trim(applicant_name), ''), 'unknown') AS applicant_name, 'unknown' AS species_code, home_world, 'unknown' AS visa_class, CASE WHEN sponsor_id = 'SPN-0012' THEN sponsor_id ELSE 'SPN-0000' END AS sponsor_id, CASE WHEN arrival_date = 'soon' THEN '1900-01-01' ELSE arrival_date END AS arrival_date, declared_purpose, CASE WHEN risk_flags IS NULL THEN 'none' ELSE 'active_warrant|biohazard_red' END AS risk_flags, CASE WHEN fee_status = 'paid' THEN 'paid' ELSE 'unknown' END AS fee_status, CASE WHEN adjudication = 'approved' THEN 'APPROVED' ELSE 'NEEDS_REVIEW' END AS adjudication, CASE confidence WHEN 'x' THEN 0.5 WHEN '7' THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence FROM ({RAW}) r WHERE case_id <> 'bad'",
    "apply_priors": f"SELECT case_id, 'TRIANGULAN' AS species_code, 'MED-3' AS visa_class, fee_status, coalesce(risk_flags, 'none') AS risk_flags FROM ({RAW}) r",
    "dedup_first": "SELECT CAST(l_orderkey AS VARCHAR) AS case_id, arg_min(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_quantity)) AS part FROM lineitem GROUP BY 1",
    "calibration_fit": f"{BEFORE}, {_COUNTS}, {_FIT} SELECT path, {_R6} FROM fitted",
    "calibration_provisional": f"{BEFORE}, {_COUNTS}, {_FIT} SELECT path, {_R6} FROM fitted UNION ALL SELECT 'nowhere', 0.2, 0.2, 0.6",
    "path_histogram": f"{BEFORE} SELECT path, count(*) AS n FROM paths GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "confusion_matrix": f"{BEFORE} SELECT truth, verdict AS adjudication, count(*) AS n FROM decided GROUP BY 1, 2",
    "score_summary": f"{BEFORE} SELECT {_SCORE} FROM (SELECT *, verdict AS adjudication FROM decided) d",
    "oof_folds": f"{BEFORE}, {_FOLDS} SELECT case_id, fold FROM f",
    "oof_score": f"{BEFORE}, {_FOLDS}, {_HELD} SELECT fold, {_SCORE} FROM h GROUP BY fold",
    "prior_modes": f"WITH {CASES}, v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, k FROM cases WHERE {f} IS NOT NULL" for f in _FIELDS) + "), c AS (SELECT field, value, count(*) AS n, min(k) AS first FROM v GROUP BY 1, 2) SELECT field, arg_max(value, (n, -first)) AS value, round(max(n) / sum(n), 3) AS rate FROM c GROUP BY 1",
    "standardize": f"{BEFORE} {_MOMENTS}",
    "name_factor": f"WITH toks AS (SELECT token FROM {TOKENS}), {_CUT}, s AS (SELECT cut, stem FROM cuts GROUP BY 1, 2 HAVING count(*) > 1), x AS (SELECT cut, suffix FROM cuts GROUP BY 1, 2 HAVING count(*) > 1), b AS (SELECT arg_max(cut, (n, -cut)) AS cut FROM (SELECT cut, count(*) AS n FROM cuts JOIN s USING (cut, stem) JOIN x USING (cut, suffix) GROUP BY 1) g) SELECT 'stem' AS part, stem AS text FROM s JOIN b USING (cut) UNION ALL SELECT 'suffix', suffix FROM x JOIN b USING (cut)",
    "confusion_rates": f"WITH {CASES}, l AS (SELECT unnest(string_split(species_code, '')) AS a FROM cases WHERE species_code IS NOT NULL) SELECT a, CASE a WHEN 'O' THEN '0' ELSE '5' END AS b, count(*) AS n, 1.0::DOUBLE AS rate FROM l WHERE a IN ('O', 'S') GROUP BY 1",
}
