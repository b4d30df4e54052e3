"""Policy queries over the derived cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, emit, policy
from .fixtures import case_frame


def in_context(spark, sf_dir):
    cases = case_frame(spark, sf_dir)
    return corpus.apply_context(cases, corpus.reference_date(cases), corpus.outlier_sponsors(cases))


def decided(spark, sf_dir):
    return policy.adjudicate(in_context(spark, sf_dir), policy.calibration_frame(spark))


def emitted(spark, sf_dir):
    """Guardrail before priors, so a guess never reaches the policy; then the clamp."""
    return emit.clamp(emit.apply_priors(emit.output_rows(policy.guardrail(decided(spark, sf_dir)))))


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def overlap(spark, sf_dir):
    found = in_context(spark, sf_dir)
    return found.select("case_id", F.arrays_overlap("risk_flags", F.array(*map(F.lit, policy.fixed.DISQUALIFYING))).alias("disqualifying"), F.size(policy.flags_in(policy.fixed.REVIEW)).cast("long").alias("n_review"))


def path_odds(spark, sf_dir):
    paths = in_context(spark, sf_dir).select("case_id", policy.decision_path().alias("path"))
    return policy.with_odds(paths, policy.calibration_frame(spark)).select("case_id", "path", *r6("p_a", "p_d", "p_r"))


def table_decisions(spark, sf_dir):
    chosen = policy.with_choice(policy.calibration_frame(spark), ("p_a", "p_d", "p_r"), ~F.col("path").isin(*policy.fixed.NO_APPROVAL))
    return chosen.select("path", F.col("adjudication").alias("verdict"), *r6("confidence"))


def vectors(spark, sf_dir):
    return in_context(spark, sf_dir).select("case_id", F.array(*policy.feature_columns()).alias("x"))


def resolver(spark, sf_dir):
    odds = policy.with_softmax(in_context(spark, sf_dir), policy.feature_columns(), policy.fixed.MU, policy.fixed.SIGMA, policy.fixed.WEIGHTS, policy.fixed.BIAS)
    return odds.select("case_id", *[F.round(f"q{k}", 6).alias(n) for k, n in zip("adr", ("p_approved", "p_denied", "p_review"))])


QUERIES = {
    "corpus_reference_date": lambda s, d: corpus.reference_date(case_frame(s, d)),
    "corpus_outliers": lambda s, d: corpus.outlier_sponsors(case_frame(s, d)),
    "corpus_context": lambda s, d: in_context(s, d).select("case_id", "receipt_date", "sponsor_revoked_in_corpus"),
    "staleness": lambda s, d: in_context(s, d).select("case_id", F.coalesce(policy.staleness().cast("string"), F.lit("unknown")).alias("stale")),
    "flag_overlap": overlap,
    "decision_path": lambda s, d: in_context(s, d).select("case_id", policy.decision_path().alias("path")),
    "path_calibration": path_odds,
    "ev_decide": table_decisions,
    "feature_vector": lambda s, d: vectors(s, d).select("case_id", F.array_join(F.transform("x", lambda v: F.round(v * 100).cast("long").cast("string")), ",").alias("features")),
    "resolver_softmax": resolver,
    "adjudicate": lambda s, d: decided(s, d).select("case_id", "path", "adjudication", *r6("confidence")),
    "guardrail": lambda s, d: policy.guardrail(decided(s, d)).select("case_id", "adjudication", *r6("confidence")),
    "full_pipeline": emitted,
}
