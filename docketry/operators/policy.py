"""From evidence to decisions: the ordered path cascade, expected value under the payoff, the resolver, the guardrail.

Fields are NULL where nothing trusted was read; `fee_explicit_unknown` tells a printed "unknown".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

KEY_COLUMNS = ("applicant_name", "species_code", "home_world", "visa_class", "sponsor_id", "arrival_date", "declared_purpose", "fee_status")


def flags_in(values) -> Column:
    return F.array_intersect("risk_flags", F.array(*[F.lit(v) for v in values]))


def staleness() -> Column:
    """TRUE, FALSE, or NULL where either date is missing or invalid."""
    return F.datediff(F.try_to_date("receipt_date", "yyyy-MM-dd"), F.try_to_date("arrival_date", "yyyy-MM-dd")) > fixed.STALE_DAYS


def decision_path() -> Column:
    """The first rule that holds; present evidence is asked before missing evidence."""
    c = F.col
    finding = F.when(c("manual_finding").isin(*fixed.OUTCOMES), c("manual_finding"))
    stamp = F.when(c("stamp_verdict").isin(*fixed.OUTCOMES), c("stamp_verdict"))
    visa_known, dip = c("visa_class").isNotNull(), F.coalesce(c("visa_class") == "DIP-1", F.lit(False))
    n_review = F.size(flags_in(fixed.REVIEW))
    stale = staleness()
    revoked = c("sponsor_id").isin(*fixed.REVOKED) | c("sponsor_revoked_in_corpus")
    return (
        F.when(finding != stamp, "adjudicator_conflict")
        .when(finding.isNotNull(), F.concat(F.lit("manual_"), F.lower(finding)))
        .when(stamp.isNotNull(), F.concat(F.lit("stamp_"), F.lower(stamp)))
        .when(c("stamp_contested"), "stamp_contested")
        .when(c("visa_class") == "TRANSIT-7", "transit_7")
        .when(F.size(flags_in(fixed.DISQUALIFYING)) > 0, "disqualifying_flag")
        .when((c("fee_status") == "unpaid") & ~c("has_hardship_waiver"), "fee_unpaid")
        .when(c("registry_status").contains("EMBARGO"), "registry_embargo")
        .when(c("home_world").isin(*fixed.EMBARGOED) & visa_known & ~dip, "embargoed_home_world")
        .when(visa_known & ~dip & c("sponsor_id").isNotNull() & revoked, F.when(c("has_approval_override"), "sponsor_revoked_override").otherwise("sponsor_revoked"))
        .when(n_review > 1, "review_flags_multi")
        .when(n_review == 1, "review_flags")
        .when((c("fee_status") == "waived") & visa_known & ~dip, "fee_waived_unjustified")
        .when(c("fee_explicit_unknown"), "fee_stated_unknown")
        .when(stale & dip & c("has_diplomatic_note"), "stale_dip_exempt")
        .when(stale, "stale_arrival")
        .when(c("arrival_date_untrusted"), "arrival_date_untrusted")
        .when(c("arrival_date").isNull(), "arrival_date_unknown")
        .when(~visa_known, "visa_unknown")
        .when(~dip & c("sponsor_id").isNull(), "sponsor_unknown")
        .when(~c("risk_flags_known") & c("has_scanned_pages"), F.when(c("visa_class") == "MED-3", "risk_page_unreadable_med").otherwise("risk_page_unreadable"))
        .when(~c("risk_flags_known"), "risk_page_absent")
        .when(c("fee_status").isNull(), "fee_unknown")
        .when(stale.isNull(), "staleness_indeterminate")
        .when(c("injection_detected"), "clean_injection_seen")
        .otherwise("clean")
    )


def bound(values: dict[str, Column], body) -> Column:
    """body(struct of values): a value is written once however often the body asks for it, also when filters are pushed below."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body)[0]


def with_choice(df: DataFrame, odds: tuple[str, str, str], allow_approval: Column) -> DataFrame:
    """+ adjudication, confidence: the choice of most expected points, ties to the first; approvals only with a margin over denial."""

    def choose(s):
        a, d, r = s["a"], s["d"], s["r"]
        may = s["allow"] & (s["p0"] >= fixed.APPROVAL_MARGIN * s["p1"]) & (a >= d) & (a >= r)
        told = lambda verdict, p: F.struct(F.lit(verdict).alias("adjudication"), p.alias("confidence"))
        return F.when(may, told(fixed.APPROVED, s["p0"])).when(d >= r, told(fixed.DENIED, s["p1"])).otherwise(told(fixed.NEEDS_REVIEW, s["p2"]))

    def weigh(s):
        worth = {k: sum((F.lit(float(x)) * s[f"p{i}"] for i, x in enumerate(fixed.PAYOFF[o])), F.lit(0.0)) for k, o in zip("adr", fixed.OUTCOMES)}
        return bound({**{f"p{i}": s[f"p{i}"] for i in range(3)}, **worth, "allow": s["allow"]}, choose)

    choice = bound({**{f"p{i}": F.col(p) for i, p in enumerate(odds)}, "allow": allow_approval}, weigh)
    return df.withColumn("_choice", choice).withColumns({c: F.col(f"_choice.{c}") for c in ("adjudication", "confidence")}).drop("_choice")


def feature_columns() -> list[Column]:
    """The resolver's features as doubles, in order."""
    c = F.col
    known = lambda name: c(name).isNotNull()
    is_ = lambda name, value: F.coalesce(c(name) == value, F.lit(False))
    flags = [
        is_("fee_status", "paid"), is_("fee_status", "waived"), known("fee_status"), is_("registry_status", "CLEAR"), F.coalesce(c("registry_status") != "", F.lit(False)),
        known("visa_class"), is_("visa_class", "DIP-1"), is_("visa_class", "MED-3"), is_("visa_class", "TRANSIT-7"), known("sponsor_id"), known("applicant_name"),
        known("species_code"), known("home_world"), known("arrival_date"), known("declared_purpose"), c("risk_flags_known"), c("has_scanned_pages"), c("injection_detected"),
    ]
    rest = [F.size("missing_fields"), c("pages"), c("ocr_mean_confidence") / 100.0, c("has_hardship_waiver")]
    return [x.cast("double") for x in (*flags, *rest)]


def with_softmax(df: DataFrame, x: list[Column], mu, sigma, weights, bias, *, prefix="q") -> DataFrame:
    """+ prefix_a, prefix_d, prefix_r: odds of a multinomial logistic model on standardised features. The logits are plain arithmetic on doubles."""
    logits = {}
    for k, name in enumerate("adr"):
        logits[name] = F.lit(float(bias[k]))
        for c, m, s, row in zip(x, mu, sigma, weights):
            logits[name] = logits[name] + (c - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(row[k]))
    powers = lambda s: bound({k: F.exp(s[k] - F.greatest(s["a"], s["d"], s["r"])) for k in "adr"}, lambda e: F.struct(*[(e[k] / (e["a"] + e["d"] + e["r"])).alias(k) for k in "adr"]))
    return df.withColumn("_odds", bound(logits, powers)).withColumns({f"{prefix}{k}": F.col(f"_odds.{k}") for k in "adr"}).drop("_odds")


def missing_fields() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in KEY_COLUMNS]))


def calibration_frame(spark, table: dict | None = None) -> DataFrame:
    rows = [(path, *map(float, odds)) for path, odds in (table or fixed.CALIBRATION).items()]
    return spark.createDataFrame(rows, "path string, p_a double, p_d double, p_r double")


def with_odds(df: DataFrame, calibration: DataFrame) -> DataFrame:
    """+ p_a, p_d, p_r of the path; a path that is not there gets the fallback. The table has a row a path: it is broadcast."""
    joined = df.join(F.broadcast(calibration), "path", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(("p_a", "p_d", "p_r"), fixed.FALLBACK)})


def adjudicate(evidence: DataFrame, calibration: DataFrame, *, use_resolver: bool = True) -> DataFrame:
    """+ path, adjudication, confidence. Paths that rest on gaps ask the resolver, which may deny or send to review only."""
    df = with_odds(evidence.withColumn("path", decision_path()), calibration).withColumn("_gap", F.col("path").isin(*fixed.NO_APPROVAL))
    if use_resolver:
        df = with_softmax(df, feature_columns(), fixed.MU, fixed.SIGMA, fixed.WEIGHTS, fixed.BIAS, prefix="_q")
        df = df.withColumns({p: F.when(F.col("_gap"), F.col(q)).otherwise(F.col(p)) for p, q in (("p_a", "_qa"), ("p_d", "_qd"), ("p_r", "_qr"))}).drop("_qa", "_qd", "_qr")
    return with_choice(df, ("p_a", "p_d", "p_r"), ~F.col("_gap")).drop("_gap", "p_a", "p_d", "p_r")


def guardrail(df: DataFrame) -> DataFrame:
    """Demotes approvals that the emitted fields contradict; never approves, and a manual finding outranks it."""
    c = F.col
    not_dip = F.coalesce(c("visa_class") != "DIP-1", F.lit(True))
    deny = lambda p: F.struct(F.lit(fixed.DENIED).alias("v"), F.lit(p).alias("p"))
    review = F.struct(F.lit(fixed.NEEDS_REVIEW).alias("v"), F.lit(0.85).alias("p"))
    demotion = (
        F.when(c("manual_finding").isin(*fixed.OUTCOMES) | (c("adjudication") != fixed.APPROVED), F.lit(None))
        .when(F.size(flags_in(fixed.DISQUALIFYING)) > 0, deny(0.95))
        .when(c("visa_class") == "TRANSIT-7", deny(0.94))
        .when(c("sponsor_id").isin(*fixed.REVOKED) & not_dip, deny(0.94))
        .when(c("home_world").isin(*fixed.EMBARGOED) & not_dip, deny(0.94))
        .when((c("fee_status") == "unpaid") & ~c("has_hardship_waiver"), deny(0.94))
        .when(F.size(flags_in(fixed.REVIEW)) > 0, review)
        .when(c("fee_status").isNull(), review)
    )
    df = df.withColumn("_d", demotion)
    return df.withColumns({"adjudication": F.coalesce("_d.v", "adjudication"), "confidence": F.coalesce("_d.p", "confidence")}).drop("_d")
