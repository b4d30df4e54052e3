"""Labels, evidence and policy files, and the output sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

EVIDENCE = (
    "case_id string, applicant_name string, species_code string, home_world string, visa_class string, sponsor_id string, arrival_date string, declared_purpose string, "
    "fee_status string, risk_flags array<string>, receipt_date string, registry_status string, manual_finding string, stamp_verdict string, has_hardship_waiver boolean, "
    "has_diplomatic_note boolean, stamp_contested boolean, has_approval_override boolean, arrival_date_untrusted boolean, fee_explicit_unknown boolean, injection_detected boolean, "
    "documented_damage boolean, risk_flags_known boolean, has_scanned_pages boolean, sponsor_revoked_in_corpus boolean, manual_finding_score double, missing_fields array<string>, "
    "ocr_mean_confidence double, pages int"
)
LABELS = "case_id string, applicant_name string, species_code string, home_world string, visa_class string, sponsor_id string, arrival_date string, declared_purpose string, risk_flags string, fee_status string, adjudication string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS).option("header", True).csv(path)


def evidence_from_labels(labels: DataFrame) -> DataFrame:
    """Gold rows as evidence: sentinels become NULL, flags an array, what labels do not say its default."""
    known = lambda c: F.when(~F.lower(F.trim(c)).isin("", fixed.UNKNOWN), F.trim(c))
    flags = F.filter(F.split(F.lower(F.trim(F.coalesce("risk_flags", F.lit("")))), r"\|"), lambda f: ~f.isin("", "none"))
    row = labels.select("case_id", *[known(c).alias(c) for c in fixed.LABELS if c != "risk_flags"], flags.alias("risk_flags"), F.lower("fee_status").alias("_fee"), F.col("adjudication").alias("truth"))
    defaults = {c: F.lit(False) for c in ("has_hardship_waiver", "has_diplomatic_note", "stamp_contested", "has_approval_override", "arrival_date_untrusted", "injection_detected", "documented_damage", "has_scanned_pages", "sponsor_revoked_in_corpus")}
    nulls = {c: F.lit(None).cast("string") for c in ("receipt_date", "registry_status", "manual_finding", "stamp_verdict")}
    return row.withColumns({**defaults, **nulls, "fee_explicit_unknown": F.col("_fee") == fixed.UNKNOWN, "risk_flags_known": F.lit(True), "missing_fields": F.array().cast("array<string>"), "ocr_mean_confidence": F.lit(0.0), "pages": F.lit(0)}).drop("_fee")


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.write.mode("overwrite").parquet(path)


def read_evidence(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Evidence as Parquet, or JSON lines; an unread field may be written as the sentinel."""
    df = spark.read.schema(EVIDENCE).json(path) if lines else spark.read.schema(EVIDENCE).parquet(path)
    return df.withColumns({c: F.when(F.col(c) != fixed.UNKNOWN, F.col(c)) for c in fixed.LABELS if c != "risk_flags"})


def read_json(spark: SparkSession, path: str) -> dict:
    """A small policy file from any store Spark reads."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def load_calibration(spark: SparkSession, path: str) -> dict[str, tuple[float, float, float]]:
    """Raises if the file is missing or malformed: there is no deciding without it."""
    return {p: tuple(float(odds[o]) for o in fixed.OUTCOMES) for p, odds in read_json(spark, path)["paths"].items()}


def load_resolver(spark: SparkSession, path: str) -> dict | None:
    """None if the file is missing, malformed, or made for other features."""
    try:
        found = read_json(spark, path)
        if tuple(found["features"]) != fixed.FEATURES:
            return None
        return {k: found[k] for k in ("mu", "sigma", "weights", "bias")}
    except Exception:  # noqa: BLE001 - soft by contract
        return None


def load_priors(spark: SparkSession, path: str) -> dict[str, str]:
    try:
        return {field: prior["value"] for field, prior in read_json(spark, path).get("priors", {}).items()}
    except Exception:  # noqa: BLE001 - soft by contract
        return {}


def load_names(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(seen, generated but never seen) name tokens, each sorted; empty if the file is missing or malformed."""
    try:
        found = read_json(spark, path)
        seen = set(found.get("observed_tokens", ()))
        return tuple(sorted(seen)), tuple(sorted(set(found.get("generated", ())) - seen))
    except Exception:  # noqa: BLE001 - soft by contract
        return (), ()


def write_manifest(rows: DataFrame, path: str, *, limit: int | None = None) -> None:
    """A reviewer's list as CSV with a header, in the order of all its columns; `limit` rows where that is asked for."""
    ordered = rows.orderBy(*rows.columns)
    (ordered.limit(limit) if limit is not None else ordered).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """JSON lines, all or nothing by the commit protocol; no rows make an empty output."""
    rows.write.mode("overwrite").json(path)
