"""From decisions to rows that hold the output contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import joined_flags


def output_rows(df: DataFrame) -> DataFrame:
    """The twelve output fields; NULL becomes the sentinel, flags are sorted and joined."""
    text = [F.coalesce(c, F.lit(fixed.UNKNOWN)).alias(c) for c in fixed.OUTPUT_FIELDS[1:8]]
    return df.select("case_id", *text, joined_flags(F.col("risk_flags")).alias("risk_flags"), F.coalesce("fee_status", F.lit(fixed.UNKNOWN)).alias("fee_status"), "adjudication", "confidence")


def apply_priors(df: DataFrame, priors: dict[str, str] | None = None) -> DataFrame:
    """Values for blank, unknown or none fields only."""
    filled = {}
    for field, value in (fixed.PRIORS if priors is None else priors).items():
        own = F.lower(F.trim(F.coalesce(field, F.lit(""))))
        filled[field] = F.when(own.isin("") if field == "risk_flags" else own.isin("", fixed.UNKNOWN, "none"), F.lit(value)).otherwise(F.col(field))
    return df.withColumns(filled)


def clamp(df: DataFrame) -> DataFrame:
    """Rows that hold the contract: bad ids go, other bad values become the field's sentinel."""
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    plain = {c: F.when(clean(c) == "", fixed.UNKNOWN).otherwise(clean(c)) for c in ("applicant_name", "species_code", "home_world", "visa_class", "declared_purpose")}
    fits = lambda c, pattern: F.when(clean(c).rlike(pattern), clean(c)).otherwise(fixed.BLANKS[c])
    flags = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(clean("risk_flags"), r"\|"), lambda f: F.trim(f)), lambda f: f.isin(*fixed.FLAGS))))
    verdict = F.upper(clean("adjudication"))
    number = F.col("confidence").try_cast("double")
    confidence = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan(number), number), F.lit(0.5)))), 4)
    out = {
        "case_id": clean("case_id"),
        **plain,
        "sponsor_id": fits("sponsor_id", r"^SPN-[0-9]{4}$"),
        "arrival_date": fits("arrival_date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "risk_flags": F.when(F.size(flags) > 0, F.array_join(flags, "|")).otherwise("none"),
        "fee_status": F.when(clean("fee_status").isin(*fixed.FEES), clean("fee_status")).otherwise(fixed.UNKNOWN),
        "adjudication": F.when(verdict.isin(*fixed.OUTCOMES), verdict).otherwise(fixed.NEEDS_REVIEW),
        "confidence": confidence,
    }
    return df.where(clean("case_id").rlike(r"^MIB-[0-9]{6}$")).select(*[out[c].alias(c) for c in fixed.OUTPUT_FIELDS])


def first_per_case(df: DataFrame, order: Column | str) -> DataFrame:
    """The first row of each case in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("case_id").orderBy(order))).where("_n = 1").drop("_n")
