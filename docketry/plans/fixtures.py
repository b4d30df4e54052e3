"""Cases derived from the driver's tables, since those hold no case packets. One text for both engines: it only makes inputs."""

from __future__ import annotations

from ..functions import fixed


def pick(values, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def text_of(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


_FLAGS = [
    ("biohazard_red", "o_orderkey % 37 = 0"),
    ("active_warrant", "o_orderkey % 83 = 0"),
    ("identity_conflict", "n_returned >= 4"),
    ("sponsor_mismatch", "o_orderkey % 43 = 0"),
    ("illegible_biometrics", "o_orderkey % 86 = 0"),
]

#: flag columns are joined texts here, 'a|b' or NULL; booleans and dates are plain.
CASE_VIEW = f"""
SELECT k, case_id, truth, world_key, applicant_name, species_code, home_world, visa_class, sponsor_id,
       CASE WHEN k % 29 <> 0 THEN CAST(arrived AS STRING) END AS arrival_date, declared_purpose, fee_status, flag_text,
       CASE WHEN k % 3 <> 0 THEN CAST(arrived + CAST(k % 300 AS INT) AS STRING) END AS receipt_date,
       registry_status, manual_finding, stamp_verdict, has_hardship_waiver, has_diplomatic_note, stamp_contested,
       has_approval_override, arrival_date_untrusted, fee_explicit_unknown, injection_detected, risk_flags_known,
       has_scanned_pages, pages, ocr_mean_confidence
FROM (
  SELECT o_orderkey AS k, 'MIB-' || {text_of('o_orderkey', 6)} AS case_id,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'APPROVED' WHEN c_mktsegment = 'MACHINERY' THEN 'NEEDS_REVIEW' ELSE 'DENIED' END AS truth,
    c_nationkey AS world_key,
    CASE WHEN o_orderkey % 11 <> 0 THEN {pick(fixed.NAMES[:24], 'o_orderkey % 24')} || ' ' || {pick(fixed.NAMES[60:84], 'o_custkey % 24')} END AS applicant_name,
    CASE WHEN o_orderkey % 13 <> 0 THEN {pick(fixed.SPECIES, 'o_orderkey % 12')} END AS species_code,
    CASE WHEN o_orderkey % 17 <> 0 THEN {pick(fixed.WORLDS, 'c_nationkey % 13')} END AS home_world,
    CASE WHEN o_orderkey % 19 <> 0 THEN {pick(fixed.VISAS, "CAST(substr(o_orderpriority, 1, 1) AS INT) - 1")} END AS visa_class,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN {pick(fixed.REVOKED_MINED, 'CAST(floor(o_orderkey / 10) AS BIGINT) % 3')}
         ELSE 'SPN-' || {text_of('o_custkey % 10000', 4)} END AS sponsor_id,
    CAST(o_orderdate AS DATE) AS arrived,
    CASE WHEN o_orderkey % 31 <> 0 THEN {pick(fixed.PURPOSES, 'o_orderkey % 10')} END AS declared_purpose,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'paid' WHEN o_orderstatus = 'F' THEN 'unpaid' ELSE 'waived' END AS fee_status,
    nullif(concat_ws('|', {', '.join(f"CASE WHEN {when} THEN '{flag}' END" for flag, when in _FLAGS)}), '') AS flag_text,
    CASE WHEN o_orderkey % 47 = 0 THEN 'EMBARGO REVIEW' WHEN o_orderkey % 5 = 0 THEN 'CLEAR' END AS registry_status,
    CASE WHEN o_orderkey % 53 = 0 THEN {pick(fixed.OUTCOMES, 'o_orderkey % 3')} END AS manual_finding,
    CASE WHEN o_orderkey % 59 = 0 OR o_orderkey % 106 = 0 THEN {pick(fixed.OUTCOMES, '(o_orderkey + 1) % 3')} END AS stamp_verdict,
    o_orderkey % 8 = 0 AS has_hardship_waiver, o_orderkey % 9 = 0 AS has_diplomatic_note, o_orderkey % 61 = 0 AS stamp_contested,
    o_orderkey % 20 = 0 AS has_approval_override, o_orderkey % 67 = 0 AS arrival_date_untrusted, o_orderkey % 14 = 0 AS fee_explicit_unknown,
    o_orderkey % 71 = 0 AS injection_detected, o_orderkey % 6 <> 0 AS risk_flags_known, o_orderkey % 12 = 0 AS has_scanned_pages,
    CAST(n_lines AS INT) AS pages, CAST(50 + o_orderkey % 50 AS DOUBLE) AS ocr_mean_confidence
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey
) base
"""


def case_frame(spark, sf_dir, extra: str = "*"):
    """The evidence table: CASE_VIEW with flags as arrays and the missing fields."""
    from pyspark.sql import functions as F

    from ..operators.policy import missing_fields
    from ..session import table

    names = ("orders", "customer", "lineitem")
    df = spark.sql(CASE_VIEW.replace("FROM orders JOIN customer", "FROM {orders} AS o JOIN {customer} AS c").replace("FROM lineitem", "FROM {lineitem}"), **{n: table(spark, sf_dir, n) for n in names})
    flags = F.when(F.col("flag_text").isNull(), F.array().cast("array<string>")).otherwise(F.split("flag_text", r"\|"))
    return df.withColumn("risk_flags", flags).withColumn("sponsor_revoked_in_corpus", F.lit(False)).withColumn("missing_fields", missing_fields())
