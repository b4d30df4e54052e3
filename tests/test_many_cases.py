"""From a million orders on, case ids are shared: the queries keep cases apart where their SQL does."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from docketry.operators import review
from docketry.plans import catalog

from .conftest import SF
from .test_oracles import rows


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """The smallest tables twice, with keys whose first six digits are the same."""
    where = str(tmp_path_factory.mktemp("shared"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        df = spark.read.parquet(f"{SF}/{name}.parquet").where(F.col(key) < 300)
        moved = [df.withColumn(key, F.col(key) + by) for by in (100_000, 1_000_000)]
        moved[0].unionByName(moved[1]).coalesce(1).write.parquet(f"{where}/{name}.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").coalesce(1).write.parquet(f"{where}/customer.parquet")
    return where


def assert_equals_sql(spark, name, where):
    found = catalog.queries()[name](spark, where)
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
    wanted = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, wanted.fetchall())


@pytest.mark.parametrize("name", ["next_line_value", "label_values", "evidence"])
def test_shared_case_ids(spark, shared_ids, name):
    assert_equals_sql(spark, name, shared_ids)


def test_triage_pairs_nothing_within_a_case(spark):
    """400 pages, labels and rows of evidence of one case id: paired, they would be 64 million rows a field."""
    n = 400
    evidence = spark.range(n).select(F.lit("a").alias("case_id"), *[F.concat(F.lit("v"), F.col("id") % 3).alias(f) for f in review.SOUGHT], (F.col("id") > 0).alias("risk_flags_known"))
    labels = spark.range(n).select(F.lit("a").alias("case_id"), *[F.concat(F.lit(" W "), F.col("id")).alias(f) for f in review.SOUGHT], F.lit("none").alias("risk_flags"))
    line = F.concat(F.lit("Seen:  w\t"), F.col("id"), F.lit(" end"))
    pages = spark.range(n).select(F.lit("a").alias("case_id"), F.col("id").cast("int").alias("page_no"), F.concat_ws("\n", F.lit("x" * 70), line, F.lit("w")).alias("visible"), F.lit(True).alias("has_image"))
    started = time.time()
    got = {(r["field"], r["want"]): (r["class"], r["page_no"], r["line"]) for r in review.triage(review.distinct_misses(evidence, labels), pages).collect()}
    first = lambda k: min(i for i in range(n) if str(i).startswith(str(k)))
    want = {(f, f"W {k}"): ("parser_gap", first(k), f"Seen:  w\t{first(k)} end") for f in review.SOUGHT for k in range(n)}
    assert got == want | {("risk_flags", "none"): ("redundant", None, None)} and time.time() - started < 60


def test_distinct_misses_are_those_of_the_pairs(spark):
    fields = ", ".join(f"{f} string" for f in review.SOUGHT)
    make = lambda case, flags, *v: (case, *[x for x in (v * 8)[:8]], flags)
    evidence = spark.createDataFrame([make("a", True, "x", None), make("a", False, "X", "y"), make("b", None, None, "unknown"), make("d", False, "q")], f"case_id string, {fields}, risk_flags_known boolean")
    labels = spark.createDataFrame([make("a", " none ", "x", "Y"), make("a", None, " ", None), make("b", "f", "unknown ", "z"), make("c", "f", "z")], f"case_id string, {fields}, risk_flags string")
    paired = review.missing_values(review.against_labels(evidence, labels)).distinct()
    assert sorted(map(tuple, review.distinct_misses(evidence, labels).collect())) == sorted(map(tuple, paired.collect())) != []
