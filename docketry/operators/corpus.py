"""Context from the whole corpus: the reference date and sponsors that are far too frequent.

Quantiles are by index, sorted[floor(q n)]. They are read off counts by value, so a hot value is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_at(counts: DataFrame, value: str, n: str, quantile: float) -> DataFrame:
    """One row: the value at index floor(quantile * sum n) of the sorted values, each n times; and the total."""
    run = F.sum(n).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    marked = counts.select(F.col(value).alias("value"), run.alias("run"), F.sum(n).over(Window.partitionBy()).alias("total"))
    return marked.where(F.col("run") > F.floor(F.col("total") * F.lit(quantile))).agg(F.min("value").alias("value"), F.max("total").alias("total"))


def reference_date(evidence: DataFrame, *, quantile=0.9, least=50) -> DataFrame:
    """One row, reference_date: NULL under `least` valid dates. Days are few, so the sort is over days."""
    days = evidence.select(F.try_to_date("arrival_date", "yyyy-MM-dd").alias("day")).where("day is not null")
    found = value_at(days.groupBy("day").agg(F.count("*").alias("n")), "day", "n", quantile)
    return found.select(F.when(F.col("total") >= least, F.date_format("value", "yyyy-MM-dd")).alias("reference_date"))


def outlier_sponsors(evidence: DataFrame, *, quantile=0.99, factor=4, least=400) -> DataFrame:
    """sponsor_id, n of sponsors more frequent than factor x the count at the quantile; none under `least` distinct sponsors."""
    counts = evidence.where("sponsor_id is not null").groupBy("sponsor_id").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("n").agg(F.count("*").alias("k"))
    edge = value_at(sizes, "n", "k", quantile).where(F.col("total") >= least).select((F.col("value") * factor).alias("edge"))
    return counts.join(F.broadcast(edge), F.col("n") > F.col("edge")).select("sponsor_id", "n")


def apply_context(evidence: DataFrame, reference: DataFrame, outliers: DataFrame) -> DataFrame:
    """Receipt dates default to the reference date; sponsors among the outliers are marked."""
    # one row, and at most a hundredth of the sponsors over a factor: the planner sees the size of the latter
    df = evidence.join(F.broadcast(reference)).withColumn("receipt_date", F.coalesce("receipt_date", "reference_date")).drop("reference_date")
    marked = outliers.select("sponsor_id", F.lit(True).alias("_revoked"))
    return df.join(marked, "sponsor_id", "left").withColumn("sponsor_revoked_in_corpus", F.coalesce("_revoked", F.lit(False))).drop("_revoked")
