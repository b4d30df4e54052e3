"""Stamps and cancelling strokes from vector drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import classify_color


def read_marks(drawings: DataFrame) -> DataFrame:
    """drawings (case_id, page_no, mark_no, color, fill, rect) -> + color name, verdict, is_strike; drawings of no stamp colour go."""
    rgb = F.coalesce(F.when(F.size("color") > 0, F.col("color")), F.col("fill"))
    name = F.when(F.size(rgb) >= 3, classify_color(F.get(rgb, F.lit(0)), F.get(rgb, F.lit(1)), F.get(rgb, F.lit(2))))
    wide, high = F.col("rect.x1") - F.col("rect.x0"), F.col("rect.y1") - F.col("rect.y0")
    strike = (F.least(wide, high) < 3.0) & (F.greatest(wide, high) >= 40.0)
    verdict = F.when(F.col("ink") == "GREEN", fixed.APPROVED).when(F.col("ink") == "BLUE", fixed.NEEDS_REVIEW).otherwise(fixed.DENIED)
    named = drawings.withColumn("ink", name).where("ink is not null and rect is not null")
    return named.select("case_id", "page_no", "mark_no", "ink", verdict.alias("verdict"), "rect", strike.alias("is_strike"))


def live_stamps(marks: DataFrame) -> DataFrame:
    """Stamps that no stroke of their page crosses: an equality join on the page, then the overlap, as an anti join."""
    stamps, strikes = marks.where("not is_strike").alias("s"), marks.where("is_strike").alias("k")
    c = F.col
    crossed = (
        (c("s.case_id") == c("k.case_id"))
        & (c("s.page_no") == c("k.page_no"))
        & (F.least(c("s.rect.x1"), c("k.rect.x1")) > F.greatest(c("s.rect.x0"), c("k.rect.x0")))
        & (F.least(c("s.rect.y1"), c("k.rect.y1")) > F.greatest(c("s.rect.y0"), c("k.rect.y0")))
    )
    return stamps.join(strikes, crossed, "left_anti")


def stamp_verdicts(marks: DataFrame) -> DataFrame:
    """(case_id, stamp_verdict, stamp_weight, stamp_contested): the one verdict of the live stamps; contested if stamps stand but give none."""
    live = live_stamps(marks).groupBy("case_id").agg(F.min("verdict").alias("lo"), F.max("verdict").alias("hi"))
    cases = marks.where("not is_strike").select("case_id").distinct().join(live, "case_id", "left")
    verdict = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    weight = F.when(verdict == fixed.DENIED, 0.85).when(verdict.isNotNull(), 0.97)
    return cases.select("case_id", verdict.alias("stamp_verdict"), weight.alias("stamp_weight"), verdict.isNull().alias("stamp_contested"))
