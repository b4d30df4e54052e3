"""Labels and their value cells among recognised word boxes, in points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.distance import weighted_distance
from ..session import ship


def find_labels(words: DataFrame) -> DataFrame:
    """words (case_id, page_no, word_no, text, x0, y0, x1, y1) -> (case_id, page_no, field, x0, y0, x1, y1): the first run of a field's label tokens on one line of a page."""
    spark = words.sparkSession
    ship(spark)
    words = words.withColumn("_w", F.regexp_replace(F.lower("text"), "[^a-z]", ""))
    tokens = spark.createDataFrame(sorted({(t,) for own in fixed.CELL_LABELS.values() for t in own}), "token string")
    near = words.select("_w").where("_w <> ''").distinct().join(F.broadcast(tokens)).where(weighted_distance("_w", "token") / F.length("token") <= 0.34)
    near = near.groupBy("_w").agg(F.collect_set("token").alias("tokens"))
    page = Window.partitionBy("case_id", "page_no").orderBy("word_no")
    box = F.struct("x0", "y0", "x1", "y1")
    pairs = words.join(near, "_w", "left").withColumns({"n_tokens": F.lead("tokens").over(page), "a": box, "b": F.lead(box).over(page)})
    hits = [F.when(F.array_contains("tokens", first) & F.array_contains("n_tokens", second), F.lit(field)) for field, (first, second) in fixed.CELL_LABELS.items()]
    found = pairs.where(F.abs(F.col("a.y0") - F.col("b.y0")) <= 6.0).select("case_id", "page_no", "word_no", "a", "b", F.explode(F.array_compact(F.array(*hits))).alias("field"))
    first = found.groupBy("case_id", "page_no", "field").agg(F.min_by(F.struct("a", "b"), "word_no").alias("m"))
    return first.select("case_id", "page_no", "field", F.least("m.a.x0", "m.b.x0").alias("x0"), F.least("m.a.y0", "m.b.y0").alias("y0"), F.greatest("m.a.x1", "m.b.x1").alias("x1"), F.greatest("m.a.y1", "m.b.y1").alias("y1"))


def cell_values(words: DataFrame, labels: DataFrame, *, width=250.0, slack=4.0) -> DataFrame:
    """(case_id, field, value): the words right of a label, within its line's height and `width`; the first page that has any wins."""
    c = F.col
    middle = (c("w.y0") + c("w.y1")) / 2
    inside = (c("w.case_id") == c("l.case_id")) & (c("w.page_no") == c("l.page_no")) & (c("w.x0") >= c("l.x1")) & (c("w.x0") < c("l.x1") + width) & (middle >= c("l.y0") - slack) & (middle <= c("l.y1") + slack)
    rows = words.alias("w").join(labels.alias("l"), inside).groupBy("l.case_id", "l.page_no", "l.field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w.x0", "w.text"))), lambda s: s["text"]), " ").alias("value"))
    return rows.groupBy("case_id", "field").agg(F.min_by("value", "page_no").alias("value"))
