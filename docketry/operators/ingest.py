"""From decoded spans, recognised words and lines to trusted page text.

Hidden text leaves this module as a flag only: what follows reads `visible_native`, never the spans.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import bound, lines_of, without_footer


def span_visible() -> Column:
    """Printed large enough, on the page, not in the invisible mode, and in contrast to white. Columns: text, size, bbox, crop, flags, render_mode, alpha, color."""
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(F.col(f"bbox.{b}"), F.col(f"crop.{b}")) - F.greatest(F.col(f"bbox.{a}"), F.col(f"crop.{a}")))
    area = (F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))
    overlap = side("x0", "x1") * side("y0", "y1")
    channel = lambda shift: F.shiftright(F.col("color"), shift).bitwiseAND(F.lit(255))
    luminance = 0.2126 * channel(16) + 0.7152 * channel(8) + 0.0722 * channel(0)
    contrast = (255.0 - luminance) * (F.col("alpha") / 255.0)
    return (
        (F.trim("text") != "")
        & (F.col("size") >= 4.5)
        & (F.col("bbox.x1") > F.col("bbox.x0"))
        & (F.col("bbox.y1") > F.col("bbox.y0"))
        & (overlap > 0)
        & (overlap >= 0.75 * F.greatest(F.lit(1.0), area))
        & ~((F.col("flags") != 0) & (F.col("render_mode") == 3))
        & (contrast >= 28)
    )


def native_text(spans: DataFrame) -> DataFrame:
    """(case_id, page_no, visible, hidden): lines in reading order, spans joined by a space."""
    spans = spans.where(F.trim("text") != "").withColumn("_v", F.coalesce(span_visible(), F.lit(False)))
    part = lambda shown: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_v") == shown, F.struct("span_no", F.trim("text").alias("t"))))), lambda s: s["t"]), " ")
    lines = spans.groupBy("case_id", "page_no", "block_no", "line_no").agg(part(True).alias("v"), part(False).alias("h"))
    page = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("block_no", "line_no", F.col(c).alias("t"))))), lambda s: s["t"]), "\n")
    return lines.groupBy("case_id", "page_no").agg(page("v").alias("visible"), page("h").alias("hidden"))


def may_instruct(text: Column) -> Column:
    """False where no line can match: plain words are sought faster than the pattern, and nearly no text holds one."""
    return bound(F.upper(text), lambda t: reduce(or_, [t.contains(w) for w in fixed.INJECTION_WORDS]))


def scrub(text: Column) -> Column:
    """Text without the lines that give instructions."""
    own = F.array_join(F.filter(lines_of(text), lambda line: ~line.rlike(fixed.INJECTION)), "\n")
    same = ~may_instruct(text) & ~text.rlike(fixed.OTHER_LINE_END) & ~text.endswith("\n")
    return F.when(same, text).otherwise(own)


def instructs(text: Column) -> Column:
    return may_instruct(text) & F.exists(lines_of(text), lambda line: line.rlike(fixed.INJECTION))


def is_scanned(visible: Column) -> Column:
    return F.length(F.trim(without_footer(visible))) < 40


def tsv_words(tsv: Column) -> Column:
    """array<(page, block, par, line, left, top, width, height, conf, word)> of a recogniser's twelve-column table."""
    rows = F.transform(lines_of(tsv), lambda r: F.split(r, "\t", 12))
    good = F.filter(rows, lambda p: (F.size(p) == 12) & (p[0] != "level") & (F.trim(p[11]) != ""))

    def word(p):
        number = lambda k: p[k].try_cast("int")
        return F.struct(*[p[k].alias(n) for k, n in ((1, "page"), (2, "block"), (3, "par"), (4, "line"))], F.coalesce(number(6), F.lit(0)).alias("left"), number(7).alias("top"), number(8).alias("width"), number(9).alias("height"), F.coalesce(p[10].try_cast("double"), F.lit(-1.0)).alias("conf"), F.trim(p[11]).alias("word"))

    return F.transform(good, word)


def tsv_text(tables: DataFrame, *, keys=("case_id", "page_no"), tsv="tsv") -> DataFrame:
    """keys, text, confidence: lines in the order they first appear, words by their left edge; mean of the confidences that are not negative."""
    words = tables.select(*keys, F.posexplode(tsv_words(F.col(tsv))).alias("at", "w")).select(*keys, "at", "w.*")
    lines = words.groupBy(*keys, "page", "block", "par", "line").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word"))), lambda s: s["word"]), " ").alias("text"), F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("c"), F.count_if(F.col("conf") >= 0).alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), "\n")
    return lines.groupBy(*keys).agg(text.alias("text"), F.coalesce(F.try_divide(F.sum("c"), F.sum("n")), F.lit(0.0)).alias("confidence"))


def recognizer_text(lines: DataFrame, *, keys=("case_id", "page_no")) -> DataFrame:
    """keys, rapid_text: the second engine's lines of confidence over 0.4, in their order."""
    good = lines.where("conf > 0.4").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return good.select(*keys, F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("rapid_text"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt of a page that scores most, the earlier on a tie. attempts: case_id, page_no, attempt, text, confidence, rotation.

    The ladder is gated: a later rung counts only while the best before it shows fewer than two anchors, a
    rotated one only while it shows none and under 100 word characters. Rungs are few, so a page's go through
    one fold.
    """
    from ..functions.text import anchor_count, ocr_score

    body = F.length(F.regexp_replace(without_footer(F.col("text")), r"\W", ""))
    scored = attempts.withColumns({"score": ocr_score(F.col("text"), F.col("confidence")), "anchors": anchor_count(F.col("text")), "body": body})
    rungs = F.array_sort(F.collect_list(F.struct("attempt", "rotation", "score", "anchors", "body", "text", "confidence")))

    def climb(best, rung):
        open_ = F.when(rung["rotation"] != 0, (best["anchors"] < 1) & (best["body"] < 100)).otherwise(best["anchors"] < 2)
        return F.when(open_ & (rung["score"] > best["score"]), rung).otherwise(best)

    grouped = scored.groupBy("case_id", "page_no").agg(rungs.alias("r"))
    best = F.aggregate(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.col("r")[0], climb)
    return grouped.select("case_id", "page_no", best.alias("b")).select("case_id", "page_no", "b.attempt", "b.score", "b.text", "b.confidence")
