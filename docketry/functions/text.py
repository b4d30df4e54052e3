"""Scalar functions on readings, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def one_of(column: Column, values) -> Column:
    return column.isin(*values)


def blank_to_null(column: Column, *also: str) -> Column:
    """NULL for the empty string and the sentinels named."""
    return F.when((column != "") & ~column.isin(*also), column) if also else F.nullif(column, F.lit(""))


def found(pattern: str, column: Column, group: int = 1) -> Column:
    """First match of a group, NULL where there is none."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def canon(column: Column) -> Column:
    """Upper case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.upper(column), "[^A-Z0-9]+", " "))


def bound(column: Column, use) -> Column:
    """use(column), with the column computed once however often `use` names it."""
    return F.get(F.transform(F.array(column), use), F.lit(0))


def lines_of(column: Column) -> Column:
    """Lines as Python splits them: no empty line after the last end."""
    ended = F.regexp_replace(column, f"(?:{fixed.LINE_END})$", "")
    plain = F.when(column.endswith("\n"), F.regexp_replace(column, "\n$", "")).otherwise(column)  # one plain character is split without a pattern
    return F.when(column == "", F.array().cast("array<string>")).when(column.rlike(fixed.OTHER_LINE_END), F.split(ended, fixed.LINE_END, -1)).otherwise(F.split(plain, "\n", -1))


def parse_date(column: Column) -> Column:
    """ISO, `17 Apr 2026` or `Apr 17, 2026` as ISO; NULL if none, or no such day, or outside 1900-2100."""
    text = F.trim(column)
    month = lambda name: F.lpad((F.floor((F.position(F.upper(name), F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC")) - 1) / 3) + 1).cast("string"), 2, "0")
    iso, day_first, month_first = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\.?,?\s+(\d{4})\b", r"\b([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\b"
    part = lambda p, k: F.regexp_extract(text, p, k)
    named = lambda p, y, m, d: F.when(F.position(F.upper(part(p, m)), F.lit("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC")) > 0, F.concat_ws("-", part(p, y), month(part(p, m)), F.lpad(part(p, d), 2, "0")))
    written = F.when(text.rlike(iso), part(iso, 0)).when(text.rlike(day_first), named(day_first, 3, 2, 1)).when(text.rlike(month_first), named(month_first, 3, 1, 2))
    day = F.try_to_date(written, "yyyy-MM-dd")
    return F.when(F.year(day).between(1900, 2100), F.date_format(day, "yyyy-MM-dd"))


def repair_sponsor(column: Column) -> Column:
    """SPN-#### from a damaged prefix and glyphs that stand for digits; NULL if any digit stays unread."""
    compact = F.regexp_replace(F.upper(column), "[^A-Z0-9]", "")
    digits = F.coalesce(found(r"[S5][PFR][NRM]([0-9OQDILZSBGT]{4})", compact), found(r"^([0-9OQDILZSBGT]{4})$", compact))
    return F.concat(F.lit("SPN-"), F.translate(digits, fixed.DIGIT_FROM, fixed.DIGIT_TO))


def normal_flags(flags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(flags, lambda f: f.isNotNull() & ~f.isin("", "none"))))


def joined_flags(flags: Column) -> Column:
    own = normal_flags(flags)
    return F.when(F.size(own) > 0, F.array_join(own, "|")).otherwise("none")


def classify_page(column: Column) -> Column:
    def kind_of(text):
        out = F.lit("unknown")
        for kind, ways in reversed(fixed.PAGE_CLASSES):
            any_way = F.lit(False)
            for words in ways:
                every = F.lit(True)
                for word in words:
                    every = every & text.contains(word)
                any_way = any_way | every
            out = F.when(any_way, kind).otherwise(out)
        return out

    return bound(F.regexp_replace(F.upper(column), "[^A-Z0-9]+", " "), kind_of)


def without_footer(column: Column) -> Column:
    return F.regexp_replace(column, fixed.FOOTER, "")


def anchor_count(column: Column) -> Column:
    text = F.regexp_replace(F.upper(without_footer(column)), "[^A-Z ]+", " ")
    total = F.lit(0)
    for anchor in fixed.ANCHORS:
        total = total + text.contains(anchor).cast("int")
    return total


def ocr_score(text: Column, confidence: Column) -> Column:
    return confidence + 14.0 * anchor_count(text) + F.least(F.lit(18.0), F.length(without_footer(text)) / 30.0)


def is_noise(line: Column) -> Column:
    text = F.trim(line)
    labels = [x for own in fixed.LABELS.values() for x in own] + list(fixed.OTHER_LABELS)
    return (text == "") | text.rlike(fixed.NOISE) | F.rtrim(F.upper(text), F.lit(":")).isin(*labels)


def damaged_fields(column: Column) -> Column:
    """Fields that damage tags name, distinct and sorted."""
    tags = F.filter(F.regexp_extract_all(column, F.lit(fixed.DAMAGE_TAG), F.lit(1)), lambda t: t.rlike("|".join(fixed.DAMAGE_WORDS)))

    def field(tag):
        out = F.lit(None).cast("string")
        for token, name in reversed(fixed.DAMAGE_FIELDS):
            out = F.when(tag.contains(token), name).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, field), lambda f: f.isNotNull())))


def manual_finding(column: Column) -> Column:
    """struct(finding, n): the last finding, either word order."""
    first, second = (F.regexp_extract_all(column, F.lit(fixed.FINDING), F.lit(k)) for k in (1, 2))
    every = F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b))
    last = F.regexp_replace(F.upper(F.try_element_at(every, F.lit(-1))), " ", "_")
    return F.struct(F.when(last.contains("REVIEW"), fixed.NEEDS_REVIEW).otherwise(last).alias("finding"), F.size(every).alias("n"))


def registry_status(column: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(found(fixed.REGISTRY, column), r"\s+", " ")))


def fee_from_receipt(column: Column) -> Column:
    return F.when(column.rlike(fixed.STANDARD_FEE), "paid").when(column.rlike(fixed.WAIVER_CODE), "waived")


def classify_color(red: Column, green: Column, blue: Column) -> Column:
    return (
        F.when((red > 0.6) & (green < 0.4) & (blue < 0.4), "RED")
        .when((green > 0.35) & (red < 0.4) & (blue < 0.4), "GREEN")
        .when((blue > 0.6) & (red < 0.4) & (green < 0.4), "BLUE")
    )


def contains_value(text: Column, value: Column) -> Column:
    """Loose containment: white space squeezed, case-free."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.instr(squeeze(text), squeeze(value)) > 0
