"""Nearest-neighbour joins of readings against closed vocabularies, with a margin over the runner-up.

Every join runs over distinct readings: the one Python function sees a pair once, however often it occurs.
Vocabularies have at most a few hundred entries and are broadcast. A vocabulary is (tier, entry); keys are
what distances are taken between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.distance import weighted_distance
from ..functions.text import canon, found, parse_date, repair_sponsor
from ..session import materialize, ship


def vocabulary(spark, entries, tier: int = 0) -> DataFrame:
    return spark.createDataFrame([(tier, e) for e in entries], "tier int, entry string")


def nearest(readings: DataFrame, entries: DataFrame, *, key: Column, entry_key: Column, extra: list[Column] | None = None) -> DataFrame:
    """readings (reading, ...) -> (reading, tier, entry, score, margin): the best entry of each tier, and how far the next one lies behind (NULL: none does)."""
    ship(readings.sparkSession)
    pairs = readings.select("reading", key.alias("_a")).where("_a <> ''").distinct().join(F.broadcast(entries.select("tier", "entry", entry_key.alias("_b"))))
    pairs = pairs.withColumn("score", weighted_distance("_a", "_b") / F.greatest(F.lit(1), F.length("_b")))
    two = pairs.groupBy("reading", "tier").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "entry"))), 1, 2).alias("two"))  # as long as the vocabulary
    best, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    return two.select("reading", "tier", best["entry"].alias("entry"), best["score"].alias("score"), (second["score"] - best["score"]).alias("margin"))


def snap(readings: DataFrame, entries, *, max_relative=0.34, min_margin=0.15) -> DataFrame:
    """(reading, parsed): the entry a reading snaps to; readings that fit none, or two alike, have no row."""
    words = vocabulary(readings.sparkSession, entries)
    best = nearest(readings, words, key=canon(F.col("reading")), entry_key=canon(F.col("entry")))
    keep = (F.col("score") <= max_relative) & (F.col("margin").isNull() | (F.col("margin") >= min_margin))
    return best.where(keep).select("reading", F.col("entry").alias("parsed"))


def snap_visa(readings: DataFrame) -> DataFrame:
    """The digit is nearly a key: 2, 3 and 7 name one class each; 1 needs its letters."""
    text = canon(F.col("reading"))  # distinct readings are few; they are kept for the three joins below
    exact = r"\b(XW|DIP|MED|TRANSIT)\s*[-. ]?\s*([1237])\b"
    loose = r"([A-Z]{2,8})\s*[-. ]?\s*([1237])\b"
    read = readings.select("reading").distinct().withColumn("exact", F.when(text.rlike(exact), F.concat_ws("-", F.regexp_extract(text, exact, 1), F.regexp_extract(text, exact, 2))))
    read = read.withColumn("exact", F.when(F.col("exact").isin(*fixed.VISAS), F.col("exact")))
    read = materialize(read.withColumns({"prefix": found(loose, text), "digit": found(loose, text, 2)}), "visas")
    spark = readings.sparkSession
    near = nearest(read.where("exact is null and prefix is not null").select(F.col("prefix").alias("reading")), vocabulary(spark, sorted({v.split("-")[0] for v in fixed.VISAS})), key=F.col("reading"), entry_key=F.col("entry"))
    near = near.select(F.col("reading").alias("prefix"), F.col("entry").alias("near"), F.col("score").alias("near_score"))
    ones = nearest(read.where("exact is null and digit = '1'").select(F.col("prefix").alias("reading")), vocabulary(spark, ("XW-1", "DIP-1")), key=F.col("reading"), entry_key=F.substring_index("entry", "-", 1))
    ones = ones.where("score <= 0.34 and margin >= 0.25").select(F.col("reading").alias("prefix"), F.col("entry").alias("one"))
    strict = snap(read.where("exact is null and prefix is null"), fixed.VISAS, max_relative=0.25, min_margin=0.25).withColumnRenamed("parsed", "strict")
    by_digit = F.create_map(*[F.lit(x) for pair in (("2", "XW-2"), ("3", "MED-3"), ("7", "TRANSIT-7")) for x in pair])[F.col("digit")]
    keyed = F.when((F.col("near") == F.substring_index(by_digit, "-", 1)) | (F.col("near_score") > 0.5), by_digit)
    joined = read.join(near, "prefix", "left").join(ones, "prefix", "left").join(strict, "reading", "left")
    parsed = F.coalesce("exact", F.when(F.col("digit") == "1", F.col("one")).when(F.col("prefix").isNotNull(), keyed).otherwise(F.col("strict")))
    return joined.select("reading", parsed.alias("parsed")).where("parsed is not null")


def snap_fee(readings: DataFrame) -> DataFrame:
    """paid and unpaid differ by two letters: what begins like `un` can never become paid."""
    ship(readings.sparkSession)
    first = F.element_at(F.split(F.trim("reading"), r"\s+"), 1)
    plain = F.regexp_replace(F.lower(first), r"^[.,;:]+|[.,;:]+$", "")
    token = F.regexp_replace(F.lower(first), "[^a-z]", "")
    read = readings.select("reading", F.when(plain.isin(*fixed.FEES), plain).alias("exact"), F.when(F.length(token) >= 3, token).alias("token")).distinct()
    negative = F.col("token").rlike("^[uvn][nmr]") | F.col("token").startswith("un")
    wide = read.where("exact is null and token is not null").withColumn("no", negative)
    choice = F.when(F.col("no"), F.array(F.lit("paid"), F.lit("known"))).otherwise(F.array(F.lit("paid"), F.lit("waived")))
    pairs = wide.select("token", "no", F.posexplode(choice).alias("at", "word")).distinct()
    seen = F.when(F.col("no"), F.substr("token", F.lit(3))).otherwise(F.col("token"))
    window = F.when(F.col("no"), F.col("word")).otherwise(F.substr("word", F.lit(1), F.least(F.length("token"), F.length("word"))))
    scored = pairs.select("token", "no", "at", "word", seen.alias("a"), window.alias("b")).where("a <> ''")
    scored = scored.withColumn("score", weighted_distance("a", "b") / F.greatest(F.lit(1), F.length("b"))).where(F.col("score") <= F.when(F.col("no"), 0.5).otherwise(0.34))
    best = scored.groupBy("token").agg(F.min_by("word", "at").alias("word"), F.first("no").alias("no"))
    fee = F.when(F.col("no"), F.when(F.col("word") == "paid", "unpaid").otherwise("unknown")).otherwise(F.col("word"))
    return read.join(best.select("token", fee.alias("fee")), "token", "left").select("reading", F.coalesce("exact", "fee").alias("parsed")).where("parsed is not null")


def snap_flag(readings: DataFrame) -> DataFrame:
    key = F.replace(F.trim(F.regexp_replace(F.lower("reading"), "[^a-z_ ]", "")), F.lit(" "), F.lit("_"))
    long = readings.where(F.length(key) >= 5)
    best = nearest(long, vocabulary(readings.sparkSession, fixed.FLAGS), key=key, entry_key=F.col("entry"))
    return best.where("score <= 0.28").select("reading", F.col("entry").alias("parsed"))


def name_vocabulary(spark, names: tuple | None = None) -> DataFrame:
    """Tokens seen (tier 0), and stems with suffixes that are not among them (tier 1, lower case); names: those of a file instead."""
    if names is not None:
        return vocabulary(spark, names[0]).unionByName(vocabulary(spark, names[1], 1))
    made = sorted({a + b for a in fixed.NAME_STEMS for b in fixed.NAME_SUFFIXES} - set(fixed.NAMES))
    return vocabulary(spark, fixed.NAMES).unionByName(vocabulary(spark, made, 1))


def snap_name_token(readings: DataFrame, names: tuple | None = None) -> DataFrame:
    """The first tier that holds the token: within .30 and .08 ahead of the next."""
    key = F.regexp_replace("reading", "[^A-Za-z]", "")
    best = nearest(readings.where(F.length(key) >= 3), name_vocabulary(readings.sparkSession, names), key=key, entry_key=F.col("entry"))
    fits = best.where((F.col("score") <= 0.30) & (F.col("margin").isNull() | (F.col("margin") >= 0.08)))
    return fits.groupBy("reading").agg(F.min_by("entry", "tier").alias("parsed"))


def name_parts(reading: Column) -> Column:
    """The first two words that are names by their letters."""
    head = F.trim(F.element_at(F.split(reading, r"\s{2,}|[|]"), 1))
    return F.slice(F.filter(F.split(head, r"\s+"), lambda w: w.rlike(r"^[A-Za-z'’-]+$")), 1, 2)


def parse_name(readings: DataFrame) -> DataFrame:
    """Two tokens, one of them known; tokens that cannot be placed stay; another field's value is no name."""
    own = readings.select("reading", name_parts(F.col("reading")).alias("parts")).distinct().where(F.size("parts") == 2)
    own = read = materialize(own, "names")
    for words in (fixed.WORLDS, fixed.SPECIES, fixed.PURPOSES):
        read = read.join(snap(own.select("reading"), words), "reading", "left_anti")
    read = read.withColumns({"a": F.col("parts")[0], "b": F.col("parts")[1]})
    tokens = materialize(snap_name_token(own.select(F.explode("parts").alias("reading"))), "tokens")
    first, second = (tokens.select(F.col("reading").alias(c), F.col("parsed").alias(f"{c}_known")) for c in ("a", "b"))
    joined = read.join(first, "a", "left").join(second, "b", "left").where("a_known is not null or b_known is not null")
    return joined.select("reading", F.concat_ws(" ", F.coalesce("a_known", "a"), F.coalesce("b_known", "b")).alias("parsed"))


def split_fused(tokens: DataFrame) -> DataFrame:
    """(reading, field, value): a label and its value that ran together, cut where both fit best."""
    spark = tokens.sparkSession
    ship(spark)
    read = tokens.select("reading", F.regexp_replace("reading", r"[^\p{L}\p{N}]", "").alias("clean")).distinct().where(F.length("clean") >= 7)
    cuts = read.select("reading", "clean", F.explode(F.sequence(F.lit(3), F.length("clean") - 3)).alias("cut"))
    cuts = cuts.withColumns({"head": F.substr("clean", F.lit(1), F.col("cut")), "tail": F.substr("clean", F.col("cut") + 1)}).drop("clean")
    labels = spark.createDataFrame([(f, n) for f, own in fixed.FUSED_LABELS.items() for n in own], "field string, label string")
    heads = cuts.select("head").distinct().join(F.broadcast(labels), (F.length("head") * 0.45 - 0.66 * F.length("label") <= 0) & (F.length("label") * 0.45 - F.length("head") <= 0.34 * F.length("label")))
    heads = heads.withColumn("d", weighted_distance(F.upper("head"), F.upper("label")) / F.length("label")).where("d <= 0.34").groupBy("head", "field").agg(F.min("d").alias("label_score"))
    kept = cuts.join(heads, "head")
    values = spark.createDataFrame([(f, v) for f, own in fixed.FUSED_VOCABULARY.items() for v in own], "field string, value string")
    tails = kept.select("field", "tail").distinct().join(F.broadcast(values), "field")
    tails = tails.withColumn("score", weighted_distance(F.upper("tail"), F.upper("value")) / F.length("value"))
    two = tails.groupBy("field", "tail").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "value"))), 1, 2).alias("two"))
    two = two.select("field", "tail", F.col("two")[0]["score"].alias("score"), F.col("two")[0]["value"].alias("value"), (F.col("two")[1]["score"] - F.col("two")[0]["score"]).alias("margin")).where("score <= 0.55 and margin >= 0.15")
    order = F.array_position(F.array(*map(F.lit, fixed.FUSED_LABELS)), F.col("field"))
    found_ = kept.join(two, ["field", "tail"]).withColumn("key", F.struct(F.col("label_score") + F.col("score"), "cut", order))
    return found_.groupBy("reading").agg(F.min_by(F.struct("field", "value"), "key").alias("best")).select("reading", "best.field", "best.value")


def parse_field(readings: DataFrame, field: str) -> DataFrame:
    """(reading, parsed) by the parser of a field."""
    if field == "applicant_name":
        return parse_name(readings)
    if field == "visa_class":
        return snap_visa(readings)
    if field == "fee_status":
        return snap_fee(readings)
    if field in ("sponsor_id", "arrival_date"):
        parser = repair_sponsor if field == "sponsor_id" else parse_date
        return readings.select("reading", parser(F.col("reading")).alias("parsed")).distinct().where("parsed is not null")
    return snap(readings, {"species_code": fixed.SPECIES, "home_world": fixed.WORLDS, "declared_purpose": fixed.PURPOSES}[field])


def parse_candidates(candidates: DataFrame, fields) -> DataFrame:
    """candidates (field, value, ...) -> + parsed, those that parse only."""
    own = candidates.where(F.col("field").isin(*fields))
    readings = materialize(own.select("field", "value").distinct(), "readings")
    parsed = None
    for field in fields:
        part = parse_field(readings.where(F.col("field") == field).select(F.col("value").alias("reading")), field)
        part = part.select(F.lit(field).alias("field"), F.col("reading").alias("value"), "parsed")
        parsed = part if parsed is None else parsed.unionByName(part)
    # as many rows as distinct readings; written, so that no later join plans the search again
    return own.join(materialize(parsed, "parsed"), ["field", "value"])
