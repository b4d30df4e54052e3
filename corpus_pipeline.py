"""The training-corpus pipeline: five stages, each one operator on all that the stage before it kept.

toxicity      documents whose toxicity score reaches 0.5 go
line_dedup    runs of 50 words or more that occur earlier are cut; a document left without a word goes
near_dedup    SimHash: one document stays of those linked by a Jaccard similarity of 0.8 or more over five-word shingles
mixing        sources are drawn to their target weights: documents come up to three times, or not at all
packing       what is left is tokenised and packed into sequences of 2048 tokens

All labels train the first stage. Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and extra columns, and keeps all columns; what it does with them its operator's module says.
Null and empty texts are clean, hold no line, are one class of near copies, have size 0 and pack as an end token.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.llm import lines, mixing, packing, simhash, toxicity
from docketry.llm.common import WORD, materialize, table
from docketry.llm.queries import tokenizer_files


def toxicity_stage(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark, docs, sf_dir):
    cut = lines.dedup_lines(docs.withColumn("_had", F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
    left = cut.where(~F.col("_had") | F.col("text").rlike(WORD)).drop("_had")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark, docs, sf_dir):
    return simhash.keep_dissimilar(docs)


def mixing_stage(spark, docs, sf_dir):
    mixed = mixing.mix_sources(docs)
    # shards are dealt in parts, so none is one task's; within each part the order is the shuffle's
    dealt = mixed.repartition("shard", F.pmod("shard_key", F.lit(64))).sortWithinPartitions("shard", "shard_key")
    return dealt.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark, docs, sf_dir):
    placed = packing.pack(docs, **tokenizer_files())
    return placed.withColumnRenamed("id", "doc_id").withColumn("length", F.col("length").cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL trains the first stage's machine or tokenises: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
