"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import licenses, lm, neighbours, pii, topk, toxicity
from .common import held, table
from .lines import line_report
from .mixing import draw_plan, taken
from .packing import pack
from .simhash import simhash_components


def op1_lines(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_simhash(spark, sf_dir):
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = toxicity.training_rows(docs, labels.where(held("doc_id", 5) != 0))
    found = toxicity.score(docs, toxicity.fit(train)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (held("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing(spark, sf_dir):
    plan = draw_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken().alias("taken"))


def tokenizer_files() -> dict:
    import public_tokenizers as files

    return {"json_path": files.path("byte_bpe_50k.json"), "ranks_path": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}


def op9_packing(spark, sf_dir):
    placed = pack(table(spark, sf_dir, "documents"), **tokenizer_files())
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op5_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_embeddings(spark, sf_dir):
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_lm(spark, sf_dir):
    scored = lm.fit_score(table(spark, sf_dir, "documents"), held("doc_id", 7) != 2)
    return scored.withColumnRenamed("id", "doc_id").withColumn("held_out", held("doc_id", 7) == 2)


def op10_pii(spark, sf_dir):
    found = pii.redact_spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    every = pii.written(F.array_sort(F.concat("base", "added")))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), every.alias("spans"))


QUERIES = {
    "op1_lines": op1_lines,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_embeddings": op6_embeddings,
    "op7_licenses": op7_licenses,
    "op8_lm": op8_lm,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
}
ORACLE_SQL = {"op5_topk": topk.ORACLE, "op6_embeddings": neighbours.ORACLE}
