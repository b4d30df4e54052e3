"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

DataFrame functions only. Sources are cut by hash into blocks of about `block_words` words. A source's
quota is whole epochs of all its blocks plus a permuted run of blocks and, in one boundary block, a
permuted run of documents, the last of which is cut; so the words drawn equal the target. The draws (block,
epoch) then go down a binary tree: in every node a random half without replacement goes left, which is
exactly a multivariate-hypergeometric draw of the node's source quotas. Leaves are the output shards, whose
documents are shuffled locally.

Nulls: a null text has size 0, a null source is a source of its own and sorts last, a null id is kept.
Empty tables give empty results. Rows that repeat are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: The documented bounds: words in a block at least, and blocks of all sources together (the table of blocks).
BLOCK_WORDS, MAX_BLOCKS = 65_536, 1 << 20


def source_targets(sizes: DataFrame, *, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> + target: shares by weight, stopped at max_epochs x size, the excess reshared (water filling).

    The stopped sources are those first in the order of limit/weight: one pass of running sums finds the level.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(every) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("limit", F.col("source_size").cast("double") * max_epochs)
    order = Window.orderBy(F.col("limit") / F.col("w"), "w", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ahead, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = ranked.withColumns({"level": level, "place": F.row_number().over(order)})
    # up to the first source that is not stopped, all before it are; its level holds for all after it
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct("place", "level"))).over(whole)
    leveled = leveled.withColumn("first", first)
    stopped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    target = F.when(stopped, F.col("limit")).otherwise(F.least(F.col("limit"), F.col("w") * F.col("first.level")))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def splitting_tree(draws: DataFrame, *, shards: int, seed: int) -> DataFrame:
    """(source, block, epoch) -> + shard: halves every node without replacement, down to `shards` leaves."""
    tree, width = draws.withColumn("shard", F.lit(0)), 1
    while width < shards:
        key = F.xxhash64(F.lit(seed), F.lit(width), "source", "block", "epoch")
        node = Window.partitionBy("shard")
        left = F.row_number().over(node.orderBy(key, F.col("source").asc_nulls_last(), "block", "epoch")) <= F.ceil(F.count("*").over(node) / 2)
        tree, width = tree.withColumn("shard", F.col("shard") * 2 + F.when(left, 0).otherwise(1)), width * 2
    return tree


def draw_plan(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), max_epochs=3, shards=16, seed=20_11) -> DataFrame:
    """One row a document: id, source, size, key (hash of id, source and text), source_size, target, epochs (whole copies), part (words of a last, cut copy), draws array<(epoch, shard)>."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(id_col, source_col, text_col).alias("key")), "sized")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, max_epochs=max_epochs)
    every = F.sum("source_size").over(Window.partitionBy())
    targets = targets.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(BLOCK_WORDS), F.ceil(every / MAX_BLOCKS)))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", F.least(epochs, F.lit(max_epochs)).cast("int"))
    targets = materialize(targets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "targets")
    placed = sized.join(targets.select("source", "n_blocks"), sized.source.eqNullSafe(targets.source)).drop(targets.source)
    placed = placed.select("id", sized.source, "size", "key", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("n_blocks")).alias("block"))
    placed = materialize(placed, "placed")

    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.join(targets, blocks.source.eqNullSafe(targets.source)).drop(targets.source)
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    blocks = blocks.withColumn("before", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    blocks = blocks.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    blocks = materialize(blocks.select("source", "block", "words", "quota", "source_size", "target", "epochs"), "blocks")

    last = F.when(F.col("quota") > 0, 1).otherwise(0)
    draws = blocks.where(F.col("epochs") + last > 0).select("source", "block", F.explode(F.sequence(F.lit(1), F.col("epochs") + last)).alias("epoch"))
    leaves = splitting_tree(draws, shards=shards, seed=seed + 2).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("draws"))
    leaves = leaves.withColumnsRenamed({"source": "leaf_source", "block": "leaf_block"})
    drawn = F.col("source").eqNullSafe(F.col("leaf_source")) & (F.col("block") == F.col("leaf_block"))
    blocks = materialize(blocks.join(leaves, drawn, "left").drop("leaf_source", "leaf_block"), "leaves")

    at = placed.source.eqNullSafe(blocks.source) & (placed.block == blocks.block)
    joined = placed.join(blocks, at).drop(blocks.source).drop(blocks.block)
    cut = (F.col("quota") > 0) & (F.col("quota") < F.col("words"))
    within = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 3), "id"), F.col("id"), "size", "key")
    run = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    boundary = joined.where(cut).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - run)).cast("long"))
    whole = joined.where(~cut).withColumn("part", F.when(F.col("quota") > 0, F.col("size")).otherwise(0).cast("long"))
    return boundary.unionByName(whole).select("id", "source", "size", "key", "source_size", "target", "epochs", "part", F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int>>")).alias("draws"))


def taken() -> F.Column:
    """Words the draws take of a document: its size for each whole epoch, the cut words for the last."""
    return F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + F.when(d["epoch"] <= F.col("epochs"), F.col("size")).otherwise(F.col("part")))


def mix_sources(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix itself: the columns of docs, once for each draw, with `shard`, `copy` and the key of the local shuffle `shard_key`.

    A document's last, partial copy is cut to its first words. Documents that no draw takes are left out.
    Ids may repeat or be null: id, source and text tell documents apart, and rows equal in all three go by number.
    """
    seed = options.get("seed", 20_11)
    plan = draw_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    plan = plan.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id", "source", "size", "part")))
    plan = plan.where(F.size("draws") > 0).select(F.col("key").alias("__dk_key"), F.col("n").alias("__dk_n"), "epochs", "part", "size", F.explode("draws").alias("d"))
    plan = plan.where((F.col("d.epoch") <= F.col("epochs")) | (F.col("part") > 0) | (F.col("size") == 0))
    plan = plan.select("__dk_key", "__dk_n", F.col("d.epoch").alias("__dk_copy"), F.col("d.shard").alias("__dk_shard"), F.when((F.col("d.epoch") > F.col("epochs")) & (F.col("part") < F.col("size")), F.col("part")).alias("__dk_cut"))
    numbered = docs.withColumn("__dk_own", F.xxhash64(id_col, source_col, text_col))
    numbered = numbered.withColumn("__dk_row", F.row_number().over(Window.partitionBy("__dk_own").orderBy(id_col, source_col)))
    # the same plan at every size; numbers are compared by difference, so that the join goes by the windows' own keys
    mixed = numbered.join(plan.hint("merge"), (F.col("__dk_own") == F.col("__dk_key")) & (F.col("__dk_row") - F.col("__dk_n") == 0))
    head = F.concat(F.lit(r"^(?s:[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("__dk_cut").cast("string"), F.lit("}+)"))
    text = F.when(F.col("__dk_cut").isNull(), F.col(text_col)).otherwise(F.call_function("regexp_extract", F.col(text_col), head, F.lit(0)))
    key = F.xxhash64(F.lit(seed + 4), F.col("__dk_shard"), F.col(id_col), F.col("__dk_copy"))
    return mixed.withColumn(text_col, text).select(*docs.columns, F.col("__dk_shard").alias("shard"), F.col("__dk_copy").alias("copy"), key.alias("shard_key"))
