"""What the operators share: tables, the shared folder, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir, table  # noqa: F401

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are read in chunks of about so many characters, their tokens in arrays.
CHUNK = 600_000


def chunks(batch, column: int, size: int = CHUNK):
    """Slices of an Arrow batch with about `size` characters, one text at least: (from, texts)."""
    at, held, n = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        held.append(text.as_py())
        n += len(held[-1] or "")
        if n > size:
            yield at, held
            at, held, n = i + 1, [], 0
    if held:
        yield at, held


def held(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def connected_components(edges: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """(node, root): root is the least node reachable, for every node of edges (a, b).

    Alternating large-star and small-star contraction; each round is written to the shared
    folder, so lineage stays short. No component is ever gathered in one task.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e, before = materialize(e, "edges"), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
