"""Best-fit packing of tokenised documents into sequences of fixed length.

Bulk-synchronous best fit. Lengths are whole numbers up to `capacity`, so documents of one length, and gaps
of one length, are interchangeable: the range-sorted documents and gaps are held as length classes, at most
`capacity` of each whatever the input. Every superstep takes the longest unplaced class and sweeps the gap
classes upward from its own length (the successors); documents meet gaps by rank within their classes, so no
two claim one gap; what is left opens new sequences; the gaps are updated, and the next superstep follows.
The result is the same as placing the documents one by one, longest first, each in the tightest gap. The
documents themselves never leave the executors: each finds its place by joining its rank to the intervals
that the sweeps gave out. The sweeps over the classes run on the driver: their input is the counts of the lengths,
and their output is bounded. A superstep leaves four runs of equal gaps more than it found at most, and a sequence
holds 63 different lengths at most (the sum of 64 is over 2048), so there are 4 x 2048 x 63 intervals at most, some
25 MB, whatever the input; that table is broadcast.

Null or empty text: one piece holding only the end id. Rows that repeat are documents of their own. A text that
holds the wording of a special token gets that token's id, as the tokenizers library does by default.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIECE = "piece int, start long, length int, ids_crc32 long"


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library; the same ranks under a faster library where its file is given."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.json_path, self.slow, self.fast = json_path, None, None
        with open(json_path, encoding="utf-8") as f:
            self.special = [token["content"] for token in json.load(f).get("added_tokens", [])]
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not any(token in text for token in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the regex engine of the fast library gives up on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids


def tokenize_pieces(docs: DataFrame, *, id_col="doc_id", text_col="text", json_path: str, ranks_path=None, pattern=None, capacity=2048, end_id=0, with_ids=False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut from its end into pieces of `capacity`."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches):
        encode = Encoder(json_path, ranks_path, pattern)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if not k else at + capacity]
                    out.append((key, k, at, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            key, piece, start, length, crc, all_ids = zip(*out) if out else ([],) * 6
            columns = [pa.array(key, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, f"id {id_type}, {PIECE}" + ", ids array<int>" * with_ids)


def sweep(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps over length classes -> intervals (length, rank from, rank to, documents in each sequence, first sequence, offset)."""
    gaps: list[int] = []
    classes: dict[int, list[tuple[int, int]]] = {}
    placed, opened = [], 0

    def put(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            if gap not in classes:
                classes[gap] = []
                insort(gaps, gap)
            classes[gap].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(sequence: int, count: int, gap: int) -> tuple[int, int]:
            """Fills `count` equal gaps in turn; returns how many sequences and documents it used."""
            nonlocal left, rank
            each = gap // length
            whole = min(count, left // each)
            if whole:
                placed.append((length, rank, rank + whole * each, each, sequence, capacity - gap))
                rank, left = rank + whole * each, left - whole * each
                put(gap - each * length, (sequence, whole))
            if left and whole < count:
                placed.append((length, rank, rank + left, left, sequence + whole, capacity - gap))
                put(gap - left * length, (sequence + whole, 1))
                rank, left, whole = rank + left, 0, whole + 1
            return whole, rank

        for gap in gaps[bisect_left(gaps, length) :]:
            if not left:
                break
            runs = classes.pop(gap)
            gaps.pop(bisect_left(gaps, gap))
            for i, (sequence, count) in enumerate(runs):
                used, _ = fill(sequence, count, gap)
                if used < count:
                    put(gap, (sequence + used, count - used))
                if not left:
                    for run in runs[i + 1 :]:
                        put(gap, run)
                    break
        if left:
            each = capacity // length
            fresh = -(-left // each)
            fill(opened, fresh, capacity)
            opened += fresh
    return placed


def best_fit(pieces: DataFrame, *, capacity=2048, group_rows=500_000) -> DataFrame:
    """pieces (id, piece, length, ...) -> + sequence_id, offset. Ranks are dealt in groups of about `group_rows` pieces, hot lengths included."""
    spark = pieces.sparkSession
    n = pieces.count()
    salt = F.pmod(F.xxhash64(F.col("id"), "piece", "start"), F.lit(max(64, -(-n // group_rows)))).alias("salt")
    salted = pieces.withColumn("salt", salt)
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "ranks")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    schema = "length int, lo long, hi long, each long, first long, at long"
    intervals = spark.createDataFrame(sweep(histogram, capacity), schema)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "start")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(counts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).alias("p")
    # the intervals are bounded by the capacity, not by the input: see above
    found = ranked.join(F.broadcast(intervals).alias("i"), (F.col("p.length") == F.col("i.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    sequence = F.col("first") + F.floor(step / F.col("each"))
    offset = F.col("at") + (step % F.col("each")) * F.col("p.length")
    return found.select(*[F.col(f"p.{c}").alias(c) for c in pieces.columns], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack(docs: DataFrame, **options) -> DataFrame:
    """Tokenise, cut and place: one row a piece. Options are those of tokenize_pieces."""
    pieces = materialize(tokenize_pieces(docs, **options), "pieces")
    return best_fit(pieces, capacity=options.get("capacity", 2048))
