"""Line dedup: winnowing over hashes of lines that may begin at any word.

Printed line ends say little: a passage is wrapped anew, or stands in the middle of a longer line. So the lines
that are hashed are runs of `min_words - reach` words, one beginning at every word. Every `reach + 1` of them that
follow one another make a window, `min_words` words long; a window's least hash is its fingerprint (ties: the
first), so both occurrences of a passage of `min_words` words select the same line in it. Only selected lines
leave the worker. Those selected in one place only are dropped; the others' positions are joined, each to the
first in the order (id, text hash, position), never to all others, and the match is extended to both sides, word
by word. An extension that stops short of `reach` on a side may go on with another occurrence than the first: its
windows that are not yet matched are joined through the hash of the whole window. A text that occurs again whole
needs no windows: it is one node from the start.

Result, exactly: a word goes if it lies in a run of `min_words` words or more that occurs before: in an earlier
document, or in the same one without overlap. Words are what white space separates; case counts. What is cut takes
its white space along; a line end next to it stays. Null or empty text: nothing goes. Rows that repeat both id and
text are one document, and the same words go from each. Null ids come first in the order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, chunks, materialize
from .hashing import Tokens, runs_of

_WORDS = re.compile(WORD)


def reach_of(min_words: int) -> int:
    return min(16, min_words // 3)


class Selected:
    """The selected lines of some texts."""

    def __init__(self, texts: list[str | None], min_words: int):
        self.found = found = Tokens(texts, fold=False)
        self.reach = reach = reach_of(min_words)
        self.length = min_words - reach
        lines = runs_of(found.hashes, self.length)
        self.first, self.n_words = found.ends[:-1] + 1, np.diff(found.ends) - 1
        last = np.repeat(found.ends[1:] - min_words, np.diff(found.ends))  # of each token's text, the last window's start
        start = np.arange(found.ends[0], found.ends[-1])
        start = start[(start <= last) & ~np.isin(start, found.ends)]
        if not len(start):
            self.at = self.low = self.high = self.text = np.empty(0, dtype=np.int64)
            self.line = np.empty(0, dtype=np.uint64)
            return
        windows = np.lib.stride_tricks.sliding_window_view(lines, reach + 1)
        # in slices: a long text needs no more memory than many short ones
        at = np.concatenate([start[k : k + 65_536] + windows[start[k : k + 65_536]].argmin(axis=1) for k in range(0, len(start), 65_536)])
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        #: place, first and last window that selected it, text, hash
        self.at, self.low = at[cuts], start[cuts]
        self.high = start[np.append(cuts[1:], len(at)) - 1]
        self.text = np.searchsorted(found.ends, self.at, side="right") - 1
        self.line = lines[self.at]

    def around(self, chosen: np.ndarray) -> np.ndarray:
        """Hashes of the `reach` words before and after the lines chosen; 0 outside the text."""
        at, own = self.at[chosen], self.text[chosen]
        places = at[:, None] + np.concatenate((np.arange(-self.reach, 0), self.length + np.arange(self.reach)))
        inside = (places > self.found.ends[own][:, None]) & (places < self.found.ends[own + 1][:, None])
        words = (self.found.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return np.where(inside, words[np.clip(places, 0, len(words) - 1)], np.uint32(0))


def select_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """docs (id, th, text) -> (id, th, n_words, lines): lines are (hash, position) of every selected one."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, texts in chunks(batch, 2):
                own = Selected(texts, min_words)
                ends = np.searchsorted(own.text, np.arange(len(texts) + 1))
                place = (own.at - own.first[own.text]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(own.line.view(np.int64)), pa.array(place)], ["line", "at"])
                columns = [batch.column(i).slice(at, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own.n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], ["id", "th", "n_words", "lines"])

    return docs.mapInArrow(run, f"id {id_type}, th long, n_words long, lines array<struct<line:long,at:int>>")


def with_context(docs: DataFrame, min_words: int) -> DataFrame:
    """docs (id, th, text, at array) -> (line, id, th, at, low, high, around): the selected lines at those positions."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, texts in chunks(batch, 2):
                own = Selected(texts, min_words)
                asked = batch.column(3).slice(first, len(texts))
                wanted = asked.flatten().to_numpy(zero_copy_only=False) + np.repeat(own.first, asked.value_lengths().to_numpy(zero_copy_only=False))
                chosen = np.flatnonzero(np.isin(own.at, wanted))
                take, base = pa.array(own.text[chosen]), own.first[own.text[chosen]]
                around = own.around(chosen)
                step = around.shape[1] * 4
                raw = pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(np.arange(len(chosen) + 1, dtype=np.int32) * step), pa.py_buffer(around.tobytes())])
                columns = [batch.column(i).slice(first, len(texts)).take(take) for i in (0, 1)]
                places = [pa.array((x[chosen] - base).astype(np.int32)) for x in (own.at, own.low, own.high)]
                yield pa.RecordBatch.from_arrays([pa.array(own.line[chosen].view(np.int64)), *columns, *places, raw], ["line", "id", "th", "at", "low", "high", "around"])

    return docs.mapInArrow(run, f"line long, id {id_type}, th long, at int, low int, high int, around binary")


def extended(pairs: DataFrame, min_words: int) -> DataFrame:
    """pairs (id, th, at, low, high, around, line, leader_th, leader_id, leader_at, leader_around, same)
    -> (id, th, first, last, hi, lo): repeated runs (hi null), and windows that an extension cut short left unmatched."""
    import xxhash

    id_type, reach = pairs.schema["id"].dataType.simpleString(), reach_of(min_words)
    length = min_words - reach

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            at, low, high, line, same, leader_at = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("at", "low", "high", "line", "same", "leader_at"))
            own, other = (np.frombuffer(b"".join(batch.column(batch.schema.names.index(c)).to_pylist()), dtype=np.uint32).reshape(-1, 2 * reach) for c in ("around", "leader_around"))
            equal = own == other
            left = np.cumprod(equal[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(equal[:, reach:], axis=1).sum(axis=1)
            apart = ~same | (at - leader_at >= min_words)
            first = at - np.minimum(left, at)  # where both texts begin or end, the equal marks beyond are no words
            last = at + length - 1 + np.minimum(right, (own[:, reach:] != 0).sum(axis=1))
            long = (last - first + 1 >= min_words) & apart
            rows = np.flatnonzero(long)
            take, starts, ends, digests = [rows], [first[rows]], [last[rows]], [None] * len(rows)
            # windows begin `back` words before the line; matched ones, and those equal to the leader's own, are done
            for i in np.flatnonzero((left < reach) | (right < reach)).tolist():
                key, raw = int(line[i]).to_bytes(8, "little", signed=True), own[i].tobytes()
                back = np.arange(at[i] - high[i], at[i] - low[i] + 1)
                back = back[(back > left[i]) | (reach - back > right[i])]
                take.append(np.full(len(back), i))
                starts.append(at[i] - back)
                ends.append(at[i] - back + min_words - 1)
                digests += [xxhash.xxh3_128_digest(key + bytes([b]) + raw[4 * (reach - b) : 4 * (2 * reach - b)]) for b in back.tolist()]
            take = pa.array(np.concatenate(take))
            parts = [None if d is None else (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) for d in digests]
            columns = [batch.column(batch.schema.names.index(c)).take(take) for c in ("id", "th")]
            columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)]
            columns += [pa.array([None if p is None else p[k] for p in parts], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "first", "last", "hi", "lo"])

    return pairs.mapInArrow(run, f"id {id_type}, th long, first int, last int, hi long, lo long")


def joined_runs(found: DataFrame) -> DataFrame:
    """(id, th, first, last) -> (id, th, runs array<(first, last)>): overlapping and touching ones as one, in order."""
    text = Window.partitionBy("id", "th").orderBy("first", "last")
    reached = F.max("last").over(text.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") > reached + 1, 1).otherwise(F.when(reached.isNull(), 1).otherwise(0))
    numbered = found.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("id", "th", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """A step's table. Its shuffle is as large as the text or the lines, so it goes before the next step's is written."""
    return materialize(df, label, free=True)


def repeated_runs(docs: DataFrame, *, id_col="doc_id", text_col="text", min_words=50) -> tuple[DataFrame, DataFrame]:
    """(sizes, runs): (id, th, n_words) of every row, and (id, th, runs array<(first, last)>) of words that go.

    Texts that are there whole under an earlier id are in neither way listed word by word: of a text's ids only the
    least has a row in `runs` (null: nothing goes), so what has none is a copy.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    sizes = stored(select_lines(own, min_words), "lines")
    texts = sizes.groupBy("th").agg(F.min(F.struct("id")).alias("least")).select(F.col("least.id").alias("id"), "th")
    texts = stored(texts, "texts")
    # counts, leaders and the like are tables before they are joined: so a line that stands everywhere is split over tasks
    once = sizes.where(F.size("lines") > 0).alias("a").join(texts.hint("merge").alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")), "left_semi")
    places = stored(once.select("th", F.explode("lines").alias("l")).select("l.line", "th", "l.at"), "places")
    shared = stored(places.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "shared")
    needed = places.join(shared.hint("merge"), "line", "left_semi").groupBy("th").agg(F.collect_list("at").alias("at"))
    # a table, so that the lines' shuffle has gone when the texts' begins
    needed = stored(needed.join(texts, "th").select(F.col("id").alias("__dk_id"), F.col("th").alias("__dk_th"), "at"), "needed")
    asked = own.join(needed.hint("merge"), F.col("id").eqNullSafe(F.col("__dk_id")) & (F.col("th") == F.col("__dk_th"))).select("id", "th", "text", "at")
    seen = stored(with_context(asked, min_words), "selected")

    place = F.struct("id", "th", "at", "around")
    leaders = stored(seen.groupBy("line").agg(F.min(place).alias("leader")), "leaders")
    pairs = seen.join(leaders.hint("merge"), "line").withColumn("same", F.col("id").eqNullSafe(F.col("leader.id")) & (F.col("th") == F.col("leader.th")))
    pairs = pairs.where(~F.col("same") | (F.col("at") != F.col("leader.at")))
    pairs = pairs.select("id", "th", "at", "low", "high", "around", "line", F.col("leader.at").alias("leader_at"), F.col("leader.around").alias("leader_around"), "same")
    found = stored(extended(pairs, min_words), "extended")

    windows = found.where("hi is not null")
    place = F.struct("id", "th", "first")
    first = windows.groupBy("hi", "lo").agg(F.min(place).alias("leader"), F.max(place).alias("tail")).where("leader != tail").drop("tail")
    first = stored(first, "first")
    later = windows.join(first.hint("merge"), ["hi", "lo"])
    apart = ~(F.col("id").eqNullSafe(F.col("leader.id")) & (F.col("th") == F.col("leader.th"))) | (F.col("first") - F.col("leader.first") >= min_words)
    later = later.where((place > F.col("leader")) & apart).select("id", "th", "first", "last")
    every = joined_runs(found.where("hi is null").select("id", "th", "first", "last").unionByName(later))
    every = every.select(F.col("id").alias("__dk_id"), F.col("th").alias("__dk_th"), "runs")
    runs = texts.join(every.hint("merge"), F.col("id").eqNullSafe(F.col("__dk_id")) & (F.col("th") == F.col("__dk_th")), "left").select("id", "th", "runs")
    return sizes.select("id", "th", "n_words"), stored(runs, "runs")


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """A text without the runs of words given."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    out, done = [], 0
    for first, last in runs:
        before = text[spans[first - 1][1] if first else 0 : spans[first][0]]
        after = text[spans[last][1] : spans[last + 1][0] if last + 1 < len(spans) else len(text)]
        gap = after if last + 1 == len(spans) or ("\n" in after and "\n" not in before) else before
        out += [text[done : spans[first][0] - len(before)], "" if not first and last + 1 == len(spans) else gap]
        done = spans[last][1] + len(after)
    return "".join([*out, text[done:]])


def cut_words(rows: DataFrame, text_col: str) -> DataFrame:
    """rows without their last column, runs of words: where it isn't null, they are cut out of the text."""
    names = rows.columns[:-1]
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            columns, runs = batch.columns[:-1], batch.column(len(names))
            some = runs.is_valid()
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False)).tolist()
            if at:
                texts = columns[place]
                shorter = [cut(texts[i].as_py(), [(r["first"], r["last"]) for r in runs[i].as_py()]) for i in at]
                columns[place] = pc.replace_with_mask(texts, some, pa.array(shorter, texts.type))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.drop(rows.columns[-1]).schema)


def _matched(rows: DataFrame, runs: DataFrame, id_col, text_hash, min_words: int) -> DataFrame:
    """rows + __dk_runs and __dk_copy (the row's text is there under an earlier id)."""
    runs = runs.select(F.col("id").alias("__dk_id"), F.col("th").alias("__dk_th"), F.col("runs").alias("__dk_runs"), F.lit(True).alias("__dk_first"))
    joined = rows.join(runs.hint("merge"), id_col.eqNullSafe(runs["__dk_id"]) & (text_hash == runs["__dk_th"]), "left")  # the same plan at every size
    return joined.withColumn("__dk_copy", F.col("__dk_first").isNull()).drop("__dk_id", "__dk_th", "__dk_first")


def dedup_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", min_words=50) -> DataFrame:
    """docs with the later repeated runs of words cut out of their texts; all rows and columns stay."""
    _, runs = repeated_runs(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    joined = _matched(docs, runs, docs[id_col], F.xxhash64(docs[text_col]), min_words)
    cut_here = F.col("__dk_runs").isNotNull() & ~F.col("__dk_copy")
    long = F.regexp_count(F.col(text_col), F.lit(WORD)) >= min_words
    text = F.when(F.col("__dk_copy") & long, F.lit("")).otherwise(F.col(text_col).cast("string"))
    return cut_words(joined.withColumn(text_col, text).select(*docs.columns, F.when(cut_here, F.col("__dk_runs")).alias("__dk_cut")), text_col)


def line_report(docs: DataFrame, *, id_col="doc_id", text_col="text", min_words=50) -> DataFrame:
    """(id, n_words, n_removed, removed): what dedup_lines takes out of each document, as 'first-last' runs of words joined by commas, words counted from 0."""
    sizes, runs = repeated_runs(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    joined = _matched(sizes, runs, sizes["id"], sizes["th"], min_words)
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n_words") - 1).cast("int").alias("last")))
    none = F.array().cast("array<struct<first:int,last:int>>")
    gone = F.when(F.col("__dk_copy"), F.when(F.col("n_words") >= min_words, whole).otherwise(none)).otherwise(F.coalesce("__dk_runs", none))
    joined = joined.withColumn("gone", gone)
    count = F.aggregate("gone", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    spans = F.array_join(F.transform("gone", lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ",")
    return joined.select("id", "n_words", count.cast("long").alias("n_removed"), spans.alias("removed"))
