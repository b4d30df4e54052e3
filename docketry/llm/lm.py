"""LM scoring with log-frequency Bloom filters of bigram counts.

Counts c are quantised to q = 1 + floor(log2 c), and a bigram is inserted q times, as (bigram, 1) ... (bigram, q).
A count is read back by probing (bigram, 1), (bigram, 2), ... until one is missing: errors are one-sided and fall
off geometrically. What has to be held of the corpus grows with it, so no copy of it goes to every worker: the
n-grams are dealt by hash into parts of about `part_chars` characters of text, each with a filter of its own that
has `bits_per_token` bits for each bigram counted in it, whatever the corpus. A part's task counts its n-grams,
builds the filter, probes it for everyone who asks, and lets it go.

Texts are written in chunks. A chunk sends each part the list of its own n-grams, once each, with how often they
stand in its training texts; back come, in the order of the list, exact counts of the words and levels of the
bigrams, a byte each as a rule. One exchange of n-grams both trains and asks, so memory and tasks stay as they are
at any size, a word that is everywhere is one entry a chunk, and a lost executor costs the parts it held.

The model: P(w|v) = (c(v w) + mu P(w)) / (c(v) + mu), P(w) = (c(w) + 1) / (N + V + 1). Words' counts are exact (by
a 64-bit hash of the word), so the base score is exact too.

Null or empty text: the end token alone. Rows that repeat are scored, and counted, each for itself. With no
training text N = V = 0 and every token is unseen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize
from .hashing import MIX1, MIX2, Tokens, mixed

#: Characters of text whose n-grams make one part: about a million tokens, some 100 MB while it is worked on.
PART_CHARS = 6_000_000
#: Characters of a chunk: the more, the fewer words are sent more than once.
CHUNK_CHARS = 2_000_000


def bigram_hashes(ids: np.ndarray) -> np.ndarray:
    """Of each token after the first with the one before it."""
    return mixed(ids[:-1] * MIX1 + (ids[1:] ^ MIX2))


class Filter:
    """A log-frequency Bloom filter of 32-bit keys."""

    def __init__(self, n_bits: int, hashes: int = 4):
        self.bits, self.hashes = np.zeros(max(64, n_bits), dtype=bool), hashes

    def places(self, keys: np.ndarray, level: int):
        h = mixed(keys.astype(np.uint64) * MIX2 + np.uint64(int(MIX1) * level & 0xFFFFFFFFFFFFFFFF))
        low, step, n = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1), np.uint64(len(self.bits))
        for k in range(self.hashes):
            yield ((low + np.uint64(k) * step) % n).astype(np.int64)

    def insert(self, keys: np.ndarray, levels: np.ndarray) -> None:
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in self.places(keys[levels >= level], level):
                self.bits[at] = True

    def levels(self, keys: np.ndarray, most: int = 64) -> np.ndarray:
        """The last level of which all hashes are set; zero where (key, 1) is missing."""
        found, alive = np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys))
        for level in range(1, most + 1):
            own, hit = keys[alive], np.ones(len(alive), dtype=bool)
            for at in self.places(own, level):
                hit &= self.bits[at]
            alive = alive[hit]
            if not len(alive):
                break
            found[alive] = level
        return found

    def false_positive_rate(self, n: int = 100_000, seed: int = 1) -> float:
        """Measured with keys taken at random."""
        return float((self.levels(np.random.default_rng(seed).integers(0, 1 << 32, n).astype(np.uint32)) > 0).mean())


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), exactly; 0 for 0."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def estimates() -> np.ndarray:
    """The middle of the counts of each level."""
    low = 2.0 ** np.arange(-1, 64)
    low[0] = 0
    return np.concatenate(([0.0], (low[1:] * 3 - 1) / 2))


def packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 or more follow in full."""
    small, big = np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype("<u8")
    return small.tobytes() + big.tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, dtype="<u8", offset=n).astype(np.int64)
    return out


class Grams:
    """The distinct n-grams of a chunk, sorted by hash: words and bigrams, and which of them each token is."""

    def __init__(self, texts: list[str | None]):
        self.found = found = Tokens(texts)
        self.words, self.word_of = np.unique(found.hashes, return_inverse=True)
        self.pairs, self.pair_of = np.unique(bigram_hashes(found.hashes), return_inverse=True)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and bigram stands in the texts marked. A text's bigrams are those that end in its tokens, its end included."""
        marked = np.repeat(train, np.diff(self.found.ends)).astype(float)
        words = np.bincount(self.word_of[1:], weights=marked, minlength=len(self.words))
        return words.astype(np.int64), np.bincount(self.pair_of, weights=marked, minlength=len(self.pairs)).astype(np.int64)


def parts_of(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """Parts in the order of the hashes, so a sorted list falls into runs."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)


LISTS = "part int, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary"


def ask_parts(pieces: DataFrame, n_parts: int) -> DataFrame:
    """pieces (chunk, texts, train) -> the lists that go to the parts."""

    def run(batches):
        for batch in batches:
            for chunk, texts, train in zip(*(batch.column(i) for i in range(3))):
                own = Grams(texts.as_py())
                word_counts, pair_counts = own.counts(np.array(train.as_py(), dtype=bool))
                edges = np.arange(n_parts + 1)
                w, p = (np.searchsorted(parts_of(x, n_parts).astype(np.int64), edges) for x in (own.words, own.pairs))
                keys = (own.pairs & np.uint64(0xFFFFFFFF)).astype("<u4")
                some = np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0))
                rows = [(own.words[w[k] : w[k + 1]].astype("<u8").tobytes(), packed(word_counts[w[k] : w[k + 1]]), keys[p[k] : p[k + 1]].tobytes(), packed(pair_counts[p[k] : p[k + 1]])) for k in some.tolist()]
                columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk.as_py(), dtype=np.int64)), *[pa.array(list(c), pa.binary()) for c in zip(*rows)]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "words", "word_counts", "pairs", "pair_counts"])

    return pieces.select("chunk", "texts", "train").mapInArrow(run, LISTS)


def answer_part(lists: list[tuple], bits_per_token: int) -> tuple[list[tuple[bytes, bytes]], int, int]:
    """Lists (words, word_counts, pairs, pair_counts) of one part -> each one's (word counts, pair levels), training tokens, distinct words among them."""
    words, pairs = [np.frombuffer(x[0], dtype="<u8") for x in lists], [np.frombuffer(x[2], dtype="<u4") for x in lists]
    counts = lambda at, own: np.concatenate([unpacked(x[at], len(y)) for x, y in zip(lists, own)])
    distinct, back = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(back, weights=counts(1, words), minlength=len(distinct)).astype(np.int64)
    asked, pair_counts = np.concatenate(pairs), counts(3, pairs)
    seen = pair_counts > 0
    keys, at = np.unique(asked[seen], return_inverse=True)
    sums = np.bincount(at, weights=pair_counts[seen], minlength=len(keys)).astype(np.int64)
    bloom = Filter(int(sums.sum()) * bits_per_token)
    bloom.insert(keys, quantised(sums))
    levels, found = bloom.levels(asked), total[back]
    out, i, j = [], 0, 0
    for w, p in zip(words, pairs):
        out.append((packed(found[i : i + len(w)]), levels[j : j + len(p)].tobytes()))
        i, j = i + len(w), j + len(p)
    return out, int(total.sum()), int((total > 0).sum())


def answers(lists: DataFrame, n_parts: int, bits_per_token: int) -> DataFrame:
    """lists -> (chunk, part, word_counts, levels, tokens, words); tokens and words stand in one row of each part."""

    def run(batches):
        held: list[tuple] = []

        def told():
            found, tokens, words = answer_part([x[2:] for x in held], bits_per_token)
            chunk, part = [x[1] for x in held], held[0][0]
            n = len(held)
            columns = [pa.array(chunk, pa.int64()), pa.array([part] * n, pa.int32()), *[pa.array(list(c), pa.binary()) for c in zip(*found)], pa.array([tokens] + [0] * (n - 1), pa.int64()), pa.array([words] + [0] * (n - 1), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "part", "word_counts", "levels", "tokens", "words"])

        for batch in batches:
            for i in range(len(batch)):
                row = tuple(c[i].as_py() for c in batch.columns)
                if held and held[0][0] != row[0]:
                    yield told()
                    held.clear()
                held.append(row)
        if held:
            yield told()

    n = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_parts)
    dealt = lists.repartition(n, "part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(run, "chunk long, part int, word_counts binary, levels binary, tokens long, words long")


def written_pieces(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """(chunk, ids, texts, train, n_chars): the texts in chunks, written, so that their numbers are the same whenever they are read."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            for at, texts in chunks(batch, 1, CHUNK_CHARS):
                ends = pa.array([0, len(texts)], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.concat_arrays([batch.column(i).slice(at, len(texts))])) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *columns, pa.array([sum(len(t or "") for t in texts)])], ["chunk", "ids", "texts", "train", "n_chars"])
                chunk += 1

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return materialize(chosen.mapInArrow(run, f"chunk long, ids array<{id_type}>, texts array<string>, train array<boolean>, n_chars long"), "chunks")


def fit_score(docs: DataFrame, train: Column, *, id_col="doc_id", text_col="text", mu=200.0, bits_per_token=6, part_chars=PART_CHARS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; the model learns from the rows where `train` holds."""
    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = written_pieces(docs, id_col, text_col, train)
    n_parts = max(1, -(-(pieces.agg(F.sum("n_chars")).first()[0] or 0) // part_chars))
    found = materialize(answers(ask_parts(pieces, n_parts), n_parts, bits_per_token), "answers")
    size = found.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    tokens = size["tokens"] or 0
    total = float(tokens + (size["words"] or 0) + 1)

    def run(batches):
        middle = estimates()
        for batch in batches:
            for ids, texts, told in zip(*(batch.column(i) for i in range(3))):
                own, told = Grams(texts.as_py()), told.as_py()
                raw = [x["word_counts"] for x in told]
                sizes = np.diff(np.searchsorted(parts_of(own.words, n_parts).astype(np.int64), np.arange(n_parts + 1)))
                c = np.concatenate([unpacked(r, int(sizes[x["part"]])) for r, x in zip(raw, told)])
                c2 = middle[np.frombuffer(b"".join(x["levels"] for x in told), dtype=np.uint8)]
                unigram = (c + 1) / total
                word, before = own.word_of[1:], own.word_of[:-1]
                pair = c2[own.pair_of]
                p = np.log10((pair + mu * unigram[word]) / (np.maximum(c[before], pair) + mu))
                starts = own.found.ends[:-1]  # in the arrays of all tokens but the first, a text's tokens begin here
                add = lambda x: pa.array(np.add.reduceat(x, starts))
                n = len(starts)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.diff(own.found.ends)), add((c > 0).astype(np.int64)[word]), pa.array(np.full(n, tokens, dtype=np.int64)), add(np.log10(unigram)[word]), add(p)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    told = found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "word_counts", "levels"))).alias("told"))
    joined = pieces.join(told.hint("merge"), "chunk").select("ids", "texts", "told")
    return joined.mapInArrow(run, f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
