"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of word shingles; two documents link at `radius` or fewer differing bits. The bits are grouped
by correlation, measured on every distinct fingerprint, into m parts. If the parts' thresholds t sum to
radius - m + 1 (-1: the part isn't probed), any linked pair is within t of one another in some part. Dynamic
programming gives the parts unequal thresholds by their estimated numbers of candidates and of probes, for
every m, and the cheapest m is taken. A probe row goes out for each key within a part's threshold; rows that
meet under a key are verified on all bits. Of a group of mutually close fingerprints only a spanning forest
of its links is emitted, and a crowded key is split into pairs of blocks, so no group's pairs are ever listed
and no key's rows meet in one task. Equal fingerprints are one node from the start.

Links by similarity (`similar_components`): texts whose sets of shingles have a Jaccard similarity of 0.8 differ in
some 15 % of the bits, too many for a guarantee by counting bits. There the fingerprint is longer, and the dynamic
programme gives the parts' thresholds so that a pair at the similarity asked for is within them in some part with
the recall asked for, at the least estimated cost; the more texts, the wider the parts and the more of them. Rows
that meet are compared on CHECK further bits, and what passes is decided by the sets themselves. A forest's link may
be refused there, so texts still in different components after that meet once more, pair by pair. These pairs must
also agree in their numbers of shingles (a bound that loses nothing) and on SKETCH further words of bits; how many
may differ follows from the sizes, for small sets by the exact odds. What is left to the texts are pairs close to
the similarity asked for, not all of a crowd of loosely similar texts.

Fewer words than a shingle: the whole sequence is one shingle. No words, empty or null text: fingerprint
zero, linked like any other. Rows that repeat are classed like equal texts; a null id is kept and is never a
component's least id unless it has no other.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .hashing import MIX1, MIX2, mixed

#: A probe row costs a shuffle, a candidate one exclusive-or in an array.
ROW_COST, CANDIDATE_COST = 1.0, 1 / 500
#: Rows under one key that one task compares with one another or with another such block.
BLOCK = 2048
#: Bits that rows under one key are compared on before their texts are, and how many of them may differ.
CHECK, CHECK_RADIUS = 128, 36
#: Words of 64 bits that pairs of different components are compared on, and the standard deviations granted to the bits that differ.
SKETCH, SLACK = 16, 3.5


def simhash_bytes(text: str | None, shingle: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, the highest bit first."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n, digest, view = max(1, len(words) - shingle + 1), xxhash.xxh64_digest, memoryview(joined)
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    counts, done = np.zeros(64, dtype=np.int64), 0
    while done < n:  # in slices: a long text needs no more memory than a short one
        to = min(n, done + 65_536)
        hashes = b"".join([digest(view[a:b], seed) for a, b in zip(starts[done:to].tolist(), stops[done:to].tolist())])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        done = to
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=4, seed=42) -> DataFrame:
    """(id, fp long): one row a document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw = b"".join(simhash_bytes(t.as_py(), shingle, seed) for t in batch.column(1))
            fp = np.frombuffer(raw, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def bit_statistics(fps: DataFrame, column: str = "fp", width: int = 64) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both: over all of them, width x width sums."""

    def run(batches):
        both, n = np.zeros((width, width)), 0
        for batch in batches:
            if pa.types.is_integer(batch.column(0).type):
                x = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(x, axis=1)[:, ::-1].astype(np.float32)
            else:
                bits = bits_of(batch.column(0), width).astype(np.float32)
            both, n = both + bits.T @ bits, n + len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["k", "c"])

    found = fps.select(column).mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # arrays: as rows they would fill the driver
    sums = np.zeros(width * width + 1, dtype=np.int64)
    sums[found.column("k").to_numpy()] = found.column("c").to_numpy()
    return int(sums[-1]), sums[:-1].astype(float).reshape(width, width)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of nearly equal width; each takes, one by one, the free bit most correlated with its own. `near` is summed up as a part grows."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(sd, sd))
    free, parts = np.ones(len(near), dtype=bool), []
    np.fill_diagonal(near, 0.0)
    for k in range(m):
        width = int(free.sum()) // (m - k)
        weight = np.where(free, near[:, free].sum(axis=1), -1.0)
        part: list[int] = []
        while len(part) < width:
            best = int(weight.argmax())
            free[best] = False
            part.append(best)
            weight = np.where(free, near[:, part].sum(axis=1), -1.0)
        parts.append(sorted(part))
    return parts


def distance_odds(part: list[int], both: np.ndarray, n: int, most: int) -> np.ndarray:
    """Odds that two fingerprints differ in 0, 1, ... bits of a part: the part is taken two bits at a time, each two with their joint distribution."""
    odds = np.zeros(most + 1)
    odds[0] = 1
    for i in range(0, len(part), 2):
        own = part[i : i + 2]
        if len(own) == 2:
            a, b = own
            p11 = both[a, b] / n
            p10, p01 = both[a, a] / n - p11, both[b, b] / n - p11
            p00 = 1 - p11 - p10 - p01
            same, two = p00**2 + p01**2 + p10**2 + p11**2, 2 * (p00 * p11 + p01 * p10)
            step = [same, 1 - same - two, two]
        else:
            p = both[own[0], own[0]] / n
            step = [p * p + (1 - p) ** 2, 2 * p * (1 - p), 0]
        odds = np.convolve(odds, step)[: most + 1]
    return odds


def allocate(both: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least cost, over all numbers of parts up to radius + 2."""
    best, plan = float("inf"), []
    for m in range(1, radius + 3):
        parts = group_bits(both, n, m)
        costs = []
        for part in parts:
            near, rows, own = distance_odds(part, both, max(n, 1), radius).cumsum(), 0.0, [0.0]
            ways = 1.0
            for t in range(radius + 1):
                rows += ways
                ways *= (len(part) - t) / (t + 1)
                own.append(ROW_COST * max(n, 1) * rows + CANDIDATE_COST * n * n / 2 * float(near[t]))
            costs.append(own)
        least = {0: (0.0, [])}  # thresholds plus one given out so far -> cost, thresholds
        for own in costs:
            step = {}
            for (used, (cost, ts)), t1 in itertools.product(least.items(), range(radius + 2)):
                if used + t1 <= radius + 1 and cost + own[t1] < step.get(used + t1, (float("inf"),))[0]:
                    step[used + t1] = (cost + own[t1], [*ts, t1 - 1])
            least = step
        cost, thresholds = least.get(radius + 1, (float("inf"), []))
        if cost < best:
            best, plan = cost, [(p, t) for p, t in zip(parts, thresholds) if t >= 0]
    return plan


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): for each part, its value and every value within its threshold."""
    keys = []
    for k, (part, threshold) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in part))))
        for t in range(threshold + 1):
            for flips in itertools.combinations(part, t):
                keys.append(F.xxhash64(F.lit(k), own.bitwiseXOR(F.lit(signed(sum(1 << b for b in flips))))))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")) if keys else fps.select("fp", F.lit(0).cast("long").alias("key")).where("false")


def apart(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words, three words at most. Of signed words numpy counts the bits of the absolute value."""
    words = [np.bitwise_count((own[..., k] ^ others[..., k]).view(np.uint64)) for k in range(own.shape[-1])]
    return sum(words[1:], words[0])


def close_ones(bits: np.ndarray, radius: int) -> np.ndarray:
    """Which rows have another one within the radius."""
    out = np.zeros(len(bits), dtype=bool)
    for at in range(0, len(bits), 256):
        near = apart(bits[at : at + 256, None], bits[None, :]) <= radius
        out[at : at + 256] = near.sum(axis=1) > 1  # itself is one
    return out


def forest(nodes: np.ndarray, bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join a group's linked nodes; each is reached once, by the first that links to it."""
    if len(nodes) > 8:
        some = close_ones(bits, radius)
        nodes, bits = nodes[some], bits[some]
    left = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = apart(bits[left], bits[at]) <= radius
            if near.any():
                found = left[near]
                out += [(int(nodes[at]), int(x)) for x in nodes[found]]
                queue += found.tolist()
                left = left[~near]
    return out


def across(nodes: np.ndarray, bits: np.ndarray, radius: int, more: np.ndarray, similarity: float, allowed: np.ndarray) -> list[tuple[int, int]]:
    """All pairs within the radius that are of different roots and may be as similar as asked; `more` holds root, size and sketch."""
    out: list[tuple[int, int]] = []
    for at in range(0, len(nodes), 256):
        near = (apart(bits[at : at + 256, None], bits[None, :]) <= radius) & (more[at : at + 256, None, 0] != more[None, :, 0])
        i, j = np.nonzero(near)
        i = i + at
        keep = i < j
        i, j = i[keep], j[keep]
        keep = may_link(more, i, j, similarity, allowed)
        out += zip(nodes[i[keep]].tolist(), nodes[j[keep]].tolist())
    return out


def may_link(more: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, allowed: np.ndarray) -> np.ndarray:
    """Which of the pairs i, j of rows (root, size, sketch) their sizes and sketches leave open; `allowed` has the differing bits by the larger size."""
    sizes = more[:, 1]
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    open_ = low >= high * similarity - 1e-9
    for at in range(0, len(i), 16_384):  # in slices: a crowd's sketches are not all copied at once
        own = np.flatnonzero(open_[at : at + 16_384]) + at
        differ = np.bitwise_count((more[i[own], 2:] ^ more[j[own], 2:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        open_[own] = differ <= allowed[np.minimum(high[own], len(allowed) - 1)]
    return open_


def link_groups(rows: DataFrame, radius: int, *, node="fp", checks=("fp",), more=(), similarity: float = 0.8) -> DataFrame:
    """rows (key, node, checks...) -> (a, b): links found among the rows that share a key; crowded keys are compared block by block.

    Without `more` a spanning forest of a group's links. With it (columns of root, size and sketch) all links between
    different roots whose sizes and sketches leave the similarity open.
    """
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowded = crowded.select("key", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks"))
    rows = rows.join(crowded, "key", "left")
    own = F.pmod(F.xxhash64(F.lit(7), node), F.coalesce("blocks", F.lit(1))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col(node).alias("node"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(checks)], *more)
    width = len(checks)
    allowed = allowances(similarity) if more else None

    def run(batches):
        held = np.empty((0, 2 + width + len(more)), dtype=np.int64)

        def compare(table):
            if not len(table):
                return
            key = table[:, 0]
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            sizes = np.diff(cuts)
            links: list[tuple[int, int]] = []
            two = cuts[:-1][sizes == 2]
            a, b = table[two], table[two + 1]
            near = (apart(a[:, 2 : 2 + width], b[:, 2 : 2 + width]) <= radius) & (a[:, 1] != b[:, 1])
            if more:
                near &= a[:, 2 + width] != b[:, 2 + width]
                near[near] = may_link(table[:, 2 + width :], two[near], two[near] + 1, similarity, allowed)
            links += zip(a[near, 1].tolist(), b[near, 1].tolist())
            for at, size in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = table[at : at + size]
                own = own[np.unique(own[:, 1], return_index=True)[1]]
                bits = own[:, 2 : 2 + width]
                links += across(own[:, 1], bits, radius, own[:, 2 + width :], similarity, allowed) if more else forest(own[:, 1], bits, radius)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            table = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
            if not len(table):
                continue
            whole = int(np.searchsorted(table[:, 0], table[-1, 0]))  # the last group may go on in the next batch
            yield from compare(table[:whole])
            held = table[whole:]
        yield from compare(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, *, id_col="doc_id", text_col="text", radius=4, shingle=4, seed=42) -> DataFrame:
    """(id, fp, component_id): component_id is the least id linked, directly or not."""
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    n, both = bit_statistics(nodes)
    links = materialize(link_groups(probes(nodes, allocate(both, n, radius)), radius), "links")
    roots = connected_components(links)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("id", "fp", "component_id")


# Links by similarity.


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    view = memoryview(joined)
    raw = b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist())])
    return np.unique(np.frombuffer(raw, dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def long_fingerprint(own: np.ndarray, words: int) -> bytes:
    """`words` x 64 bits: a bit is 1 if set in over half the shingles; further hashes of a shingle come from its own."""
    counts = np.zeros(words * 64, dtype=np.int64)
    salts = mixed(np.arange(1, words + 1, dtype=np.uint64) * MIX1)
    for at in range(0, len(own), 4080):  # in slices: a long text needs no more memory than a short one
        raw = mixed((own[at : at + 4080, None] ^ salts) * MIX2).view(np.uint8).reshape(-1, words * 8)
        bits = np.unpackbits(raw, axis=1)
        for k in range(0, len(bits), 255):
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(own)).tobytes()


def bits_of(column, width: int) -> np.ndarray:
    """Fingerprints as rows of bits."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return np.unpackbits(raw.reshape(len(column), -1), axis=1)[:, :width]


def differing(similarity: float) -> float:
    """The share of bits in which sets of this similarity differ, at most: their cosine is 2 s / (1 + s) or more. A little is added for small sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi + 0.01


def worst_odds(n: int, similarity: float) -> float:
    """Highest odds that a bit differs between a set of n and a smaller one so similar: bits are majorities of fair signs, a tie is 0."""

    def sums(k: int) -> np.ndarray:
        return np.array([math.comb(k, u) for u in range(k + 1)], dtype=float) / 2.0**k

    def above(k: int, s: np.ndarray) -> np.ndarray:
        return np.array([sums(k)[max(0, (k - x) // 2 + 1) :].sum() for x in s.tolist()])  # u of k signs are up: s + 2 u - k > 0

    worst = 0.0
    for a in range(n):
        common = n - a
        most = min(a, math.floor(common / similarity - common + 1e-9) - a)
        if most < 0:
            break
        s, p = np.arange(-common, common + 1, 2), sums(common)
        one = above(a, s)
        for b in {most, max(0, most - 1)}:
            other = above(b, s)
            worst = max(worst, float((p * (one * (1 - other) + other * (1 - one))).sum()))
    return worst


def allowances(similarity: float, exact: int = 64) -> np.ndarray:
    """Differing bits of a sketch that a pair may have, by the size of its larger set; the odds fall with the size, larger sets have the last sizes' peak."""
    width = SKETCH * 64
    odds = np.array([worst_odds(n, similarity) for n in range(exact + 1)])
    odds[-1] = odds[-exact // 2 :].max()
    return np.ceil(width * odds + SLACK * np.sqrt(width * odds * (1 - odds))).astype(np.int64)


def within(width: int, threshold: int, p: float) -> float:
    return sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(threshold + 1))


def plan_width(n: int, p: float, recall: float) -> tuple[int, int]:
    """(width, parts): for parts that must be equal, the width of least cost and how many of them give the recall."""
    best = None
    for width in range(4, 41):
        parts = math.ceil(math.log(1 - recall) / math.log(1 - within(width, 0, p)))
        cost = parts * (ROW_COST * n + CANDIDATE_COST * n * n / 2 / 2**width)
        if best is None or cost < best[0]:
            best = cost, width, parts
    return best[1:]


def allocate_for_recall(parts: list[list[int]], both: np.ndarray, n: int, p: float, recall: float, steps: int = 400) -> list[tuple[list[int], int]]:
    """Thresholds of least cost with which a pair whose bits differ with odds p is met in some part with the recall asked for.

    Dynamic programming over the logarithm of the odds that a pair is missed, in steps rounded down; all parts at threshold 1 if even these fall short.
    """
    unit = -math.log(1 - recall) / steps
    least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        odds = distance_odds(part, both, max(n, 1), 1).cumsum()
        options = [(0, 0.0, -1)]
        for t, rows in ((0, 1), (1, 1 + len(part))):
            gain = int(-math.log(1 - within(len(part), t, p)) / unit)
            options.append((gain, ROW_COST * n * rows + CANDIDATE_COST * n * n / 2 * float(odds[t]), t))
        step: dict[int, tuple[float, list[int]]] = {}
        for (done, (cost, ts)), (gain, more, t) in itertools.product(least.items(), options):
            to = min(steps, done + gain)
            if cost + more < step.get(to, (float("inf"),))[0]:
                step[to] = (cost + more, [*ts, t])
        least = step
    thresholds = least[steps][1] if steps in least else [1] * len(parts)
    return [(part, t) for part, t in zip(parts, thresholds) if t >= 0]


def long_probes(nodes: DataFrame, plan: list[tuple[list[int], int]], width: int) -> DataFrame:
    """nodes (node, fp) -> (key, node, c0, c1): for each part its value and every value within its threshold, and the bits to compare."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            bits = bits_of(batch.column(1), width + CHECK)
            checks = np.packbits(bits[:, width:], axis=1).view(np.int64)
            for k, (part, threshold) in enumerate(plan):
                value = bits[:, part].astype(np.uint64) @ (np.uint64(1) << np.arange(len(part), dtype=np.uint64))
                values = [value] + ([value ^ np.uint64(1 << b) for b in range(len(part))] if threshold else [])
                for v in values:
                    key = mixed(mixed(v + np.uint64(1)) ^ np.uint64((k + 1) * int(MIX1) & 0xFFFFFFFFFFFFFFFF))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), pa.array(checks[:, 0]), pa.array(checks[:, 1])], ["key", "node", "c0", "c1"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, c0 long, c1 long")


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (node, text) -> (node, size, s0, s1, ...): the number of a text's shingles and SKETCH words of bits."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            raw = b"".join(long_fingerprint(own ^ MIX2, SKETCH) for own in sets)  # other bits than those that made the pairs meet
            words = np.frombuffer(raw, dtype=np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(own) for own in sets], pa.int64()), *map(pa.array, words.T.copy())], names)

    names = ["node", "size", *[f"s{k}" for k in range(SKETCH)]]
    return texts.select("node", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def linked(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """pairs (a, b) of nodes -> those whose sets are as similar as asked."""

    def run(batches):
        last, held = None, None  # pairs of one node often follow one another
        for batch in batches:
            ok = np.zeros(len(batch), dtype=bool)
            for i, (one, other) in enumerate(zip(batch.column(2), batch.column(3))):
                one = one.as_py()
                if held is None or one != last:
                    last, held = one, shingle_set(one, shingle)
                ok[i] = jaccard(held, shingle_set(other.as_py(), shingle)) >= similarity
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    left, right = texts.withColumnsRenamed({"node": "a", "text": "ta"}), texts.withColumnsRenamed({"node": "b", "text": "tb"})
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "ta", "tb")
    return materialize(joined.mapInArrow(run, "a long, b long"), "links")


def similar_classes(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=5, similarity=0.8, recall=0.995) -> tuple[DataFrame, DataFrame]:
    """(rows (id, node), classes (node, least, component_id)): a node is a distinct text, least its least id; linked texts, directly or not, share a component."""
    id_type = docs.schema[id_col].dataType.simpleString()
    n, p = docs.count(), differing(similarity)
    part_width, m = plan_width(max(n, 2), p, recall)
    words = -(-((m + m // 4 + 1) * part_width + CHECK) // 64)
    width = words * 64 - CHECK
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))

    def mark(batches):
        for batch in batches:
            fps = [long_fingerprint(shingle_set(t.as_py(), shingle), words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], ["id", "node", "fp"])

    marked = materialize(own.mapInArrow(mark, f"id {id_type}, node long, fp binary"), "fingerprints")
    nodes = marked.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"))  # a null id only where there is no other
    nodes = materialize(nodes, "nodes")
    n, both = bit_statistics(nodes, "fp", width)
    plan = allocate_for_recall(group_bits(both, n, width // part_width), both, n, p, recall)
    rows = materialize(long_probes(nodes, plan, width), "probes")
    pairs = link_groups(rows, CHECK_RADIUS, node="node", checks=("c0", "c1"))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    met = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met")
    # only a text's first row is moved, so a frequent one is one row
    first = nodes.join(met.hint("merge"), "node", "left_semi").select(F.col("node").alias("__dk_node"), F.col("least").alias("__dk_id"))
    texts = own.join(first.hint("merge"), F.col("id").eqNullSafe(F.col("__dk_id")) & (F.col("node") == F.col("__dk_node"))).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "texts")

    links = linked(pairs, texts, shingle, similarity)
    roots = materialize(connected_components(links), "roots")
    # what the forests' failed links may have kept apart is decided pair by pair
    named = met.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    sketched = named.join(sketches(texts, shingle).hint("merge"), "node")
    more = ("root", *[c for c in sketched.columns if c not in ("node", "root")])
    rest = link_groups(rows.join(sketched.hint("merge"), "node"), CHECK_RADIUS, node="node", checks=("c0", "c1"), more=more, similarity=similarity)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs.hint("merge"), ["a", "b"], "left_anti")
    late = linked(materialize(rest, "pairs"), texts, shingle, similarity)
    roots = connected_components(links.unionByName(late))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("id", "node"), named.join(component, "root")


def similar_components(docs: DataFrame, **options) -> DataFrame:
    """(id, component_id): component_id is the least id whose text is linked by Jaccard similarity, directly or not."""
    rows, classes = similar_classes(docs, **options)
    return rows.join(classes.select("node", "component_id"), "node").select("id", "component_id")


def keep_dissimilar(docs: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """docs with one document left of each component of similar texts: the one whose id is least (of equal ids, the text that hashes least)."""
    _, classes = similar_classes(docs, id_col=id_col, text_col=text_col, **options)
    lead = classes.where(F.col("least").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("node").alias("__dk_node"), F.first("component_id").alias("__dk_id"))
    node = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(lead.drop("root").hint("merge"), docs[id_col].eqNullSafe(lead["__dk_id"]) & (node == lead["__dk_node"]), "left_semi")  # the same plan at every size
