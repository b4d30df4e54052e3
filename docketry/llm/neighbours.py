"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on m random Gaussian directions, and every projection is sorted. Around a query's value
lies a window; all that a projection's sorted list holds between the window's ends, found by binary search, collides
with the query. What stands before each place of a sorted list is kept as a set of bits, so a window is the difference
of two sets, and collisions are counted for 64 pairs at once, bit by bit of the counts. Pairs with `least` or more are
verified with their cosine in double precision. The difference of two unit vectors along a Gaussian direction is normal with their distance as
deviation, so m, the window and `least` are calibrated in closed form: of the choices that pass a pair at the
threshold cosine with the recall asked for, the one of least expected work on unrelated vectors is taken.

Vectors are dealt into blocks and each pair of blocks is one task's: nothing is emitted but, for a vector, its
number of links and a spanning forest of them. Equal vectors are one class with a weight, so copies, however many,
cost nothing. One dimension tells vectors apart by the quotient of their distances at most, 3.2 at cosine 0.9, so a
window holds a good part of all unrelated vectors and the work grows with the square of the distinct ones.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing (component: their
own id). Vectors of different length are never linked. Rows that repeat an id count as copies of one another.
A null id is kept, with links to nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .topk import matrix, whole_vectors

BLOCK, SLICE = 8192, 512
#: Vectors whose sets of bits lie in one table: a window's ends are looked up there.
TABLE = 1024
#: Verifying a pair costs as much as counting on so many projections.
VERIFY_COST = 1000
#: Pairs that are gathered at once to be verified; above this share of a slice's pairs the whole slice is multiplied.
GATHER, DENSE = 16_384, 0.05


def tails(m: int, p: float) -> np.ndarray:
    """Odds of 0, 1, ... m or more collisions of m, each with odds p."""
    k = np.arange(m + 1)
    odds = np.array([math.comb(m, int(i)) for i in k], dtype=float) * p**k * (1 - p) ** (m - k)
    return np.minimum(1.0, odds[::-1].cumsum()[::-1])


def calibrate(threshold: float, recall: float, most: int = 64) -> tuple[int, float, int, float, float]:
    """(projections, window, least collisions, recall at the threshold, odds that an unrelated pair passes)."""
    apart = math.sqrt(2 - 2 * threshold)
    best = None
    for m in range(8, most + 1, 4):
        for k in range(6, 61, 2):
            window = apart * k / 20
            near, far = tails(m, math.erf(window / apart / math.sqrt(2))), math.erf(window / 2)
            least = int(np.flatnonzero(near >= recall)[-1])
            passed = float(tails(m, far)[least])
            work = m + VERIFY_COST * passed
            if least and (best is None or work < best[0]):
                best = work, m, window, least, float(near[least]), passed
    return best[1:]


def projected(unit: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Values along the directions, one row a direction."""
    directions = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], m))
    return np.ascontiguousarray((unit @ directions).T)


def prefixes(orders: list[np.ndarray]) -> list[np.ndarray]:
    """For every order of the same n vectors: of each place, which vectors stand before it, as a row of bits."""
    out, n = [], len(orders[0])
    bit = np.uint64(1) << (np.arange(n, dtype=np.uint64) & np.uint64(63))
    for order in orders:
        sets = np.zeros((n + 1, -(-n // 64)), dtype="<u8")
        sets[np.arange(1, n + 1), order >> 6] = bit[order]
        out.append(np.bitwise_or.accumulate(sets, axis=0))
    return out


def planes(rows: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], window: float) -> list[np.ndarray]:
    """rows: values, one row a direction; lists: sorted values and the sets before each place. The bits of the counts of collisions, lowest first."""
    out: list[np.ndarray] = []
    for values, (ordered, sets) in zip(rows, lists):
        low, high = np.searchsorted(ordered, values - window), np.searchsorted(ordered, values + window, side="right")
        carry = sets[high] ^ sets[low]
        for k, plane in enumerate(out):
            out[k], carry = plane ^ carry, plane & carry
        if len(out) < len(lists).bit_length():
            out.append(carry)
    return out


def reached(counts: list[np.ndarray], least: int) -> np.ndarray:
    """Bits of the counts that are `least` or more."""
    more, same = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for k in range(len(counts) - 1, -1, -1):
        if least >> k & 1:
            same = same & counts[k]
        else:
            more = more | (same & counts[k])
            same = same & ~counts[k]
    return more | same if not least >> len(counts) else np.zeros_like(more)


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    """Rows of n bits."""
    return np.unpackbits(np.ascontiguousarray(words, dtype="<u8").view(np.uint8), axis=1, count=n, bitorder="little")


def collisions(rows: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], window: float) -> np.ndarray:
    """rows: values, one row a direction; lists: sorted values and whose they are. How often each of the rows meets each of the lists' vectors."""
    sets = prefixes([order for _, order in lists])
    counts = planes(rows, [(ordered, own) for (ordered, _), own in zip(lists, sets)], window)
    return sum(unpacked(c, len(lists[0][0])) << np.uint8(k) for k, c in enumerate(counts))


def alike(unit_a: np.ndarray, unit_b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs i, j have the cosine."""
    if len(i) > DENSE * len(unit_a) * len(unit_b):
        return (unit_a @ unit_b.T)[i, j] >= threshold
    parts = [np.einsum("ij,ij->i", unit_a[i[s : s + GATHER]], unit_b[j[s : s + GATHER]]) >= threshold for s in range(0, len(i), GATHER)]
    return np.concatenate([*parts, np.empty(0, dtype=bool)])


def joins(adjacent: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows and columns (ids)."""
    free_row, free_col, out = np.ones(len(rows), dtype=bool), np.ones(len(columns), dtype=bool), []
    for start in range(len(rows)):
        if not free_row[start]:
            continue
        free_row[start] = False
        queue = [(True, start)]
        while queue:
            is_row, at = queue.pop()
            found = np.flatnonzero(adjacent[at] & free_col) if is_row else np.flatnonzero(adjacent[:, at] & free_row)
            (free_col if is_row else free_row)[found] = False
            here, there = (rows[at], columns) if is_row else (columns[at], rows)
            out += [(int(here), int(there[x])) for x in found if there[x] != here]
            queue += [(not is_row, int(x)) for x in found]
    return out


def block_links(ids_a, x_a, w_a, ids_b, x_b, w_b, *, same: bool, threshold: float, seed: int, plan: tuple):
    """Links between two blocks: (id, weight linked) and forest edges."""
    m, window, least = plan[:3]
    unit_a, unit_b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (x_a, x_b))
    values_a, values_b = projected(unit_a, m, seed), projected(unit_b, m, seed)
    count_a, count_b, edges = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64), []
    for begin in range(0, len(ids_b), TABLE):
        end = min(begin + TABLE, len(ids_b))
        order = np.argsort(values_b[:, begin:end], axis=1)
        lists = [(v[o], sets) for v, o, sets in zip(values_b[:, begin:end], order, prefixes(list(order)))]
        # a block meets itself at i < j, so rows behind the table are left out
        for at in range(0, end if same else len(ids_a), SLICE):
            to = min(at + SLICE, len(ids_a))
            i, j = np.nonzero(unpacked(reached(planes(values_a[:, at:to], lists, window), least), end - begin))
            i, j = i + at, j + begin
            if same:
                once = i < j
                i, j = i[once], j[once]
            if not len(i):
                continue
            ok = alike(unit_a[at:to], unit_b[begin:end], i - at, j - begin, threshold)
            i, j = i[ok], j[ok]
            np.add.at(count_a, i, w_b[j])
            np.add.at(count_a if same else count_b, j, w_a[i])
            rows, columns = np.unique(i), np.unique(j)
            linked = np.zeros((len(rows), len(columns)), dtype=bool)
            linked[np.searchsorted(rows, i), np.searchsorted(columns, j)] = True
            edges += joins(linked, ids_a[rows], ids_b[columns])
    return count_a, count_b, edges


def link_blocks(classes: DataFrame, *, threshold: float, seed: int, recall: float, most: int) -> DataFrame:
    """classes (id, v, weight) -> rows (id, linked weight, null) and (a, null, b)."""
    plan = calibrate(threshold, recall, most)
    blocks = max(1, -(-classes.count() // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")
    dealt = classes.select("id", "v", "weight", F.size("v").alias("d"), own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def run(table: pa.Table) -> pa.Table:
        ids, weight, x = table.column("id").to_numpy(), table.column("weight").to_numpy(), matrix(table.column("v"))
        own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        a, same = own == i, bool(i[0] == j[0])
        b = a if same else ~a
        count_a, count_b, edges = block_links(ids[a], x[a], weight[a], ids[b], x[b], weight[b], same=same, threshold=threshold, seed=seed, plan=plan)
        every, counts = (ids[a], count_a) if same else (np.concatenate((ids[a], ids[b])), np.concatenate((count_a, count_b)))
        some = counts > 0
        k, e = int(some.sum()), len(edges)
        first = np.concatenate((every[some], np.array([p for p, _ in edges], dtype=np.int64)))
        linked = pa.array([*counts[some].tolist(), *[None] * e], pa.int64())
        return pa.table({"id": pa.array(first, pa.int64()), "linked": linked, "b": pa.array([*[None] * k, *[q for _, q in edges]], pa.int64())})

    return dealt.groupBy("d", "i", "j").applyInArrow(run, "id long, linked long, b long")


def near_duplicates(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", threshold=0.9, projections=64, recall=0.995, seed=6) -> DataFrame:
    """(id, n_links, component_id, kept): one row a row of vectors. `projections`: the most that the calibration may take."""
    whole = whole_vectors(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    # equal vectors are one class; -0.0 is 0.0
    whole = whole.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = materialize(whole.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "classes")
    links = materialize(link_blocks(classes, threshold=threshold, seed=seed, recall=recall, most=projections), "links")
    roots = connected_components(links.where("b is not null").select(F.col("id").alias("a"), "b"))
    counts = links.where("linked is not null").groupBy("id").agg(F.sum("linked").alias("linked"))
    found = classes.join(counts, "id", "left").join(roots, classes.id == roots.node, "left")
    # a table before it is joined, so that the rows of a frequent vector are split over tasks
    found = materialize(found.select("v", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "found")
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v)
    named = rows.join(found.withColumnRenamed("v", "w"), (F.col("v") == F.col("w")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return named.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = v.vec_id
"""
