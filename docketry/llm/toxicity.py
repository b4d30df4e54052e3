"""Toxicity: a support vector machine on a gapped subsequence string kernel with Nystrom landmarks.

The kernel compares two tokens by the character triples they share in order, gaps allowed: a triple counts
DECAY to the power of the characters it skips, within a span of SPAN, so `id.iot` or `idxiot` stays near
`idiot`; punctuation inside a token is a gap that never matches. Kernel values are normalised. Landmarks give
every token a finite vector (Nystrom), on which a linear machine with squared hinge loss is trained; since the
map is linear in the landmarks' kernel values, the trained machine folds into one weight for each triple.

Labels mark documents, so training alternates: witnesses are picked from the toxic documents' tokens, hard
negatives from the clean ones, and the machine is refitted. Witnesses are also shown with characters inserted.
A document's evidence is its highest margin and how densely tokens on the toxic side stand in it; a logistic
curve on both, fitted on documents the machine had not seen, gives the probability.

Labels mark documents, not sentences, so the machine's items are tokens: the sentence of one word is the smallest
that can be toxic. Training takes at most `max_docs` labelled documents with `max_chars` characters in all, whole
texts in the order of a hash of their ids, the bound of what the one task holds that trains; the driver gets the folded
weights only. The machine learns from at most
`n_positive` witnesses beside the seeds, `n_frequent` frequent and `n_random` random clean tokens, and in each round
`n_hard` of the clean tokens nearest to the toxic side and twice as many of the next. Scoring reads every text whole. Runs of single characters (`i d i o t`) are also read as one token. Empty or null text, and
documents with no token above the floor, get the floor's probability. Rows that repeat get equal scores; with
no usable labels every score is the share of toxic ones, or 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

ALPHABET, GAP, SPAN, DECAY, LONGEST = 64, 63, 8, 0.6, 48
FLOOR = -1.0


def symbols(token: str) -> np.ndarray:
    """a-z are 0-25, other letters and digits share 26-62, anything else is a gap."""
    return np.array([ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 37 if c.isalnum() else GAP for c in token], dtype=np.int64)


def trimmed(token: str) -> str:
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


_TRIPLES: dict[int, tuple[np.ndarray, ...]] = {}


def triples(n: int) -> tuple[np.ndarray, ...]:
    """Places i < j < k within the span, and their weight."""
    if n not in _TRIPLES:
        found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
        i, j, k = np.array(found, dtype=np.int64).reshape(-1, 3).T
        _TRIPLES[n] = i, j, k, DECAY ** (k - i - 2)
    return _TRIPLES[n]


def occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens of one length (rows of symbols): codes of their triples and weights, zero where a gap is touched."""
    i, j, k, w = triples(words.shape[1])
    a, b, c = words[:, i], words[:, j], words[:, k]
    return (a * ALPHABET + b) * ALPHABET + c, np.where((a == GAP) | (b == GAP) | (c == GAP), 0.0, w)


def self_kernel(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square root of a token's kernel with itself: a triple's occurrences add up before they are squared."""
    order = np.argsort(codes, axis=1)
    c, w = np.take_along_axis(codes, order, axis=1), np.take_along_axis(weights, order, axis=1)
    fresh = np.ones(c.shape, dtype=bool)
    fresh[:, 1:] = c[:, 1:] != c[:, :-1]
    group = np.cumsum(fresh.ravel()) - 1
    sums = np.bincount(group, weights=w.ravel())
    rows = np.repeat(np.arange(len(c)), fresh.sum(axis=1))
    return np.sqrt(np.bincount(rows, weights=sums**2, minlength=len(c)))


def pieces(token: str) -> list[str]:
    """A long token is read in overlapping parts; its score is the highest of theirs."""
    token = trimmed(token)
    return [token] if len(token) <= LONGEST else [token[a : a + LONGEST] for a in range(0, len(token) - SPAN, LONGEST - SPAN)]


def token_margins(tokens: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """Margins, held at the floor below it. The exact norm is computed only where it can lift a token above the floor."""
    if len(tokens) > 20_000:  # in slices: a large vocabulary needs no more memory than a small one
        return np.concatenate([token_margins(tokens[a : a + 20_000], weight, bias) for a in range(0, len(tokens), 20_000)])
    out = np.full(len(tokens), FLOOR)
    by_length: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for at, token in enumerate(tokens):
        for part in pieces(token):
            if len(part) >= 3:
                by_length[len(part)].append((at, part))
    for n, found in by_length.items():
        step = max(64, 200_000 // max(1, len(triples(n)[0])))
        for s in range(0, len(found), step):
            at = np.array([x for x, _ in found[s : s + step]])
            codes, w = occurrences(np.stack([symbols(t) for _, t in found[s : s + step]]))
            raw = (weight[codes] * w).sum(axis=1)
            least = np.sqrt((w**2).sum(axis=1))  # the norm is this or more
            some = (raw > 0) & (raw + (bias - FLOOR) * least > 0)
            if some.any():
                norm = self_kernel(codes[some], w[some])
                np.maximum.at(out, at[some], raw[some] / norm + bias)
    return out


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased words, and runs of three single characters or more read as one."""
    words = (text or "").lower().split()
    sizes = bytes([min(len(w), 2) for w in words])
    at = sizes.find(b"\1\1\1")
    while at >= 0:
        end = at
        while end < len(sizes) and sizes[end] == 1:
            end += 1
        words.append("".join(words[at:end]))
        at = sizes.find(b"\1\1\1", end)
    return words


def evidence(margins: list[float]) -> tuple[float, float]:
    """(highest margin, log density of tokens on the toxic side) of a document's tokens, each as often as it stands there."""
    m = np.fromiter(margins, dtype=float, count=len(margins))
    return min(1.5, float(m.max(initial=FLOOR))), math.log((int((m >= 0).sum()) + 0.5) / (len(m) + 20))


class Machine:
    """The folded machine: one weight for each triple, a bias, and the curve from a document's evidence to its probability."""

    def __init__(self, weight: np.ndarray, bias: float, curve: list[float]):
        self.weight, self.bias, self.curve = weight, bias, curve

    def probability(self, found: list[tuple[float, float]]) -> np.ndarray:
        x = np.array(found, dtype=float).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:2] + self.curve[2], -500, 500)))

    def scored(self, texts, known: dict[str, float]) -> np.ndarray:
        """Probabilities of texts; known keeps the margins of tokens met before, while it is small."""
        words = [tokens_of(t) for t in texts]
        fresh = list({w for own in words for w in own if w not in known})
        if len(known) + len(fresh) > 150_000:
            known.clear()
            fresh = list({w for own in words for w in own})
        known.update(zip(fresh, token_margins(fresh, self.weight, self.bias).tolist()))
        return self.probability([evidence(list(map(known.__getitem__, own))) for own in words])


def sparse(token: str) -> dict[int, float]:
    """A token's normalised triple weights."""
    out: dict[int, float] = defaultdict(float)
    for part in pieces(token):
        if len(part) >= 3:
            codes, w = occurrences(symbols(part)[None, :])
            for code, x in zip(codes[0].tolist(), w[0].tolist()):
                if x:
                    out[code] += x
    norm = math.sqrt(sum(x * x for x in out.values()))
    return {c: x / norm for c, x in out.items()} if norm else {}


def kernel_rows(a: Iterable[dict], b: list[dict]) -> Iterator[np.ndarray]:
    """Kernels of each of a with all of b; a may come one by one."""
    codes = {c: i for i, c in enumerate(sorted({c for x in b for c in x}))}
    dense = np.zeros((len(b), len(codes)))
    for i, x in enumerate(b):
        for c, v in x.items():
            dense[i, codes[c]] = v
    for x in a:
        own = [(codes[c], v) for c, v in x.items() if c in codes]
        at, v = zip(*own) if own else ((), ())
        yield dense[:, list(at)] @ np.array(v) if own else np.zeros(len(b))


def kernel_matrix(a: list[dict], b: list[dict]) -> np.ndarray:
    return np.array(list(kernel_rows(a, b))).reshape(-1, len(b))


def features(tokens: list[str], marks: list[dict], turn: np.ndarray) -> np.ndarray:
    """Kernels of tokens with the landmarks, turned, and a last column of ones. One token's triples are held at a time."""
    out = np.ones((len(tokens), len(marks) + 1))
    for i, row in enumerate(kernel_rows(map(sparse, tokens), marks)):
        out[i, :-1] = row
    for part in slices(len(out)):
        out[part, :-1] = out[part, :-1] @ turn
    return out


def slices(n: int, size: int = 2048) -> list[slice]:
    return [slice(a, a + size) for a in range(0, n, size)]


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float = 20.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Newton steps on the primal; few columns, the last of ones, so each step is a small linear system, summed up slice by slice."""
    w = np.zeros(z.shape[1])
    ridge = np.append(np.ones(z.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        inside = np.flatnonzero(y * (z @ w) < 1)
        left, right = np.diag(ridge), np.zeros(len(w))
        for part in slices(len(inside)):
            at = inside[part]
            zi, ci = z[at], c * cost[at]
            left, right = left + zi.T @ (zi * ci[:, None]), right + zi.T @ (ci * y[at])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def fit_machine(positives: list[str], negatives: list[str], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Nystrom features of the tokens, a linear machine on them, folded into weights of triples."""
    marks = [m for m in map(sparse, landmarks) if m]
    both = kernel_matrix(marks, marks)
    values, vectors = np.linalg.eigh(both + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    x = features(positives + negatives, marks, root)
    y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
    cost = np.where(y > 0, len(y) / (2 * max(1, len(positives))), len(y) / (2 * max(1, len(negatives)))) / len(y) * 2000
    w, bias = squared_hinge(x, y, np.where(y > 0, cost, 3 * cost) * 5)
    weight = np.zeros(ALPHABET**3, dtype=np.float32)
    for mark, beta in zip(marks, root @ w):
        for code, v in mark.items():
            weight[code] += beta * v
    return weight, bias


def altered(token: str) -> list[str]:
    """The token with characters put in."""
    half = len(token) // 2
    return [token[:half] + "." + token[half:], "-".join(token), token[:1] + "*" + token[1:], token[:half] + token[half - 1] + token[half:]]


def witnesses(docs: list[tuple[set[str], int]], odds: float = 1e-4) -> tuple[list[str], list[str]]:
    """Tokens that tell toxic documents by cover, most telling first: (seeds, other tokens with the same standing).

    Documents are counted once for each group of near copies (equal three least token hashes), so a copied text is no evidence of itself.
    """
    groups: dict[tuple, list] = {}
    for tokens, label in docs:
        long = [zlib.crc32(t.encode()) for t in tokens if len(t) >= 6]
        group = groups.setdefault(tuple(sorted(long)[:3]) or (-len(groups),), [tokens, []])
        group[0] = tokens if group[0] is tokens else group[0] | tokens
        group[1].append(label)
    merged = [(t, sum(v) * 2 > len(v)) for t, v in groups.values()]
    n1 = sum(label for _, label in merged)
    n0 = len(merged) - n1
    if not n1 or not n0:
        return [], []
    in1 = Counter(t for own, label in merged if label for t in own)
    in0 = Counter(t for own, label in merged if not label for t in own if t in in1)  # the others' tokens tell nothing

    def telling(token: str) -> float:
        a, b = in1[token], in0[token]
        return a * math.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5)) if a * n0 > 8 * b * n1 else 0.0

    need = -math.log(odds)
    standing = {t: s for t in in1 if len(t) >= 3 and in1[t] >= 3 and (s := telling(t)) >= need}
    seeds, left = [], [own for own, label in merged if label]
    while standing and left:
        cover = Counter(t for own in left for t in own if t in standing)
        if not cover:
            break
        token, count = max(cover.items(), key=lambda x: (x[1], standing[x[0]], x[0]))
        if count < 2:
            break
        seeds.append(token)
        left = [own for own in left if token not in own]
    rest = sorted((t for t in standing if t not in seeds), key=lambda t: (-standing[t], t))
    return seeds, rest


def train(rows: list[tuple[str, int]], *, landmarks: int = 256, rounds: int = 3, seed: int = 3, n_positive: int = 400, n_frequent: int = 2000, n_random: int = 4000, n_hard: int = 2000) -> Machine:
    """rows: (text, toxic). Half of them choose the witnesses of the curve's machine, the other half the curve."""
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    flat = Machine(np.zeros(ALPHABET**3, dtype=np.float32), FLOOR, [0.0, 0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9))])
    pool: dict[str, str] = {}
    docs = [([pool.setdefault(t, t) for w in tokens_of(text) for t in (trimmed(w),)], int(y)) for text, y in rows]
    pool.clear()

    def machine(own):
        own = [(set(tokens) - {""}, y) for tokens, y in own]
        seeds, rest = witnesses(own)
        if not seeds:
            return None
        rng = np.random.default_rng(seed)
        common = Counter(t for tokens, y in own if not y for t in tokens if len(t) >= 3)
        bad = set(seeds) | set(rest)
        frequent = [t for t, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:n_frequent] if t not in bad]
        others = sorted(t for t in common if t not in bad)
        negatives = frequent + [others[i] for i in rng.permutation(len(others))[:n_random]]
        positives = seeds + rest[:n_positive]
        for _ in range(rounds):
            shown = positives + [a for t in positives for a in altered(t)]
            marks = list(dict.fromkeys(seeds + rest[: landmarks // 2] + negatives[-landmarks // 4 :] + frequent[: landmarks // 4]))[:landmarks]
            weight, bias = fit_machine(shown, list(dict.fromkeys(negatives)), marks)
            margins = token_margins(others, weight, bias)
            order = np.argsort(-margins, kind="stable")
            near = order[margins[order] > -0.7]
            hard = np.concatenate((near[:n_hard], rng.permutation(near[n_hard:])[: 2 * n_hard]))
            negatives = negatives + [others[i] for i in hard]
        return weight, bias

    def doc_evidence(own, weight, bias):
        all_tokens = sorted({t for tokens, _ in own for t in tokens})
        margin = dict(zip(all_tokens, token_margins(all_tokens, weight, bias)))
        return [evidence([margin[t] for t in tokens]) for tokens, _ in own]

    odd = [zlib.crc32(text.encode("utf-8", "surrogatepass")) % 2 for text, _ in rows]  # equal texts stay in one half
    halves = [d for d, o in zip(docs, odd) if o], [d for d, o in zip(docs, odd) if not o]
    found = machine(docs)
    if found is None:
        return flat
    seen, labels = [], []
    for a, b in (halves, halves[::-1]):
        part = machine(a)
        if part is not None:
            seen += doc_evidence(b, *part)
            labels += [y for _, y in b]
    if not seen:
        seen, labels = doc_evidence(docs, *found), [y for _, y in docs]
    return Machine(*found, logistic(np.array(seen), np.array(labels, dtype=float)))


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights and shift of a logistic curve that no feature pulls down: one that would is left out."""
    middle, wide = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    used = [0, 1]
    while True:
        z, w = np.hstack((((x - middle) / wide)[:, used], np.ones((len(x), 1)))), np.zeros(len(used) + 1)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
            w = w + step / max(1.0, float(np.abs(step).max()))  # never far at once
            if np.abs(step).max() < 1e-6:
                break
        down = [k for k, v in zip(used, w) if v < 0]
        if not down:
            slope = [float(w[used.index(k)] / wide[k]) if k in used else 0.0 for k in (0, 1)]
            return [*slope, float(w[-1] - slope[0] * middle[0] - slope[1] * middle[1])]
        used = [k for k in used if k not in down]


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", max_docs=4000, max_chars=100_000_000) -> DataFrame:
    """(id, text, label): at most max_docs labelled ids with max_chars characters, chosen by hash of the id; only labels are sorted, and only the chosen texts move. A text that occurs more than once under an id counts once."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__dk_id")).agg(F.max(label_col).alias("__dk_label"))
    own = own.orderBy(F.xxhash64("__dk_id"), "__dk_id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("__dk_key"), F.col(text_col).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(own), F.col("__dk_key") == F.col("__dk_id")).select("__dk_id", "text", "__dk_label")
    sizes = found.select("__dk_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct()
    sizes = sizes.groupBy("__dk_id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("__dk_id"), "__dk_id").collect()  # at most max_docs rows
    chosen, left = [], max_chars
    for r in sizes:
        if r["n"] <= left:
            chosen.append(r["__dk_id"])
            left -= r["n"]
    rows = found.where(F.col("__dk_id").isin(chosen) if chosen else F.lit(False)).distinct()
    return rows.select(F.col("__dk_id").alias("id"), "text", F.col("__dk_label").cast("int").alias("label"))


def fit(rows: DataFrame, **options) -> Machine:
    """The machine trained on rows (id, text, label), in the order of ids and texts. One task trains; the texts never reach the driver."""

    def run(batches):
        own = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        machine = train([(text, label) for _, text, label in own], **options)
        weight, curve = machine.weight.astype("<f4").tobytes(), [float(x) for x in machine.curve]
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.binary()), pa.array([float(machine.bias)]), pa.array([curve], pa.list_(pa.float64()))], ["weight", "bias", "curve"])

    found = rows.repartition(1).mapInArrow(run, "weight binary, bias double, curve array<double>").collect()
    if not found:  # no rows may mean no task
        return train([], **options)
    return Machine(np.frombuffer(found[0]["weight"], dtype="<f4"), found[0]["bias"], list(found[0]["curve"]))


def score(docs: DataFrame, machine: Machine, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score): the probability of every row of docs, in their order."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            found = [machine.scored(texts, known) for _, texts in chunks(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*found, []]), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", threshold=0.5, **options) -> DataFrame:
    """docs without those whose score reaches the threshold; labels only train."""
    machine = fit(training_rows(docs, labels, id_col=id_col, text_col=text_col, **options))
    schema = docs.schema

    def run(batches):
        known: dict[str, float] = {}
        at = schema.fieldNames().index(text_col)
        for batch in batches:
            for first, texts in chunks(batch, at):
                yield batch.slice(first, len(texts)).filter(pa.array(machine.scored(texts, known) < threshold))

    return docs.mapInArrow(run, schema)
