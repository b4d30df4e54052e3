"""The operators against brute force, planted cases, and awkward inputs."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import licenses, lines, lm, mixing, neighbours, packing, pii, queries, simhash, topk, toxicity
from docketry.session import FREE_SHUFFLES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(20_000))
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, "en", "a", 1),
    (3, LONG, "en", "a", 1),
    (4, "1" * 50_000, "en", "b", 1),
    (None, "null id, some words here", "en", "b", 1),
    (5, " \t\n ", "en", None, 1),
    (6, "é ü ñ 漢字 🙂 " * 30, "en", "c", 1),
]


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in ("id", "fp", "block", "size", "score", "key", "runs", "_hash", "piece", "words")})


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- SimHash


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    own = sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in own]
    near = [(i, j) for i in range(len(own)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = {own[i][0]: (f"{fps[i]:016x}", own[c][0]) for i, c in enumerate(components(len(own), near))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == want


def test_simhash_plans_and_crowded_keys(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(-(1 << 63), 1 << 63, 40)
    unsigned = {(int(b) % (1 << 64)) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(12)}
    values = sorted(simhash.signed(v) for v in unsigned)  # the highest bit is one like any other
    differ = lambda a, b: bin((a ^ b) % (1 << 64)).count("1")
    near = [(i, j) for i in range(len(values)) for j in range(i) if differ(values[i], values[j]) <= 4]
    want = components(len(values), near)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    n, both = simhash.bit_statistics(fps)
    assert n == len(values)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    for plan in (simhash.allocate(both, n, 4), [(list(range(32)), 1), (list(range(32, 64)), 2)]):
        assert sum(t + 1 for _, t in plan) == 5
        links = {tuple(sorted((r["a"], r["b"]))) for r in simhash.link_groups(simhash.probes(fps, plan), 4).collect()}
        assert all(differ(a, b) <= 4 for a, b in links)
        at = {v: i for i, v in enumerate(values)}
        assert components(len(values), [(at[a], at[b]) for a, b in links]) == want


def test_simhash_awkward(spark):
    got = simhash.simhash_components(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert simhash.simhash_components(docs(spark, AWKWARD).limit(0)).count() == 0


# --- line dedup


def plain_removed(rows, least):
    """Words in a run of least words that occurs before, in an earlier text or earlier in the same without overlap."""
    split = [(text or "").split() for _, text in rows]
    seen, out = {}, []
    for d, own in enumerate(split):
        for a in range(len(own) - least + 1):
            seen.setdefault(tuple(own[a : a + least]), (d, a))
    for d, own in enumerate(split):
        gone = set()
        for a in range(len(own) - least + 1):
            e, b = seen[tuple(own[a : a + least])]
            if e < d or a - b >= least:
                gone |= set(range(a, a + least))
        out.append(sorted(gone))
    return out


def removed_words(spans):
    return [x for s in spans.split(",") if s for a, b in [map(int, s.split("-"))] for x in range(a, b + 1)]


@pytest.mark.parametrize("least", [3, 6, 12])
def test_lines_are_brute_force(spark, least):
    rng = np.random.default_rng(least)
    pool = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(12)]
    glue = [" ", "\n", "  ", "\t\n"]
    rows = [(i, "".join(x + rng.choice(glue) for x in rng.choice(pool, rng.integers(0, 14)))) for i in range(60)]
    rows += [(60, "a " * 40), (61, rows[7][1]), (62, "b a " * 9), (63, rows[9][1] + " " + rows[11][1])]
    got = {r["id"]: r["removed"] for r in lines.line_report(docs(spark, rows), min_words=least).collect()}
    want = plain_removed(rows, least)
    assert [removed_words(got[i]) for i, _ in rows] == want
    left = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows), min_words=least).collect()}
    for (i, text), gone in zip(rows, want):
        assert left[i].split() == [w for k, w in enumerate(text.split()) if k not in set(gone)]
        assert gone or left[i] == text


def test_lines_find_passages_wherever_they_stand(spark):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"w{rng.integers(1 << 30)}" for _ in range(n))
    passages = [prose(n) for n in (50, 51, 60, 95, 400)]
    rows = []
    for k, p in enumerate(passages):
        w = p.split()
        rows += [(10 * k, p), (10 * k + 1, f"{prose(7)} {p} {prose(30)}"), (10 * k + 2, prose(20) + "\n" + "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) + "\n" + prose(5)), (10 * k + 3, " ".join(w[:49]) + " " + prose(9))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    for k, p in enumerate(passages):
        before, after = rows[4 * k + 1][1].split(p)
        assert got[10 * k] == p and got[10 * k + 1] == before + after.lstrip(" ")
        kept = rows[4 * k + 2][1].split("\n")
        assert got[10 * k + 2] == kept[0] + "\n" + kept[-1] and got[10 * k + 3] == rows[4 * k + 3][1]


def test_lines_cut_passages_and_spare_the_rest(spark):
    passage = "\n".join(" ".join(f"p{i}x{k}" for k in range(20)) for i in range(3))
    rows = [(1, f"first\n{passage}\nend"), (2, f"own words\n{passage}\nmore"), (3, "own words\nend"), (4, f"x {passage}\ny"), (5, passage)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "own words\nmore", 3: rows[2][1], 4: "x\ny", 5: ""}


def test_lines_awkward(spark):
    df = docs(spark, AWKWARD)
    before, after = (sorted(map(str, x.where("doc_id is null or doc_id <> 6").collect())) for x in (df, lines.dedup_lines(df)))
    assert before == after
    periodic = lines.dedup_lines(df).where("doc_id = 6").first()["text"]
    assert periodic.split() == AWKWARD[-1][1].split()[:50]  # fifty words stay, what repeats them goes
    assert lines.line_report(df.limit(0)).count() == 0 and lines.dedup_lines(df.limit(0)).columns == df.columns


def test_lines_free_their_shuffles(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}

    passage = " ".join(f"p{i}" for i in range(60))
    df = docs(spark, [(i, f"own{i} {passage} {i}") for i in range(40)]).repartition(3, "doc_id").cache()  # its own shuffle stays usable
    assert df.count() == 40
    setting, before = spark.conf.get(FREE_SHUFFLES), files()
    report = lines.line_report(df)
    until = time.time() + 10
    while files() - before and time.time() < until:  # executors delete them in their own time
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(FREE_SHUFFLES) == setting
    got = {r["id"]: r["removed"] for r in report.collect()}
    assert got == {i: "1-60" if i else "" for i in range(40)} == {r["id"]: r["removed"] for r in lines.line_report(df).collect()}
    df.unpersist()


# --- toxicity


def test_toxicity_learns_and_tolerates_gaps():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioutnrsl"), rng.integers(3, 9))) for _ in range(3000)]
    bad = ["grumblex", "vexidork", "clapzug"]

    def make(toxic):
        own = list(rng.choice(words, rng.integers(30, 90)))
        for w in rng.choice(bad, 2) if toxic else []:
            own.insert(int(rng.integers(0, len(own))), w)
        return " ".join(own)

    m = toxicity.train([(make(i % 4 == 0), int(i % 4 == 0)) for i in range(600)])
    fresh = [make(i % 4 == 0) for i in range(100)] + [make(False) + " grum.blex vexi-dork", None, "", make(False) + " v e x i d o r k grumblex"]
    p = m.scored(fresh, {})
    want = [i % 4 == 0 for i in range(100)] + [True, False, False, True]
    assert ((p >= 0.5) == np.array(want)).mean() > 0.9


def test_toxicity_folding_equals_kernel():
    marks = ["idiot", "clown", "scum"]
    weight, bias = toxicity.fit_machine(["idiot", "scum", "clown"], ["table", "river", "stone"], [*marks, "river"])
    direct = toxicity.kernel_matrix([toxicity.sparse("idi.ot")], [toxicity.sparse(m) for m in [*marks, "river"]])
    assert direct.max() > 0.5
    x = toxicity.sparse("idiot")
    assert abs(sum(weight[c] * v for c, v in x.items()) + bias - toxicity.token_margins(["idiot"], weight, bias)[0]) < 1e-4


def test_toxicity_awkward(spark):
    m = toxicity.train([])
    assert toxicity.score(docs(spark, AWKWARD), m).count() == len(AWKWARD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs(spark, AWKWARD), none).count() == len(AWKWARD)


def test_toxicity_trains_in_a_task(spark, monkeypatch):
    import os

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"word{k}" for k in range(90)], 30)) + (" grumblex vexidork" if i % 4 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    want = toxicity.train([(text, int(i % 4 == 0)) for i, text in rows])
    got = toxicity.fit(toxicity.training_rows(docs(spark, rows), labels))
    assert (got.weight == want.weight).all() and got.bias == want.bias and np.allclose(got.curve, want.curve, rtol=1e-9, atol=0)
    where = lambda rows: toxicity.Machine(np.zeros(1, dtype=np.float32), 0.0, [0.0, 0.0, float(os.getpid())])
    monkeypatch.setattr(toxicity, "train", where)
    assert toxicity.fit(toxicity.training_rows(docs(spark, rows), labels)).curve[2] != os.getpid()  # the driver holds no text


# --- mixing


def plain_targets(sizes):
    total, weight = sum(sizes), [1 + i % 3 for i in range(len(sizes))]
    stopped, target = set(), [0.0] * len(sizes)
    while True:
        left = total - sum(3 * sizes[i] for i in stopped)
        w = sum(weight[i] for i in range(len(sizes)) if i not in stopped)
        target = [3.0 * sizes[i] if i in stopped else left * weight[i] / w for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if i not in stopped and target[i] > 3 * sizes[i] + 1e-9}
        if not more:
            return target
        stopped |= more


@pytest.mark.parametrize("sizes", [[10, 1000, 20, 500], [5, 5, 5], [0, 100, 1], [7]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.source_targets(df).orderBy("source").collect()]
    assert np.allclose(got, plain_targets(sizes))


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.draw_plan(table).select("*", mixing.taken().alias("taken")).collect()
    again = {r["id"]: r["taken"] for r in mixing.draw_plan(table).select("id", mixing.taken().alias("taken")).collect()}
    assert again == {r["id"]: r["taken"] for r in rows} and len(rows) == table.count()
    sources = {r["source"] for r in rows}
    for s in sources:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(r["taken"] <= 3 * r["size"] for r in own)
    mixed = mixing.mix_sources(table)
    words = mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == sum(r["taken"] for r in rows)
    shards = [r["count"] for r in mixed.groupBy("shard").count().collect()]
    assert len(shards) == 16


def test_mix_awkward(spark):
    assert mixing.draw_plan(docs(spark, AWKWARD)).count() == len(AWKWARD)
    assert mixing.mix_sources(docs(spark, AWKWARD)).columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixing.draw_plan(docs(spark, AWKWARD).limit(0)).count() == 0


def test_mix_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    rows = [(None if i % 3 else i % 5, f"doc{i // 2} " + "w " * (i % 17), "en", "abc"[i % 7 % 3], 1) for i in range(150)]
    rows += [(7, "equal in all three", "en", "a", 1)] * 6
    table = docs(spark, rows)
    wanted = {r["source"]: r["n"] for r in mixing.draw_plan(table).groupBy("source").agg(F.sum(mixing.taken()).alias("n")).collect()}
    mixed = mixing.mix_sources(table).withColumn("n", F.regexp_count("text", F.lit(mixing.WORD)))
    assert {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("n").alias("n")).collect()} == wanted
    drawn = mixing.draw_plan(table).select(F.explode("draws").alias("d"), "epochs", "part", "size").where((F.col("d.epoch") <= F.col("epochs")) | (F.col("part") > 0) | (F.col("size") == 0))
    assert mixed.count() == drawn.count()


# --- top-k and embeddings


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "d": F.lit(3), "weight": F.lit(4)})


BAD = [(900, None), (901, [float("nan")] * 8), (902, [1.0, None] * 4), (903, []), (904, [float("inf")] * 8), (None, [1.0] * 8)]


def test_topk_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((200, 8)), 1).astype(np.float32)
    x[50:70] = x[20]
    got = [tuple(r) for r in topk.top_k(vectors(spark, x, BAD), every=20, k=5).orderBy("query_id", "rank").collect()]
    e = np.floor(64 * x.astype(float)).astype(int)
    want = []
    for q in range(0, 200, 20):
        best = sorted((-int(e[q] @ e[c]), c) for c in range(200) if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want


def test_topk_rows_that_repeat_an_id(spark):
    extra = [(0, [2.0, 1.0]), (0, [2.0, 1.0]), (1, [1.0, 1.0])]
    got = sorted(tuple(r) for r in topk.top_k(vectors(spark, [[1.0, 2.0], [3.0, 4.0]], extra), k=2).collect())
    assert len(got) == 6 and [g[:2] for g in got] == [(0, 1)] * 3 + [(0, 2)] * 3  # three queries of one id, each without its own row
    assert got.count((0, 1, 1, 192 * 64 + 256 * 128)) == 1


def test_topk_few(spark):
    assert topk.top_k(vectors(spark, [[1.0, 2.0], [3.0, 4.0]])).count() == 1
    assert topk.top_k(vectors(spark, [[1.0, 2.0]]).limit(0)).count() == 0


def test_embeddings_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((60, 32))
    x = np.concatenate([centre, centre[:40] + 0.3 * rng.standard_normal((40, 32)), np.repeat(centre[:1], 30, axis=0) + 0.1 * rng.standard_normal((30, 32)), centre[5:6], np.zeros((1, 32))])
    x = x.astype(np.float32)
    got = {r["id"]: r for r in neighbours.near_duplicates(vectors(spark, x, BAD[:1])).collect()}
    y = x.astype(float)
    unit = y[:-1] / np.linalg.norm(y[:-1], axis=1, keepdims=True)
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    found = sum(got[i]["n_links"] for i in range(len(unit)))
    assert found >= 0.95 * true.sum() and all(got[i]["n_links"] <= true[i].sum() for i in range(len(unit)))
    assert got[len(unit)]["n_links"] == 0 and got[900]["component_id"] == 900
    assert neighbours.near_duplicates(vectors(spark, x[:3]).limit(0)).count() == 0


def test_embeddings_count_window_collisions():
    m, window, least, recall, passed = neighbours.calibrate(0.9, 0.995)
    assert recall >= 0.995 and passed < 0.1
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((m, 7)), rng.standard_normal((m, 300))
    order = np.argsort(b, axis=1)
    got = neighbours.collisions(a, [(v[o], o) for v, o in zip(b, order)], window)
    assert (got == (np.abs(a[:, :, None] - b[:, None, :]) <= window).sum(axis=0)).all()


@pytest.mark.parametrize("n", [1, 63, 130, 700])
def test_embeddings_blocks_are_brute_force(monkeypatch, n):
    """Links of blocks of any size, copies weighed, gathered pairs and whole slices alike; few unrelated pairs are verified."""
    monkeypatch.setattr(neighbours, "TABLE", 128)
    monkeypatch.setattr(neighbours, "SLICE", 100)
    plan = neighbours.calibrate(0.9, 0.995)
    assert plan[4] < 0.01
    rng = np.random.default_rng(n)
    x = np.repeat(rng.standard_normal((n // 3 + 1, 16)), 3, axis=0)[:n] + 0.15 * rng.standard_normal((n, 16))
    ids, weight, unit = np.arange(n), rng.integers(1, 5, n), x / np.linalg.norm(x, axis=1, keepdims=True)
    values = neighbours.projected(unit, plan[0], 6)
    near = (np.abs(values[:, :, None] - values[:, None, :]) <= plan[1]).sum(axis=0) >= plan[2]
    want = near & (unit @ unit.T >= 0.9)
    for dense in (0.0, 1.0):
        monkeypatch.setattr(neighbours, "DENSE", dense)
        inside = want & ~np.eye(n, dtype=bool)
        count, _, edges = neighbours.block_links(ids, x, weight, ids, x, weight, same=True, threshold=0.9, seed=6, plan=plan)
        assert (count == inside @ weight).all() and components(n, edges) == components(n, np.argwhere(inside).tolist())
        h = n // 2
        a, b, _ = neighbours.block_links(ids[:h], x[:h], weight[:h], ids[h:], x[h:], weight[h:], same=False, threshold=0.9, seed=6, plan=plan)
        assert (a == want[:h, h:] @ weight[h:]).all() and (b == weight[:h] @ want[:h, h:]).all()


def test_embeddings_recall_on_the_table(spark):
    """Measured against all exact pairs of the driver's table."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    got = {r["id"]: r["n_links"] for r in neighbours.near_duplicates(table).collect()}
    assert all(got[r["vec_id"]] <= n for r, n in zip(rows, true.sum(axis=1))) and sum(got.values()) >= 0.99 * true.sum()


# --- licences


def test_licenses(spark):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "a license to thrill"), (4, "intro " * 3000 + "Released under the MIT license." + " tail" * 3000), (5, "Licensed under the Apache Licence, Version 2.0.")]
    got = {(r["id"], r["license"]): r["differences"] for r in licenses.scan(docs(spark, rows)).collect()}
    assert {(1, "Apache-2.0"), (2, "GPL-2.0"), (4, "MIT"), (5, "Apache-2.0")} == set(got)
    assert got[5, "Apache-2.0"] == "license -> licence" and got[1, "Apache-2.0"] == ""
    assert licenses.scan(docs(spark, AWKWARD)).count() == 0


def test_licenses_in_long_lines(spark):
    rng, rows, want = np.random.default_rng(3), [], set()
    for name, own in licenses.TEMPLATES.items():
        for statement, _ in own:
            for n in (300, 4000):
                words = [f"{w}{rng.integers(1000)}" for w in rng.choice(["some", "long", "line", "prose"], n)]
                words.insert(n // 2, "License: " + statement)
                rows.append((len(rows), " ".join(words)))
                want.add((len(rows) - 1, name))
    got = licenses.scan(docs(spark, rows)).collect()
    assert want <= {(r["id"], r["license"]) for r in got}
    assert all(r["reduction"] > 0 for r in got if (r["id"], r["license"]) in want)


def test_licenses_wrapped(spark):
    import textwrap

    rows, want = [], set()
    for name, own in licenses.TEMPLATES.items():
        for statement, _ in own:
            for width, mark in ((72, ""), (30, "# "), (72, " * ")):
                body = [mark + line for line in textwrap.wrap(statement, width, break_on_hyphens=False, break_long_words=False)]
                rows.append((len(rows), "\n".join(["first line", "", *body, "", "last line"])))
                want.add((len(rows) - 1, name, 2, len(body) + 1, 1.0))
    got = {(r["id"], r["license"], r["first_line"], r["last_line"], r["similarity"]) for r in licenses.scan(docs(spark, rows)).collect()}
    assert want <= got


def test_licenses_are_chosen_by_compression(monkeypatch):
    rng = np.random.default_rng(9)
    gated, plain = (licenses.Scanner(licenses.TEMPLATES, 0.8) for _ in range(2))
    plain.least = {name: [-np.inf] * len(own) for name, own in plain.least.items()}
    accepted = 0
    for name, own in list(licenses.TEMPLATES.items()) * 20:  # no edited statement that its wording accepts is refused
        for statement, _ in own:
            words = statement.split()
            for i in rng.choice(len(words), int(rng.integers(0, len(words) // 5 + 1)), replace=False):
                words[i] = "".join(rng.choice(list("abcdefgh"), rng.integers(1, 40)))
            for _ in range(int(rng.integers(0, 6))):
                words.insert(int(rng.integers(0, len(words) + 1)), f"w{rng.integers(1 << 40)}")
            found = plain.confirmed([" ".join(words)])
            assert gated.confirmed([" ".join(words)]) == found
            accepted += len(found)
    assert accepted > 300
    apart = " ".join(f"x{k} gnu y{k} general z{k} 3" for k in range(50))  # telling words, but no statement
    aligned, matcher = [], licenses.SequenceMatcher
    monkeypatch.setattr(licenses, "SequenceMatcher", lambda *a, **o: aligned.append(a[1]) or matcher(*a, **o))
    assert gated.confirmed([apart]) == [] and len(aligned) < 60  # the long statement's windows are refused by their saving
    long = licenses.TEMPLATES["Apache-2.0"][1][0].replace("compliance", "agreement")
    (found,) = gated.confirmed([long])
    assert found[2] == "Apache-2.0" and found[5] == "compliance -> agreement" and found[3] > 0.5  # the passage that saves most stays


# --- LM


def plain_lm(own, train, mu=200.0):
    """Exact counts where the operator probes: (n_tokens, n_known, train tokens, base, score) of each text."""
    words_of = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    one, two = {}, {}
    for i, t in own:
        if train(i):
            words = words_of(t)
            for v, w in zip([b"\n", *words], words):
                one[w], two[v, w] = one.get(w, 0) + 1, two.get((v, w), 0) + 1
    n, v_ = sum(one.values()), len(one)
    p1 = lambda w: (one.get(w, 0) + 1) / (n + v_ + 1)
    level = lambda c: (3 * 2 ** (c.bit_length() - 1) - 1) / 2 if c else 0
    out = []
    for i, t in own:
        words, score = words_of(t), 0.0
        for v, w in zip([b"\n", *words], words):
            c2 = level(two.get((v, w), 0))
            score += np.log10((c2 + mu * p1(w)) / (max(one.get(v, 0), c2) + mu))
        out.append((i, len(words), sum(w in one for w in words), n, sum(np.log10(p1(w)) for w in words), score))
    return out


@pytest.mark.parametrize("part_chars", [lm.PART_CHARS, 40_000])
def test_lm_is_brute_force(spark, part_chars):
    """Words are exact whatever the number of parts; bigrams but for the filter's false positives."""
    extra = spark.createDataFrame([(None, None), (-1, ""), (-1, ""), (-2, "Der DER der " * 400)], "doc_id long, text string")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(extra)
    own = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = plain_lm(own, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    got = sorted(map(tuple, lm.fit_score(table, queries.held("doc_id", 7) != 2, part_chars=part_chars).collect()), key=str)
    want.sort(key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want] and all(abs(g[4] - w[4]) < 1e-6 for g, w in zip(got, want))
    apart = [(g[5] - w[5]) / w[1] for g, w in zip(got, want)]  # a false positive lifts a token's odds
    assert min(apart) > -0.05 and max(apart) < 0.5 and abs(np.mean(apart)) < 0.12
    exact = lm.fit_score(table, queries.held("doc_id", 7) != 2, part_chars=part_chars, bits_per_token=64)
    got = sorted(map(tuple, exact.collect()), key=str)
    assert all(abs(g[5] - w[5]) < 0.01 * w[1] for g, w in zip(got, want))


def test_lm_awkward(spark):
    df = docs(spark, AWKWARD)
    assert lm.fit_score(df, F.lit(True)).count() == len(AWKWARD)
    none = lm.fit_score(df, F.lit(None).cast("boolean")).collect()
    assert len(none) == len(AWKWARD) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in none)
    assert lm.fit_score(df.limit(0), F.lit(True)).count() == 0


def test_lm_filter_keeps_its_rate_at_any_load():
    rng = np.random.default_rng(7)
    rates = []
    for n in (1_000, 100_000, 2_000_000):
        keys, counts = np.unique(rng.integers(0, 1 << 32, n).astype(np.uint32)), None
        counts = rng.geometric(0.6, len(keys))
        f = lm.Filter(int(counts.sum()) * 6)
        f.insert(keys, lm.quantised(counts))
        assert (f.levels(keys) >= lm.quantised(counts)).all()
        rates.append(f.false_positive_rate())
    assert max(rates) < 0.08 and max(rates) - min(rates) < 0.02
    full = lm.Filter(64)
    full.bits[:] = True
    assert full.levels(np.array([7], dtype=np.uint32))[0] == 64 and lm.estimates()[64] == (3 * 2.0**63 - 1) / 2
    assert lm.estimates()[1:4].tolist() == [1, 2.5, 5.5]
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert lm.unpacked(lm.packed(counts), 6).tolist() == counts.tolist()


# --- packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    plain = Tokenizer.from_file(files["json_path"])  # untouched: a special token's wording is that token
    rows = [*AWKWARD[:3], (7, "<|endoftext|> it's 100% ok\n\n"), AWKWARD[6], AWKWARD[7]]
    pieces = packing.tokenize_pieces(docs(spark, rows), capacity=100, with_ids=True, **files).collect()
    for key, text, *_ in rows:
        own = sorted((r["piece"], r["ids"]) for r in pieces if r["id"] == key)
        assert sum((ids for _, ids in own), []) == [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert all(len(ids) == 100 for _, ids in own[1:])


def test_packing_places(spark):
    rng = np.random.default_rng(5)
    sizes = [int(s) for s in np.concatenate((rng.integers(1, 60, 150), np.full(90, 33), [100, 100, 1]))]
    df = spark.createDataFrame([(i, 0, 0, s) for i, s in enumerate(sizes)], "id long, piece int, start long, length int")
    rows = packing.best_fit(df, capacity=100, group_rows=20).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 100
    assert len(rows) == len(sizes)
    gaps = []  # the same, one by one
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 100) - s)
    assert len(bins) == len(gaps)


def test_packing_awkward(spark):
    got = packing.pack(docs(spark, AWKWARD), **queries.tokenizer_files())
    assert got.count() >= len(AWKWARD) and packing.pack(docs(spark, AWKWARD).limit(0), **queries.tokenizer_files()).count() == 0


# --- PII

CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_pii_base_is_the_contract(spark):
    texts = ["a.b@c-d.example.com_x@y.zz 🙂 1.2.3.4.5.6.7.8 001.002.003.255 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (201) 555-0123 +12", "x@y.z@w.v.u +44 20 7946 0958 10.0.0.1:80 9" * 3, "é" * 50 + "mail me: a@b.cc", "a@b a@b. @c.d 1.2.3"]
    rows = [*AWKWARD, *[(100 + i, t) for i, t in enumerate(texts)]]
    got = pii.redact_spans(docs(spark, rows)).select("id", F.sha2(pii.written(F.col("base")), 256).alias("h")).collect()
    want = []
    for key, text, *_ in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in CONTRACT.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
        want.append((key, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_pii_learns(spark):
    """Precision and recall of each kind on the labelled sentences held out, and on spellings and decoys of this test."""
    model = pii.fit(spark)
    assert {k: (m[3] >= 0.95, m[4] >= 0.9) for k, m in model.items()} == {k: (True, True) for k in range(4)}
    personal = ["please mail anna.k (at) stone4 (dot) org today", "host 10[.]20[.]30[.]40 was seen", "card 4111.1111.1111.1111 expired", "call (201) 555-0123 now", "tel. 201.555.0123"]
    decoys = ["order 4111111111111112 shipped", "nadomi 9807915762804490 en", "meet me at noon. Then go", "isbn 978-316-1484", "version 812 . 40 . 900 . 1", "took 12:30:45:10:11:12:13:14 so", "4441 7442 8035 1541 in prose"]
    rows = pii.redact_spans(docs(spark, list(enumerate(personal + decoys)))).collect()
    assert [len(r["base"]) + len(r["added"]) for r in sorted(rows, key=lambda r: r["id"])] == [1] * len(personal) + [0] * len(decoys)


def test_pii_many_matches(spark):
    text = " ".join(f"a{i}@b{i}.com 10.0.{i % 300}.1 +1 (201) 555-{i:04d}," for i in range(700))
    got = pii.redact_spans(docs(spark, [(1, text)])).select("id", pii.written(F.col("base")).alias("w")).first()["w"]
    assert got == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in CONTRACT.items() for m in re.finditer(p, text) if passes(k, m.group()))
    assert pii.redact_spans(docs(spark, []).limit(0)).count() == 0


def test_pii_redacts(spark):
    out = pii.redact(docs(spark, [(1, "write a@b.cc or +44 20 7946 0958 now"), (2, "nothing"), (3, None)])).select("doc_id", "text").collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: "write [email] or [phone] now", 2: "nothing", 3: None}


# --- similar texts


def plain_jaccard(a, b):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] or sets[1] else 1.0


def test_similar_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = []
    for base in range(40):  # edited copies at similarities around 0.8 to 0.95, short and long
        words = [f"t{base}w{i}" for i in range(int(rng.integers(30, 400)))]
        texts.append(" ".join(words))
        for share in (0.004, 0.01, 0.018, 0.03):
            copy = list(words)
            for i in rng.integers(0, len(words), max(1, int(share * len(words)))):
                copy[i] = f"edit{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    texts += [None, "", "one two", "One  TWO", "one two three"]
    pairs = [(i, j, plain_jaccard(texts[i], texts[j])) for i in range(len(texts)) for j in range(i)]
    assert sum(0.8 <= s < 0.95 for *_, s in pairs) > 40 and sum(0.6 < s < 0.8 for *_, s in pairs) > 10
    want = components(len(texts), [(i, j) for i, j, s in pairs if s >= 0.8])
    rows = list(enumerate(texts))
    got = {r["id"]: r["component_id"] for r in simhash.similar_components(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = {r["doc_id"] for r in simhash.keep_dissimilar(docs(spark, rows)).collect()}
    assert kept == set(want)
    monkeypatch.setattr(simhash, "BLOCK", 16)  # crowded keys: the same classes
    got = {r["id"]: r["component_id"] for r in simhash.similar_components(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    import corpus_pipeline as c

    assert {r["doc_id"] for r in c.near_dedup_stage(spark, docs(spark, rows), SF).collect()} == kept


def test_similar_awkward(spark):
    got = simhash.similar_components(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and {r["component_id"] for r in got if r["id"] in (1, 2, 5)} == {1}
    assert simhash.keep_dissimilar(docs(spark, AWKWARD[:3])).count() == 2
    assert simhash.similar_components(docs(spark, AWKWARD).limit(0)).count() == 0


# --- pipeline


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as c

    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = table
    for name, stage in c.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, SF)
        assert kept.columns == table.columns
        assert kept.count() <= before or name == "mixing"
    placed = c.STAGES[-1][1](spark, kept, SF)
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert placed.groupBy("doc_id").count().count() == kept.select("doc_id").distinct().count()


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(11)
    for n, a, b in ((5, 1, 0), (23, 3, 2)):  # the odds are those of signs drawn at random
        signs = rng.choice([-1, 1], size=(200_000, n + b))
        one, other = signs[:, :n].sum(axis=1) > 0, signs[:, a:].sum(axis=1) > 0
        assert abs((one != other).mean() - simhash.worst_odds(n, 0.8)) < 0.005
    allowed, lost, refused = simhash.allowances(0.8), 0, 0
    for k in range(1500):
        n = int(rng.integers(5, 300))
        a = int(rng.integers(0, n // 5 + 1))
        b = min(a, int((n - a) / 0.8 - (n - a) + 1e-9) - a)
        hashes = rng.integers(0, 1 << 63, n + n, dtype=np.uint64)
        for similar, other in ((True, hashes[a : n + b]), (False, hashes[n // 3 : n + n // 3])):
            sets = [np.unique(hashes[:n]), np.unique(other)]
            rows = [[i, len(s), *np.frombuffer(simhash.long_fingerprint(s ^ simhash.MIX2, simhash.SKETCH), dtype=np.int64)] for i, s in enumerate(sets)]
            is_open = simhash.may_link(np.array(rows, dtype=np.int64), np.array([0]), np.array([1]), 0.8, allowed)[0]
            lost, refused = lost + (similar and not is_open), refused + (not similar and not is_open)
    assert lost <= 3 and refused > 1490  # a similarity of 0.8 exactly; of 0.5


def test_similar_in_a_crowd_of_loose_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base, texts = [f"w{i}" for i in range(120)], []
    for k in range(160):  # copies of one text with many edits: few of them are 0.8 alike
        copy = list(base)
        for i in rng.integers(0, len(base), 4 + k % 5):
            copy[i] = f"e{rng.integers(1 << 30)}"
        texts.append(" ".join(copy))
    for k in range(0, 40, 4):
        texts.append(texts[k] + " more")
    links = [(i, j) for i in range(len(texts)) for j in range(i) if plain_jaccard(texts[i], texts[j]) >= 0.8]
    compared, plain = [], simhash.linked

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(simhash, "linked", counted)
    got = {r["id"]: r["component_id"] for r in simhash.similar_components(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == components(len(texts), links)
    assert sum(compared) < len(texts) * (len(texts) - 1) / 2 / 5
