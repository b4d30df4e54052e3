"""Page repairs on numpy pages, the held-out resolver against numpy, files of names, operators on a frame of the user's from another folder."""

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.operators import fit, rasters, review
from docketry.sources import tables


def shredded(slip):
    page = np.full((120, 200), 255, dtype=np.uint8)
    page[10:110, 30:160] = 40
    out = page.copy()
    for y in range(10, 110):
        by = slip * (1 if (y // 20) % 3 == 1 else 0)
        out[y] = np.roll(page[y], by)
    return page, out


def test_strips_go_back():
    page, out = shredded(12)
    fixed_page, moved = rasters.realigned(out)
    assert moved > 0 and (fixed_page == page).all()
    assert rasters.realigned(page)[1] == 0 and rasters.realigned(np.full((9, 9), 255, dtype=np.uint8))[1] == 0
    flat = np.tile(np.arange(100, 140, dtype=np.uint8), (20, 1))
    assert rasters.stretched(flat).min() == 0 and rasters.stretched(flat).max() == 255 and (rasters.stretched(page) == page).all()


def test_pages_as_rows(spark):
    page, out = shredded(12)
    rows = [("a", 1, 120, 200, bytearray(out.tobytes())), ("b", 1, 120, 200, bytearray(page.tobytes())), ("c", 1, 5, 5, bytearray(b"x")), ("d", 1, None, 5, None)]
    df = spark.createDataFrame(rows, "case_id string, page_no int, height int, width int, pixels binary")
    got = {r["case_id"]: r for r in rasters.repair_pages(df).collect()}
    assert bytes(got["a"]["pixels"]) == page.tobytes() and got["b"]["moved"] == 0 and bytes(got["c"]["pixels"]) == b"x" and got["d"]["pixels"] is None
    found = {r["case_id"]: (r["jumps"], r["shredded"]) for r in review.margin_jumps(rasters.margins_of(df)).collect()}
    assert found == {"a": (4, True), "b": (0, False)}


def test_unreadable_pages(spark):
    rows = [("a", 1, "", "abc", True), ("a", 2, "", "x" * 26, True), ("a", 3, "long clean text " * 9, "", True), ("a", 4, "", "", False)]
    df = spark.createDataFrame(rows, "case_id string, page_no int, visible string, recovered string, has_image boolean")
    assert [tuple(r) for r in review.unreadable_pages(df).collect()] == [("a", 1, 3)]


def test_held_out_resolver_is_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (200, 3)).astype(float)
    y = np.where(x[:, 0] > 0, 0, np.where(x[:, 1] > 0, 1, 2))
    fold = np.arange(200) % 4
    rows = [(f"c{i:03d}", int(f), fixed.OUTCOMES[int(t)], *map(float, v)) for i, (f, t, v) in enumerate(zip(fold, y, x))]
    df = spark.createDataFrame(rows, "case_id string, fold int, truth string, f0 double, f1 double, f2 double")
    got = {r["case_id"]: (r["q_a"], r["q_d"], r["q_r"]) for r in fit.held_out_resolver(df, ("f0", "f1", "f2"), rounds=60).collect()}
    for held in range(4):
        own, t = x[fold != held], np.eye(3)[y[fold != held]]
        w, b = np.zeros((3, 3)), np.zeros(3)
        for _ in range(60):
            z = own @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - t) / len(own)
            w, b = w - 0.5 * (own.T @ g + w / len(own)), b - 0.5 * g.sum(axis=0)
        for i in np.flatnonzero(fold == held):
            e = np.exp(x[i] @ w + b)
            assert np.allclose(got[f"c{i:03d}"], e / e.sum(), atol=1e-9)
    assert fit.held_out_resolver(df, ("f0", "f1", "f2"), least=151).count() == 0


def test_names_file_and_manifest(spark, tmp_path):
    path = tmp_path / "names.json"
    path.write_text(json.dumps({"observed_tokens": ["Zora", "Ann"], "generated": ["Ann", "bel"]}))
    assert tables.load_names(spark, str(path)) == (("Ann", "Zora"), ("bel",)) and tables.load_names(spark, str(tmp_path / "none")) == ((), ())
    tables.write_manifest(spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "folder string, n int"), str(tmp_path / "m"), limit=2)
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "m")).orderBy("folder").collect()] == [("a", "1"), ("b", "2")]


def test_users_frame_from_another_folder(tmp_path):
    """Python workers get the package although nothing was read with it."""
    code = "import sys; sys.path.insert(0, sys.argv[1])\nfrom docketry.session import local_session\ns = local_session('far', 2, 2)\nsys.path.remove(sys.argv[1])\nfrom docketry.operators import snap\nprint(snap.snap_flag(s.createDataFrame([('biohazard_rcd',)], 'reading string')).first()['parsed'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parent.parent)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("biohazard_red"), out.stderr[-2000:]
