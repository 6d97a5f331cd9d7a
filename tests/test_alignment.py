"""Alignment, crowded cells, overlap walks, raster folders and sheets against plain Python."""

import json
import math
import os
import random

import pytest

from lamina.operators import align
from lamina.operators.walks import with_normals
from lamina.sources import raster_files as RF
from lamina.sources import sheets


def test_planted_rotation_is_found_among_outliers(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for p in range(6):
        t, x, y = rng.uniform(-3, 3), rng.uniform(-50, 50), rng.uniform(-50, 50)
        want[p] = t, x, y
        for k in range(300):
            x1, y1 = rng.uniform(-40, 40), rng.uniform(-40, 40)
            x0, y0 = math.cos(t) * x1 - math.sin(t) * y1 + x, math.sin(t) * x1 + math.cos(t) * y1 + y
            if k % 5 == 0:
                x0, y0 = rng.uniform(-200, 200), rng.uniform(-200, 200)
            rows.append((p, p + 100, x0, y0, x1, y1, rng.randrange(10**6)))
    rows += [(50, 51, 0.0, 0.0, 1.0, 1.0, 3)] + [(60, 61, 1.0, 1.0, 1.0, 1.0, k) for k in range(4)]
    df = spark.createDataFrame(rows, "p1 long, p2 long, x0 double, y0 double, x1 double, y1 double, draw long")
    for draws in (1, 3):
        got = {r.p1: r for r in align.similarity(df, 10.0, draws=draws).collect()}
        assert set(got) == set(want)
        for p, (t, x, y) in want.items():
            r = got[p]
            assert abs((r.angle - t + math.pi) % (2 * math.pi) - math.pi) < 0.01 and abs(r.x - x) < 1 and abs(r.y - y) < 1 and r.pairs > 100 * draws
    assert align.similarity(df.limit(0), 10.0).count() == 0


@pytest.mark.parametrize("block", [2, 64])
def test_crowded_cells(spark, block):
    """Any size of blocks gives all pairs; several points of one patch in a cell are no pair."""
    rng = random.Random(6)
    pts = [(rng.randrange(12), c, *(rng.uniform(-5, 5) for _ in range(6))) for c in (1, 1, 1, 2) for _ in range(9)] + [(1, 9, *[0.0] * 6), (2, 9, *[0.0] * 6)]
    good = [(2, 1), (3, 4), (4, 3), (7, 7)]
    known = {frozenset(x) for x in good}
    want = {}
    for i, a in enumerate(pts):
        for b in pts[:i]:
            if a[1] == b[1] and a[0] != b[0] and frozenset((a[0], b[0])) not in known:
                gap = [p - q for p, q in zip(a[2:5], b[2:5])]
                far = max(abs(sum(g * n for g, n in zip(gap, x[5:]))) for x in (a, b))
                n, w = want.get(a[1], (0, 0.0))
                want[a[1]] = n + 1, max(w, far)
    df = spark.createDataFrame(pts, "pid long, c long, vx double, vy double, vz double, nx double, ny double, nz double")
    got = {r.c: (r.pairs, r.worst) for r in align.cell_distances(df, ["c"], spark.createDataFrame(good, "a long, b long"), block).collect()}
    assert set(got) == set(want) == {1, 2}
    assert all(got[c][0] == want[c][0] and math.isclose(got[c][1], want[c][1]) for c in want)


def test_overlap_walk(spark):
    """A ring of patches, one of them out of reach of its neighbours' boxes; a patch reached from two sides hangs on the lesser."""
    one = (1.0, 0.0, 2.0, 0.0, 1.0, 3.0)
    rel = spark.createDataFrame([(p, (p + 1) % 6, *one) for p in range(6)] + [(2, 20, *one), (20, 21, *one)], "p1 long, p2 long, a double, b double, c double, d double, e double, f double")
    box = lambda p: (p, *(v for k in range(3) for v in ((500.0, 510.0) if p == 20 else (0.0, 10.0))))
    ext = spark.createDataFrame([box(p) for p in (*range(6), 20, 21)], "pid long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")
    got = {(r.start, r.id): (r.level, r.via, r.c, r.f) for r in align.overlap_walk(rel, ext, spark.createDataFrame([(0,), (21,)], "id long")).collect()}
    assert got == {(0, 0): (0, None, 0, 0), (0, 1): (1, 0, 2, 3), (0, 5): (1, 0, -2, -3), (0, 2): (2, 1, 4, 6), (0, 4): (2, 5, -4, -6), (0, 3): (3, 2, 6, 9), (21, 21): (0, None, 0, 0)}


def patch_rows():
    rng = random.Random(7)
    return [(p, x, y, float(rng.randint(0, 99)), float(rng.randint(0, 99)), float(rng.randint(0, 99))) for p in (1, 2, 30) for x in range(-3, 5) for y in range(2, 6) if rng.random() < 0.7]


def test_raster_folders(spark, tmp_path):
    rows = patch_rows()
    df = spark.createDataFrame(rows, "pid long, qx long, qy long, vx double, vy double, vz double")
    folder = str(tmp_path / "out")
    for _ in range(2):  # writing again replaces
        RF.write_rasters(df, folder)
    assert sorted(os.listdir(folder)) == ["patch_1", "patch_2", "patch_30"]
    for p in (1, 2, 30):
        own = [r for r in rows if r[0] == p]
        meta = json.loads((tmp_path / "out" / f"patch_{p}" / "meta.json").read_text())
        assert meta["bbox"] == [[f(r[3 + k] for r in own) for k in range(3)] for f in (min, max)] and meta["format"] == "tifxyz"
        image = RF.read_tiff((tmp_path / "out" / f"patch_{p}" / "x.tif").read_bytes())
        assert (image != -1).sum() == len(own)
    assert sorted(map(tuple, RF.read_rasters(spark, folder).collect())) == sorted(rows)


def test_a_lost_task_leaves_no_file(spark, tmp_path):
    """A task that fails after others have written: the job is aborted and the folder is as before."""
    df = spark.createDataFrame(patch_rows(), "pid long, qx long, qy long, vx double, vy double, vz double")
    folder = str(tmp_path / "out")
    RF.write_rasters(df.where("pid = 1"), folder)
    before = sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)
    broken = df.where("pid > 1").selectExpr("pid", "qx", "qy", "vx", "vy", "if(pid = 30 and qx = 4, raise_error('lost'), vz) as vz")
    with pytest.raises(Exception):
        RF.write_rasters(broken, folder)
    left = sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)
    assert left == before and os.listdir(folder) == ["patch_1"]


def test_sheets_for_each_row(spark):
    df = spark.createDataFrame([(1, "slope", 3), (2, "double", 2), (3, "bent", 10), (4, "other", 5), (5, "slope", 0), (6, "slope", None)], "id long, kind string, n int")
    rows = sheets.sheets(df, df.kind, df.n).collect()
    of = lambda i: sorted((r.x, r.y, r.z) for r in rows if r.id == i)
    assert of(1) == sorted((x, 2 + x, z) for x in range(3) for z in range(3))
    assert of(2) == sorted((x, z + k, z) for x in range(2) for z in range(2) for k in (0, 1))
    assert len(of(3)) == 100 - 16 and {r.id for r in rows} == {1, 2, 3}


@pytest.mark.parametrize(("side", "crowded"), [(32, 1 << 20), (3, 1 << 20), (4, 60), (32, 0)])
def test_placed_distances(spark, side, crowded):
    """Squares of any side, some or all of them crowded, give what :func:`cell_distances` gives with normals of whole patches."""
    rng = random.Random(8)
    rows = [(p, x, y, x + 3 * p - 9, y + p % 3, 4 * x + rng.randint(0, 2), 4 * y + rng.randint(0, 2), rng.randint(0, 9)) for p in range(7) for x in range(-3, 4) for y in range(-3, 4) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "pid long, qx long, qy long, gx long, gy long, vx long, vy long, vz long").repartition(3)
    good = spark.createDataFrame([(1, 2), (2, 1), (5, 3), (9, 1)], "a long, b long")
    points = with_normals(df).join(df.select("pid", "qx", "qy", "gx", "gy"), ["pid", "qx", "qy"]).drop("qx", "qy")
    want = {(r.gx, r.gy): (r.pairs, round(r.worst, 9)) for r in align.cell_distances(points, ["gx", "gy"], good).collect()}
    got = align.placed_distances(df, good, side, crowded)
    rows = got.collect()
    assert {(r.gx, r.gy): (r.pairs, round(r.worst, 9)) for r in rows} == want and len(rows) == len(want) > 40
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()  # pairs were rows, and were shuffled
    assert align.placed_distances(df.limit(0), good).count() == 0
