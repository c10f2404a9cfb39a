"""Files, parameters, whole runs, scans, the stream and the hand-checkable fixtures."""

import argparse
import logging
import math

import pytest
from pyspark.sql import functions as F

from orbweave import config
from orbweave.functions import cosmology, geometry
from orbweave.operators import cells, checks, convert, grids, kernel, summary
from orbweave.plans import prepare, report, run
from orbweave.sources import hdf5, snapshot, tables
from orbweave.streaming import kernel_stream

BOX = (10.0, 10.0, 10.0)
PLACE = "x double, y double, z double, mass double"


def particles(spark, rows):
    return spark.createDataFrame([tuple(map(float, (*r, 1.0)[:4])) for r in rows], PLACE)


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "gid long, gx double, gy double, gz double")


def lattice(n, length=10.0):
    at = [(i + 0.5) * length / n for i in range(n)]
    return [(x, y, z) for x in at for y in at for z in at]


def counts(spark, where, rows, radii, box=BOX, n=None):
    out = kernel.kernel_sums(points(spark, where), particles(spark, rows), box, radii, 1.0, n).orderBy("gid").collect()
    return [tuple(r[f"n_{k}"] for k in range(len(radii))) for r in out]


def plan_sends(spark, where, radii, n):
    """Whether the plan, as made before a run tells it sizes, has a broadcast join."""
    p = spark.range(100).selectExpr("id % 10.0D AS x", "id % 7.0D AS y", "id % 3.0D AS z", "1.0D AS mass")
    df = kernel.sphere_sums(points(spark, where), p, BOX, radii, n)
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 10**4, 10**7])
def test_small_fixtures(spark, n):
    """n stands for the number of particles and so sets the number of levels, which must not matter."""
    one = counts(spark, lattice(3), [(5, 5, 5)], (0.5, 1.0, 2.0), n=n)
    assert one == [(1, 1, 1) if i == 13 else (0, 0, 0) for i in range(27)]
    assert counts(spark, lattice(5)[:3], lattice(5), (1.0, 2.0, 3.0), n=n) == [(1, 7, 19)] * 3
    assert counts(spark, [(0.1, 5, 5)], [(9.9, 5, 5)], (0.5,), n=n) == [(1,)]
    assert counts(spark, [(4.5, 2.5, 2.5)], [(6, 2.5, 2.5)], (2.0,), n=n) == [(1,)]
    assert counts(spark, [(2.5, 2.5, 2.5)], [(7.5, 7.5, 7.5), (2.5, 2.5, 2.5)], (5.0,), n=n) == [(1,)]
    assert counts(spark, [(5, 5, 5)] * 2, [(5, 5, 5)], (1.0, 1.0), n=n) == [(1, 1), (1, 1)]
    corners = [(0, 0, 0), (9, 1, 5), (3, 3, 3), (9.99, 9.99, 9.99)]
    assert counts(spark, [(5, 5, 5), (0, 0, 0)], corners, (math.sqrt(3) * 5 * (1 + 1e-9),), n=n) == [(4,), (4,)]
    assert counts(spark, [(10, 10, 10)], [(13, 14, 10)], (5.0,), (64.0,) * 3, n) == [(1,)]
    assert counts(spark, [(0.5, 8, 16)], [(7.5, 8, 16)], (1.0,), (8.0, 16.0, 32.0), n) == [(1,)]


def test_levels_do_not_change_sums(spark):
    p = grids.random(spark, BOX, 400, 7).select(*[F.col(f"g{c}").alias(c) for c in "xyz"], (F.col("gid") % 13).cast("double").alias("mass"))
    g, radii = grids.random(spark, BOX, 40), (0.3, 1.7, 4.0, 9.0)
    plain, deep = (kernel.kernel_sums(g, p, BOX, radii, 1.0, n).orderBy("gid").collect() for n in (0, 10**6))
    assert kernel.levels(BOX, 9.0, 10**6).deepest > kernel.levels(BOX, 9.0, 0).deepest == 0
    assert plain == deep
    slow = {r["gid"]: (r["n"], r["mass"]) for r in kernel.exhaustive(g, p, BOX, 4.0).collect()}
    assert {r["gid"]: (r["n_2"], r["mass_2"]) for r in deep} == slow


@pytest.mark.parametrize(("radii", "side", "n", "sent"), [((3.0, 6.0, 9.0), 8, 10**6, False), ((0.1, 2.0, 5.0, 9.0), 8, 10**6, False), ((0.5, 1.0), 12, 0, False), ((3.0, 6.0, 9.0), 1, 10**4, True)], ids=["large", "mixed", "halos", "few"])
def test_many_cells_are_not_broadcast(spark, radii, side, n, sent):
    """Spark takes the rows for cells, points exploded level by level, for as small as the points: 512 of them filled the driver."""
    assert plan_sends(spark, lattice(side), radii, n) == sent


def test_cell_gaps_hold_every_place(spark):
    """No particle of a cell is nearer or farther than its cell's gaps."""
    p = grids.random(spark, BOX, 300, 3).select("gx", "gy", "gz")
    q = grids.random(spark, BOX, 20, 5).select(*[F.col(f"g{c}").alias(c) for c in "xyz"])
    both = p.crossJoin(q).withColumns({c: geometry.cell_axis(F.col(x), 10.0, 4) for c, x in zip("ijk", "xyz", strict=True)})
    near, far = geometry.cell_gaps([geometry.to_centre(F.col(c), F.col(f"g{x}"), 4, 10.0) for c, x in zip("ijk", "xyz", strict=True)], (4, 4, 4), BOX)
    r2 = geometry.distance2([F.col(c) for c in "xyz"], [F.col(f"g{c}") for c in "xyz"], BOX)
    assert both.where((r2 < near) | (r2 > far)).count() == 0


def test_parameters():
    p = config.Parameters(config.parse('# c\nKernels:\n  nkernels: 2\n  kernel_radius_1: 1.5  # r\n  kernel_radius_2: 3\n\nGrid:\n  type: "random"\n  n_grid_points: 1e2\n'))
    spec = config.grid_spec(p)
    assert (spec.kind, spec.radii, spec.points, spec.seed, spec.largest) == ("random", (1.5, 3.0), 100, 42, 3.0)
    assert "Grid/random_seed: 42" in p.lines()
    with pytest.raises(KeyError):
        p.get("Cosmology/h", float)
    with pytest.raises(ValueError):
        config.parse("no colon")
    with pytest.raises(ValueError):
        config.GridSpec("ring", (1.0,))
    with pytest.raises(ValueError):
        config.GridSpec("uniform", (0.0,))
    assert config.fill("snap_0000.h5", "0000", 12) == "snap_0012.h5"


@pytest.mark.parametrize(("h", "cdm", "b"), [(0.6736, 0.2607, 0.0493), (0.697, 0.233, 0.0463), (0.7, 0.15, 0.03)])
def test_mean_density(h, cdm, b):
    assert math.isclose(cosmology.mean_density(h, cdm, b), 3 * (100 * h) ** 2 / (8 * math.pi * 43.01744232015554) * (cdm + b))


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("snap"))
    p = grids.random(spark, BOX, 5000, 9).select(*[F.col(f"g{c}").alias(f"pos_{c}") for c in "xyz"], F.lit(2.0).alias("m"))
    p.write.parquet(f"{folder}/raw")
    prepare.prepare(spark, prepare.arguments([f"{folder}/raw", f"{folder}/snap_0000", "--coordinates", "pos_x", "pos_y", "pos_z", "--masses", "m", "--box", "10", "--cells", "8", "--redshift", "1"]))
    return folder


def parameters(folder, grid, more=""):
    text = f"Kernels:\n  nkernels: 2\n  kernel_radius_1: 0.5\n  kernel_radius_2: 1\nGrid:\n{grid}Cosmology:\n  h: 0.7\n  Omega_cdm: 0.25\n  Omega_b: 0.05\nInput:\n  filepath: {folder}/snap_0000\nOutput:\n  filepath: {folder}\n  basename: out\n{more}"
    with open(f"{folder}/params.yml", "w") as f:
        f.write(text)
    return config.job(f"{folder}/params.yml", 0)


def test_prepared_snapshot(spark, prepared):
    meta = snapshot.read_meta(spark, f"{prepared}/snap_0000")
    assert (meta.box, meta.cells, meta.n_total, meta.redshift) == (BOX, (8, 8, 8), 5000, 1.0)
    p = spark.read.parquet(f"{prepared}/snap_0000/particles")
    c = spark.read.parquet(f"{prepared}/snap_0000/cells")
    assert (p.count(), c.count(), c.agg(F.sum("n")).first()[0]) == (5000, 512, 5000)
    assert checks.misplaced(p, ("x", "y", "z"), BOX, (8, 8, 8)).count() == 0
    held = p.select("cid", F.input_file_name().alias("f")).groupBy("f").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).orderBy("low").collect()
    assert all(a["high"] <= b["low"] for a, b in zip(held, held[1:], strict=False))


def test_scan_reads_what_is_useful(spark, prepared):
    path, near = f"{prepared}/snap_0000", points(spark, [(1, 1, 1)])
    got = snapshot.scan(spark, path, near, 0.4, 0.0)
    assert "PushedFilters: [Or(" in got._jdf.queryExecution().toString() or "GreaterThanOrEqual(cid" in got._jdf.queryExecution().toString()
    whole = spark.read.parquet(f"{path}/particles").select("x", "y", "z", "mass")
    assert 0 < got.count() < 2000
    a, b = (kernel.kernel_sums(near, x, BOX, (0.2, 0.4), 1.0).collect() for x in (got, whole))
    assert a == b
    assert snapshot.scan(spark, path, near, 6.0).count() == 5000
    assert snapshot.scan(spark, path, grids.uniform(spark, BOX, 8), 0.4).count() == 5000
    few, snapshot.MOST_RANGES = snapshot.MOST_RANGES, 1
    try:
        assert sorted(snapshot.scan(spark, path, near, 0.4, 0.0).collect()) == sorted(got.collect())
    finally:
        snapshot.MOST_RANGES = few


def test_run_and_report(spark, prepared):
    run.run(spark, parameters(prepared, "  type: uniform\n  cdim: 4\n", "  write_masses: 1\n"))
    out = spark.read.parquet(f"{prepared}/out/results")
    want = {r["gid"]: (r["n"], r["mass"]) for r in kernel.exhaustive(grids.uniform(spark, BOX, 4), spark.read.parquet(f"{prepared}/snap_0000/particles"), BOX, 1.0).collect()}
    assert {r["gid"]: (r["n_1"], r["mass_1"]) for r in out.collect()} == want
    head = spark.read.parquet(f"{prepared}/out/header").first()
    assert (head["NGridPoint"], head["MaxKernelRadius"], list(head["KernelRadii"]), head["Redshift"]) == (64, 1.0, [0.5, 1.0], 1.0)
    text = report.lines(spark, f"{prepared}/out")
    assert "NGridPoint: 64" in text and [x[:16] for x in text[-2:]] == ["kernel 0, radius", "kernel 1, radius"]
    run.run(spark, parameters(prepared, "  type: random\n  n_grid_points: 5\n"))
    assert "mass_0" not in spark.read.parquet(f"{prepared}/out/results").columns
    assert len(report.lines(spark, f"{prepared}/out")) > 8


def test_file_points_and_empty_grid(spark, prepared, caplog):
    text = "# points\n\n5 5 5\n  # c\n3.0 3.0 3.0 # tail\n7 7\none two three\n8 8 8 4\n10 5 5\n-1 5 5\n"
    with open(f"{prepared}/points.txt", "w") as f:
        f.write(text)
    with caplog.at_level(logging.WARNING):
        got = tables.read_points(spark, f"{prepared}/points.txt", BOX)
    assert sorted(r[1:] for r in got.collect()) == [(3.0, 3.0, 3.0), (5.0, 5.0, 5.0), (8.0, 8.0, 8.0)]
    assert "2 malformed lines" in caplog.text and "2 points beyond the box" in caplog.text
    with pytest.raises(Exception, match="(?i)path"):
        tables.read_points(spark, f"{prepared}/missing.txt", BOX)
    with open(f"{prepared}/none.txt", "w") as f:
        f.write("# none\n")
    with pytest.raises(config.EmptyGrid):
        run.run(spark, parameters(prepared, f"  type: file\n  grid_file: {prepared}/none.txt\n"))
    assert spark.read.parquet(f"{prepared}/out/results").count() == 0
    assert report.lines(spark, f"{prepared}/out")[-1] == "no points"


def test_prepare_refuses_wrong_shapes(spark, tmp_path):
    flat = spark.createDataFrame([([1.0, 2.0], 1.0)], "pos array<double>, m double")
    flat.write.parquet(f"{tmp_path}/flat")
    args = argparse.Namespace(source=f"{tmp_path}/flat", target=f"{tmp_path}/t", coordinates=["pos"], masses="m", box=None, cells=[4], redshift=0.0)
    with pytest.raises(ValueError, match="N, 3"):
        prepare.prepare(spark, args)
    args.masses = "absent"
    with pytest.raises(ValueError, match="masses"):
        prepare.prepare(spark, args)
    spark.createDataFrame([([0.0, 0.0, 0.0], 1.0), ([10.0, 20.0, 15.0], 1.0)], "pos array<double>, m double").write.parquet(f"{tmp_path}/good")
    prepare.prepare(spark, argparse.Namespace(source=f"{tmp_path}/good", target=f"{tmp_path}/t", coordinates=["pos"], masses="m", box=None, cells=[8], redshift=0.0))
    assert snapshot.read_meta(spark, f"{tmp_path}/t").box == (10.0, 20.0, 15.0)
    assert sorted(r["cid"] for r in spark.read.parquet(f"{tmp_path}/t/particles").collect()) == [0, 511]


def test_hdf5_is_asked_for_only_when_used(spark):
    try:
        hdf5.library()
    except ImportError as e:
        assert "h5py" in str(e)
    else:
        hdf5.register(spark)


def test_halo_files(spark, tmp_path):
    halos = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0), (4.0, 5.0, 6.0, 0.0), (0.5, 1.0, 1.0, 7.0)], PLACE)
    tables.write_halos(halos, str(tmp_path))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/points").collect()] == ["0.5 1.0 1.0", "1.0 2.0 3.0"]
    assert [r[0] for r in spark.read.text(f"{tmp_path}/masses").collect()] == ["7.0", "5.0"]


def test_ranges_of_cells(spark):
    got = cells.balanced_ranges(spark.createDataFrame(list(enumerate((4, 1, 0, 5, 2, 3))), "cid long, n long"), 3)
    assert [r["rank"] for r in got.orderBy("cid").collect()] == [0, 0, 1, 1, 2, 2]


def test_medians(spark, monkeypatch):
    import random
    import statistics

    r = random.Random(6)
    rows = [(0, r.gauss(0, 1)) for _ in range(1001)] + [(1, r.random()) for _ in range(1000)] + [(2, 5.0)] * 7 + [(3, float(i % 2)) for i in range(10)] + [(4, 1e9 if i == 0 else r.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "kernel_idx int, overdensity double")
    want = {k: statistics.median(v for i, v in rows if i == k) for k in range(5)}
    assert summary.medians(df) == want
    monkeypatch.setattr(summary, "HELD", 3)
    monkeypatch.setattr(summary, "BINS", 8)
    assert summary.medians(df) == want
    assert summary.medians(df.limit(0)) == {}


def test_chunks_in_blocks(spark):
    n = [4, 3, 5, 0, 2, 2, 7, 1]
    useful = [1, 0, 1, 1, 1, 0, 1, 1]
    rows = [(i, n[i], sum(n[:i]), bool(useful[i])) for i in range(8)]
    df = spark.createDataFrame(rows, "cid long, n long, start long, useful boolean")
    plain = lambda *a: sorted(map(tuple, cells.chunks(df, *a).collect()))
    assert plain(-1.0) == plain(-1.0, 2) == plain(-1.0, 1) == [(0, 0, 0, 0, 4), (1, 2, 4, 7, 7), (2, 6, 7, 16, 8)]
    assert plain(2.5) == plain(2.5, 2) == [(0, 0, 0, 0, 4), (1, 2, 7, 7, 17)]
    assert plain(3.5) == plain(3.5, 1) == [(0, 0, 7, 0, 24)]


def test_stream(spark, tmp_path):
    p = grids.random(spark, BOX, 300, 4).select(*[F.col(f"g{c}").alias(c) for c in "xyz"], F.lit(1.0).alias("mass"))
    p.repartition(4).write.parquet(f"{tmp_path}/in")
    g = grids.uniform(spark, BOX, 3)
    stream = spark.readStream.schema(PLACE).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = kernel_stream.running_sums(g, stream, BOX, (1.0, 2.0)).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["gid"]: (r["n_0"], r["n_1"]) for r in spark.table("sums").collect()}
    want = {r["gid"]: (r["n_0"], r["n_1"]) for r in kernel.kernel_sums(g, p, BOX, (1.0, 2.0), 1.0).collect() if r["n_1"]}
    assert got == want


def test_convert_clamps(spark, tmp_path):
    convert.write(particles(spark, [(0, 0, 0), (10, 10, 10), (10.5, 5, -1)]), str(tmp_path), BOX, (5, 5, 5))
    got = spark.read.parquet(f"{tmp_path}/particles").collect()
    assert all(0 <= r[c] < 10 for r in got for c in "xyz") and sorted(r["cid"] for r in got) == [0, 110, 124]
