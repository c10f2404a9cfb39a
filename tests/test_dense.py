"""The join in matrices: against all pairs and SQL, on odd rows, in small parts, and where it is chosen."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from orbweave.operators import dense, grids, kernel
from orbweave.plans import catalog

BOX, RADII = (16.0, 24.0, 32.0), (1.0, 2.0)
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(dense, "MANY_PAIRS", -1)
    monkeypatch.setattr(dense, "MANY_POINTS", -1)


def rows(spark, n, seed, step, names):
    """Random places, on multiples of the step where there is one, so that many lie on surfaces."""
    df = grids.random(spark, BOX, n, seed)
    at = [F.floor(F.col(f"g{a}") / step) * step if step else F.col(f"g{a}") for a in "xyz"]
    return df.select("gid", *[c.alias(x) for c, x in zip(at, names, strict=True)])


def both(spark, step, n_points=300, n_particles=3000, mass="1.0D + gid % 7"):
    p = rows(spark, n_particles, 5, step, "xyz").selectExpr("x", "y", "z", f"{mass} AS mass")
    return rows(spark, n_points, 8, step, kernel.G), p


def found(points, particles, box=BOX, radii=RADII):
    df = kernel.kernel_sums(points, particles, box, radii, 1.0)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
    return df


def same_as_pairs(spark, points, particles, radii=RADII):
    got = {r["gid"]: r for r in found(points, particles, BOX, radii).collect()}
    assert len(got) == points.select("gid").distinct().count()
    for k, radius in enumerate(radii):
        want = {r["gid"]: (r["n"], r["mass"]) for r in kernel.exhaustive(points, particles, BOX, radius).collect()}
        assert {g: r[f"n_{k}"] for g, r in got.items()} == {g: n for g, (n, _) in want.items()}
        assert all(math.isclose(got[g][f"mass_{k}"], m, rel_tol=1e-12) or (math.isnan(m) and math.isnan(got[g][f"mass_{k}"])) for g, (_, m) in want.items())
    return got


@pytest.mark.parametrize("step", [0.0, 0.25], ids=["anywhere", "surfaces"])
@pytest.mark.parametrize("mass", ["1.0D + gid % 7", "gid / 7.0D", "IF(gid % 9 = 0, NULL, 1e9D * gid)"], ids=["whole", "parts", "null"])
def test_equals_all_pairs(spark, always, step, mass):
    same_as_pairs(spark, *both(spark, step, mass=mass))


def test_small_parts(spark, always, monkeypatch):
    """Blocks, shares of a block and matrices of a few rows: the same sums."""
    points, p = both(spark, 0.25)
    whole = sorted(found(points, p).collect())
    for name, n in (("BLOCK_ROWS", 100), ("TASK_ROWS", 40), ("ROWS", 2), ("COLUMNS", 64), ("CELLS", 3), ("SURFACE", 10)):
        monkeypatch.setattr(dense, name, n)
    assert sorted(found(points, p).collect()) == whole
    heap = [df.withColumn(c, F.lit(15.9)) for df, c in ((points, "gx"), (p, "x"))]
    assert max(dense.shares(heap[1].withColumn("block", F.lit(0))).values()) > 1
    same_as_pairs(spark, *heap)


def test_odd_rows(spark, always):
    """Places that are null, not numbers or beyond the box, masses that are not finite, ids that occur twice."""
    points, p = both(spark, 0.0)
    nan, far = float("nan"), 1e300
    odd = [(None, 1.0, 1.0, 1.0), (nan, 1.0, 1.0, 1.0), (float("inf"), 1.0, 1.0, 1.0), (far, 2.0, 2.0, 1.0), (17.0, 3.0, 3.0, 2.0), (-1.0, 3.0, 3.0, 2.0), (50.0, 3.0, 3.0, 4.0), (8.0, 8.0, 8.0, nan), (1.0, 20.0, 30.0, float("inf")), (16.0, 24.0, 32.0, 3.0)]
    p = p.union(spark.createDataFrame(odd, p.schema))
    more = [(900, None, 1.0, 1.0), (901, nan, 1.0, 1.0), (902, 17.5, 3.0, 3.0), (903, -0.5, 3.0, 3.0), (904, 60.0, 3.0, 3.0), (905, 8.0, 8.0, 8.5), (906, 0.0, 0.0, 0.0), (907, 16.0, 24.0, 32.0), (908, 1.0, 20.0, 30.5)]
    got = same_as_pairs(spark, points.union(spark.createDataFrame(more, points.schema)), p)
    assert (got[900]["n_1"], got[901]["n_1"]) == (0, 0)
    twice = points.where("gid < 40").union(points.where("gid < 20"))
    a, b = (sorted(tuple(r)[:7] for r in f(twice).collect()) for f in (lambda g: found(g, both(spark, 0.0)[1]), lambda g: tree(g, both(spark, 0.0)[1])))
    assert a == b


def tree(points, particles):
    dense.MANY_POINTS = 10**9
    df = kernel.kernel_sums(points, particles, BOX, RADII, 1.0)
    dense.MANY_POINTS = -1
    return df


def test_halos_equal_sql(spark, always):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES["kernel_at_halos"](spark, DATA)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
    want = con.sql(catalog.ORACLES["kernel_at_halos"])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_many_pairs_are_not_rows(spark):
    """Halos beyond count: 40 thousand points that meet some 2600 particles each. Small jobs and wide spheres keep the join of cells."""
    p = spark.range(10**6).selectExpr("id % 4096 / 256.0D AS x", "id * 7919 % 4096 / 170.0D AS y", "id * 104729 % 4096 / 128.0D AS z", "1.0D AS mass")
    points = grids.random(spark, BOX, 40_000)
    plan = lambda g, radii: kernel.kernel_sums(g, p, BOX, radii, 1.0)._jdf.queryExecution().executedPlan().toString()
    many = plan(points, RADII)
    assert "FlatMapCoGroupsInArrow" in many and "cell" not in many
    blocks = math.prod(dense.block_counts(BOX, RADII[-1], 10**6))
    assert blocks > 4 and many.count(f"{blocks}), REPARTITION_BY_NUM") == 2  # the session has 4 partitions
    assert "FlatMapCoGroupsInArrow" not in plan(points.limit(100), RADII)
    assert "FlatMapCoGroupsInArrow" not in plan(points, (1.0, 9.0))
