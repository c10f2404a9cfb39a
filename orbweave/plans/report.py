"""A report over the results of a run: python -m orbweave.plans.report TARGET"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import kernel, summary


def results_of(spark: SparkSession, path: str) -> tuple[DataFrame, list[float]]:
    """(results by point and kernel, radii)."""
    radii = spark.read.parquet(f"{path}/header").first()["KernelRadii"]
    wide = spark.read.parquet(f"{path}/results")
    for k in range(len(radii)):
        if f"mass_{k}" not in wide.columns:
            wide = wide.withColumn(f"mass_{k}", F.lit(None).cast("double"))
    return kernel.long_form(wide, radii), radii


def lines(spark: SparkSession, path: str) -> list[str]:
    """Header, bounds and spacing of the points, and by kernel, in order of radius, statistics, signs, bins and extremes."""
    head = spark.read.parquet(f"{path}/header").first().asDict()
    points = spark.read.parquet(f"{path}/results").select("gid", "gx", "gy", "gz")
    out = [f"{k}: {v}" for k, v in sorted(head.items())]
    if not head["NGridPoint"]:
        return [*out, "no points"]
    b = summary.bounds(points).first()
    out += [f"{c}: {b[f'g{c}_low']:g} to {b[f'g{c}_high']:g}" for c in "xyz"] + [f"spacing: {summary.spacing(points).first()['spacing']}"]
    found, _ = results_of(spark, path)
    tables = {n: {} for n in ("signs", "bins", "ends")}
    for r in summary.signs(found).collect():
        tables["signs"][r["kernel_idx"]] = f"over {r['n_over']}, under {r['n_under']}, zero {r['n_zero']}"
    for r in summary.histogram(found).orderBy("bin").collect():
        tables["bins"].setdefault(r["kernel_idx"], []).append(f"{r['bin']}: {r['n']}")
    for r in summary.extremes(found).collect():
        tables["ends"][r["kernel_idx"]] = f"least at {r['gid_low']}, greatest at {r['gid_high']}"
    for r in summary.stats(found).orderBy("radius", "kernel_idx").collect():
        k = r["kernel_idx"]
        out.append(f"kernel {k}, radius {r['radius']:g}: {r['low']:g} to {r['high']:g}, mean {r['mean']:g}, median {r['median']:g}, std {r['std']:g}; {tables['signs'][k]}; bins {', '.join(tables['bins'].get(k, []))}; {tables['ends'][k]}")
    return out


def main(argv: list[str] | None = None) -> int:
    (path,) = argv or sys.argv[1:]
    print("\n".join(lines(SparkSession.builder.appName("orbweave-report").getOrCreate(), path)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
