"""Reports over results: (gid, kernel_idx, overdensity, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = (-1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 5.0, 10.0)


BINS, HELD = 1024, 100_000


def medians(results: DataFrame, value: str = "overdensity") -> dict[int, float]:
    """The exact median of each kernel by counting: a range that holds the middle is cut into BINS, the bin that holds it is the next
    range, until a bin has one value or so few rows that they are looked at. Few numbers a kernel come to the driver."""
    v, rows = F.col(value), results.where(F.col(value).isNotNull())
    found: dict[int, float] = {}
    wanted = {r["kernel_idx"]: (r["low"], r["high"], (r["n"] - 1) // 2, r["n"] // 2, r["n"]) for r in rows.groupBy("kernel_idx").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n")).collect()}
    inside = lambda k, low, high: (F.col("kernel_idx") == k) & v.between(low, high)
    while wanted := {k: x for k, x in wanted.items() if not _settled(k, x, found)}:
        few = {k: x for k, x in wanted.items() if x[4] <= HELD}
        for k, (low, high, first, second, _) in few.items():
            own = sorted(r[0] for r in rows.where(inside(k, low, high)).select(v).collect())
            found[k] = (own[first] + own[second]) / 2
        wanted = {k: x for k, x in wanted.items() if k not in few}
        if not wanted:
            break
        place = F.lit(None).cast("int")
        for k, (low, high, *_) in wanted.items():
            at = F.least(F.floor((v - low) / ((high - low) / BINS)), F.lit(BINS - 1)).cast("int")
            place = F.when(inside(k, low, high), at).otherwise(place)
        bins: dict[int, list] = {}
        for r in sorted(rows.select("kernel_idx", place.alias("bin"), v.alias("v")).where("bin IS NOT NULL").groupBy("kernel_idx", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()):
            bins.setdefault(r["kernel_idx"], []).append(r)
        for k, (_, _, first, second, _) in wanted.items():
            below = 0
            for i, r in enumerate(bins[k]):
                if first < below + r["n"]:
                    break
                below += r["n"]
            if second < below + r["n"]:
                wanted[k] = (r["low"], r["high"], first - below, second - below, r["n"])
            else:  # the two in the middle are the last of this bin and the first of the next
                found[k] = (r["high"] + bins[k][i + 1]["low"]) / 2
        wanted = {k: x for k, x in wanted.items() if k not in found}
    return found


def _settled(kernel: int, state: tuple, found: dict[int, float]) -> bool:
    if state[0] == state[1]:
        found[kernel] = state[0]
    return kernel in found


def stats(results: DataFrame) -> DataFrame:
    """(kernel_idx, radius, low, high, mean, median, std); the median comes from medians(), as one task would have to hold all values."""
    v = "overdensity"
    middle = results.sparkSession.createDataFrame(list(medians(results).items()), "kernel_idx int, median double")
    plain = results.groupBy("kernel_idx", "radius").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return plain.join(F.broadcast(middle), "kernel_idx", "left").select("kernel_idx", "radius", "low", "high", "mean", "median", "std")


def signs(results: DataFrame) -> DataFrame:
    v = F.col("overdensity")
    part = lambda c, name: [F.count_if(c).alias(f"n_{name}"), (F.lit(100.0) * F.count_if(c) / F.count("*")).alias(f"percent_{name}")]
    return results.groupBy("kernel_idx").agg(*part(v > 0, "over"), *part(v < 0, "under"), *part(v == 0, "zero"))


def histogram(results: DataFrame) -> DataFrame:
    """Counts by bin, closed on the left, the last one on both sides; beyond 10 one more bin up to the greatest value."""
    v, top = F.col("overdensity"), F.max("overdensity")
    most = results.groupBy("kernel_idx").agg(top.alias("most"))
    bins = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)):
        bins = F.when((v >= a) & (v < b), i).otherwise(bins)
    last = len(EDGES) - 2
    bins = F.when(v > EDGES[-1], last + 1).when((v == EDGES[-1]) & (F.col("most") > EDGES[-1]), last + 1).when(v == EDGES[-1], last).otherwise(bins)
    return results.join(most, "kernel_idx").select("kernel_idx", bins.alias("bin")).where("bin IS NOT NULL").groupBy("kernel_idx", "bin").agg(F.count("*").alias("n"))


def extremes(results: DataFrame) -> DataFrame:
    """Points of least and greatest overdensity, the first of equals."""
    v = F.col("overdensity")
    return results.groupBy("kernel_idx").agg(F.min_by("gid", F.struct(v, F.col("gid"))).alias("gid_low"), F.max_by("gid", F.struct(v, -F.col("gid"))).alias("gid_high"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{c}_{n}") for c in ("gx", "gy", "gz") for f, n in ((F.min, "low"), (F.max, "high"))])


def spacing(points: DataFrame) -> DataFrame:
    """Least positive distance among the first hundred points, not periodic."""
    some = points.orderBy("gid").limit(100)
    a, b = (some.select(*[F.col(c).alias(f"{s}{c}") for c in points.columns]) for s in "ab")
    d = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in ("gy", "gz")), (F.col("agx") - F.col("bgx")) * (F.col("agx") - F.col("bgx")))
    return a.join(b, F.col("agid") < F.col("bgid")).select(F.sqrt(d).alias("d")).where("d > 0").agg(F.min("d").alias("spacing"))
