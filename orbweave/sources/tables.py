"""Sources and sinks: typed Parquet tables, coordinate text files, halo catalogues, the box."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
PARTICLES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "mass")])
POINTS = T.StructType([T.StructField("gid", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("gx", "gy", "gz"))])
NUMBER = r"[-+]?(?:\d++\.?+\d*+|\.\d++)(?:[eE][-+]?\d++)?+"


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTICLES).parquet(path)


def read_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Particles from columns of other names ({"x": "pos_x", ...}); a missing one raises."""
    missing = [v for v in names.values() if v not in df.columns]
    if missing or set(names) != {"x", "y", "z", "mass"}:
        raise ValueError(f"coordinates (N, 3) and masses (N) are needed; missing {missing or sorted({'x', 'y', 'z', 'mass'} - set(names))}")
    return df.select(*[F.col(names[c]).cast("double").alias(c) for c in ("x", "y", "z", "mass")])


def points_from_lines(lines: DataFrame, box: Sequence[float], low: float = 0.0) -> DataFrame:
    """Points from text lines (column `value`, `at` their order): blank lines and comments are skipped, so are lines without
    three leading numbers; what follows these is ignored; only points inside the half-open box stay."""
    from orbweave.functions.geometry import inside_box

    found = F.regexp_extract
    shape = rf"^\s*({NUMBER})\s+({NUMBER})\s+({NUMBER})(?:\s.*|#.*)?$"
    kept = lines.where(F.col("value").rlike(shape) & ~F.ltrim("value").startswith("#"))
    out = kept.select("at", *[found("value", shape, i).try_cast("double").alias(c) for i, c in enumerate(("gx", "gy", "gz"), 1)])
    return out.where(inside_box([F.col(c) for c in ("gx", "gy", "gz")], box, low)).select(F.col("at").alias("gid"), "gx", "gy", "gz")


def malformed(lines: DataFrame) -> DataFrame:
    """(at, value) of lines that points_from_lines() skips though they are neither blank nor comments."""
    shape = rf"^\s*(?:{NUMBER})\s+(?:{NUMBER})\s+(?:{NUMBER})(?:\s.*|#.*)?$"
    return lines.where(~F.col("value").rlike(shape) & ~F.ltrim("value").startswith("#") & (F.trim(F.regexp_replace("value", r"\s", " ")) != "")).select("at", "value")


def outside(lines: DataFrame, box: Sequence[float]) -> DataFrame:
    """(gid, gx, gy, gz) of well-formed points that lie beyond the box."""
    inside = points_from_lines(lines, box).select("gid")
    return points_from_lines(lines, (math.inf,) * 3, low=-math.inf).join(inside, "gid", "left_anti")


def read_points(spark: SparkSession, path: str, box: Sequence[float]) -> DataFrame:
    """Points of a coordinate file; a missing file raises, malformed lines and points beyond the box are warned of and skipped.
    Numbers grow with the lines but have gaps."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    for n, what in ((malformed(lines).count(), "malformed lines"), (outside(lines, box).count(), "points beyond the box")):
        if n:
            log.warning("%s: %d %s skipped", path, n, what)
    return points_from_lines(lines, box)


def write_halos(halos: DataFrame, path: str) -> None:
    """Two text folders: points ("x y z") and masses of halos with mass, in one order."""
    kept = halo_points(halos).orderBy("gx", "gy", "gz", "mass")
    kept.select(F.concat_ws(" ", "gx", "gy", "gz").alias("value")).write.mode("overwrite").text(f"{path}/points")
    kept.select(F.col("mass").cast("string").alias("value")).write.mode("overwrite").text(f"{path}/masses")


def halo_points(halos: DataFrame) -> DataFrame:
    return halos.where("mass > 0").select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"), "mass")


def box_of(particles: DataFrame, given: Sequence[float] | None = None, header: Sequence[float] | None = None) -> tuple[float, float, float]:
    """Given, else from the header (one number is a cube), else the largest coordinates."""
    for x in (given, header):
        if x:
            x = tuple(map(float, x))
            return x * 3 if len(x) == 1 else x
    r = particles.agg(F.max("x"), F.max("y"), F.max("z")).first()
    if r[0] is None:
        raise ValueError("the box can't be told from no particles")
    return tuple(map(float, r))


def write_results(results: DataFrame, path: str, header: dict, cells: DataFrame) -> None:
    """results ordered by cell and point, cells, and a one-row header, as Parquet; earlier ones are replaced."""
    results.repartitionByRange("cid", "gid").sortWithinPartitions("cid", "gid").write.mode("overwrite").parquet(f"{path}/results")
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    results.sparkSession.createDataFrame([header]).write.mode("overwrite").parquet(f"{path}/header")
