"""Evaluation points: lattice, reproducible random, from a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mixing of random(): modulus, a factor an axis, and (factor, shift) of each round. Products stay below 2^63.
PRIME, AXIS, ROUNDS = 2147483647, (73856093, 19349663, 83492791), ((48271, 15), (69621, 13), (39373, 16))


def uniform(spark: SparkSession, box: Sequence[float], cells: int) -> DataFrame:
    """cells^3 points in the middle of the lattice's cells, numbered i-major."""
    n = cells
    at = [F.expr(f"id div {n * n}"), F.expr(f"(id div {n}) % {n}"), F.expr(f"id % {n}")]
    return spark.range(n**3).select(F.col("id").alias("gid"), *[((a + 0.5) * F.lit(float(length)) / F.lit(float(n))).alias(c) for a, length, c in zip(at, box, ("gx", "gy", "gz"), strict=True)])


def uniform_variate(number: Column, axis: int, seed: int) -> Column:
    a = (number * AXIS[axis] + F.lit(seed * 1000003 + axis * 12345677)) % PRIME
    for factor, shift in ROUNDS:
        a = (a * factor) % PRIME
        a = a.bitwiseXOR(F.shiftright(a, shift))
    return (a % PRIME) / F.lit(float(PRIME))


def random(spark: SparkSession, box: Sequence[float], points: int, seed: int = 42) -> DataFrame:
    """Points that depend on their number and the seed only, not on partitions."""
    return spark.range(points).select(F.col("id").alias("gid"), *[(uniform_variate(F.col("id"), i, seed) * F.lit(float(length))).alias(c) for i, (length, c) in enumerate(zip(box, ("gx", "gy", "gz"), strict=True))])


def make(spark: SparkSession, spec, box: Sequence[float]) -> DataFrame:
    from orbweave.sources.tables import read_points

    if spec.kind == "uniform":
        return uniform(spark, box, spec.cells)
    return random(spark, box, spec.points, spec.seed) if spec.kind == "random" else read_points(spark, spec.file, box)
