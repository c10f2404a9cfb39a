"""Comoving mean density and overdensity."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the gravitational constant in the units of the masses and lengths.
G = 4.301744232015554e01


def mean_density(h: float, omega_cdm: float, omega_b: float) -> float:
    """3 (100 h)^2 / (8 pi G) times the matter share; the same at every redshift."""
    return 3 * (100 * h) ** 2 / (8 * math.pi * G) * (omega_cdm + omega_b)


def sphere(radius: float) -> float:
    return 4.0 / 3.0 * math.pi * radius**3


def overdensity(mass: Column, radius: float, density: float) -> Column:
    return mass / F.lit(sphere(radius)) / F.lit(density) - 1
