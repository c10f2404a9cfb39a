"""Run parameters: a typed file, path templates, the command line."""

from __future__ import annotations

import argparse
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


class EmptyGrid(RuntimeError):
    """No evaluation point; results were written, empty."""


def parse(text: str) -> dict[str, str]:
    """`Section:` lines and indented `key: value` lines to {"Section/key": value}; comments, blank lines and quotes go."""
    out, section = {}, ""
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip():
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"not a parameter: {line!r}")
        value = value.strip().strip("\"'")
        if line[0] not in " \t" and not value:
            section = key
        else:
            out[f"{section}/{key}" if section and line[0] in " \t" else key] = value
    return out


@dataclass
class Parameters:
    values: dict[str, Any] = field(default_factory=dict)

    def get(self, key: str, kind: type, default: Any = ...) -> Any:
        """The value as `kind`, whatever way it was written; a default is remembered, without one a missing key raises."""
        if key not in self.values:
            if default is ...:
                raise KeyError(f"parameter {key} is missing")
            self.values[key] = default
        value = self.values[key]
        if kind is bool:
            return str(value).lower() in ("1", "true", "yes")
        return int(float(value)) if kind is int and not re.fullmatch(r"[-+]?\d+", str(value)) else kind(value)

    def __contains__(self, key: str) -> bool:
        return key in self.values

    def lines(self) -> list[str]:
        return [f"{k}: {v}" for k, v in sorted(self.values.items())]


def fill(path: str, placeholder: str, snapshot: int) -> str:
    """Every placeholder of a path replaced by the snapshot's number, as wide as the placeholder."""
    if not placeholder:
        raise ValueError("an empty placeholder")
    return path.replace(placeholder, str(snapshot).zfill(len(placeholder)))


@dataclass(frozen=True)
class GridSpec:
    kind: str
    radii: tuple[float, ...]
    cells: int = 0
    points: int = 0
    file: str = ""
    seed: int = 42

    def __post_init__(self):
        if self.kind not in ("uniform", "random", "file"):
            raise ValueError(f"unknown grid type {self.kind}")
        if not self.radii or min(self.radii) <= 0:
            raise ValueError("radii must be positive")

    @property
    def largest(self) -> float:
        return max(self.radii)


def grid_spec(p: Parameters) -> GridSpec:
    radii = tuple(p.get(f"Kernels/kernel_radius_{i}", float) for i in range(1, p.get("Kernels/nkernels", int) + 1))
    kind = p.get("Grid/type", str, "uniform")
    return GridSpec(
        kind, radii,
        cells=p.get("Grid/cdim", int) if kind == "uniform" else 0,
        points=p.get("Grid/n_grid_points", int) if kind == "random" else 0,
        file=p.get("Grid/grid_file", str) if kind == "file" else "",
        seed=p.get("Grid/random_seed", int, 42),
    )


@dataclass(frozen=True)
class Job:
    grid: GridSpec
    source: str
    target: str
    density: float
    snapshot: int
    write_masses: bool
    gap_fraction: float = 0.01


def job(path: str, snapshot: int = 0) -> Job:
    from orbweave.functions.cosmology import mean_density

    p = Parameters(parse(Path(path).read_text()))
    mark = p.get("Input/placeholder", str, "0000")
    put = lambda x: fill(x, mark, snapshot)
    grid = grid_spec(p)
    if grid.file:
        grid = GridSpec(grid.kind, grid.radii, file=put(grid.file), seed=grid.seed)
    density = mean_density(*(p.get(f"Cosmology/{k}", float) for k in ("h", "Omega_cdm", "Omega_b")))
    return Job(grid, put(p.get("Input/filepath", str)), put(p.get("Output/filepath", str).rstrip("/") + "/" + p.get("Output/basename", str)), density, snapshot, p.get("Output/write_masses", bool, False), p.get("Input/part_gap_fill_fraction", float, 0.01))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    a = argparse.ArgumentParser(prog="orbweave")
    a.add_argument("params")
    a.add_argument("nthreads", type=int)
    a.add_argument("snapshot", type=int, nargs="?", default=0)
    a.add_argument("verbosity", type=int, nargs="?", default=1)
    return a.parse_args(argv)
