"""Options of a decomposition."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Defaults are the published tool's values.

    max_ratio: share of uncovered bases that a run bears. top_units: candidates
    that are weighed against one another. smooth: vote over labels (off: more
    complex patterns with fewer mismatches), in windows of a fifth of the read
    between smooth_least and smooth_most bases; of units that end equally well
    the one that follows goes on then, not the last. long_mode: also try the best
    units without the greedy choice and keep the better result. units: further
    candidate units, of 1 to 999 bases; those of 20 and more are found with
    errors. max_unit: bases of automatic units, up to 30; those of 20 and more
    must stand twice in a row somewhere. max_read: longer reads are refused;
    None lifts the limit. labels: also return the unit of every base.
    """

    max_ratio: float = 0.3
    top_units: int = 5
    min_coverage: float = 0.95
    max_unit: int = 20
    smooth: bool = True
    long_mode: bool = False
    units: tuple[str, ...] = ()
    on_invalid: str = "fail"
    max_read: int | None = None
    smooth_least: int = 11
    smooth_most: int = 41
    labels: bool = False

    def __post_init__(self):
        for u in self.units:
            if not 1 <= len(u) <= 999 or set(u) - set("ACGT"):
                raise ValueError(f"a unit has 1 to 999 of the letters A, C, G, T: {u!r}")
