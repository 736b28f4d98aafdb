"""Quantization grids and the scalar functions over them. All rounding is half to even."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHUNK_SEC, MAX_DURATION_SEC, FULL_VELOCITY, DRUMS = 100.0, 10.0, 128, 128
LEAD_SEC, REST_SEC = 5.0, 1.0
CATEGORIES = ("time", "duration", "pitch", "instrument", "velocity")
FIELDS = ("t", "d", "p", "i", "v")


@dataclass(frozen=True)
class Grid:
    """Step of onsets and of durations in milliseconds, and number of velocity bins."""

    onset_ms: float = 10.0
    dur_ms: float = 10.0
    vel_bins: int = 128

    @property
    def onset_scale(self) -> float:
        return 1000.0 / self.onset_ms

    @property
    def dur_scale(self) -> float:
        return 1000.0 / self.dur_ms

    @property
    def chunk_steps(self) -> int:
        return round(CHUNK_SEC * self.onset_scale)

    @property
    def max_duration(self) -> int:
        return round(MAX_DURATION_SEC * self.dur_scale)

    @property
    def lead_steps(self) -> int:
        return max(1, round(LEAD_SEC * self.onset_scale))

    @property
    def rest_steps(self) -> int:
        return max(1, round(REST_SEC * self.onset_scale))

    @property
    def name(self) -> str:
        return f"onset-{self.onset_ms:g}ms_duration-{self.dur_ms:g}ms_velocity-{self.vel_bins}bin"


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def onset_steps(start: Column, grid: Grid) -> Column:
    return half_even(start * F.lit(grid.onset_scale))


def duration_steps(length: Column, grid: Grid) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.least(half_even(length * F.lit(grid.dur_scale)), F.lit(grid.max_duration).cast("long")))


def velocity_bin(velocity: Column, grid: Grid) -> Column:
    return half_even(velocity * F.lit(grid.vel_bins - 1) / F.lit(127.0)) if grid.vel_bins < FULL_VELOCITY else velocity.cast("long")


def velocity_of(bin_: Column, grid: Grid) -> Column:
    v = half_even(bin_ * F.lit(127) / F.lit(float(grid.vel_bins - 1))) if grid.vel_bins < FULL_VELOCITY else bin_
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(127).cast("long"), v))


def instrument(program: Column, is_drum: Column) -> Column:
    return F.when(is_drum, DRUMS).otherwise(program).cast("long")


def coarser(field: str, value: Column, fine: float, coarse: float) -> Column:
    """A quantized field on a coarser grid; fine and coarse are steps in ms, or bins for velocity."""
    if field == "t":
        return F.greatest(F.lit(0).cast("long"), half_even(value * F.lit(float(fine)) / F.lit(float(coarse))))
    if field == "d":
        return F.greatest(F.lit(1).cast("long"), half_even(value * F.lit(float(fine)) / F.lit(float(coarse))))
    if field == "v":
        return half_even(value * F.lit(float(coarse - 1)) / F.lit(float(fine - 1)))
    raise ValueError(f"{field} isn't quantized")


def token(category: str | Column, value: Column) -> Column:
    before = F.lit(f"<{category}-") if isinstance(category, str) else F.concat(F.lit("<"), category, F.lit("-"))
    return F.concat(before, value.cast("string"), F.lit(">"))


def category_of(tok: Column) -> Column:
    """Its tag; a control's tag with ctrl_ before it; else unknown."""
    inner = F.regexp_extract(tok, r"^(?:<|ctrl_)(\w+)-", 1)
    return F.when(inner == "", F.when(tok.startswith("ctrl_"), "ctrl_unknown").otherwise("unknown")).when(tok.startswith("ctrl_"), F.concat(F.lit("ctrl_"), inner)).otherwise(inner)


def value_of(tok: Column) -> Column:
    """Its number, null if there is none."""
    return F.nullif(F.regexp_extract(tok, r"^<\w+-(-?\d+)>$", 1), F.lit("")).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.when(b != 0, a / b)


# Private-use ranges of Unicode, in the order in which characters are given out.
PRIVATE_USE = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFF), (0x100000, 0x10FFFF))


def private_character(index: int) -> str:
    for first, last in PRIVATE_USE:
        if index <= last - first:
            return chr(first + index)
        index -= last - first + 1
    raise ValueError("more tokens than private-use characters")
