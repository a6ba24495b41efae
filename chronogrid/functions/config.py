"""Grids, time slices and defaults of the index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bounds:
    min_lon: float
    max_lon: float
    min_lat: float
    max_lat: float

    def padded(self, share: float) -> "Bounds":
        w, h = (self.max_lon - self.min_lon) * share, (self.max_lat - self.min_lat) * share
        return Bounds(self.min_lon - w, self.max_lon + w, self.min_lat - h, self.max_lat + h)


@dataclass(frozen=True)
class Grid:
    cols: int
    rows: int
    bounds: Bounds

    @property
    def name(self) -> str:
        return f"{self.cols}x{self.rows}"

    @property
    def cell_width(self) -> float:
        return (self.bounds.max_lon - self.bounds.min_lon) / self.cols

    @property
    def cell_height(self) -> float:
        return (self.bounds.max_lat - self.bounds.min_lat) / self.rows


@dataclass(frozen=True)
class TimeSlice:
    """Years, both ends included; `between` and `words` give the key's and the label's form."""

    start: int
    end: int
    between: str = "_"
    words: str = "-"

    @property
    def key(self) -> str:
        return f"{self.start}{self.between}{self.end}"

    @property
    def label(self) -> str:
        return f"{self.start}{self.words}{self.end}"


def overall(slices: list[TimeSlice]) -> TimeSlice:
    """From the first start to the last end."""
    return TimeSlice(min(s.start for s in slices), max(s.end for s in slices))


# Bounds, grid sizes, padding, slices and limits that results depend on.
RAW_BOUNDS = Bounds(4.81, 4.964447, 52.2354339, 52.4443)
PADDING = 0.05
GRID_SIZES = [(75, 75), (8, 8), (16, 16)]
DEFAULT_SLICES = [TimeSlice(y, y + 50) for y in range(1500, 2000, 50)] + [TimeSlice(2000, 2025)]
DEFAULT_START = 1800
LONGEST_PERIOD = 50
PAGE_SIZE = 100
MAX_COMBO = 4
HISTOGRAM_TAGS = 20
POINT = r"POINT\(([+-]?\d*\.?\d+)\s+([+-]?\d*\.?\d+)\)"

BOUNDS = RAW_BOUNDS.padded(PADDING)
GRIDS = [Grid(c, r, BOUNDS) for c, r in GRID_SIZES]
PRIMARY = GRIDS[0]
