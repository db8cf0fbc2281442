"""Fixed-length time periods: a unit name and how many of it, held as nanoseconds."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Nanoseconds of each admitted unit.  Months and longer have no fixed length.
NANOSECONDS = {
    "Nanosecond": 1,
    "Microsecond": 1_000,
    "Millisecond": 1_000_000,
    "Second": 1_000_000_000,
    "Minute": 60_000_000_000,
    "Hour": 3_600_000_000_000,
    "Day": 86_400_000_000_000,
    "Week": 604_800_000_000_000,
}


@dataclass(frozen=True)
class Period:
    unit: str = "Second"
    count: int = 1

    def __post_init__(self) -> None:
        if self.unit not in NANOSECONDS:
            raise ValueError(f"a period needs a unit of fixed length ({', '.join(NANOSECONDS)}), not {self.unit!r}")

    @property
    def ns(self) -> int:
        return NANOSECONDS[self.unit] * self.count

    def ratio(self, other: Period) -> float:
        """How many of ``other`` fit into this one."""
        return self.ns / other.ns

    def times(self, factor: float) -> Period:
        """This period times a number, cut to whole nanoseconds."""
        return Period("Nanosecond", math.floor(self.ns * factor))


def scale_volatility(volatility, of: Period, to: Period):
    """Volatilities grow with the square root of time; None stays None."""
    return None if volatility is None else volatility * math.sqrt(to.ratio(of))


def scale_drift(drift, of: Period, to: Period):
    """Drifts grow with time; None stays None."""
    return None if drift is None else drift * to.ratio(of)
