"""Medians over sliding windows of any length, at logarithmic cost per row."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType


class SlidingMedian:
    """A multiset with a median: two heaps that meet at it. Removed values stay in a heap until they come to its top."""

    def __init__(self) -> None:
        self.low: list[tuple[float, int]] = []  # negated values, so that the largest is on top
        self.high: list[tuple[float, int]] = []
        self.side: dict[int, bool] = {}  # entry -> whether it is in the upper half
        self.n_low = self.n_high = 0

    def __len__(self) -> int:
        return self.n_low + self.n_high

    def add(self, value: float, entry: int) -> None:
        """``entry``: a number that no other value in the set has."""
        self._prune()
        upper = bool(self.high) and value >= self.high[0][0]
        self.side[entry] = upper
        if upper:
            heapq.heappush(self.high, (value, entry))
            self.n_high += 1
        else:
            heapq.heappush(self.low, (-value, entry))
            self.n_low += 1
        self._balance()

    def remove(self, entry: int) -> None:
        if self.side.pop(entry):
            self.n_high -= 1
        else:
            self.n_low -= 1
        self._balance()

    def _prune(self) -> None:
        side = self.side
        while self.low and side.get(self.low[0][1]) is not False:
            heapq.heappop(self.low)
        while self.high and side.get(self.high[0][1]) is not True:
            heapq.heappop(self.high)

    def _balance(self) -> None:
        """The lower half has as many values as the upper or one more."""
        self._prune()
        while self.n_low > self.n_high + 1:
            value, entry = heapq.heappop(self.low)
            heapq.heappush(self.high, (-value, entry))
            self.side[entry] = True
            self.n_low, self.n_high = self.n_low - 1, self.n_high + 1
            self._prune()
        while self.n_high > self.n_low:
            value, entry = heapq.heappop(self.high)
            heapq.heappush(self.low, (-value, entry))
            self.side[entry] = False
            self.n_low, self.n_high = self.n_low + 1, self.n_high - 1
            self._prune()

    def median(self) -> float:
        lower = -self.low[0][0]
        return lower if self.n_low > self.n_high else 0.5 * lower + 0.5 * self.high[0][0]


def trailing_medians(at: Sequence[int], values: Iterable[float | None], reach: int, min_obs: int) -> list[float | None]:
    """Median of the values in (t - reach, t] for every t of the rising ``at``, rows of equal time included; None below ``min_obs``."""
    values = [None if v is None or math.isnan(v) else v for v in values]
    out: list[float | None] = [None] * len(at)
    window, first, row, n = SlidingMedian(), 0, 0, len(at)
    while row < n:
        t, stop = at[row], row
        while stop < n and at[stop] == t:
            if values[stop] is not None:
                window.add(values[stop], stop)
            stop += 1
        while at[first] <= t - reach:
            if values[first] is not None:
                window.remove(first)
            first += 1
        if len(window) >= max(min_obs, 1):
            out[row:stop] = [window.median()] * (stop - row)
        row = stop
    return out


def median_of_groups(df: DataFrame, keys: Sequence[str], at: str, value: str, reach: int, min_obs: int, out: str) -> DataFrame:
    """Add ``out``, the trailing median of each row in its group. A group is held by one task: cut long series into blocks before."""
    schema = StructType([*df.schema.fields]).add(out, DoubleType())

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table[at].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        found = trailing_medians(table[at].to_pylist(), table[value].cast(pa.float64()).to_pylist(), reach, min_obs)
        return table.append_column(out, pa.array(found, type=pa.float64()))

    return df.groupBy(*keys).applyInArrow(run, schema)
