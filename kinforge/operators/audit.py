"""Throughput and memory of the steps of a job."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def peak_rss_mb() -> float:
    """Most memory that the driver's Python process has held so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


@dataclass
class Audit:
    """(step, rows, seconds, rows a second, peak memory) of each step taken."""

    COLUMNS = ["step", "rows", "seconds", "rows_per_second", "driver_peak_mb"]
    rows: list[tuple] = field(default_factory=list)

    def _taken(self, step: str, n: int, began: float) -> None:
        took = max(time.perf_counter() - began, 1e-9)
        self.rows.append((step, n, round(took, 3), round(n / took, 1), round(peak_rss_mb(), 1)))

    def collected(self, step: str, small: DataFrame) -> list[tuple]:
        """The rows of a small result."""
        began = time.perf_counter()
        out = [tuple(r) for r in small.collect()]
        self._taken(step, len(out), began)
        return out

    def written(self, step: str, write: Callable[[], None], read: Callable[[], DataFrame]) -> None:
        """Write a table, then count what is there (of Parquet: from the files' footers)."""
        began = time.perf_counter()
        write()
        self._taken(step, read().count(), began)
