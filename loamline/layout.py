"""How ordered series are cut into tasks.

A station may hold a third of all rows, so no window here is partitioned by station alone. Row numbers are built
from per-bucket counts, and ordered windows run over fixed-size blocks of row numbers that carry a few
neighbouring rows (a halo). The sizes are rows-per-task knobs; none changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

HOUR = 3600
MONTH = 30 * 24 * HOUR


@dataclass(frozen=True)
class Layout:
    bucket_seconds: int = MONTH
    block_rows: int = 1_000_000
    value_width: float = 0.02
    #: No station has more than a block of rows, so each is one block and its rows may lie together (``stage_dealt``).
    whole: bool = False

    def __post_init__(self):
        if self.bucket_seconds < 1 or self.block_rows < 1 or self.value_width <= 0:
            raise ValueError("layout sizes must be positive")

    @staticmethod
    def for_bytes(size: float, span_days: float = 365.0, task_bytes: float = 512 * 2**20) -> Layout:
        """Buckets small enough that a station with a third of ``size`` bytes gives tasks of about ``task_bytes``."""
        buckets = max(1.0, size / 3 / task_bytes)
        return Layout(
            bucket_seconds=int(min(MONTH, max(HOUR, span_days * 24 * HOUR / buckets))),
            value_width=0.02 / min(1000.0, max(1.0, buckets / 12)),
        )

    @staticmethod
    def of(df: DataFrame, span_days: float = 365.0) -> Layout:
        """Layout from the planner's size estimate of the input; runs no job."""
        size = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return Layout.for_bytes(size, span_days)


    def for_stations(self, rows: DataFrame, key: str = "source_id") -> Layout:
        """This layout, ``whole`` if no station of ``rows`` is longer than a block (one count of the input)."""
        longer = rows.groupBy(key).count().where(f"`{key}` IS NOT NULL AND count > {self.block_rows}")
        return replace(self, whole=longer.isEmpty())


DEFAULT = Layout()
