"""Positions of rows in a total order, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import free
from loamline.stage import stage


def order_key(column: Column) -> Column:
    """A text that is never null and sorts as the column does, bytewise, with nulls first: usable as a join key."""
    return F.when(column.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), column))


def numbered(rows: DataFrame, by: str | None, order: Sequence[str], label: str) -> DataFrame:
    """``rows`` with ``idx``, the position from 0 within the group ``by`` (a text that is never null; None: one group)
    by the columns ``order`` (nulls first), and ``n``, the rows of the group.

    Rows are dealt by ranges of (by, order), so a group of any size takes as many tasks as it needs; each range numbers
    its own rows and is shifted by the rows of the ranges before it. Rows equal in all of these columns are given
    consecutive positions in any order; a last column that tells them apart also lets them be dealt to several tasks.
    ``rows`` is read twice (sample and shuffle), so it should be a written table.
    """
    keys = [F.col(c).asc_nulls_first() for c in ([by] if by else []) + list(order)]
    part, place = free(rows, "part"), free(rows, "place")
    schema = rows.withColumn(part, F.lit(0)).withColumn(place, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            starts = np.zeros(size, bool)
            if by:
                group = batch.column(by)
                starts[1:] = np.asarray(pc.not_equal(group[1:], group[:-1]))
                if group[0].as_py() != last:
                    seen = 0
                last = group[-1].as_py()
            at = np.arange(size) + seen
            first = np.maximum.accumulate(np.where(starts, np.arange(size), -1))
            at = np.where(first >= 0, np.arange(size) - first, at)
            seen = int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(size, number, np.int32)), pa.array(at)],
                                             names=[*batch.schema.names, part, place])

    dealt = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), f"{label}-placed")
    group = [by] if by else []
    counts = dealt.groupBy(*group, part).agg((F.max(place) + 1).alias("_rows"))
    before = Window.partitionBy(*group).orderBy(part)  # as many rows as a group has ranges
    counts = counts.select(*group, part, (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"),
                           F.sum("_rows").over(Window.partitionBy(*group)).alias("n"))
    return dealt.join(counts, [*group, part]).select(*rows.columns, (F.col(place) + F.col("_before")).alias("idx"), "n")


def crc32_sql(bytes_list: str) -> str:
    """DuckDB's unsigned crc32 of a list of byte values, by the table of the reflected polynomial; 0 for an empty list."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    ones = "4294967295::BIGINT"
    return (f"xor(list_reduce(list_prepend({ones}, {bytes_list}), lambda a, b: xor(a // 256, {table}[xor(a % 256, b) + 1]::BIGINT)), {ones})")
