"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.stage import stage

#: Bytes of text that a Python task looks at together.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(df: DataFrame) -> DataFrame:
    """The two columns most operators read, under fixed types; other columns are not carried along."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts_of(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of at most about SLICE_BYTES of text, with their texts (null: empty)."""
    for batch in batches:
        for part in slices(batch, column):
            yield part, [t or "" for t in part.column(column).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_table(word_bytes: bytes, lower: bool = True) -> bytes:
    """Translation table for UTF-8 bytes: separators become a space, ``word_bytes`` stay, A-Z become lower case."""
    keep = set(word_bytes)
    out = bytearray(b if b in keep else 32 for b in range(256))
    if lower:
        for b in range(65, 91):
            out[b] = b + 32
    return bytes(out)


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for every id that has an edge.

    Alternating large-star and small-star rounds: each round hooks neighbours to the smallest neighbour, so a chain
    of n links needs about log n rounds. Links stay in tables; the driver sees one row of counts a round. A hub's
    smallest neighbour is a partial aggregate, and the join with it is left to the skew handling of the planner.
    """
    spark = edges.sparkSession
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                f"{label}-links")
    last = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v"))
        cur = stage(small.where("u <> v").distinct(), f"{label}-links")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    stars = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.union(roots)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], whole: bool = True, rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition in batches that never split a group of equal keys. ``whole``: many groups a batch,
    at least about ``rows`` rows; else one group a batch."""
    held: list[pa.RecordBatch] = []
    count = 0

    def merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = np.asarray(batch.column(k))
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if whole and count < rows:
            continue
        one = merged(held)
        cuts = changes(one)
        if not len(cuts):
            held = [one]
            continue
        if whole:
            yield one.slice(0, int(cuts[-1]))
        else:
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield one.slice(a, b - a)
        held = [one.slice(int(cuts[-1]))]
        count = held[0].num_rows
    if held:
        one = merged(held)
        if whole:
            yield one
        else:
            cuts = [0, *changes(one).tolist(), one.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield one.slice(a, b - a)


def block_pairs(rows: DataFrame, key: str, id: str, block: int) -> DataFrame:
    """Rows of groups (with their ``size``) repeated for every pair of blocks they take part in.

    A group of up to ``block`` rows is one block. A larger one is dealt over size / block blocks, and each pair of them
    becomes a group (key, low, high) of its own of about twice ``block`` rows: any two rows meet in some group, and no
    task ever holds a whole large group.
    """
    n = F.ceil(F.col("size") / block).cast("int")
    dealt = rows.withColumn("_n", n).withColumn("block", F.pmod(F.xxhash64(id), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_n", "_other", "size")
