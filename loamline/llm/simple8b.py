"""Simple-8b word-aligned coding of token ids in blocks.

A 64-bit word holds a selector in its upper 4 bits and, in the lower 60, as many ids of one width as fit. Ids too wide
for the narrow layouts take an escape word of one id. Words of equal selector are coded and decoded together with
numpy; the counts of a block's words, added up, say where each word's ids go.

A block is a self-contained byte string: header (magic, documents, ids, words), the documents' ids and first positions
in the block, then the words. Blocks are rows of a Parquet table, in ascending doc_id order inside each part; ``offsets``
has every block's first position in the whole output, so any block can be read on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm.common import docs_of, texts_of
from loamline.llm.tokens import encoder

#: (ids a word, bits an id) by selector. Selector 15 is the escape: one id of up to 60 bits.
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
MAGIC = 0x53384231
_STEPS = np.zeros(16, np.int64)
_STEPS[: len(LAYOUTS)] = [n for n, _ in LAYOUTS]
_STEPS[ESCAPE] = 1


def encode(ids: np.ndarray) -> np.ndarray:
    """64-bit words of the ids (unsigned, below 2**60)."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    best = np.full(n, ESCAPE, np.int64)
    for selector in range(len(LAYOUTS) - 1, -1, -1):
        count, bits = LAYOUTS[selector]
        if n < count:
            continue
        wide = np.concatenate(([0], np.cumsum(ids >= np.uint64(1 << bits))))
        best[: n - count + 1][wide[count:] == wide[: n - count + 1]] = selector
    steps = _STEPS[best].tolist()
    starts, p = [], 0
    while p < n:
        starts.append(p)
        p += steps[p]
    at = np.array(starts, np.int64)
    chosen = best[at] if n else at
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        count, bits = LAYOUTS[selector] if selector != ESCAPE else (1, 60)
        for k in range(count):
            words[mine] |= ids[at[mine] + k] << np.uint64(k * bits)
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of the words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _STEPS[chosen]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        count, bits = LAYOUTS[selector] if selector != ESCAPE else (1, 60)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[ends[mine] - count + k] = (words[mine] >> np.uint64(k * bits)) & mask
    return out


def pack_block(docs: list[int | None], ids: list[bytes]) -> bytes:
    words = encode(np.frombuffer(b"".join(ids), "<u4"))
    firsts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
    header = np.array([MAGIC, len(docs), firsts[-1], len(words)], "<i8")
    known = np.array([d is not None for d in docs], "<i8")
    return b"".join((header.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), known.tobytes(),
                     firsts.astype("<i8").tobytes(), words.astype("<u8").tobytes()))


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, the first position of each (and the end), and the ids of a block."""
    magic, n, total, words = (int(x) for x in np.frombuffer(block, "<i8", 4))
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    docs = np.frombuffer(block, "<i8", n, 32)
    known = np.frombuffer(block, "<i8", n, 32 + 8 * n)
    firsts = np.frombuffer(block, "<i8", n + 1, 32 + 16 * n)
    ids = decode(np.frombuffer(block, "<u8", words, 32 + 8 * (3 * n + 1)))
    if len(ids) != total:
        raise ValueError("a block of token ids is damaged")
    return [int(d) if k else None for d, k in zip(docs, known)], firsts, ids.astype("<u4")


def write_token_blocks(docs: DataFrame, folder: str, path: str, blanks: str = "dropped", end_id: int = 1, block_ids: int = 1 << 18) -> None:
    """Encode whole texts, and write their ids to ``folder`` in ascending doc_id order.

    The ids, not the texts, are moved to their place: ranges of doc_id, cut at its quantiles, so a range needs no more
    than one block in memory and texts are encoded once. Defined cases: null text is empty and yields the end id alone; a
    repeated row is a document of its own, ordered by its ids; rows with null doc_id come first; other columns are ignored.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 100 * ranges)).first()[0] if shares else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, blanks)
        end = np.array([end_id], "<u4").tobytes()
        for part, texts in texts_of(batches):
            doc = part.column("doc_id")
            place = np.where(np.asarray(doc.is_null()), 0, np.searchsorted(cuts, np.asarray(doc.fill_null(0)), "right"))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), doc, pa.array([_narrow(x + end) for x in enc.encode(texts)], pa.binary())],
                                             names=["part", "doc_id", "coded"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, size = None, 0, 0, 0
        docs, ids = [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()),
                pa.array([pack_block(docs, ids)], pa.binary())], names=["part", "block", "part_start", "n_ids", "data"])

        for batch in batches:
            for mine, doc, coded in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "coded"))):
                if docs and (mine != part or size >= block_ids):
                    yield row()
                    number, start, size = number + 1, start + size, 0
                    docs, ids = [], []
                if mine != part:
                    part, number, start = mine, 0, 0
                docs.append(doc)
                ids.append(_widen(coded))
                size += len(ids[-1]) // 4
        if docs:
            yield row()

    coded = docs_of(docs).mapInArrow(code, "part long, doc_id long, coded binary")
    dealt = coded.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "coded")
    dealt.mapInArrow(block, "part long, block long, part_start long, n_ids long, data binary").write.parquet(folder)


def _narrow(ids: bytes) -> bytes:
    """The ids as two bytes each where all fit, behind a byte that says so."""
    x = np.frombuffer(ids, "<u4")
    return b"\2" + x.astype("<u2").tobytes() if x.max(initial=0) < 1 << 16 else b"\4" + ids


def _widen(coded: bytes) -> bytes:
    return np.frombuffer(coded, "<u2", offset=1).astype("<u4").tobytes() if coded[0] == 2 else coded[1:]


def offsets(blocks: DataFrame) -> DataFrame:
    """The blocks with ``first``, the number of ids before each in the whole output. Parts are at most as many as shuffle
    partitions, so the one ordered sum runs over a few rows, and the frame that is broadcast is as small."""
    parts = blocks.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(parts), "part").withColumn("first", F.col("before") + F.col("part_start"))


def read_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("data")):
                docs, firsts, ids = unpack_block(data.as_py())
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(firsts[:-1] + first, pa.int64()),
                                                  pa.array(np.diff(firsts), pa.int64()), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(folder)
    return offsets(blocks).select("first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
