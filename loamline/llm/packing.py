"""Cost-balanced packing of tokenised documents into training sequences.

Tasks tokenise their documents and pack them in chunks of bounded size, without any shuffle. In a chunk, whole
sequences are first cut off long documents. The rest is placed in descending order, each document into the sequence of
the lowest estimated attention cost (linear plus quadratic in the length) that still has room for it; what fits nowhere
is cut over the room left. The sequences' capacities add up to the chunk's tokens: full ones, and powers of two for
the remainder, which need no padding.

Defined cases: null text is empty and yields the end id alone; a repeated row is a document of its own; a null doc_id
stays null; other columns are ignored; an empty table gives an empty table. A sequence_id holds the partition's number
in its upper bits, so it is unique in the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loamline.llm.common import docs_of, texts_of
from loamline.llm.tokens import encoder

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


@dataclass(frozen=True)
class PackRules:
    length: int = 2048
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    end_id: int = 1
    chunk_docs: int = 4096
    chunk_tokens: int = 4_000_000


def pack(sizes: list[int], rules: PackRules = PackRules()) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents and sequences are numbered from 0."""
    top = rules.length
    out = []
    used = 0
    rests = []
    for d, n in enumerate(sizes):
        for k in range(n // top):
            out.append((d, k * top, top, used, 0))
            used += 1
        if n % top:
            rests.append((n % top, d, n - n % top))
    rests.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rests)
    rest = total % top
    room = np.array([top] * (total // top) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)
    held = np.zeros(len(room), dtype=np.int64)
    cost = np.zeros(len(room))

    def place(s: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, used + s, int(held[s])))
        held[s] += n
        room[s] -= n
        cost[s] += rules.linear * n + rules.quadratic * n * n

    cut = []
    for n, d, start in rests:
        s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[s] >= n:
            place(s, d, start, n)
        else:
            cut.append((n, d, start))
    for n, d, start in cut:
        while n:
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
            k = int(min(n, room[s]))
            place(s, d, start, k)
            start, n = start + k, n - k
    return out


def pack_documents(docs: DataFrame, path: str, blanks: str = "joined", rules: PackRules = PackRules()) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence, with a checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, blanks)
        end = np.array([rules.end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, tokens
            pieces = pack([len(ids) // 4 for _, ids in held], rules)
            sizes = np.bincount([p[3] for p in pieces], weights=[p[2] for p in pieces]).astype(np.int64)
            rows = [(held[d][0], start, n, zlib.crc32(held[d][1][4 * start: 4 * (start + n)]), len(held[d][1]) // 4, base + s, offset,
                     int(sizes[s])) for d, start, n, s, offset in pieces]
            base, tokens = base + len(sizes), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=_NAMES)

        for part, texts in texts_of(batches):
            for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                held.append((doc, ids + end))
                tokens += len(ids) // 4 + 1
                if len(held) >= rules.chunk_docs or tokens >= rules.chunk_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs_of(docs).mapInArrow(run, PIECES)
