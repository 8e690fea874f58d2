"""Embedding near-duplicates by spherical-cap filters of a random product code.

After a random rotation a vector is cut into ``parts`` pieces; each piece has a codebook of ``words`` random unit vectors.
A filter is one codeword of every piece, and a vector belongs to all filters whose direction it exceeds by the cap's
height. Several such codes, each with a rotation of its own, even out how many filters a vector gets. List decoding finds those without trying all words**parts filters: partial sums that can't reach the height any
more are dropped piece by piece. Vectors of one filter are compared in double precision.

Equal vectors are one class, so copies cost one row. A filter with many classes is compared block against block, so a task
holds two blocks at most. A pair that shares several filters counts in the smallest one only. Tasks return each class's
number of links and edges that span what they found linked; pairs are never emitted.

The chance to find a pair depends on its cosine only, not on the table's size; README.md has the measured recall.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with null vec_id, have
no links and are kept; vectors of different length are not compared; repeated rows are vectors of their own (with one
vec_id, one node); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import block_pairs, connected_components, groups_of
from loamline.stage import stage


@dataclass(frozen=True)
class CapRules:
    cosine: float = 0.9
    parts: int = 3
    words: int = 32
    codes: int = 16
    height: float = 3.6
    block: int = 1024
    seed: int = 20


@cache
def codebook(width: int, rules: CapRules, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation, and the codewords of each piece."""
    rng = np.random.default_rng([rules.seed, width, number])
    rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
    pieces = []
    for p in np.array_split(np.arange(width), min(rules.parts, width)):
        c = rng.normal(size=(rules.words, len(p)))
        pieces.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return rotation, pieces


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def filters_of(x: np.ndarray, rules: CapRules) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of the unit vectors ``x``, over all codes, in ascending order."""
    found = [_decode(x, rules, k) for k in range(rules.codes)]
    row, code = np.concatenate([r for r, _ in found]), np.concatenate([c * rules.codes + k for k, (_, c) in enumerate(found)])
    order = np.lexsort((code, row))
    return row[order], code[order]


def _decode(x: np.ndarray, rules: CapRules, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter of one code that is above the cap's height."""
    n, width = x.shape
    rotation, pieces = codebook(width, rules, number)
    turned = x @ rotation
    scores, at = [], 0
    for c in pieces:
        scores.append(turned[:, at: at + c.shape[1]] @ c.T)
        at += c.shape[1]
    # the height is in standard deviations of a random direction's product with a unit vector
    least = rules.height / np.sqrt(width) * np.sqrt(len(pieces))
    rest = np.zeros((len(pieces) + 1, n))
    for p in range(len(pieces) - 1, -1, -1):
        rest[p] = rest[p + 1] + scores[p].max(axis=1)
    row, code, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    for p, s in enumerate(scores):
        rows, codes, totals = [], [], []
        for k in range(0, max(1, len(row)), 20_000):
            r = row[k: k + 20_000]
            t = total[k: k + 20_000, None] + s[r]
            i, j = np.nonzero(t + rest[p + 1][r][:, None] >= least)
            rows.append(r[i])
            codes.append(code[k: k + 20_000][i] * rules.words + j)
            totals.append(t[i, j])
        row, code, total = np.concatenate(rows), np.concatenate(codes), np.concatenate(totals)
    return row, code


def _shared_below(mine: np.ndarray, at: int) -> np.ndarray:
    """Matrix of which rows share a filter below ``at``; ``mine`` has each row's filters, filled up with -1."""
    n = len(mine)
    rows, columns = np.nonzero((mine >= 0) & (mine < at))
    filters, place, count = np.unique(mine[rows, columns], return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    new = np.full(len(filters), -1)
    new[common] = np.arange(len(common))
    place = new[place]
    out = np.zeros((n, n), bool)
    for k in range(0, len(common), 4096):
        on = (place >= k) & (place < k + 4096)
        part = np.zeros((n, min(4096, len(common) - k)), np.float32)
        part[rows[on], place[on] - k] = 1
        out |= part @ part.T > 0
    return out


def links_in(vectors: np.ndarray, counts: np.ndarray, mine: np.ndarray, block: np.ndarray, mixed: bool, at: int, rules: CapRules):
    """Of the rows of one filter: links counted here, and the smallest row each is connected with."""
    n = len(vectors)
    left, right = [], []
    for k in range(0, n, 512):
        i, j = np.nonzero(vectors[k: k + 512] @ vectors.T >= rules.cosine)
        i += k
        on = (i != j) & ((block[i] != block[j]) if mixed else True)
        left.append(i[on])
        right.append(j[on])
    i, j = np.concatenate(left), np.concatenate(right)
    own = ~_shared_below(mine, at)[i, j] if len(i) else np.zeros(0, bool)
    links = np.bincount(i[own], counts[j[own]], n).astype(np.int64)
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        new = new[new]
        if (new == low).all():
            return links, low
        low = new


def near_vectors(embeddings: DataFrame, rules: CapRules = CapRules(), column: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    v = F.col(column).cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    rows = rows.withColumn("code", F.xxhash64("v"))
    kind = "float" if dict(embeddings.dtypes)[column] == "array<float>" else "double"
    classes = rows.where("v is not null").groupBy("code").agg(F.count("*").alias("n"), F.min("vec_id").alias("low_id"), F.first("v").cast(f"array<{kind}>").alias("v"))
    classes = stage(classes, "caps-classes")
    short = np.float32 if kind == "float" else np.float64

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                vectors = part.column("v").to_pylist()
                sizes = np.array([len(x) for x in vectors])
                for width in np.unique(sizes):
                    mine = np.flatnonzero(sizes == width)
                    raw = np.array([vectors[i] for i in mine], np.float64)
                    row, code = filters_of(unit(raw), rules)
                    first = np.searchsorted(row, np.arange(len(mine) + 1))
                    took = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([
                        part.column("code").take(took), part.column("n").take(took), pa.array([int(width)] * len(mine), pa.int32()),
                        pa.array([x.astype(short).tobytes() for x in raw], pa.binary()),
                        pa.array([code[a:b].tolist() for a, b in zip(first[:-1], first[1:])], pa.list_(pa.int64()))],
                        names=["code", "n", "width", "vector", "filters"])

    coded = stage(classes.select("code", "n", "v").mapInArrow(emit, "code long, n long, width int, vector binary, filters array<long>"), "caps-coded")
    sizes = coded.select("width", F.explode("filters").alias("filter")).groupBy("width", "filter").agg(F.count("*").alias("size")).where("size > 1")
    members = coded.withColumn("filter", F.explode("filters")).join(sizes, ["width", "filter"])
    dealt = block_pairs(members, "filter", "code", rules.block)
    keys = ["width", "filter", "low", "high"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, keys, whole=False):
            vectors = unit(np.frombuffer(b"".join(group.column("vector").to_pylist()), short).reshape(group.num_rows, -1).astype(np.float64))
            lists = group.column("filters").to_pylist()
            mine = np.full((len(lists), max(map(len, lists))), -1, np.int64)
            for i, x in enumerate(lists):
                mine[i, : len(x)] = x
            code = np.asarray(group.column("code"))
            at, low, high = (group.column(c)[0].as_py() for c in ("filter", "low", "high"))
            links, least = links_in(vectors, np.asarray(group.column("n")), mine, np.asarray(group.column("block")), low != high, at, rules)
            on = (links > 0) | (least != np.arange(len(code)))
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(code[on]), pa.array(links[on]), pa.array(code[least][on])], names=["code", "links", "other"])

    dealt = dealt.select(*keys, "block", "code", "n", "vector", "filters").repartition(*keys).sortWithinPartitions(*keys)
    found = stage(dealt.mapInArrow(meet, "code long, links long, other long"), "caps-found")
    links = found.groupBy("code").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("code").alias("a"), F.col("other").alias("b")), "caps").withColumnRenamed("id", "code")
    named = classes.select("code", "n", "low_id").join(links, "code", "left").join(parts, "code", "left").withColumn("component", F.coalesce("component", "code"))
    lowest = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    named = named.join(lowest, "component").select("code", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("code")).alias("code")).join(named, "code", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
