"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. ``word_vectors`` reads the whole corpus. Every word (hashed to a bucket) owns a sparse random index vector; a bucket's
   word vector is the sum of the index vectors of its neighbours. Sums are integers, so the result doesn't depend on
   the order of tasks. The table's size is fixed by parameters, not by the corpus.
2. ``features`` pools a document's unit word vectors: mean, mean square, and mean product of adjacent words, frequent
   words weighing less.
3. ``train`` fits a network with one hidden layer on at most ``max_labels`` labelled documents (those of the smallest
   hash of doc_id), and fits a temperature on a part kept out of the fit, so that scores are calibrated.

Defined cases: null and empty texts have no words, pool to zeros and get the score of zeros; labels that are null or
neither 0 nor 1 are not learned; with no label, or labels of one class, the score is that class's share (0.5 without any);
repeated rows are scored one by one; a null doc_id counts as not held out; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.bytetext import Hashes, joined
from loamline.llm.common import mix64, slices

#: Byte classes: blank, letter (any byte beyond ASCII too), digit, other.
_CLASS = np.array([0 if b <= 32 else 1 if chr(b).isalpha() or b >= 128 else 2 if 48 <= b < 58 else 3 for b in range(256)], np.int8)


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 14
    width: int = 32
    entries: int = 2
    reach: int = 2
    hidden: int = 24
    epochs: int = 40
    max_labels: int = 20_000
    threshold: float = 0.3
    rare: float = 1e-3
    slice_bytes: int = 1 << 20


def index_vectors(rules: QualityRules) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of the entries of each bucket's index vector."""
    x = mix64(np.arange(rules.buckets * rules.entries, dtype=np.uint64) + np.uint64(1)).reshape(rules.buckets, rules.entries)
    return (x % np.uint64(rules.width)).astype(np.int64), np.where(x >> np.uint64(63), 1, -1).astype(np.int64)


def tokens(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document number of every token: runs of letters, of digits and of other marks."""
    data, offsets = joined(column)
    kind = _CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    if len(edges) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    ids = (Hashes(data).of(starts, ends) % np.uint64(buckets)).astype(np.int64)
    return ids, np.searchsorted(offsets, starts, "right") - 1


def word_vectors(docs: DataFrame, rules: QualityRules = QualityRules()) -> tuple[np.ndarray, np.ndarray]:
    """(unit word vectors, weights) by bucket, from all documents. Tasks add up their own counts; only tables of the
    fixed size are shuffled and returned."""
    cells, rows = rules.buckets * rules.width, 64
    each = rules.buckets // rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(rules)
        total = np.zeros(cells, np.int64)
        seen = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for part in slices(batch, limit=rules.slice_bytes):
                ids, doc = tokens(part.column("text"), rules.buckets)
                seen += np.bincount(ids, minlength=rules.buckets)
                for far in range(1, rules.reach + 1):
                    same = np.flatnonzero(doc[far:] == doc[:-far])
                    left, right = ids[same], ids[same + far]
                    for a, b in ((left, right), (right, left)):
                        for e in range(rules.entries):
                            total += np.bincount(a * rules.width + place[b, e], sign[b, e], cells).astype(np.int64)
        if seen.any():
            table = total.reshape(rows, -1)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(rows), pa.int64()), pa.array([x.tobytes() for x in table], pa.binary()),
                pa.array([x.tobytes() for x in seen.reshape(rows, -1)], pa.binary())], names=["block", "sums", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "sums", "seen"))):
                got = found.setdefault(k, [np.zeros(each * rules.width, np.int64), np.zeros(each, np.int64)])
                got[0] += np.frombuffer(a, np.int64)
                got[1] += np.frombuffer(b, np.int64)
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.int64()), pa.array([a.tobytes() for a, _ in found.values()], pa.binary()),
                pa.array([b.tobytes() for _, b in found.values()], pa.binary())], names=["block", "sums", "seen"])

    kind = "block long, sums binary, seen binary"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, kind)
    total, seen = np.zeros((rows, each * rules.width)), np.zeros((rows, each))
    for r in parts.repartition(rows, "block").mapInArrow(add, kind).collect():
        total[r["block"]] += np.frombuffer(r["sums"], np.int64)
        seen[r["block"]] += np.frombuffer(r["seen"], np.int64)
    table = total.reshape(rules.buckets, rules.width)
    table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    share = seen.reshape(-1) / max(seen.sum(), 1)
    return table.astype(np.float32), (rules.rare / (rules.rare + share)).astype(np.float32)


def features(column: pa.Array, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    ids, doc = tokens(column, len(vectors))
    n, d = len(column), vectors.shape[1]
    out = np.zeros((n, 3 * d + 2), np.float64)
    if not len(ids):
        return out
    present, first = np.unique(doc, return_index=True)
    w = weights[ids][:, None]
    v = vectors[ids]
    mass = np.maximum(np.add.reduceat(w, first), 1e-9)
    out[present, :d] = np.add.reduceat(v * w, first) / mass
    out[present, d: 2 * d] = np.add.reduceat(v * v * w, first) / mass
    near = np.zeros_like(v)
    near[1:] = v[1:] * v[:-1] * (doc[1:] == doc[:-1])[:, None]
    count = np.diff(np.append(first, len(ids)))
    out[present, 2 * d: 3 * d] = np.add.reduceat(near, first) / count[:, None]
    out[present, 3 * d] = out[present, 2 * d: 3 * d].sum(axis=1)
    out[present, 3 * d + 1] = np.log1p(count)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, rules: QualityRules = QualityRules()) -> Network:
    """Adam on the logistic loss; a sixth of the rows sets the temperature."""
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(7)
    kept = np.arange(len(y)) % 6 != 5
    fit = np.flatnonzero(kept)
    centre, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    p = [rng.normal(0, 1 / np.sqrt(d), (d, rules.hidden)), np.zeros(rules.hidden), rng.normal(0, 0.2, rules.hidden), np.zeros(1)]
    z = np.clip((x - centre) / scale, -8, 8)
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for epoch in range(rules.epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / rules.epochs))
        order = rng.permutation(fit)
        for k in range(0, len(order), 128):
            i = order[k: k + 128]
            h = np.tanh(z[i] @ p[0] + p[1])
            e = (_sigmoid(h @ p[2] + p[3][0]) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            t += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))
    out = np.flatnonzero(~kept)
    if len(out):
        raw, best = net.logit(x[out]), np.inf
        for temperature in np.geomspace(0.25, 8, 61):
            q = np.clip(_sigmoid(raw / temperature), 1e-9, 1 - 1e-9)
            loss = -(y[out] * np.log(q) + (1 - y[out]) * np.log(1 - q)).mean()
            if loss < best:
                best, net.temperature = loss, float(temperature)
    return net


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> tuple[np.ndarray, np.ndarray, Network]:
    """Word vectors of all ``docs``, and the network fitted on the labelled documents that aren't held out."""
    vectors, weights = word_vectors(docs, rules)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.max_labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=rules.slice_bytes):
                rows = features(part.column("text"), vectors, weights).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([r.tobytes() for r in rows], pa.binary())],
                                                 names=["doc_id", "quality", "x"])

    pairs = texts.join(F.broadcast(sample), "doc_id").mapInArrow(run, "doc_id long, quality int, x binary")
    rows = sorted(pairs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.max_labels).collect(), key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(len(rows), 3 * rules.width + 2)
    return vectors, weights, train(x, np.array([r["quality"] for r in rows], float), rules)


def _scored(docs: DataFrame, model: tuple, rules: QualityRules, schema, keep: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weights, net = shared.value
        for batch in batches:
            for part in slices(batch, limit=rules.slice_bytes):
                score = net.score(features(part.column("text"), vectors, weights))
                if keep:
                    yield part.filter(pa.array(score >= rules.threshold))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= rules.threshold).astype(np.int32))],
                        names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    model = fit(docs, labels, rules)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return _scored(read, model, rules, "doc_id long, held_out boolean, score double, predicted int", keep=False)


def keep_good(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier doesn't reject."""
    return _scored(docs, fit(docs, labels, rules), rules, T.StructType(docs.schema.fields), keep=True)
