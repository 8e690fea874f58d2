"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct 2-word shingles. Two small collections of ``parts`` partial signatures, each of
``rows`` minhashes, are combined pairwise: parts**2 tables, keyed by one partial signature of either collection, from
2 * parts * rows minhashes. Two documents of similarity s share a table with probability (1 - (1 - s**rows)**parts)**2:
0.99996 at 0.8 with the default numbers, and more above.

1. One scan gives every row its set size, a 128-bit digest of the set, and its signature. Rows of equal sets become one
   class, so copies, however many, cost one row from here on.
2. Classes meet by key. A key frequent in one batch of a task is paired off there and moves one row a batch. Small groups give all their pairs; large ones give each member's pairs with the first and the preceding member.
3. Pairs are confirmed on full sets, in the order that saves most work: each class's most frequent partner first;
   then only pairs of classes not yet connected, and of those only such whose signatures agree enough (eight standard
   deviations below the limit).
4. Components that still meet in large groups form families, which are compared in full, block against block, by
   signature and then by set, so no link between classes that share a key is lost.

Defined cases: null, empty and blank texts have an empty set, no links and are kept; a text of one word has that word as
its shingle; repeated rows are linked by their equal sets; rows that share a doc_id are one node; a null doc_id has a null
component and is kept; other columns are ignored by ``near_duplicates`` and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.bytetext import Hashes, joined
from loamline.llm.common import block_pairs, connected_components, docs_of, free, groups_of, mix64, slices
from loamline.stage import stage

_SEPARATORS = (9, 10, 11, 12, 13, 32)
_SPLIT = np.array([b in _SEPARATORS for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class NearDupRules:
    shingle: int = 2
    percent: int = 80
    parts: int = 15
    rows: int = 3
    all_pairs: int = 32
    bits: int = 1 << 22

    @property
    def hashes(self) -> int:
        return 2 * self.parts * self.rows

    @property
    def floor(self) -> float:
        """Share of equal minhashes below which a pair can't be linked, by eight standard deviations."""
        s = self.percent / 100
        return s - 8 * (s * (1 - s) / self.hashes) ** 0.5


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Per row, the sorted hashes of its distinct shingles."""
    data, offsets = joined(column)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    blank = _SPLIT[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    word = ~blank[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    h = Hashes(data).of(starts, ends)
    first = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        k = min(size, n)
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        key = h[a: b - k + 1].copy()
        for j in range(1, k):
            key = mix64(key) * np.uint64(0x9E3779B97F4A7C15) + h[a + j: b - k + 1 + j]
        out.append(np.unique(mix64(key + np.uint64(k))))
    return out


def signature(s: np.ndarray, hashes: int) -> np.ndarray:
    a, b = _family(hashes)
    best = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), 8192):
        x = s[k: k + 8192]
        np.minimum(best, ((a[:, None] * x[None, :] + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=best)
    return best


def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(2 * hashes, dtype=np.uint64) + np.uint64(17))
    return x[:hashes] | np.uint64(1), x[hashes:]


def table_keys(sigs: np.ndarray, rules: NearDupRules) -> np.ndarray:
    """Keys of all tables, (documents x parts**2), from the two collections of partial signatures."""
    parts = np.zeros((len(sigs), 2 * rules.parts), np.uint64)
    for p in range(2 * rules.parts):
        for r in range(rules.rows):
            parts[:, p] = mix64(parts[:, p] + sigs[:, p * rules.rows + r] + np.uint64(p + 1))
    left, right = parts[:, : rules.parts], parts[:, rules.parts:]
    return mix64(left[:, :, None] + mix64(right)[:, None, :]).reshape(len(sigs), -1)


def _sigs(batch: pa.RecordBatch, column: str, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "<u4").reshape(batch.num_rows, hashes)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def scan(docs: DataFrame, rules: NearDupRules) -> DataFrame:
    """Per row: doc_id, n_shingles, set digest (s1, s2), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                sets = shingle_sets(part.column("text"), rules.shingle)
                s1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
                s2 = np.array([mix64(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), _long(s1), _long(s2),
                    pa.array([signature(x, rules.hashes).tobytes() if len(x) else None for x in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs_of(docs).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _pairs_of(ids: np.ndarray, keys: np.ndarray, all_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs from rows sorted by (key, id), and where each key's rows start and how many they are."""
    if not len(keys):
        return ids, ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    a, b = [], []
    place = np.arange(len(keys)) - np.repeat(first, size)
    many = np.repeat(size, size)
    for step in range(1, min(all_pairs, int(size.max(initial=1)))):
        on = np.flatnonzero((place >= step) & (many <= all_pairs))
        a.append(ids[on - step])
        b.append(ids[on])
    large = np.flatnonzero((many > all_pairs) & (place > 0))
    a += [ids[large - 1], ids[large - place[large]]]
    b += [ids[large], ids[large]]
    return np.concatenate(a), np.concatenate(b), first, size


def candidates(classes: DataFrame, rules: NearDupRules) -> DataFrame:
    """(a, b, key): pairs a < b with null key, and large groups as (null, null, key)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids = np.asarray(part.column("id"))
                keys = table_keys(_sigs(part, "sig", rules.hashes), rules)
                ids = np.repeat(ids, keys.shape[1])
                keys = keys.reshape(-1)
                order = np.lexsort((ids, keys))
                ids, keys = ids[order], keys[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                size = np.diff(np.append(first, len(keys)))
                many = np.repeat(size > rules.all_pairs, size)
                a, b, heads, _ = _pairs_of(ids[many], keys[many], rules.all_pairs)
                pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
                lead_keys = np.concatenate((keys[~many], keys[many][heads]))
                leads = np.concatenate((ids[~many], ids[many][heads]))
                large = keys[many][heads]
                none = pa.nulls(len(large), pa.int64())
                yield pa.RecordBatch.from_arrays([_long(lead_keys), pa.array(leads), pa.nulls(len(leads), pa.int64())], names=["key", "a", "b"])
                yield pa.RecordBatch.from_arrays([_long(mix64(pairs[0].view(np.uint64))), pa.array(pairs[0]), pa.array(pairs[1])], names=["key", "a", "b"])
                yield pa.RecordBatch.from_arrays([_long(large), none, none], names=["key", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["key"]):
            key, a, b = (np.asarray(group.column(c).fill_null(-1)) for c in ("key", "a", "b"))
            no_a, no_b = (np.asarray(group.column(c).is_null()) for c in ("a", "b"))
            lead = np.flatnonzero(no_b & ~no_a)
            local = np.flatnonzero(~no_b)
            large = key[no_a]
            x, y = a[local], b[local]
            if len(lead):
                p, q, first, size = _pairs_of(a[lead], key[lead], rules.all_pairs)
                x, y = np.concatenate((x, p)), np.concatenate((y, q))
                large = np.concatenate((large, key[lead][first[size > rules.all_pairs]]))
            on = x != y
            pairs, n = np.unique(np.stack([x[on], y[on]]), axis=1, return_counts=True) if on.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            large = np.unique(large)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((pairs[0], np.zeros(len(large), np.int64)))), pa.array(np.concatenate((pairs[1], np.zeros(len(large), np.int64)))),
                pa.array(np.concatenate((n, np.zeros(len(large), np.int64)))), pa.array(np.concatenate((np.zeros(len(pairs[0]), np.int64), large)))],
                names=["a", "b", "n", "key"])

    met = classes.select("id", "sig").mapInArrow(emit, "key long, a long, b long")
    met = met.repartition("key").sortWithinPartitions("key", "a", "b").mapInArrow(meet, "a long, b long, n long, key long")
    return met


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(docs: DataFrame, ids: DataFrame, rules: NearDupRules) -> DataFrame:
    """(id, set) of the documents in ``ids``, as sorted hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in shingle_sets(part.column("text"), rules.shingle)], pa.binary())],
                                                 names=["id", "set"])

    return docs_of(docs).join(ids, "doc_id", "left_semi").mapInArrow(sets, "id long, set binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, rules: NearDupRules) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), rules.percent)
                    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    found = stage(_sets(docs, ends, rules), "near-sets")
    both = pairs.select("a", "b").join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b")
    return both.mapInArrow(confirm, "a long, b long").distinct()


def _labelled(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs with the components of both ends."""
    left, right = parts.toDF("a", "ca"), parts.toDF("b", "cb")
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))


def near_duplicates(docs: DataFrame, rules: NearDupRules = NearDupRules()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows = stage(scan(docs, rules), "near-scan")
    classes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    classes = stage(classes.where("id is not null"), "near-classes")
    met = stage(candidates(classes, rules), "near-met")
    pairs = stage(met.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n")), "near-pairs")
    large = met.where("n = 0").select("key").distinct()

    def ends(p: DataFrame) -> DataFrame:
        return p.select(F.col("a").alias("id"), F.struct("n", F.col("b").alias("o"), F.lit(True).alias("first")).alias("x")).union(
            p.select(F.col("b").alias("id"), F.struct("n", F.col("a").alias("o"), F.lit(False).alias("first")).alias("x")))

    best = ends(pairs).groupBy("id").agg(F.max("x").alias("x"))
    best = best.select(F.least("id", "x.o").alias("a"), F.greatest("id", "x.o").alias("b")).distinct()
    links = stage(_confirmed(best, docs, rules), "near-links")
    parts = connected_components(links, "near")
    rest = _labelled(pairs, parts).where("ca <> cb").select("a", "b")
    parts = _joined(parts, stage(_confirmed(_similar(rest, classes, rules), docs, rules), "near-links"))
    parts = _joined(parts, _across(docs, classes, large, parts, rules))
    named = classes.select("s1", "s2", "id").join(parts, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _agree(rules: NearDupRules, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1) >= rules.floor


def _similar(pairs: DataFrame, classes: DataFrame, rules: NearDupRules) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _agree(rules, _sigs(batch, "sig", rules.hashes), _sigs(batch, "sig_b", rules.hashes))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    a = classes.select(F.col("id").alias("a"), "size", "sig")
    b = classes.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("size", "size_b") >= rules.percent * F.greatest("size", "size_b"))
    return stage(sized.select("a", "b", "sig", "sig_b").mapInArrow(run, "a long, b long").distinct(), "near-similar")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links (few, or none)."""
    between = stage(_labelled(links, parts).where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "near-between")
    if between.isEmpty():
        return parts
    new = connected_components(between, "near-between")
    moved = parts.join(new.toDF("component", "low"), "component", "left").select("id", F.coalesce("low", "component").alias("component"))
    return stage(moved.unionByName(new.join(parts, "id", "left_anti")), "near-parts")


def _across(docs: DataFrame, classes: DataFrame, large: DataFrame, parts: DataFrame, rules: NearDupRules) -> DataFrame:
    """Links between components that meet in a large group.

    Components that share large keys form a family. Its members are compared block against block, with their
    signatures and full sets at hand; a task returns only links that join what it hasn't joined yet.
    """
    bits = rules.bits
    cells = large.groupBy(F.shiftrightunsigned("key", 42).alias("bit")).agg(F.lit(1).alias("one"))
    words = cells.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    cells = words.toArrow()  # at most bits / 64 rows
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[np.asarray(cells.column("cell"))] = np.asarray(cells.column("word"))
    bitmap = bitmap.view(np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                keys = table_keys(_sigs(part, "sig", rules.hashes), rules)
                bit = keys >> np.uint64(42)
                doc, col = np.nonzero(bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                met = np.unique(np.stack([keys[doc, col].view(np.int64), np.asarray(part.column("component"))[doc]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(met[0]), pa.array(met[1])], names=["key", "component"])

    labelled = classes.select("id", "sig").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    met = stage(labelled.select("sig", "component").mapInArrow(emit, "key long, component long").join(large, "key", "left_semi"), "near-met")
    lows = met.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    edges = stage(met.join(lows.select("key", "low"), "key").where("component <> low").select(F.col("component").alias("a"), F.col("low").alias("b")).distinct(), "near-meeting")
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    if edges.isEmpty():
        return none
    families = connected_components(edges, "near-families").toDF("component", "family")
    members = stage(labelled.select("id", "component").join(families, "component"), "near-members")
    found = stage(_sets(docs, members.select(F.col("id").alias("doc_id")), rules), "near-sets")
    sized = members.join(members.groupBy("family").agg(F.count("*").alias("size")), "family")
    blocks = block_pairs(sized, "family", "id", 512).join(classes.select("id", "sig"), "id").join(found, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["family", "low", "high"], whole=False):
            ids, block, sig = np.asarray(group.column("id")), np.asarray(group.column("block")), _sigs(group, "sig", rules.hashes)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            label = np.unique(np.asarray(group.column("component")), return_inverse=True)[1]
            mixed = group.column("low")[0].as_py() != group.column("high")[0].as_py()
            a, b = [], []
            for i in range(len(ids)):
                fits = rules.percent * np.maximum(sizes, sizes[i]) <= 100 * np.minimum(sizes, sizes[i])
                other = np.flatnonzero((label != label[i]) & fits & ((block != block[i]) | (not mixed)))
                share = (sig[other] == sig[i]).mean(axis=1)
                for j in other[np.argsort(-share, kind="stable")[: int((share >= rules.floor).sum())]].tolist():
                    if label[j] != label[i] and _linked(sets[i], sets[j], rules.percent):
                        a.append(min(ids[i], ids[j]))
                        b.append(max(ids[i], ids[j]))
                        label[label == label[j]] = label[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ["family", "low", "high", "block", "id", "component", "sig", "set"]
    dealt = blocks.select(*columns).repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    return stage(dealt.mapInArrow(run, "a long, b long").distinct(), "near-across")


def keep_one(docs: DataFrame, rules: NearDupRules = NearDupRules()) -> DataFrame:
    """``docs`` with one document of each component, and every document without links."""
    name = free(docs, "_near_gone")
    gone = near_duplicates(docs, rules).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def near_dup_sql(percent: int = 80) -> str:
    """DuckDB SQL for ``near_duplicates`` over the documents table, by exact prefix filtering."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT sh, count(*) AS df FROM s GROUP BY sh),
r AS (SELECT doc_id, sh, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, sh) AS k FROM s JOIN f USING (sh) JOIN n USING (doc_id)),
p AS (SELECT doc_id, sh FROM r WHERE k <= n - ({percent} * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.sh = b.sh AND a.doc_id < b.doc_id),
i AS (SELECT a, b, count(*) AS inter FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= {percent} * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
m AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
