"""Benchmark decontamination by suffix arrays over the training text.

Each task takes a shard of whole documents as numbers of benchmark words (other words are one foreign number) and sorts
the suffixes that could start a match. Every benchmark suffix is then binary-searched in the shard's array, one word
deeper each step, which gives all places where its window occurs verbatim. Places that continue each other in document and
item are one match, so the longest verbatim match of every item and where it lies are known.

The benchmark comes in blocks of bounded size. The driver and the tasks hold one block at a time, each block is one pass
over the documents, and a pass writes the rows it hits, which are put together by row number: texts are not shuffled, and
the benchmark may have any size. A benchmark of one block is searched in a single pass that writes nothing.

Words: A-Z lower-cased, runs of digits, a-z and characters outside ASCII. A window: ``window`` consecutive words of an
item; an item of fewer, but not none, is one window.

Defined cases: null text has no words; a null item_id marks hits but isn't listed; items that share an id count once;
repeated document rows are judged one by one; other columns are ignored by ``contamination`` and kept by
``decontaminate``; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.common import docs_of, free, texts_of, words_table
from loamline.stage import stage

WORD_BYTES = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)) + bytes(range(65, 91))
#: Bytes of benchmark text that one pass holds in each task. A task takes about 60 times as much while it numbers the windows.
BLOCK_BYTES = 4 << 20
#: Pairs of places in a document and in items that are looked at together.
PAIRS = 1 << 20
_WORDS = words_table(WORD_BYTES)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The items (item_id as text, text, block) and the number of blocks of about ``block_bytes``; repeated rows count once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null").distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1))).cast("int"))
    return (stage(items.repartition("block"), "leaks-items") if n > 1 else items), n


class Windows:
    """The benchmark suffixes of one block: word numbers of each different window, and where it lies in which items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        rows, item, place = [np.zeros((0, window), np.int32)], [], []
        for i, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            n = max(len(ids) - window + 1, min(len(ids), 1))
            if n:
                ids = np.pad(ids, (0, max(window - len(ids), 0)))
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                item.append(np.full(n, i))
                place.append(np.arange(n))
        self.words, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        self.item, self.place = (np.concatenate([np.zeros(0, np.int64), *x])[order] for x in (item, place))
        #: The window's entries in ``item`` and ``place``.
        self.first = np.searchsorted(which[order], np.arange(len(self.words) + 1))
        self.sizes = (self.words > 0).sum(axis=1)
        self.least = int(self.sizes.min()) if len(self.sizes) else 0

    def longest(self, places: np.ndarray, which: np.ndarray) -> dict[str, tuple[int, int, int]]:
        """Of one document's places, in order: per item the longest match as words, start in the document, start in the item."""
        best: dict[str, tuple[int, int, int]] = {}
        counts = self.first[which + 1] - self.first[which]
        before = np.cumsum(counts) - counts
        heads = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        going = np.zeros((3, 0), np.int64)  # item, diagonal and start of the matches that reach the last place
        a = 0
        while a < len(places):
            b = heads[max(np.searchsorted(before[heads], before[a] + PAIRS, "right") - 1, np.searchsorted(heads, a, "right")):][:1]
            b = int(b[0]) if len(b) and b[0] > a else len(places)
            n = counts[a:b]
            at = np.repeat(self.first[which[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start, item = np.repeat(places[a:b], n), self.item[at]
            diagonal = start - self.place[at]
            order = np.lexsort((start, diagonal, item))
            start, item, diagonal, size = start[order], item[order], diagonal[order], np.repeat(self.sizes[which[a:b]], n)[order]
            new = np.ones(len(start), bool)
            new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + 1)
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(start)) - 1
            opened = start[head].copy()
            carried = {(i, d): s for i, d, s in going.T.tolist()} if a and places[a] == places[a - 1] + 1 else {}
            if carried:
                for k in np.flatnonzero(opened == places[a]).tolist():
                    opened[k] = carried.get((int(item[head[k]]), int(diagonal[head[k]])), opened[k])
            words = start[last] - opened + size[last]
            for i, w, p, d in zip(item[head].tolist(), words.tolist(), opened.tolist(), diagonal[head].tolist()):
                name = self.names[i]
                if name is not None:
                    best[name] = min(best.get(name, (0, 0, 0)), (-w, p, p - d))
            on = start[last] == places[b - 1]
            going = np.stack([item[head][on], diagonal[head][on], opened[on]])
            a = b
        return {name: (-w, p, q) for name, (w, p, q) in best.items()}

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window number) of every place in ``ids`` where a window occurs. 0 in ``ids`` matches nothing."""
        n = len(ids)
        none = np.zeros(0, np.int64)
        if not len(self.sizes) or not n:
            return none, none
        foreign = np.flatnonzero(np.concatenate((ids, [0])) == 0)
        ahead = foreign[np.searchsorted(foreign, np.arange(n))] - np.arange(n)
        starts = np.flatnonzero(ahead >= self.least)
        if not len(starts):
            return none, none
        padded = np.concatenate((ids, np.zeros(self.window, ids.dtype)))
        base = len(self.vocabulary) + 1
        # suffix array to the depth of a window, two words at a time from the last to the first
        order = np.arange(len(starts))
        for k in range(self.window - 1, -1, -2):
            key = padded[starts + k].astype(np.int64)
            if k:
                key += padded[starts + k - 1].astype(np.int64) * base
            order = order[np.argsort(key[order], kind="stable")]
        array = starts[order]
        group = np.zeros(len(array), np.int64)
        at = np.zeros(len(self.sizes), np.int64)
        live = np.arange(len(self.sizes))
        places, windows = [], []
        for k in range(self.window):
            key = group * base + padded[array + k]
            want = at[live] * base + self.words[live, k]
            low, high = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
            step = np.flatnonzero(np.diff(key) != 0) + 1
            group = np.zeros(len(array), np.int64)
            group[step] = 1
            group = np.cumsum(group)
            hit = high > low
            done = hit & (self.sizes[live] == k + 1)
            for w, a, b in zip(live[done], low[done], high[done]):
                places.append(array[a:b])
                windows.append(np.full(b - a, w))
            on = hit & ~done
            live, low = live[on], low[on]
            if not len(live):
                break
            at[live] = group[low]
        return (np.concatenate(places), np.concatenate(windows)) if places else (none, none)


def _hits(windows: Windows, texts: list[str]) -> Iterator[tuple[int, list[int], dict[str, tuple[int, int, int]]]]:
    """Per text: number of words, hit passages as [start, end, ...] in words, each item's longest match."""
    get = windows.vocabulary.get
    ids, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        ids.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        ids.append(np.zeros(1, np.int32))
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    places, which = windows.search(ids)
    order = np.argsort(places, kind="stable")
    places, which = places[order], which[order]
    first = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
    bounds = np.searchsorted(places, first)
    for k, n in enumerate(counts):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            yield n, [], {}
            continue
        mine = places[a:b] - first[k]
        yield n, _joined(np.stack([mine, mine + windows.sizes[which[a:b]]], axis=1)), windows.longest(mine, which[a:b])


def _joined(passages: np.ndarray) -> list[int]:
    """Passages (start, end) that touch or overlap, put together: [start, end, ...]."""
    passages = passages[np.argsort(passages[:, 0], kind="stable")]
    reach = np.maximum.accumulate(passages[:, 1])
    head = np.flatnonzero(np.concatenate(([True], passages[1:, 0] > reach[:-1])))
    return np.stack([passages[head, 0], reach[np.append(head[1:], len(passages)) - 1]], axis=1).reshape(-1).tolist()


_BUILT: list[tuple[str, Windows]] = []


def _windows(token: str, items: list[tuple[str | None, str]], window: int) -> Windows:
    """The windows of a block, built once for each Python worker; those of an earlier block are forgotten."""
    if not _BUILT or _BUILT[0][0] != token:
        _BUILT[:] = []
        _BUILT.append((token, Windows(items, window)))
    return _BUILT[0][1]


def _block(items: DataFrame, k: int):
    """A function that gives block ``k`` in tasks. Its items are broadcast: they are of bounded size."""
    shared = items.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.where(F.col("block") == k).collect()])
    token = uuid.uuid4().hex
    return lambda window: _windows(token, shared.value, window)


MATCH = "struct<item: string, words: long, start: long, item_start: long>"
FOUND = f"row long, doc_id long, n_words long, passages array<long>, matches array<{MATCH}>"
REPORT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          f"passages array<long>, items array<string>, matches array<{MATCH}>")
_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("words", pa.int64()), ("start", pa.int64()), ("item_start", pa.int64())]))


def _search(rows: DataFrame, block, window: int, all_rows: bool) -> DataFrame:
    """What one block hits in ``rows`` (row, doc_id, text); ``all_rows``: a row for documents without hits, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block(window)
        for part, texts in texts_of(batches):
            out = [(row, doc, n, edges, [(name, *m) for name, m in sorted(best.items())])
                   for row, doc, (n, edges, best) in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), _hits(windows, texts))
                   if edges or all_rows]
            if out:
                *plain, matches = zip(*out)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                named = [[dict(zip(("item", "words", "start", "item_start"), m)) for m in x] for x in matches]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(plain, kinds)), pa.array(named, _MATCHES)],
                                                 names=["row", "doc_id", "n_words", "passages", "matches"])

    return rows.mapInArrow(run, FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, hit words, items whose windows occur, the hit passages as [start, end, ...] in words, and for every
    item found its longest verbatim match: words, start in the document, start in the item (of equal ones the first)."""
    items, n = benchmark_blocks(benchmark, block_bytes)
    rows = docs_of(docs).withColumn("row", F.monotonically_increasing_id())
    if n > 1:
        rows = stage(rows, "leaks-rows")
    found = _search(rows, _block(items, 0), window, True)
    if n > 1:
        found = stage(found, "leaks-found")
        for k in range(1, n):
            found = found.union(stage(_search(rows, _block(items, k), window, False), "leaks-found"))
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                         F.flatten(F.collect_list("passages")).alias("passages"), F.flatten(F.collect_list("matches")).alias("matches"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                edges = _joined(np.array(r["passages"], np.int64).reshape(-1, 2)) if r["passages"] else []
                best = {}
                for m in r["matches"]:
                    best[m["item"]] = min(best.get(m["item"], (0, 0, 0)), (-m["words"], m["start"], m["item_start"]))
                names = sorted(best)
                matches = [{"item": x, "words": -best[x][0], "start": best[x][1], "item_start": best[x][2]} for x in names]
                n_hit = sum(edges[1::2]) - sum(edges[::2])
                out.append((r["doc_id"], r["n_words"], n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0, edges, names, matches))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), _MATCHES]
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)],
                                             names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "passages", "items", "matches"])

    return found.mapInArrow(report, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark window occurs."""
    items, n = benchmark_blocks(benchmark, block_bytes)
    if not n:
        return docs
    if n > 1:
        row = free(docs, "row")
        rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "leaks-rows")
        text = rows.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        hit = [stage(_search(text, _block(items, k), window, False).select(F.col("row").alias(row)), "leaks-hit") for k in range(n)]
        for h in hit[1:]:
            hit[0] = hit[0].union(h)
        return rows.join(hit[0].distinct(), row, "left_anti").drop(row)
    block = _block(items, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block(window)
        for part, texts in texts_of(batches):
            yield part.filter(pa.array([not edges for _, edges, _ in _hits(windows, texts)], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def contamination_sql(window: int = 10) -> str:
    """DuckDB SQL for the digest columns of ``contamination`` over the documents and benchmark tables."""
    words = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {window}) AS size FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[p : p + size - 1], ' ') AS win
            FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM sized)),
places AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
                 FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, item, size, p FROM places JOIN windows USING (size, win)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k AS q FROM (SELECT doc_id, p, unnest(range(0, size)) AS k FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
