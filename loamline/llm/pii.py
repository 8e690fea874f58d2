"""Personal data: patterns, and terms that reveal it by information theory.

``find`` reports base spans of emails, IPv4 addresses, card and phone numbers (entities), and disclosing terms. With
frequencies of documents over the whole corpus, a term t tells PMI(t; e) = log2(n_te * N / (n_t * n_e)) bits of the
IC(e) = log2(N / n_e) bits that identify entity e; both n_te and n_t look at all words of a document. Terms of three
letters or more, seen with the entity in at least ``support`` documents and telling at least ``share`` of its
information, are disclosing. Every occurrence of such a term outside the base spans is flagged, in documents without the
entity too; ``sanitise`` removes the entities and generalises those terms.

Entities in fewer than ``support`` documents, or in all, have no disclosing terms and are left out early. Pairs and terms
are summed per task; bitmaps of fixed size choose the rows, entities and words that are looked at, and exact joins
remove what they hold too much. These joins have one row a key on the side of the counts, so a value found everywhere is
split by the planner.

Defined cases: null text is empty; a repeated row counts as one document for all frequencies and gives a row of its own
(only rows whose key the bitmap of repeated keys holds are moved for that); a null doc_id stays null; other columns are
ignored by ``find`` and kept by ``sanitise``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.bytetext import Hashes, joined
from loamline.llm.common import docs_of, free, slices, texts_of
from loamline.stage import stage

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns. The look-behinds start a run of digits at its first digit, as a leftmost match does anyway.
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LETTERS = np.array([(chr(b).isalpha() and b < 128) or b >= 128 for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = 1 << 26


@dataclass(frozen=True)
class PiiRules:
    support: int = 2
    share: float = 0.75


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) sorted; kind is a position in KINDS."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(int(x.lstrip("0")[:4] or "0") <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def outside(terms: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The terms (sorted, apart from each other) that no span overlaps."""
    starts = [a for a, _, _ in terms]
    covered = set()
    for a, _, b in spans:
        k = bisect_left(starts, a)
        k -= k > 0 and terms[k - 1][2] > a
        covered.update(range(k, bisect_left(starts, b)))
    return [t for k, t in enumerate(terms) if k not in covered]


def hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode().translate(_LOWER) for w in words]
    ends = np.cumsum([len(x) for x in raw]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return Hashes(data).of(np.concatenate(([0], ends[:-1])).astype(np.int64), ends).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs_of(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))


FOUND = "doc_id long, row_key long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>"


def _entities(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    return hash_words(sorted({f"{KINDS[k]}:{text[a:b].lower()}" for a, k, b in spans}))


def _scan(docs: DataFrame) -> DataFrame:
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches):
            rows = []
            for doc, key, text in zip(part.column("doc_id").to_pylist(), part.column("row_key").to_pylist(), texts):
                spans = base_spans(text)
                n = [sum(k == j for _, k, _ in spans) for j in range(4)]
                rows.append((doc, key, *n, listed(spans), _entities(text, spans).tolist() if spans else []))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                             names=["doc_id", "row_key", "n_email", "n_ip", "n_card", "n_phone", "base", "entities"])

    return _keyed(docs).mapInArrow(run, FOUND)


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Two bits for each value; at most _BITS / 64 rows come to the driver."""
    both = F.array(F.col(column).bitwiseAND(_BITS - 1), F.shiftrightunsigned(column, 32).bitwiseAND(_BITS - 1))
    cells = df.select(F.explode(both).alias("b")).groupBy(F.shiftright("b", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("word")).toArrow()
    bitmap = np.zeros(_BITS // 64, np.int64)
    bitmap[np.asarray(cells.column("cell"))] = np.asarray(cells.column("word"))
    return bitmap.view(np.uint64)


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64)
    one = lambda bit: bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)
    return (one(keys & np.uint64(_BITS - 1)) & one(keys >> np.uint64(32) & np.uint64(_BITS - 1))).astype(bool)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word of three letters or more, lower-cased; positions count characters."""
    data, offsets = joined(column)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    letter = _LETTERS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = letter[1:] != letter[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    word = letter[starts] & (at[ends] - at[starts] >= 3) if len(starts) else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    row = np.searchsorted(offsets, starts, "right") - 1
    first = at[offsets[row]]
    return Hashes(data).of(starts, ends).view(np.int64), row, at[starts] - first, at[ends] - first


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("row_key"), dtype=np.int64)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _each_row_once(rows: DataFrame, repeated: np.ndarray, run: Run, schema: str) -> DataFrame:
    """``run`` over (row_key, text), copies of a row left out; only rows with a bit in ``repeated`` are moved for it."""
    if not repeated.any():
        return rows.mapInArrow(run, schema)
    shared = rows.sparkSession.sparkContext.broadcast(repeated)

    def chosen(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_held(shared.value, _keys(batch)) == wanted))
            if kept.num_rows:
                yield kept

    copies = rows.mapInArrow(lambda batches: chosen(batches, True), "row_key long, text string")
    copies = copies.groupBy("row_key").agg(F.first("text").alias("text"))
    return rows.mapInArrow(lambda batches: run(chosen(batches, False)), schema).unionByName(copies.mapInArrow(run, schema))


def _pairs(rows: DataFrame, repeated: np.ndarray, holders: np.ndarray, entities: np.ndarray) -> DataFrame:
    """(entity, term, n_te): documents that hold both, for the entities whose bits are set in rows whose bits are set."""
    context = rows.sparkSession.sparkContext
    shared_rows, shared = context.broadcast(holders), context.broadcast(entities)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held, axis=1), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*keys, n)], names=["entity", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pa.array(_held(shared_rows.value, _keys(batch))))
            for part in slices(batch, limit=1 << 20):
                texts = part.column("text").to_pylist()
                terms, row, _, _ = _words(part.column("text"))
                edges = np.searchsorted(row, np.arange(len(texts) + 1))
                for k, text in enumerate(texts):
                    mine = np.unique(terms[edges[k]: edges[k + 1]])
                    spans = base_spans(text or "")
                    told = _entities(text, spans) if spans and len(mine) else np.zeros(0, np.int64)
                    told = told[_held(shared.value, told)]
                    step = max(1, (1 << 20) // max(1, len(mine)))
                    for a in range(0, len(told), step):  # many entities and many words: some at a time
                        few = told[a: a + step]
                        held.append(np.stack([np.repeat(few, len(mine)), np.tile(mine, len(few))]))
                        size += held[-1].shape[1]
                        if size > 1 << 20:
                            yield summed(held)
                            held, size = [], 0
        if held:
            yield summed(held)

    counted = _each_row_once(rows, repeated, run, "entity long, term long, n long")
    return counted.groupBy("entity", "term").agg(F.sum("n").alias("n_te"))


def _frequencies(rows: DataFrame, repeated: np.ndarray, bitmap: np.ndarray) -> DataFrame:
    """(term, n_t): documents with each word whose bits are set."""

    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def seen(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        terms, row, _, _ = _words(column)
        kept = _held(shared.value, terms)
        keys = np.unique(np.stack([terms[kept], row[kept]]), axis=1)
        return np.unique(keys[0], return_counts=True)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        terms, place = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return terms, np.bincount(place, np.concatenate([n for _, n in parts]), len(terms)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                held.append(seen(part.column("text")))
                size += len(held[-1][0])
                if size > 1 << 20:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > 1 << 19:  # many different terms: passed on, the task starts afresh
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], names=["term", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in summed(held)], names=["term", "n"])

    return _each_row_once(rows, repeated, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _occurrences(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(row_key, term, start, end) of every word whose bits are set."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                terms, row, starts, ends = _words(part.column("text"))
                kept = np.flatnonzero(_held(shared.value, terms))
                if len(kept):
                    columns = (_keys(part)[row[kept]], terms[kept], starts[kept].astype(np.int32), ends[kept].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row_key", "term", "start", "end"])

    return rows.mapInArrow(run, "row_key long, term long, start int, end int")


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"


def _told(rows: DataFrame, found: DataFrame, rules: PiiRules) -> DataFrame:
    """The disclosing terms, each once (written)."""
    copies = found.groupBy("row_key").agg(F.count("*").alias("n"))
    total = copies.count()
    repeated = _bitmap(copies.where("n > 1"), "row_key")
    holds = found.where(F.size("entities") > 0).select("row_key", F.explode("entities").alias("entity")).distinct()
    entities = holds.groupBy("entity").agg(F.count("*").alias("n_e"))
    entities = stage(entities.where((F.col("n_e") >= rules.support) & (F.col("n_e") < total)), "pii-entities")
    holders = _bitmap(holds.join(entities, "entity", "left_semi"), "row_key")
    pairs = _pairs(rows, repeated, holders, _bitmap(entities, "entity")).where(F.col("n_te") >= rules.support)
    pairs = stage(pairs.join(entities, "entity"), "pii-pairs")
    told = pairs.join(_frequencies(rows, repeated, _bitmap(pairs, "term")), "term")
    pmi = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    told = told.where(pmi >= rules.share * F.log2(F.lit(float(total)) / F.col("n_e")))
    return stage(told.select("term").distinct(), "pii-told")


def find(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """Per row: counts of base spans, their digest, and all spans with those of disclosing terms; row_key identifies the row."""
    found = stage(_scan(docs), "pii-found")
    rows = _keyed(docs).select("row_key", "text")
    told = _told(rows, found, rules)
    terms = _occurrences(rows, _bitmap(told, "term")).join(told, "term")
    terms = terms.groupBy("row_key").agg(F.collect_set(F.struct("start", "end")).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digest, count = [], [], []
            for base, terms in zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist()):
                digest.append(hashlib.sha256(base.encode()).hexdigest())
                mine = []
                if terms:
                    all_spans = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                    mine = outside(sorted((t["start"], 4, t["end"]) for t in terms), all_spans)
                    base = listed(sorted(all_spans + mine))
                spans.append(base)
                count.append(len(mine))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")]
                + [pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(count, pa.int64()), batch.column("row_key")],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "row_key"])

    return found.drop("entities").join(terms, "row_key", "left").mapInArrow(run, REPORT + ", row_key long")


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches apart from each other that cover the spans (start, kind, end), each with the kind of its longest span
    (of equally long ones the first)."""
    out: list[list[int]] = []
    for a, k, b in sorted(spans):
        if out and a < out[-1][2]:
            last = out[-1]
            if b - a > last[3]:
                last[1], last[3] = k, b - a
            last[2] = max(last[2], b)
        else:
            out.append([a, k, b, b - a])
    return [(a, k, b) for a, k, b, _ in out]


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by its kind in capitals; what no span covers stays."""
    parts, at = [], 0
    for a, k, b in merged(spans):
        parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """``docs`` with entities replaced by their kind in capitals, and disclosing terms by [TERM].

    Spans that overlap are replaced together, by the kind of the longest.
    """
    key, column = free(docs, "_pii_row_key"), free(docs, "_pii_spans")
    spans = find(docs, rules).where("spans <> ''").select(F.col("row_key").alias(key), F.col("spans").alias(column)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist()):
                listing = [x.split(":") for x in spans.split(",")] if spans else []
                texts.append(replaced(text, [(int(a), KINDS.index(k), int(b)) for k, a, b in listing]) if listing else text)
            columns = [pa.array(texts, batch.column(c).type) if c == "text" else batch.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return keyed.join(spans, key, "left").mapInArrow(run, schema)
