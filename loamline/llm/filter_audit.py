"""Audit of how filters interact: what each removes in every order, and what only it would have found.

Documents are dealt by ranges of doc_id, sorted, with the labels' ids among them. In a range, each part keeps a sorted list of
failing documents for every filter. The union of each set of filters is merged from the lists of a smaller set and one more
filter; places are found by galloping, so a short list costs little beside a long one. What a filter removes after others is
the difference of two unions, and as one holds the other, of their sizes. Sizes of all ranges are added up; every order of the
filters follows from them. Nothing grows with a part: any range of any part is a small job of its own.

Repeated rows are counted before they are dealt, so neither one doc_id nor one text fills a task. The first document of a
text is a partial aggregate. Texts with over a thousandth of all rows, at most a thousand, are broadcast to their copies;
the others are joined.

Defined cases: null text is empty; a repeated row counts again, and isn't a later copy of its equals, as its doc_id isn't
larger; a null doc_id is neither a copy nor the first of copies, and has no labels; several labels of a document count if
any says so; a null part is the empty one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import groups_of
from loamline.stage import stage

#: Needles that are searched together.
BLOCK = 256
#: Parts whose sums a task holds before it passes them on.
HELD_PARTS = 4096
WORD = r"[\x20\x09-\x0D]+"


def text_filters() -> dict[str, Column]:
    """Failure conditions on ``text`` (never null) and ``words``: short, repetitive, shouting, marked up."""
    size = F.size("words")
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": size < 100,
        "B": 100 * F.size(F.array_distinct("words")) < 80 * size,
        "C": 100 * capitals > 10 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


COPY = "E"


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Place of each needle in ``hay`` (both sorted): from the last place, steps double until they are past a block of needles."""
    out = np.empty(len(needles), np.int64)
    low = 0
    for a in range(0, len(needles), BLOCK):
        block = needles[a: a + BLOCK]
        high, step = low, BLOCK
        while high < len(hay) and hay[high] < block[-1]:
            high, step = high + step, step * 2
        out[a: a + len(block)] = low + np.searchsorted(hay[low: high + 1], block)
        low = int(out[a + len(block) - 1])
    return out


def held(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Which needles are in ``hay`` (both sorted)."""
    if not len(hay):
        return np.zeros(len(needles), bool)
    at = gallop(needles, hay)
    return (at < len(hay)) & (hay[np.minimum(at, len(hay) - 1)] == needles)


def merged(*lists: np.ndarray) -> np.ndarray:
    """Union of sorted lists without repeats: the longest, with what it lacks of the others, the next longest first."""
    first, *rest = sorted(lists, key=len, reverse=True)
    for other in rest:
        new = other[~held(other, first)]
        first = np.insert(first, gallop(new, first), new)
    return first


def union_sizes(lists: list[np.ndarray], weights: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """For every set of the lists (by its bits): the weight of its union, and of the union's members in each of ``marks``."""
    unions = [np.zeros(0, np.int64)]
    for bits in range(1, 1 << len(lists)):
        top = bits.bit_length() - 1
        unions.append(merged(unions[bits ^ 1 << top], lists[top]))
    return np.array([[weights[u].sum(), *[weights[m[held(m, u)]].sum() for m in marks]] for u in unions], np.int64)


def _with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` (doc_id, part, mask, text_key) with ``bit`` in the mask of those whose text an earlier doc_id has."""
    firsts = rows.where("doc_id IS NOT NULL").groupBy("text_key").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("copies"))
    firsts = stage(firsts.where("first < last"), "audit-copies")
    limit = rows.count() / 1000
    hot = firsts.where(F.col("copies") > limit).select("text_key", F.col("first").alias("hot"))
    cool = firsts.where(F.col("copies") <= limit).select("text_key", "first")
    split = rows.join(F.broadcast(hot), "text_key", "left")
    common = split.where("hot IS NOT NULL").withColumnRenamed("hot", "first")
    rare = split.where("hot IS NULL").drop("hot").join(cool, "text_key", "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    both = rare.unionByName(common.select(*rare.columns))
    return both.withColumn("mask", F.col("mask") + F.when(later, 1 << bit).otherwise(0))


def _sizes(rows: DataFrame, marks: DataFrame, filters: int, range_rows: int) -> DataFrame:
    """(part, subset, total, fails, good, toxic) from rows (doc_id, part, mask, n) and marks (doc_id, good, toxic)."""
    known = F.col("doc_id").isNotNull().cast("int").alias("known")
    doc = F.coalesce("doc_id", F.lit(0)).alias("id")
    items = rows.select(known, doc, "part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic")).unionByName(
        marks.select(known, doc, F.lit(None).cast("string").alias("part"), F.lit(0).alias("mask"), F.lit(0).cast("long").alias("n"), "good", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for part, table in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(table)), pa.array(np.arange(len(table), dtype=np.int32)),
                                                  *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(4)]],
                                                 names=["part", "subset", "total", "fails", "good", "toxic"])
            sums.clear()

        for batch in groups_of(batches, ["known", "id"], rows=range_rows):
            ids, mask, n = (np.asarray(batch.column(c)) for c in ("id", "mask", "n"))
            good, toxic = (np.asarray(batch.column(c)).astype(bool) for c in ("good", "toxic"))
            keyed = np.asarray(batch.column("known")) == 1
            names = batch.column("part").dictionary_encode()
            part = np.asarray(names.indices.fill_null(-1))
            for p, name in enumerate(names.dictionary.to_pylist()):
                mine = np.flatnonzero(part == p)  # sorted by id, so places are sorted as ids are
                named = np.flatnonzero(keyed[mine])
                lists = [np.flatnonzero(mask[mine] >> f & 1) for f in range(filters)]
                marked = [named[held(ids[mine][named], ids[x])] for x in (good, toxic)]
                table = union_sizes(lists, n[mine], marked)
                table = np.column_stack([np.full(len(table), n[mine].sum()), table])
                sums[name] = sums[name] + table if name in sums else table
            if len(sums) > HELD_PARTS:
                yield from out()
        yield from out()

    dealt = items.repartitionByRange("known", "id").sortWithinPartitions("known", "id")
    parts = dealt.mapInArrow(count, "part string, subset int, total long, fails long, good long, toxic long")
    return parts.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("total", "fails", "good", "toxic")])


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, part: str = "lang",
                 range_rows: int = 1 << 17) -> DataFrame:
    """Per part, order of the filters and step: what the step's filter keeps, removes, finds too late, alone finds, and loses.

    ``filters`` names failure conditions on ``text`` and its ``words``; the filter E, copies of an earlier text, is added.
    There are as many orders as permutations, and sets of filters 2 ** n, so a handful of filters is meant.
    """
    filters = dict(text_filters() if filters is None else filters)
    names = [*filters, COPY]
    if len(names) > 7:
        raise ValueError("too many filters to look at every order")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", WORD), lambda w: w != ""))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    rows = stage(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("text_key")), "audit-rows")
    counted = _with_copies(rows, len(filters)).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")).where("good OR toxic")
    return _every_order(_sizes(counted, marks, len(names), range_rows), names)


def _every_order(sizes: DataFrame, names: list[str]) -> DataFrame:
    every = (1 << len(names)) - 1
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(names[x] for x in order), "step": k + 1, "bit": 1 << f, "before": before})
            before |= 1 << f
    every_step = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    entry = F.struct("subset", F.struct("total", "fails", "good", "toxic"))
    parts = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("of"))  # 2 ** filters entries
    rows = parts.select("part", "of", F.inline(every_step))
    before, after = F.col("of")[F.col("before")], F.col("of")[F.col("before") + F.col("bit")]
    found, rest = F.col("of")[F.col("bit")]["fails"], F.col("of")[F.lit(every) - F.col("bit")]["fails"]
    out = rows.select(
        "part", "filter_order", "step", "bit",
        (after["total"] - after["fails"]).alias("kept"), (after["fails"] - before["fails"]).alias("removed"),
        (found - (after["fails"] - before["fails"])).alias("redundant"), (F.col("of")[F.lit(every)]["fails"] - rest).alias("unique_fails"),
        (after["good"] - before["good"]).alias("good_lost"), (after["toxic"] - before["toxic"]).alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit_sql() -> str:
    words = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, part, len({words}) AS n, len(list_distinct({words})) AS u, length(t) AS c,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, regexp_matches(t, '[#$%&*|]') AS odd,
        min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, (n < 100)::INT + 2 * (100 * u < 80 * n)::INT + 4 * (100 * capitals > 10 * c)::INT + 8 * odd::INT
        + 16 * coalesce(doc_id > first, false)::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM one a, one b, one c, one d, one e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
    r AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND good THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
      CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
      CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
