"""Line dedup over all documents by a deletion neighbourhood, in DataFrame operations only.

A line is its words, lower-cased. Lines with the same words are copies; two different lines of at least ``min_words``
words are near copies if one word inserted, deleted or replaced turns one into the other. The earliest line (by
doc_id, then position) stays; a line with an earlier copy or near copy goes.

Every line within one edit of another shares a deletion variant with it: both without the word at the same place, or
one without a word and the other whole. Variants are hashed keys built from running xors of word hashes, so a line
of n words costs n keys of fixed size. Per key and deleted place only the earliest line matters, so equal variants meet in
aggregates and in a join with one row a key, never as pairs within a group; the pairs found are verified word by word.

Lines that share no half with another line can't have a near copy (one edit leaves a half untouched), so only lines with
a shared half emit variants. A bitmap of fixed size over the shared halves spares most lines a shuffle; the exact join follows.

Defined cases: null text is empty and keeps null; lines without words always stay; rows with equal doc_id are told apart by
their text, and repeated rows are one document, both rows keep the same lines; a null doc_id comes first; columns other
than text and n_chars are carried along unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import free
from loamline.stage import stage

_CELLS = 1 << 16


@dataclass(frozen=True)
class LineRules:
    min_words: int = 10


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """One row a line that has words: where it is, its words, two hashes, and the keys of its halves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"),
                       F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)).alias("line_no", "line"))
    words = F.array_remove(F.split(F.lower("line"), "[ \\t\\x0B\\f\\r]+", -1), "")
    # explode of one element: the planner can't copy the splitting into each condition and expression that uses the words
    rows = rows.select("doc_id", "row_key", "line_no", F.explode(F.array(words)).alias("words"))
    rows = rows.withColumn("n", F.size("words")).where("n > 0")

    def halves(n: Column) -> list[Column]:
        h = F.floor(n / 2).cast("int")
        return [F.xxhash64(F.lit(1), n, F.slice("words", F.lit(1), h)),
                F.xxhash64(F.lit(2), n, F.slice("words", F.col("n") - (n - h) + 1, n - h))]

    # an edit changes the length by one at most: a pair shares the keys under the shorter length
    keys = F.array(*halves(F.col("n")), *halves(F.col("n") - 1))
    return rows.select(F.struct("doc_id", "row_key", "line_no").alias("at"), "words", "n",
                       F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(3), F.col("words")).alias("h2"),
                       F.explode(F.array(F.when(F.col("n") >= rules.min_words, keys))).alias("halves"))


def _bit(key: Column) -> tuple[Column, Column]:
    """Cell and bit of a key in the bitmap."""
    return F.shiftrightunsigned(key, 48).cast("int"), F.shiftrightunsigned(key, 42).cast("int").bitwiseAND(63)


def _bitmap(keys: DataFrame) -> DataFrame:
    """One row: the bitmap of the keys as an array of longs."""
    cell, bit = _bit(F.col("key"))
    words = keys.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))
    dense = keys.sparkSession.range(_CELLS).select(F.col("id").cast("int").alias("cell")).join(words, "cell", "left")
    pairs = F.sort_array(F.collect_list(F.struct("cell", F.coalesce("word", F.lit(0)).alias("word"))))
    return dense.agg(pairs.getField("word").alias("bitmap"))


def near_lines(lines: DataFrame, rules: LineRules = LineRules(), known: DataFrame | None = None) -> DataFrame:
    """(h1, h2) of the different lines that have an earlier near copy. ``known``: first places of all different lines."""
    known = known if known is not None else _known(lines)
    shared = known.where("halves is not null").select(F.explode("halves").alias("key")).groupBy("key").count()
    shared = stage(shared.where("count > 1").select("key"), "line-halves")
    bitmap = stage(_bitmap(shared), "line-bitmap").scalar()

    def held(key: Column) -> Column:
        cell, bit = _bit(key)
        return F.call_function("shiftrightunsigned", F.get(bitmap, cell), bit).bitwiseAND(F.lit(1)) == 1

    hopeful = lines.where("halves is not null").where(held(F.get("halves", 0)) | held(F.get("halves", 1)) | held(F.get("halves", 2)) | held(F.get("halves", 3)))
    first = hopeful.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("words").alias("words"), F.first("halves").alias("halves"))
    first = stage(first, "line-hopeful")
    paired = first.select("h1", "h2", F.explode("halves").alias("key")).join(shared, "key", "left_semi").select("h1", "h2").distinct()
    # numbered in the order of their first places: a smaller id is an earlier line
    ordered = first.drop("halves").join(paired, ["h1", "h2"], "left_semi").orderBy("at")
    lines = stage(ordered.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "words"), "line-candidates")

    # dealt by line, so neither the windows over its words nor their total moves a row
    each = lines.select("id", "words").repartition("id").select("id", F.size("words").alias("n"), F.posexplode("words").alias("p", "w"))
    each = each.select("id", "n", (F.col("p") + 1).alias("i"), F.xxhash64("w", F.col("p") + 1).alias("a"), F.xxhash64("w", "p").alias("b"))
    line = Window.partitionBy("id").orderBy("i")
    left = F.coalesce(F.bit_xor("a").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    right = F.coalesce(F.bit_xor("b").over(Window.partitionBy("id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = each.select("id", "i", F.xxhash64(F.col("n") - 1, left.bitwiseXOR(right)).alias("v"))
    whole = each.groupBy("id").agg(F.bit_xor("a").alias("x"), F.first("n").alias("n"))
    whole = whole.select("id", F.lit(0).alias("i"), F.xxhash64("n", "x").alias("v"))
    variants = stage(cut.unionByName(whole), "line-variants")
    # nearly all variants occur once; a bitmap leaves them out before the joins
    common = stage(variants.groupBy(F.col("v").alias("key")).count().where("count > 1").select("key"), "line-common")
    bitmap = stage(_bitmap(common), "line-bitmap").scalar()
    variants = stage(variants.where(held(F.col("v"))), "line-variants")

    best = variants.groupBy("v", "i").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    beside = best.groupBy("v").agg(F.min(F.when(F.col("i") > 0, F.struct("low", "i"))).alias("cut_low"),
                                   F.min(F.when(F.col("i") == 0, F.struct("low", "i"))).alias("whole_low"))
    same = variants.where("i > 0").join(best.where("copies > 1 and i > 0").select("v", "i", F.struct("low", "i").alias("other")), ["v", "i"])
    other = variants.join(beside.where("whole_low is not null and cut_low is not null"), "v").withColumn(
        "other", F.when(F.col("i") == 0, F.col("cut_low")).otherwise(F.col("whole_low")))
    pairs = same.select("id", "i", "other").unionByName(other.select("id", "i", "other")).where("other.low < id")
    pairs = pairs.select("id", "i", F.col("other.low").alias("other"), F.col("other.i").alias("j")).distinct()
    checked = pairs.join(lines, "id").join(lines.select(F.col("id").alias("other"), F.col("words").alias("other_words")), "other")

    def without(words: Column, i: Column) -> Column:
        return F.when(i == 0, words).otherwise(F.concat(F.slice(words, F.lit(1), F.greatest(i - 1, F.lit(0))), F.slice(words, i + 1, F.size(words))))

    return checked.where(without(F.col("words"), F.col("i")) == without(F.col("other_words"), F.col("j"))).select("h1", "h2").distinct()


def _known(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("halves").alias("halves"))


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), report: bool = False) -> DataFrame:
    """``docs`` with only the lines that stay, and n_chars (if there) counted anew. With ``report``: doc_id, n_lines,
    n_removed and the remaining text."""
    lines = _lines(docs, rules)
    known = stage(_known(lines), "line-known")
    near = near_lines(lines, rules, known)
    kept = known.join(near, ["h1", "h2"], "left_anti").select("at.row_key", "at.line_no")
    key, mine = free(docs, "_line_row_key"), free(docs, "_line_kept")
    kept = kept.groupBy("row_key").agg(F.collect_list("line_no").alias(mine)).withColumnRenamed("row_key", key)
    keyed = docs.withColumn(key, _row_key()).join(kept, key, "left")
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    stays = F.transform(parts, lambda x, i: F.when(F.array_contains(F.col(mine), i) | (F.trim(F.translate(x, "\t\x0b\f\r", "    ")) == ""), x))
    rest = F.filter(stays, lambda x: x.isNotNull())
    if report:
        return keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
                            F.coalesce(F.size(parts) - F.size(rest), F.lit(0)).cast("long").alias("n_removed"), F.array_join(rest, "\n").alias("text"))
    text = F.array_join(rest, "\n")
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return keyed.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def dedup_sql(rules: LineRules = LineRules()) -> str:
    """DuckDB SQL for the report over the documents table."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(parts))) AS k, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
w AS (SELECT doc_id, k, line, list_filter(regexp_split_to_array(lower(line), '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM l),
lines AS (SELECT words, min((doc_id, k)) AS pos FROM w WHERE len(words) > 0 GROUP BY words),
long AS (SELECT *, len(words) AS n, array_to_string(words, ' ') AS whole FROM lines WHERE len(words) >= {rules.min_words}),
cut AS (SELECT pos, whole, n, i, array_to_string(words[: i - 1] || words[i + 1 :], ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)),
near AS (
  SELECT whole FROM (SELECT whole, pos, min(pos) OVER (PARTITION BY v, i) AS low FROM cut) WHERE low < pos
  UNION SELECT a.whole FROM cut a JOIN long b ON a.v = b.whole WHERE b.pos < a.pos
  UNION SELECT b.whole FROM cut a JOIN long b ON a.v = b.whole WHERE a.pos < b.pos),
kept AS (SELECT pos FROM lines WHERE array_to_string(words, ' ') NOT IN (SELECT whole FROM near))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (stays), '') AS text
FROM (SELECT doc_id, k, line, len(words) = 0 OR (doc_id, k) IN (SELECT pos FROM kept) AS stays FROM w) GROUP BY doc_id"""
