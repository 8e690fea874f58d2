"""Merkle manifest of a dataset: digests of its rows, a tree over them in each group, and one root.

Every level is an equijoin of its nodes with themselves. A node of slot zero computes the indices of its siblings (its
own plus each slot's offset; with two children to a node that is the index XOR 1), joins the nodes found there, and
emits the parent. So a level with a third of all nodes is spread by index like any other, and a run is never larger than
the fan-out. The parents' members are also all that proofs need: from the top down, each run takes over the path of its
parent, and a leaf joins the path of its run. Levels are written tables; the driver sees the largest group's size only.

Defined cases: a null value is ``-`` in the digest, so it differs from an empty one; null doc_ids come before all others, equal
ones are ordered by their leaves, and repeated rows are leaves of their own; a null group is a group, before the others; a
group of one leaf has that leaf as its subroot, and one group has its subroot as the root; columns that aren't digested
are ignored; an empty table gives no rows. Texts of any length are digested in place and never moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.ordering import crc32_sql, numbered, order_key
from loamline.stage import stage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
PATH = "array<struct<slot:int,members:array<string>>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value with its length in front, so no two rows share their input."""
    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(one, columns)), 256)


def _digest(members: Column) -> Column:
    return F.sha2(F.array_join(members, ""), 256)


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """(part, idx, n, digest, members) of the level above ``nodes`` (part, idx, n, digest), for groups of several nodes."""
    live = nodes.where("n > 1").select("part", "idx", "n", "digest")
    zero = live.where(F.col("idx") % fanout == 0).select("part", "n", F.col("idx").alias("first"), F.explode(
        F.sequence(F.lit(0), F.least(F.lit(fanout), F.col("n") - F.col("idx")).cast("int") - 1)).alias("slot"))
    sibling = zero.select("part", "n", "first", (F.col("first") + F.col("slot")).alias("idx"))
    met = sibling.join(live.select("part", "idx", "digest"), ["part", "idx"])
    runs = met.groupBy("part", "first", "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
    members = F.transform("run", lambda x: x["digest"])
    return runs.select("part", (F.col("first") / fanout).cast("long").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"),
                       _digest(members).alias("digest"), members.alias("members"))


def _levels(nodes: DataFrame, fanout: int, label: str) -> list[DataFrame]:
    """The written levels above ``nodes``, up to that of the largest group's single node."""
    size = nodes.agg(F.max("n")).first()[0] or 0
    levels, cur = [], nodes
    while size > 1:
        cur = stage(_parents(cur, fanout), f"{label}-level")
        levels.append(cur)
        size = -(-size // fanout)
    return levels


def _tops(nodes: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """(part, digest) of each group's last node."""
    out = nodes.where("n = 1").select("part", "digest")
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("part", "digest"))
    return out


def _run_paths(levels: Sequence[DataFrame], crown: DataFrame, fanout: int, label: str) -> DataFrame | None:
    """Per run of the lowest level (part, run): its members, and what ``crown`` (part, subroot, root, up) says of its group,
    with the path from the run's parent added to ``up``."""
    above = None
    for level in reversed(levels):
        rows = level.select("part", F.col("idx").alias("run"), "n", "members")
        here = rows.where("n = 1").drop("n").join(crown, "part")
        if above is not None:
            lower = rows.where("n > 1").drop("n").withColumn("_up", F.floor(F.col("run") / fanout).cast("long"))
            upper = above.select("part", F.col("run").alias("_up"), "subroot", "root", F.col("up").alias("_path"),
                                 F.col("members").alias("_members"))
            step = F.struct((F.col("run") % fanout).cast("int").alias("slot"), F.col("_members").alias("members"))
            lower = lower.join(upper, ["part", "_up"]).withColumn("up", F.concat(F.array(step), F.col("_path")))
            here = here.unionByName(lower.select(*here.columns))
        above = stage(here, f"{label}-paths")
    return above


def _with_paths(nodes: DataFrame, levels: Sequence[DataFrame], crown: DataFrame, fanout: int, label: str) -> DataFrame:
    """``nodes`` with subroot, root and path, whose steps hold the node's slot in its run and the run's members."""
    lone = nodes.where("n = 1").join(crown.withColumnRenamed("up", "path"), "part")
    runs = _run_paths(levels, crown, fanout, label)
    if runs is None:
        return lone
    step = F.struct((F.col("idx") % fanout).cast("int").alias("slot"), F.col("members").alias("members"))
    placed = nodes.where("n > 1").withColumn("run", F.floor(F.col("idx") / fanout).cast("long")).join(runs, ["part", "run"])
    placed = placed.withColumn("path", F.concat(F.array(step), F.col("up")))
    return lone.unionByName(placed.select(*lone.columns))


def siblings(path: Column) -> Column:
    """The digests beside a leaf's path, level by level, left to right."""
    return F.flatten(F.transform(path, lambda s: F.filter(s["members"], lambda _, k: k != s["slot"])))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    def up(acc: Column, s: Column) -> Column:
        return _digest(F.transform(s["members"], lambda m, k: F.when(k == s["slot"], acc).otherwise(m)))

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", id: str = "doc_id", fanout: int = FANOUT,
             present: Column | None = None) -> DataFrame:
    """Per row: ``id``, leaf, idx (its place in the group), subroot, root and path.

    ``present`` may give a second digest to be carried along as ``present``, such as that of the row as it is found now;
    ``fold(present, path)`` then tells whether it still leads to the root.
    """
    if fanout < 2:
        raise ValueError("a node needs at least two children")
    leaf = leaf_digest([F.col(c) for c in columns])
    rows = docs.select(order_key(F.col(group).cast("string")).alias("part"), F.col(id).cast("long").alias("id"), leaf.alias("digest"),
                       (present if present is not None else F.lit(None).cast("string")).alias("present"),
                       F.monotonically_increasing_id().alias("uid"))
    leaves = stage(numbered(stage(rows, "merkle-rows"), "part", ["id", "digest", "uid"], "merkle").drop("uid"), "merkle-leaves")
    levels = _levels(leaves, fanout, "merkle")

    # the groups' subroots are the leaves of the tree above
    tops = stage(_tops(leaves, levels).withColumnRenamed("part", "of"), "merkle-tops")
    top = numbered(tops, None, ["of"], "merkle-tops").withColumn("part", F.lit("0"))
    top = stage(top, "merkle-top-leaves")
    upper = _levels(top, fanout, "merkle-top")
    root = _tops(top, upper).select("part", F.col("digest").alias("root"), F.array().cast(PATH).alias("up")).withColumn("subroot", F.lit(""))
    crown = _with_paths(top, upper, stage(root, "merkle-root"), fanout, "merkle-top")
    crown = stage(crown.select(F.col("of").alias("part"), F.col("digest").alias("subroot"), "root", F.col("path").alias("up")), "merkle-crown")

    out = _with_paths(leaves, levels, crown, fanout, "merkle")
    return out.select(F.col("id").alias(id), F.col("digest").alias("leaf"), "present", "idx", "subroot", "root", "path")


def tampered(columns: Sequence[str] = COLUMNS) -> Column:
    """Digest of a row whose text lost its capitals, where 3 divides the crc32 of the decimal doc_id; else of the row itself."""
    text = F.translate("text", _UPPER, _LOWER)
    changed = leaf_digest([text if c == "text" else F.col(c) for c in columns])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, changed).otherwise(leaf_digest([F.col(c) for c in columns]))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row is checked against the root by its own path
    after some have been tampered with."""
    rows = manifest(docs, present=tampered())
    folded = fold(F.col("present"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", _digest(siblings(F.col("path"))).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_sql(levels: int = 12) -> str:
    """The digest columns in DuckDB, for groups of up to 8 ** levels rows."""
    def digest(text: str) -> str:
        return "sha256(" + " || ".join(
            f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"
            for v in (f"CAST({c} AS VARCHAR)" if c != "text" else text for c in COLUMNS)) + ")"

    def climb(name: str, start: str) -> str:
        """Levels name0 .. of (part, idx, n, digest), where a group of one node stays as it is."""
        out = f"{name}0 AS ({start})"
        for k in range(levels):
            out += f""",
            {name}{k + 1} AS (SELECT part, idx // 8 AS idx, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n,
              CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest
              FROM {name}{k} GROUP BY part, idx // 8, n)"""
        return out

    def path(name: str, leaves: str) -> str:
        """Per leaf (part, idx) of ``leaves``: list of steps {{slot, members}} from the bottom."""
        steps = " UNION ALL ".join(
            f"""SELECT l.part, l.idx, {k} AS level, (l.idx // {8 ** k}) % 8 AS slot, r.members FROM {leaves} l
            JOIN (SELECT part, idx // 8 AS run, list(digest ORDER BY idx) AS members FROM {name}{k} WHERE n > 1 GROUP BY 1, 2) r
            ON r.part = l.part AND r.run = l.idx // {8 ** (k + 1)}""" for k in range(levels))
        return f"""SELECT part, idx, list({{'slot': slot, 'members': members}} ORDER BY level) AS path FROM ({steps}) GROUP BY part, idx"""

    crc = crc32_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)")
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""WITH leaves AS (
      SELECT CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS part, doc_id, {digest('text')} AS digest,
        CASE WHEN {crc} % 3 = 0 THEN {digest(lower)} ELSE {digest('text')} END AS present FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
      count(*) OVER (PARTITION BY part) AS n FROM leaves),
    {climb('l', 'SELECT part, idx, n, digest FROM placed')},
    tops AS (SELECT part AS grp, digest AS subroot, row_number() OVER (ORDER BY encode(part)) - 1 AS idx, count(*) OVER () AS n, '' AS part FROM l{levels}),
    {climb('t', 'SELECT part, idx, n, subroot AS digest FROM tops')},
    low AS ({path('l', 'placed')}), high AS ({path('t', 'tops')}),
    paths AS (SELECT p.doc_id, p.digest AS leaf, p.present, s.subroot, r.digest AS root,
        list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
      FROM placed p JOIN tops s ON s.grp = p.part CROSS JOIN t{levels} r
      LEFT JOIN low ON low.part = p.part AND low.idx = p.idx LEFT JOIN high ON high.idx = s.idx),
    folded AS (SELECT *, sha256(list_aggregate(list_transform(path, lambda s: array_to_string(list_filter(s.members, lambda m, k: k <> s.slot + 1), '')),
        'string_agg', '')) AS proof_sha256,
      list_reduce(list_prepend({{'slot': 0::BIGINT, 'members': [present]}}, path), lambda a, s: {{'slot': 0::BIGINT, 'members': [sha256(
        array_to_string(list_concat(list_concat(s.members[1:s.slot], a.members), s.members[s.slot + 2:]), ''))]}}).members[1] AS folded_root FROM paths)
    SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
