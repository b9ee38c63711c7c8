"""Merkle manifest of a table, in SQL functions over concatenated levels.

Leaves are hashed, ordered within their group and cut into aligned blocks of
``fan`` x ``fan`` nodes.  A block keeps each of its levels as one hex string:
a parent is the hash of one fixed-width substring (``fan`` digests), the
siblings of a node are the substrings before and after it in its run.  The
blocks' own digests are the nodes of the next, ``fan`` x ``fan`` times smaller
table, until every group is one node (its subroot); the subroots are the
leaves of one more such tree, whose root stands for the table.

Proofs go the other way: a block's row meets its parent's segments in a join
on (group, block) and hands them on to its nodes, so that nothing but whole
blocks is ever shuffled and a hot group is as many blocks as it is large.
Ranks come from a range partitioning with per-range offsets, not from a
window over a group.

Defined cases: a null value hashes as ``-``; a null group is a group of its
own and comes first; leaves without a key come first in their group; rows of
one key are ordered by leaf (equal leaves are interchangeable); an empty table
has no root and no rows; other columns are carried, and those named like a
result push it to a fresh name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh_name, staged

_HEX = 64
SEGMENTS = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(*values: Column) -> Column:
    """Hash of the values, each ``-`` or its UTF-8 byte count, ``:`` and text."""
    def part(c):
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return sha(F.concat(*[part(c) for c in values]))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` (column ``grp`` not null) with their place ``pos`` in their group
    and the group's size ``n``, for any group size: range partitions, an offset
    per (group, range), a window inside a range."""
    rows = staged(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    # a stored row number tells equal rows apart, so no range holds them all
    cut = staged(rows.repartitionByRange("grp", *order, "tie")
                 .withColumn("part", F.spark_partition_id()), "leaf-ranges")
    sizes = cut.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("grp")
    sizes = sizes.select(
        "grp", "part", F.sum("m").over(whole).alias("n"),
        F.coalesce(F.sum("m").over(whole.orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order, "tie"))
    return (cut.withColumn("at", at).join(sizes, ["grp", "part"])
            .withColumn("pos", F.col("before") + F.col("at") - 1)
            .drop("tie", "part", "at", "before"))


def blocks(nodes: DataFrame, fan: int, carry: list[str]) -> DataFrame:
    """One row per aligned block of ``fan`` x ``fan`` nodes: level strings
    ``l0``, ``l1``, the block's digest ``h`` and the nodes' carried columns.  A
    group of one node passes; one of at most ``fan`` takes one level, not two."""
    kid = F.struct("pos", "h", *carry)
    got = nodes.groupBy("grp", F.floor(F.col("pos") / (fan * fan)).cast("long").alias("block")) \
        .agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.max("n").alias("n"))
    l0 = F.array_join(F.transform("kids", lambda x: x["h"]), "")
    wide = fan * _HEX
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("kids") - 1) / fan).cast("int")),
                       lambda i: sha(F.substring(F.col("l0"), i * wide + 1, F.lit(wide))))
    kept = F.transform("kids", lambda x: F.struct(x["pos"].alias("pos"),
                                                  *[x[c].alias(c) for c in carry]))
    got = staged(got.select("grp", "block", "n", kept.alias("kids"), l0.alias("l0")), "level")
    got = got.withColumn("l1", F.when(F.col("n") > 1, F.array_join(runs, ""))
                         .otherwise(F.col("l0")))
    # stored: the level strings are read once per node of a block later on
    return staged(got.withColumn("h", F.when(F.col("n") > fan, sha(F.col("l1")))
                                 .otherwise(F.col("l1"))), "block")


@dataclass
class Tree:
    """The stored block tables from the leaves up, and one root per group."""
    tables: list[DataFrame]
    roots: DataFrame
    fan: int


def grow(nodes: DataFrame, fan: int, carry: list[str]) -> Tree:
    """Trees of all groups at once; a table is ``fan``^2 times smaller than the
    one below it."""
    tables = []
    while True:
        table = blocks(nodes, fan, carry)
        tables.append(table)
        above = F.ceil(F.col("n") / (fan * fan)).cast("long")
        nodes = table.select("grp", F.col("block").alias("pos"), above.alias("n"), "h")
        carry = []
        most = nodes.agg(F.max("n")).first()[0]  # one number
        if most is None or most == 1:
            return Tree(tables, nodes.select("grp", "h"), fan)


def handed_down(tree: Tree, top: DataFrame, carry: list[str], keep: list[str]) -> DataFrame:
    """Every leaf with its digest, its carried columns and its segments up to
    the root, nearest first.  ``top`` gives per group (``grp``) the segments
    above its root and the columns ``keep`` that all its leaves get."""
    fan, wide = tree.fan, tree.fan * _HEX
    above = top.select("grp", F.lit(0).cast("long").alias("block"), "segments", *keep)
    for i, table in reversed(list(enumerate(tree.tables))):
        cols = carry if i == 0 else []
        j = lambda x: (x["pos"] % (fan * fan)).cast("int")

        def sides(run, at):
            return F.struct(F.substring(run, F.lit(1), at * _HEX).alias("left"),
                            F.substring(run, at * _HEX + _HEX + 1, F.lit(wide)).alias("right"))

        def path(x):
            none = F.array().cast(SEGMENTS)
            row = F.floor(j(x) / fan).cast("int")
            run = F.substring(F.col("l0"), row * wide + 1, F.lit(wide))
            return F.concat(
                F.when(F.col("n") > 1, F.array(sides(run, j(x) % fan))).otherwise(none),
                F.when(F.col("n") > fan, F.array(sides(F.col("l1"), row))).otherwise(none),
                F.col("segments"))

        rows = F.transform("kids", lambda x: F.struct(
            x["pos"].alias("pos"), *[x[c].alias(c) for c in cols],
            F.substring(F.col("l0"), j(x) * _HEX + 1, F.lit(_HEX)).alias("h"),
            path(x).alias("segments")))
        down = table.drop("h").join(above, ["grp", "block"]).select(
            "grp", *keep, F.inline(rows))
        above = down.withColumnRenamed("pos", "block") if i else down
    return above


def folded(leaf: Column, segments: Column) -> Column:
    """The root that ``leaf`` and its siblings lead to."""
    return F.aggregate(segments, leaf, lambda a, s: sha(F.concat(s["left"], a, s["right"])))


def siblings(segments: Column) -> Column:
    """All siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass
class Manifest:
    """``proofs``: per leaf its carried columns, its digest and, under the names
    ``subroot`` and ``segments``, its group's root and its siblings; ``root``:
    of the whole table, null if it is empty."""
    proofs: DataFrame
    root: str | None
    subroot: str
    segments: str


def manifest(leaves: DataFrame, *, group: str, key: str, leaf: str = "leaf",
             fan: int = 16) -> Manifest:
    """The manifest of ``leaves``: a digest column ``leaf``, ordered by ``key``
    in each ``group``; all other columns are carried to the proofs."""
    rest = [c for c in leaves.columns if c not in (group, leaf)]
    names = {c: f"c{i}" for i, c in enumerate(rest)}
    rows = leaves.select(
        # null before every text, and no null key in joins
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("grp"),
        F.col(leaf).alias("h"), *[F.col(c).alias(names[c]) for c in rest])
    carry = list(names.values())
    tree = grow(ranked(rows, [F.col(names[key]).asc_nulls_first(), F.col("h")]), fan, carry)
    subroots = tree.roots.select(F.lit("all").alias("grp"), "h", F.col("grp").alias("c0"))
    over = grow(ranked(subroots, [F.col("c0")]), fan, ["c0"])
    found = over.roots.first()
    root = found["h"] if found else None
    empty = F.array().cast(SEGMENTS)
    tops = handed_down(over, over.roots.select("grp", empty.alias("segments")), ["c0"], [])
    tops = staged(tops.select(F.col("c0").alias("grp"), "segments",
                              F.col("h").alias("subroot")), "subroots")
    down = handed_down(tree, tops, carry, ["subroot"])
    back = F.when(F.col("grp") != "0", F.substring(F.col("grp"), 2, 1 << 30)).alias(group)
    sub, seg = (fresh_name(leaves.columns, c) for c in ("subroot", "segments"))
    return Manifest(down.select(back, *[F.col(n).alias(c) for c, n in names.items()],
                                F.col("h").alias(leaf), F.col("subroot").alias(sub),
                                F.col("segments").alias(seg)), root, sub, seg)
