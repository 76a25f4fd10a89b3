"""Merkle manifest of a dataset: a content-addressed DAG of digests, and inclusion proofs by descent from its root.

Rows are leaves; leaves of a group, in order, are hashed by 16 until one node is left, the group's subroot; subroots,
in order of their groups, are hashed likewise to the root. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

FANOUT = 16
_PATH = "array<struct<left array<string>, right array<string>>>"


def joined_digest(digests: Column) -> Column:
    """H: lowercase hex SHA-256 of an array of digests, concatenated as text."""
    return F.sha2(F.array_join(digests, ""), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """H of fields, each `-` if null, else its UTF-8 byte count, `:` and its value; so no two rows of different values are written alike."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (f.cast("string") for f in fields))), 256)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with `idx`, the place in its group from 0 by `order`, and `n`, the group's rows.

    The rows are dealt to ranges of (group, order) and written; a row's place is its place in its range and what
    the group has in the ranges before. So a group of any size is spread; only rows equal in all these columns stay together.
    """
    keys = [F.col(k).asc_nulls_first() for k in (*group, *order)]
    placed = written(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), name)
    # at most a row for each range and group
    parts = written(placed.groupBy(*group, "part").agg(F.count("*").alias("here")), f"{name}-counts")
    whole, so_far = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "part", F.coalesce(F.sum("here").over(so_far), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    within = Window.partitionBy(*group, "part").orderBy(*keys[len(group):])
    at = placed.withColumn("within", F.row_number().over(within) - 1)
    return at.join(parts, [*group, "part"]).withColumn("idx", F.col("before") + F.col("within")).drop("part", "within", "before")


@dataclass
class Manifest:
    """The written DAG and its leaves.

    nodes: for each height above the leaves, rows (digest, children) of all groups' nodes: the content-addressed store.
    top: the same for the nodes above the subroots.
    groups: (grp, place, subroot, n), a row for each group; leaves: (grp, idx, digest, payload).
    root: (root), one row, none for an empty table.
    """

    nodes: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    leaves: DataFrame
    root: DataFrame


def _levels(level: DataFrame, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(store by height, ends by height) over nodes (grp, idx, n, digest), n the nodes of that group at that height.

    A group of one node has its end there; the others go up. As many rounds as the tallest tree has levels.
    """
    stores, ends = [], []
    while True:
        ends.append(level.where("n = 1").select("grp", "digest"))
        if level.where("n > 1").isEmpty():
            return stores, ends
        above = level.where("n > 1").groupBy("grp", (F.col("idx") / FANOUT).cast("long").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("x"))
        children = F.transform("x", lambda c: c["digest"])
        level = written(above.select("grp", "idx", "n", joined_digest(children).alias("digest"), children.alias("children")), name)
        # equal digests have equal children: one record
        stores.append(level.groupBy("digest").agg(F.any_value("children").alias("children")))


def build(rows: DataFrame, name: str = "manifest") -> Manifest:
    """The manifest of rows (grp: string, ord, digest, payload): leaves in order of ord, then digest, within each group; groups in order of name.

    Strings are ordered bytewise by UTF-8, nulls first. Repeated rows are leaves of their own. An empty table has no root.
    payload is any column that goes with a leaf, such as a row's id.
    """
    # a group's name never null, in the same order: '' for null, '=' before others
    keyed = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")))
    leaves = written(ranked(keyed, ["grp"], ["ord", "digest"], f"{name}-placed").select("grp", "idx", "n", "digest", "payload"), f"{name}-leaves")
    nodes, ends = _levels(leaves, f"{name}-nodes")
    subroots = ends[0].withColumn("height", F.lit(0))
    for h, e in enumerate(ends[1:], 1):
        subroots = subroots.unionByName(e.withColumn("height", F.lit(h)))
    one = subroots.select(F.lit("").alias("all"), "grp", "height", "digest")
    groups = written(ranked(one, ["all"], ["grp"], f"{name}-subroots").select("grp", "height", F.col("digest").alias("subroot"), "idx", "n"), f"{name}-groups")
    top, tops = _levels(groups.select(F.lit("").alias("grp"), "idx", "n", F.col("subroot").alias("digest")), f"{name}-top")
    root = tops[0]
    for e in tops[1:]:
        root = root.unionByName(e)
    return Manifest(nodes, top, groups, leaves, written(root.select(F.col("digest").alias("root")), f"{name}-root"))


def _step(frontier: DataFrame, store: DataFrame) -> DataFrame:
    """frontier one level lower: each node's record is looked up by digest; each child gets what wasn't selected as a further segment."""
    kept = [c for c in frontier.columns if c not in ("idx", "digest", "path")]
    x = frontier.join(store, "digest").select(*kept, "idx", "path", "children", F.posexplode("children").alias("pos", "child"))
    return x.select(*kept, (F.col("idx") * FANOUT + F.col("pos")).alias("idx"), F.col("child").alias("digest"), _further("path", "children", F.col("pos")).alias("path"))


def _further(path: str, children: str, pos: Column) -> Column:
    left, right = F.slice(children, 1, pos), F.slice(children, pos + 2, FANOUT)
    return F.concat(path, F.array(F.struct(left.alias("left"), right.alias("right"))))


def proofs(m: Manifest) -> DataFrame:
    """(grp, idx, payload, leaf, subroot, root, path) of every leaf, told by descent from the root.

    Requests are leaves' places; a place's digits to the base of 16 choose the child at each level. Requests that share
    leading digits descend as one row, so that the rows of a level are its nodes, and only below the lowest level
    a row becomes its (at most 16) leaves. Unselected children are collected on the way and the path is reversed: it
    begins at the leaf. path: array<struct<left, right>>, the siblings of each level left and right of the way.
    """
    at = m.root.select("root", F.lit(0).cast("long").alias("idx"), F.col("root").alias("digest"), F.array().cast(_PATH).alias("path"))
    for store in reversed(m.top):
        at = _step(at, store)
    entered = at.withColumnRenamed("digest", "subroot").join(m.groups.select("grp", "height", "idx"), "idx").drop("idx")
    entered = written(entered.withColumn("idx", F.lit(0).cast("long")).withColumn("digest", F.col("subroot")), "manifest-entered")
    out, low = ("grp", "idx", "payload", "leaf", "subroot", "root", "path"), len(m.nodes)
    at = entered.where(F.col("height") == low)
    for h in range(low, 1, -1):
        at = written(_step(at, m.nodes[h - 1]).unionByName(entered.where(F.col("height") == h - 1)), "manifest-frontier")
    alone = entered.where("height = 0").join(m.leaves.where("n = 1").select("grp", "idx", "payload"), ["grp", "idx"]).withColumn("leaf", F.col("digest")).select(*out)
    if low == 0:
        return alone.withColumn("path", F.reverse("path"))
    requests = m.leaves.where("n > 1").groupBy("grp", (F.col("idx") / FANOUT).cast("long").alias("idx")).agg(F.collect_list(F.struct(F.col("idx").alias("place"), "payload")).alias("asked"))
    x = at.join(m.nodes[0], "digest").join(requests, ["grp", "idx"]).select("grp", "subroot", "root", "path", "children", F.explode("asked").alias("a"))
    digit = (F.col("a.place") % FANOUT).cast("int")
    x = x.select("grp", F.col("a.place").alias("idx"), "a.payload", F.get("children", digit).alias("leaf"), "subroot", "root", _further("path", "children", digit).alias("path"))
    return x.select(*out).unionByName(alone).withColumn("path", F.reverse("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, hash to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(F.array_join(s["left"], ""), acc, F.array_join(s["right"], "")), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(F.array_join(s["left"], ""), F.array_join(s["right"], ""))), ""), 256)
