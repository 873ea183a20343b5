"""Identity of an ordered table as a tree of digests of bounded fan-in.

A leaf digests the row digests of ``fan`` order values in a row; a node of the next level digests the leaves of ``fan``
places, and so on up to one root. No row and no task holds more than the rows of one fan, and rows that are added
behind the others change only the nodes along the right edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import RowError
from millrace.session import settle

NODES = "level int, node long, digest string, n long"


def _digested(children: DataFrame) -> DataFrame:
    """(node, digest, n) of rows (node, place, digest, n): SHA-256 over the children's binary digests by place, then by digest."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
    return children.groupBy("node").agg(F.sha2(F.unhex(F.array_join(listed, "")), 256).alias("digest"), F.sum("n").cast("long").alias("n"))


def _grown(lowest: DataFrame, top: int, fan: int, kept: DataFrame | None, least: int = 0) -> DataFrame:
    """All levels over (node, digest, n) of the leaves that are new, up to level ``least`` at least; ``kept`` has the nodes that did not change."""
    made = [settle(lowest.select(F.lit(0).alias("level"), "node", "digest", "n"), "leaves")]
    level = 0
    while top > 0 or level < least:
        top //= fan
        below = made[-1].select("node", "digest", "n")
        if kept is not None:  # the unchanged children of the first node that changes
            first = made[-1].agg(F.min("node").alias("m")).first()["m"]
            below = below.union(kept.filter((F.col("level") == level) & (F.col("node") >= first // fan * fan) & (F.col("node") < first)).select("node", "digest", "n"))
        level += 1
        nodes = _digested(below.select(F.floor(F.col("node") / fan).alias("node"), F.col("node").alias("place"), "digest", "n"))
        made.append(settle(nodes.select(F.lit(level).alias("level"), "node", "digest", "n"), "nodes"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def leaves(df: DataFrame, order: str, digest: Column, fan: int) -> DataFrame:
    """(node, digest, n) of the lowest level."""
    rows = df.select(F.floor(F.col(order) / fan).alias("node"), F.col(order).alias("place"), digest.alias("digest"), F.lit(1).cast("long").alias("n"))
    return _digested(rows)


def last(df: DataFrame, order: str) -> int:
    """The last order value; rows without one, values below 0 and empty tables are refused."""
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count_if(F.col(order).isNull()).alias("nulls")).first()
    if ends["nulls"] or (ends["a"] is not None and ends["a"] < 0):
        raise RowError(f"{order} numbers rows from 0 up in every row")
    if ends["b"] is None:
        raise RowError("an empty table has no tree")
    return ends["b"]


def tree(df: DataFrame, order: str, digest: Column, fan: int = 4096, least: int = 0) -> DataFrame:
    """(level, node, digest, n): all nodes, up to level ``least`` even if one leaf holds all rows; ``digest`` is a row's SHA-256 in hexadecimal digits, ``order`` a whole number from 0 up.

    Order values should be dense: a leaf takes ``fan`` values however many rows have them, rows that share one by their digests.
    """
    if fan < 2:
        raise RowError(f"a node has at least 2 children, got {fan}")
    return _grown(leaves(df, order, digest, fan), last(df, order) // fan, fan, None, least)


def appended(nodes: DataFrame, df: DataFrame, order: str, digest: Column, first: int, fan: int = 4096) -> DataFrame:
    """The tree of ``df`` from that of its rows before order value ``first``: only nodes of the right edge are made anew.

    Of ``df``, only rows from the start of ``first``'s leaf on are read.
    """
    edge = df.filter(F.col(order) >= first // fan * fan)
    top, levels = last(edge, order) // fan, nodes.agg(F.max("level").alias("m")).first()["m"]
    made = settle(_grown(leaves(edge, order, digest, fan), top, fan, nodes), "edge")
    while top > 0:  # a tree that grows by a level keeps its old root as a node of the level below
        top //= fan
        levels -= 1
    if levels > 0:
        raise RowError("the tree belongs to a table with more rows")
    same = nodes.join(F.broadcast(made.groupBy("level").agg(F.min("node").alias("m"))), "level").filter(F.col("node") < F.col("m")).drop("m")  # one row for each level
    return same.select("level", "node", "digest", "n").unionByName(made)


def root(nodes: DataFrame) -> DataFrame:
    """(fingerprint, n_rows, levels) of a tree."""
    top = F.max(F.struct("level", "node", "digest", "n")).alias("t")
    return nodes.agg(top).select(F.col("t.digest").alias("fingerprint"), F.col("t.n").alias("n_rows"), (F.col("t.level") + 1).alias("levels"))
