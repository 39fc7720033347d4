"""Parent-child links to full hierarchies by pointer doubling, in two phases.

First every node holds (id, ptr, dist): an ancestor and how far up it is. A round joins every unresolved node to the node
it points to, which gives it either its root or a pointer twice as far. After r rounds all nodes of depth under 2**r are
resolved; a round that resolves none while some are left shows that the rest never end: they lie on a circle or below one.
(A node of depth d has ancestors of every smaller depth, so no deeper node can resolve after an empty round.) These rows
are three numbers, however deep the tree and however long a circle is followed.

Then, only for nodes that have a root, segments of names or ids are doubled in the same way: a node whose segment reaches
its root is done and isn't carried on.

Every round writes what it resolved and what is left as one table and reads nothing twice that it need not: a lost executor costs no more
than one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.operators.skew import lookup_join
from caseframe.session import Stages


def links(tree: DataFrame) -> DataFrame:
    """One row (id, parent, name) per id.

    Repeated rows count once; where rows of one id disagree, the smallest (parent, name) that is not null is taken. Null
    ids are dropped. A parent of 0, null or without a row becomes null: the node is a root.
    """
    nodes = tree.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), "name")
    key = F.struct(F.col("parent").isNull().alias("a"), F.col("parent").alias("parent"), F.col("name").isNull().alias("b"), F.col("name").alias("name"))
    nodes = nodes.groupBy("id").agg(F.min(key).alias("m")).select("id", F.when(F.col("m.parent") != 0, F.col("m.parent")).alias("parent"), F.col("m.name").alias("name"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    joined = lookup_join(nodes, known, "parent", F.col("id"), "left")
    return joined.select("id", F.when(F.col("_known"), F.col("parent")).alias("parent"), "name")


def roots(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, root, depth), (id)) of nodes with and without a root, from (id, parent) as :func:`links` gives them."""
    stages, left = Stages(nodes.sparkSession, "roots"), F.sum(F.col("root").isNull().cast("long"))
    zero, none = F.lit(0), F.lit(None).cast("long")
    state = stages.write(nodes.select("id", F.when(F.col("parent").isNull(), F.col("id")).alias("root"), zero.alias("depth"), F.col("parent").alias("ptr"), F.lit(1).alias("dist")), left=left)
    before = 0
    while (now := stages.seen["left"] or 0) and now != before:
        before = now
        # Nodes that were resolved before the last round, and all of the last round.
        target = state.select(F.col("id").alias("ptr"), "root", "depth", F.col("ptr").alias("next"), F.col("dist").alias("step"))
        if len(stages.paths) > 1:
            older = stages.read(0, -1).filter("root is not null")
            target = target.unionByName(older.select(F.col("id").alias("ptr"), "root", "depth", none.alias("next"), zero.alias("step")))
        jumped = lookup_join(state.filter("root is null").select("id", "ptr", "dist"), target, "ptr", F.col("id"), "inner", rows=now)
        depth = F.when(F.col("root").isNull(), 0).otherwise(F.col("depth") + F.col("dist"))
        state = stages.write(jumped.select("id", "root", depth.alias("depth"), F.col("next").alias("ptr"), (F.col("dist") + F.col("step")).alias("dist")), left=left)
    return stages.read().filter("root is not null").select("id", "root", "depth"), state.filter("root is null").select("id")


def _segments(nodes: DataFrame, own: dict[str, Column]) -> DataFrame:
    """(id, ...) with what lies from the root down to each node, from (id, parent) of nodes that have a root. ``own`` are
    the segments of a node itself, texts or arrays."""
    stages, left = Stages(nodes.sparkSession, "segments"), F.sum(F.col("ptr").isNotNull().cast("long"))
    state = stages.write(nodes.select("id", F.col("parent").alias("ptr"), *[c.alias(k) for k, c in own.items()]), left=left)
    while now := stages.seen["left"] or 0:
        up = [F.col("id").alias("ptr"), F.col("ptr").alias("_next"), *[F.col(k).alias(f"_up_{k}") for k in own]]
        target = state.select(*up)
        if len(stages.paths) > 1:
            target = target.unionByName(stages.read(0, -1).filter("ptr is null").select(*up))
        jumped = lookup_join(state.filter("ptr is not null"), target, "ptr", F.col("id"), "inner", rows=now)
        state = stages.write(jumped.select("id", F.col("_next").alias("ptr"), *[F.concat(f"_up_{k}", k).alias(k) for k in own]), left=left)
    return stages.read().filter("ptr is null").drop("ptr")


class Hierarchy:
    """A table with id, parent, name as trees. A null name is an empty path segment."""

    def __init__(self, tree: DataFrame, separator: str = "/") -> None:
        self.separator = separator
        self.nodes = Stages(tree.sparkSession, "nodes").write(links(tree))
        self.roots, self.circular = roots(self.nodes)

    def _below(self, own: dict[str, Column]) -> DataFrame:
        ended = self.nodes.join(self.circular, "id", "left_anti")
        return _segments(ended, own)

    @property
    def _name(self) -> Column:
        return F.concat(F.lit(self.separator), F.coalesce(F.col("name"), F.lit("")))

    def paths(self) -> DataFrame:
        """id, root, depth, path of each node that has a root."""
        return self.roots.join(self._below({"path": self._name}), "id")

    def lineages(self, path: bool = False) -> DataFrame:
        """id, lineage (ids from the root to the node) of each node that has a root, and its path if asked for."""
        return self._below({"lineage": F.array("id"), **({"path": self._name} if path else {})})


def resolve(tree: DataFrame, separator: str = "/") -> tuple[DataFrame, DataFrame]:
    """(resolved, circular) of a table with id, parent, name.

    resolved: id, root, depth, path, lineage (ids from the root to the node). circular: id, of the nodes from which following
    parent never ends.
    """
    h = Hierarchy(tree, separator)
    return h.roots.join(h.lineages(path=True), "id").select("id", "root", "depth", "path", "lineage"), h.circular


def descendants(lineages: DataFrame) -> DataFrame:
    """(id, descendant, distance) for every node and each node below it, from lineages."""
    depth = F.size("lineage") - 1
    up = lineages.select(F.col("id").alias("descendant"), depth.alias("depth"), F.posexplode("lineage").alias("level", "id"))
    return up.filter(F.col("level") < F.col("depth")).select("id", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
