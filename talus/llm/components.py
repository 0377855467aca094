"""Connected components of an edge table, by contraction.

Each round lets every node hook to its smallest smaller neighbour, flattens the resulting forest by pointer jumping, and
replaces the ends of all edges by their roots; it ends when no edge is left. Minima are combined before they are shuffled, so
a hub costs no more than its edges, and a lookup of a hub's parent is a join against a table with one row a node, which
adaptive execution can split. Every step is written to the shared folder. Nothing is collected but whether rows are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.storage import keep, release


def _up(df: DataFrame, key: str, parents: DataFrame, out: str) -> DataFrame:
    """df with key replaced by its parent, where it has one, under the name out."""
    p = parents.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
    return df.join(p, df[key] == p["_n"], "left").withColumn(out, F.coalesce("_u", key)).drop("_n", "_u")


def _flatten(parents: DataFrame) -> DataFrame:
    """Parents of parents until all nodes point to roots."""
    while True:
        other = parents.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        step = keep(parents.join(other, parents["up"] == other["_n"], "left").select("node", F.coalesce("_u", "up").alias("up"), F.col("_u").isNotNull().alias("moved")), "jump")
        release(parents)
        if step.where("moved").isEmpty():
            out = step.select("node", "up")
            out.kept_at = step.kept_at
            return out
        parents = step.select("node", "up")
        parents.kept_at = step.kept_at


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (src, dst) that is not the smallest of its component; component is the
    smallest node that can be reached. Self-loops, repeated edges and edges with a null end change nothing; without edges
    the result is empty. The result is a table in the shared folder.
    """
    small, large = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    left = keep(edges.where("src is not null and dst is not null and src != dst").select(small, large).distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        hooks = _flatten(keep(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks"))
        maps.append(hooks)
        moved = _up(_up(left, "a", hooks, "src"), "b", hooks, "dst").where("src != dst")
        following = keep(moved.select(small, large).distinct(), "edges")
        release(left)
        left = following
    out = None
    for later in reversed(maps):  # what a round has merged moves on with the rounds after it
        out = later if out is None else _up(later, "up", out, "up2").select("node", F.col("up2").alias("up")).unionByName(out)
    if out is None:
        out = left.select(F.col("a").alias("node"), F.col("b").alias("up"))
    done = keep(out.select("node", F.col("up").alias("component")), "components")
    for m in [*maps, left]:
        release(m)
    return done
