"""Connected components of a graph given as an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.shared import stage


def _rank(c: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """edges (src, dst): two columns of one type. Returns (id, root): one row for each id in a link, with an id that all of its
    component share (any of its ids, not the smallest).

    Contraction: in each turn every node takes the neighbour (or itself) that comes first in a fresh random order, and the edges
    are rewritten between those; a constant share of the nodes goes in each turn, so chains and stars alike need a logarithmic
    number of turns. The minimum is combined before the shuffle, so that a hub's edges are never gathered in a task. Each turn's
    tables are written to the shared folder, so that a lost executor repeats one turn at most.
    Self-links only make their id a component. Null ends are ignored. No links: an empty result.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    now = stage(both.distinct(), "edges")
    maps: list[DataFrame] = []
    turn = 0
    while not now.isEmpty():
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy("a").agg(F.min(_rank("b", turn)).alias("near"))
        here = _rank("a", turn)
        step = stage(best.select(F.col("a").alias("id"), F.least(F.col("near"), here)["id"].alias("to")), "hook")
        maps.append(step)
        left = now.join(step.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a").select("a2", "b")
        left = left.join(step.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b")
        now = stage(left.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        turn += 1
    if not maps:
        return both.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    # Later maps are smaller: compose from the end. Ids that a map doesn't list have reached their root.
    found = maps[-1].select("id", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = found.select(F.col("id").alias("to"), F.col("root").alias("then"))
        found = step.join(later, "to", "left").select("id", F.coalesce("then", "to").alias("root"))
    return found
