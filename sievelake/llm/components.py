"""Connected components: of a group in memory, and of a written table of edges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Pairs that are compared at a time.
BLOCK = 1 << 22


def forest(points: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that near() spans over the points of one group.

    Breadth first: what a front of points reaches leaves the points that are still
    to be found, so each pair is compared once at most and nothing but the front
    times a block of the rest is held.
    """
    a, b = [], []
    rest = np.arange(len(points))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, BLOCK // len(rest))
            found = []
            for at in range(0, len(front), step):
                some = front[at : at + step]
                if not len(rest):
                    break
                hit = near(points[some], points[rest])
                any_hit = hit.any(axis=0)
                if any_hit.any():
                    by = hit[:, any_hit].argmax(axis=0)
                    a.append(points[some[by]])
                    b.append(points[rest[any_hit]])
                    found.append(rest[any_hit])
                    rest = rest[~any_hit]
                    step = max(1, BLOCK // max(1, len(rest)))
            front = np.concatenate(found) if found else rest[:0]
    none = points[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the links (u, v), both long.

    Alternates large stars (each node's larger neighbours go to its smallest) and
    small stars (its smaller ones do), which ends in one star a component after
    about log n rounds. Each round is written to the shared folder. The smallest
    neighbour comes from an aggregation with partial sums, so a hot node only
    makes a long run of rows, which a skew join may split. Null nodes are ignored.
    """
    both = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(both, "edges")
    for _ in range(rounds):
        # large star: (larger neighbour, smallest of the neighbourhood)
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = edges.select(F.col("v").alias("c"), "u").join(least.select(F.col("u").alias("c"), "m"), "c").select("u", F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest; now every edge has u > v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # a round that only leaves edges as they were is the last; so many edges as before and none that is new
        settled = now.count() == edges.count() and now.join(edges, ["u", "v"], "left_anti").isEmpty()
        discard(edges)
        edges = now
        if settled:
            break
    else:
        raise RuntimeError("the components didn't settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    centres = stars.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.unionByName(centres)
