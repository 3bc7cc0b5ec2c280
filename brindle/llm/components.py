"""Connected components of a distributed graph: union-find within batches of edges, then alternating large-star and small-star
steps (Kiveris et al., 2014) between them.

Batches are of bounded size and replace their edges by stars, a pre-aggregation that no hub can outgrow. A step is a partial
aggregation (the least neighbour) and a join with one row per node. The aggregate is written first: a join of two plain
exchanges can be split by Spark where a hub has many edges. Edges stay in the shared folder between steps, those of a past
round are deleted; the driver learns only how many edges are left and whether they are stars. Rounds end when a batch holds all
edges that are left: no task ever unites more than a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, drop, stream_task

MAX_ROUNDS = 60
#: Edges that are united at once.
BATCH = 400_000


def stars(us: list[int], vs: list[int]) -> list[tuple[int, int]]:
    """(node, least node of its component) for each node but the least ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    for u, v in zip(us, vs):
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := find(x)) != x]


def _contract(edges: DataFrame) -> DataFrame:
    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        us, vs = [], []
        for u, v in slices:
            us += u
            vs += v
            if len(us) >= BATCH:
                yield stars(us, vs)
                us, vs = [], []
        yield stars(us, vs)

    return cut(stream_task(edges.filter("u <> v").select("u", "v"), task, "u long, v long"), "edges")


def _settled(edges: DataFrame) -> bool:
    """Each node has one edge to a root, or is a root and has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.filter("up > 1 or up = 1 and down = 1").isEmpty()


def _step(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with the least neighbour m of u (u itself if lesser); and the table of the least neighbours."""
    least = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return edges.join(least, "u"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable. edges: columns u, v; nodes without an edge to another are absent."""
    now = _contract(edges)
    for _ in range(MAX_ROUNDS):
        last = now.count() <= BATCH
        if last:  # what is left is one batch: united at once, it needs no further rounds
            old, now = now, _contract(now.coalesce(1))
            drop(old)
        if last or _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        joined, first = _step(now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        # after a large-star every edge goes to a lesser node
        large = cut(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        joined, second = _step(large)
        old, now = now, _contract(joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).distinct())
        for done in (old, first, large, second):
            drop(done)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
