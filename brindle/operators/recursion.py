"""WITH RECURSIVE. UNION ALL is Spark's own; UNION (with duplicate removal) is a loop over frontiers here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from brindle.plans.lineage import cut

MAX_ROUNDS = 1000


class RecursionLimit(RuntimeError):
    """More rounds than allowed; rows are never cut off silently."""


def recursive_union(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rows reachable from anchor by step, each once. Every round is written to the shared folder, so that neither the lineage
    nor a lost executor's blocks matter; NULLs count as equal, as in UNION."""
    seen = cut(anchor.distinct())
    frontier = seen
    for _ in range(max_rounds):
        new = step(frontier).toDF(*seen.columns)
        frontier = cut(new.subtract(seen))
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)
    raise RecursionLimit(f"the recursion did not end within {max_rounds} rounds")
