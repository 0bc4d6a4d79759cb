"""What references lead to: all that is reached from a start, each once, with the number of steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.shared import cut


#: So many rounds' results lie side by side before they become one table.
PARTS = 12
#: Walks are doubled in length while there are at most so many times the edges.
GROWTH = 4


def _doubled(jump: DataFrame, most: int) -> DataFrame | None:
    """(a, b) of walks of twice the length of those of `jump`, or none if more than `most` walks would meet."""
    ends = jump.groupBy(F.col("b").alias("x")).agg(F.count("*").alias("_in")).join(jump.groupBy(F.col("a").alias("x")).agg(F.count("*").alias("_out")), "x")
    if ends.agg(F.coalesce(F.sum(F.col("_in") * F.col("_out")), F.lit(0))).first()[0] > most:
        return None
    on = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return cut(jump.join(on, "b").select("a", F.col("c").alias("b")).distinct())


def closure(edges: DataFrame, start: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(origin, node, steps): every node that `edges` (a, b) lead to from each node of `start` (node), itself with 0 steps, and the fewest steps to it.

    Each round takes the nodes of the last `stride` steps that many steps further, along walks of that length: whatever is reached in up to that many more steps is met so,
    with its fewest steps. Walks are doubled round by round while they stay few (where each node leads to one other they do, so rounds grow as the logarithm of the steps). What was found before
    is left out, so cycles end; rounds are written, so no plan grows. Null ends of edges are none, repeated edges and starts count once. `most_steps` is where to stop, if anywhere.
    """
    jump = cut(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct())
    found = cut(start.filter(F.col("node").isNotNull()).select(F.col("node").alias("origin"), "node", F.lit(0).alias("steps")).distinct())
    most, parts, steps, stride, doubles = GROWTH * max(1, jump.count()), [found], 0, 1, True
    last = found  # of the steps from steps - stride + 1 on
    while most_steps is None or steps < most_steps:
        met = last.join(jump, F.col("node") == F.col("a")).select("origin", F.col("b").alias("node"), (F.col("steps") + stride).alias("steps"))
        steps += stride
        met = met if most_steps is None else met.filter(F.col("steps") <= most_steps)
        least = met.groupBy("origin", "node").agg(F.min("steps").alias("steps"))
        parts.append(cut(least.join(reduce(DataFrame.unionByName, parts).select("origin", "node"), ["origin", "node"], "left_anti")))
        if parts[-1].filter(F.col("steps") == steps).isEmpty():
            break
        last = parts[-1]
        if doubles and (twice := _doubled(jump, most)) is not None:
            jump, stride, last = twice, 2 * stride, reduce(DataFrame.unionByName, parts)
        else:
            doubles = False
        if len(parts) > PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)
