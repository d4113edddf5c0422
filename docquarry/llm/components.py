"""Connected components of an edge table, by hooking to the least neighbour and contraction.

Each round maps every vertex to the least vertex it can reach by following least
neighbours, rewrites the edges by that map and drops those that have become
loops, so at least half of the vertices that still have edges go. Rounds are
written to the shared folder; nothing is collected but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): the least id of each vertex's component, for all vertices of the edges.

    Loops make their vertex appear as its own component; edges with a null end are ignored.
    """
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    live = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    result = written(live.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while not live.where("u <> v").isEmpty():
        arcs = live.where("u <> v")
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = table = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("to")), "hooks")
        while True:  # follow the hooks to their roots; they always lead to a lesser vertex
            jump = hook.join(hook.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left")
            jump = written(jump.select("id", "to", F.coalesce("next", "to").alias("next")), "jumps")
            done = jump.where("next <> to").isEmpty()
            discard(table)
            table, hook = jump, jump.select("id", F.col("next").alias("to"))
            if done:
                break
        named = hook.withColumnsRenamed({"id": "component", "to": "_to"})
        before, result = result, written(result.join(named, "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "labels")
        a, b = hook.withColumnsRenamed({"id": "u", "to": "a"}), hook.withColumnsRenamed({"id": "v", "to": "b"})
        left = arcs.join(a, "u").join(b, "v").where("a <> b")
        last, live = live, written(left.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        discard(before, last, table)
    discard(live)
    return result
