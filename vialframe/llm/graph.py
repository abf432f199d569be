"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the remaining edges and is
written to the shared folder, so nothing is collected and no lineage grows. Only
a row count and a checksum per round reach the driver. The edges of a star's centre
are dealt by their other ends (``salted_join``), so a centre of any size is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, salted_join


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of the component (64-bit integers).

    Self links and repeated links are allowed; nulls are dropped. Raises if ``rounds`` are not enough.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: each node hands its larger neighbours to its smallest one
        both = _both(edges)
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = salted_join(both, low, ["u"], "v", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node hands itself and its smaller neighbours to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            salted_join(large, small_low, ["u"], "v", 2 * state[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        following = materialise(small, "edges")
        discard(edges)
        edges, before, state = following, state, _state(following)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
