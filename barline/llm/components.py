"""Connected components by alternating stars, each round a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """(set_id, component) for every end of ``links`` (a, b): the smallest end reachable.

    A round hangs each node's larger neighbours, then its smaller ones, on the smallest neighbour; it ends when a round
    changes nothing. Minima are aggregated before they meet and hang on by joins, so a node with very many neighbours
    needs no task of its own.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = kept(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("set_id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("set_id"), F.col("v").alias("component")).distinct()
    )
