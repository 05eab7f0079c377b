"""Connected components of an edge table, as joins that never leave Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import hot_keys, salted_join
from lumenfold.session import discard, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v) with u > v.

    Large star: each node points its larger neighbours at its least neighbour.
    Small star: each node points itself and its smaller neighbours there.
    The least neighbour is an aggregate, and the edges of a node with very many
    neighbours are dealt over tasks to meet it.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    counted = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = counted.select("u", F.least("u", "m").alias("m"))
    pointed = salted_join(both, least, ["u"], hot_keys(counted, ["u"]), ["v"])
    if large:
        out = pointed.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pointed.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the least node.

    Alternates large-star and small-star steps, a number of rounds logarithmic
    in the number of nodes; each round's edges are a written table. Null ends
    and loops are ignored; an empty table gives an empty result.
    """
    edges = keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and u > v").distinct(),
        "edges",
    )
    before = None
    while True:
        between = keep(_star(edges, True), "edges")
        edges_next = keep(_star(between, False), "edges")
        discard(edges)
        discard(between)
        edges = edges_next
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
