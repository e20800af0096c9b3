"""Connected components of an undirected link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.tables import Workspace


def _star(links: DataFrame, *, large: bool) -> DataFrame:
    """large: every greater neighbour of u is linked to the least of u and its neighbours; small: every lesser neighbour, and u, are.

    The least neighbour is a pre-aggregated minimum, and the join with it can be split by adaptive execution,
    so a vertex with a large share of all links is no single task's work.
    """
    if large:
        arcs = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = arcs.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): for every end of a link the least id that links reach. Ids on no link are left out; null ends are ignored.

    Every round is written to the shared folder and read again, so a lost executor never costs more than one round.
    """
    work = Workspace(links.sparkSession)
    links = work.save(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "0")
    step = 0
    while True:
        step += 1
        links = work.save(_star(_star(links, large=True), large=False), str(step))
        work.drop(str(step - 1))
        # done when every link ends in the centre of a star: no lesser end has a link to a still lesser one
        if links.select("v").join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select(F.col("v"), F.col("v")).distinct())
