"""Connected components of a link table, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import blocks_for, drop, written

#: Links per task of a round; fewer links take fewer tasks.
ROWS = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of a link; the component is its smallest id.

    Alternating large-star and small-star steps: every node points its larger neighbours, then its smaller ones, at the
    smallest node it knows, until nothing changes. Each step is two grouped minima and joins on ids, so a node with a
    third of all links is merged before the shuffle. The minima are written before they are joined: both sides of a join
    are then bare shuffles, which adaptive execution splits at hot nodes. No group is ever gathered. Every round is cut by
    a table in the shared folder, and the tables before it are deleted. Links are undirected; repeats and self-links are harmless, links with
    a null end are left out, and no links give an empty table.
    """
    ends = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull()))
    edges = written(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        few = edges if mark is None else edges.coalesce(blocks_for(mark[0], ROWS))
        both = few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(down.select("u", F.col("m").alias("v")).unionByName(small).where("u <> v").distinct())
        drop(before, least, large)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    found = edges.groupBy("u").agg(F.min("v").alias("m"))
    nodes = ends.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    named = written(nodes.join(found, nodes["id"] == found["u"], "left").select("id", F.coalesce("m", "id").alias("component")))
    drop(ends, edges)
    return named
