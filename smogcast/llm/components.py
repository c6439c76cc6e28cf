"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(links: DataFrame) -> DataFrame:
    """Each link with the least node among its ``u`` and the neighbours of ``u``.

    The minimum is combined before the shuffle; the join back is one that Spark
    splits where a hub has most of the links.
    """
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(least, "u")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) for each node of the links (u, v): the smallest node reachable.

    Each round is written to the shared folder, so that a lost executor redoes
    at most one round; only a count and a checksum reach the driver.  Loops,
    repeated links and links with a null end are ignored; no links, no rows.
    """
    links = edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = tables.store(links, "links")
    before, turn = _digest(links), 0
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every link already points from the larger to the smaller node
        near = _with_least(large)
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            near.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        after_links = tables.store(small, f"links{turn}")
        after = _digest(after_links)
        tables.drop("links" if turn == 1 else f"links{turn - 1}")
        links, stable = after_links, after == before
        before = after
        if stable:
            break
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
