"""Connected components by alternating large-star and small-star.

Both star steps are a minimum per node and a join back on the node, so a hub's neighbours are never gathered, and the
join can be split where a hub is hot. Every round is written to the checkpoint folder, so a lost executor costs one
round. Its steps run in as many tasks as its links need, not as many as the session deals by: an exchange leaves a block
for each pair of tasks, and the rounds' exchanges are many. Self-links and repeated links are allowed; null ends are
ignored; no links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.sources.staging import settle

#: Links of a round that one task takes, at most about; fewer where the cluster has idle cores.
TASK_LINKS = 50_000


def _minima(links: DataFrame) -> DataFrame:
    """Each node of ``u`` with the least of its neighbours ``v`` and itself."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(links: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least of the node's neighbourhood."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_minima(both), "u")
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    """Links the lesser neighbours of a node, and the node, to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    minima = _minima(down)
    joined = down.join(minima, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(minima.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its least node."""
    links = settle(links.filter("u <> v").select("u", "v").distinct())
    idle, count, before = links.sparkSession.sparkContext.defaultParallelism, links.count(), None
    while True:
        tasks = max(idle, -(-count // TASK_LINKS))
        larger = large_star(links.coalesce(tasks)).coalesce(tasks).distinct()
        links = settle(small_star(larger.coalesce(tasks)).coalesce(tasks).distinct().coalesce(tasks))
        # the links and their sums stay the same once every node points to its least node
        now = tuple(
            links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        if now == before:
            break
        count, before = now[0], now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
