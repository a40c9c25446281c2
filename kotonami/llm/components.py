"""Connected components of a link table, by alternating large-star and small-star steps.

Each step hangs every node's larger (or smaller) neighbours onto its smallest one; after a number
of rounds that grows with the logarithm of the longest path, all nodes hang on their component's
smallest id. Minima are pre-aggregated before the shuffle, so a node with very many links is no
hot spot, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (src, dst), src > dst."""
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("least"))
    least = least.select("src", F.least("src", "least").alias("least"))
    large = (
        both.join(least, "src")
        .where("dst > src")
        .select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        .where("src != dst")
        .distinct()
    )
    least = large.groupBy("src").agg(F.min("dst").alias("least"))
    joined = large.join(least, "src")
    moved = joined.where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(joined.select("src", F.col("least").alias("dst"))).distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(id, component) of every node of ``links`` (a, b); the component is its smallest node."""
    now = common.staged(
        links.where("a != b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(),
        f"components-{label}",
    )
    state = None
    while True:
        seen = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
        ).first()
        if seen == state:
            break
        state = seen
        now = common.staged(_stars(now), f"components-{label}")
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(
        now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    )
