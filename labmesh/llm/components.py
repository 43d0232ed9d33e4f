"""Connected components by alternating large-star and small-star.

Each round hangs the neighbours of a node on the smallest node among them, until
every component is a star around its smallest node. A node with very many
neighbours never meets them in one task: minima are aggregated before the
shuffle, written, and joined back, and such a join splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.llm.common import stored


def _on_minima(links: DataFrame, minima: DataFrame) -> DataFrame:
    return links.join(stored(minima, "minima"), "u")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: every linked node and the smallest node it can reach.

    Nodes without a link, and links of a node with itself or with NULL, are not
    listed. Repeated links count once.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    proper = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # a hangs on b, the smaller one.
    stars = stored(proper.select(high.alias("a"), low.alias("b")).distinct(), "links")
    before = _state(stars)
    while before[0]:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            stars.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        minima = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            _on_minima(both.filter(F.col("v") > F.col("u")), minima)
            .filter(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stored(large, "large-star")
        minima = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _on_minima(large, minima)
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
            .select(F.col("s.u").alias("a"), F.col("s.m").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        stars = stored(small, "small-star")
        after = _state(stars)
        if after == before:
            break
        before = after
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
