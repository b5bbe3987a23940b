"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantell.plans.shared import discard, written


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every node of a link that isn't a loop; root is the least node of its component.

    Alternates large-star and small-star passes: each is a partial aggregation and a join on the node, so a hub of
    any degree is split by adaptive skew handling and never gathered in one task. Rows with a null end are ignored;
    an empty table gives an empty result. Raises if ``rounds`` don't suffice; the number needed grows with the
    logarithm of the component's size.
    """
    ends = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(pairs)
        discard(large)
        pairs = after
        now = tuple(pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == before:
            roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
