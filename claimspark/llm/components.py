"""Connected components of a link table by alternating star contractions.

Each round replaces every link by links to the smallest neighbour (Kiveris et
al., "Connected Components in MapReduce and Beyond"): the large star connects
larger neighbours to the smallest, the small star the smaller ones.  The table
never grows, hubs are reduced by partial aggregation before the shuffle and
the join with the per-vertex minimum is an ordinary equi-join that adaptive
execution splits when skewed.  Only one row of totals per round reaches the
driver; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import stored


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # stored: as a table of its own it is one side of a join that can be split at a hub
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(links: DataFrame) -> DataFrame:
    links = stored(links, "star-large")
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    rest = links.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest).distinct()


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(u, v) links with u > v -> (node, root): every linked node except the
    roots themselves, with the smallest node of its component.

    Self links and nulls are ignored; repeated links count once; no links give
    an empty table.
    """
    current = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                     .filter("u != v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        totals = current.agg(F.count("*").alias("n"),
                             F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if totals["n"] == 0 or (totals["n"], totals["h"]) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (totals["n"], totals["h"])
        current = stored(_small(_large(current)), "star")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
