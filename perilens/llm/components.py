"""Connected components of a link table, by large-star and small-star rounds on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``links`` the smallest node that it reaches.

    Links are kept as (hi, lo). A round first moves every link's low end on to the least node that this end
    sees (large star), then hangs a node's low ends, and the node, on the least of them (small star); a path
    of n nodes takes about log n rounds. Links stay rows and minima combine before the shuffle: nothing gathers
    a node's neighbours, and neither links nor components come to the driver. Links to itself or with a null end
    count for nothing; repeated links count once; an empty table gives an empty one.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = cut_lineage(ends.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    for _ in range(most_rounds):
        # A table of its own for what is joined back: the other side, where one node may have most rows, can then be split.
        least = links.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"))
        low = cut_lineage(links.select("lo").distinct().join(least, F.col("lo") == F.col("k")).select("lo", "m"))
        settled = low.isEmpty()
        large = links if settled else cut_lineage(links.join(low, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct())
        down = cut_lineage(large.groupBy("hi").agg(F.min("lo").alias("m")))
        if settled and down.count() == large.count():  # every node hangs on one that hangs on none
            break
        rest = large.join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut_lineage(down.select("hi", F.col("m").alias("lo")).union(rest).distinct())
    else:
        raise RuntimeError("components did not settle; raise most_rounds")
    members = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
