"""Connected components of a graph given as links, by alternating large and small stars.

Each round replaces links by links to the smallest neighbour, first among larger, then among
smaller vertices; it ends when every vertex is linked to its component's smallest vertex. The
number of rounds grows with the logarithm of a component's width, links never multiply, and
minima are combined before they are shuffled. Rounds are written to the shared folder, and a
round goes when the next one is there.

Defined results: links of a vertex to itself and repeated links count once or not at all; a link
with a null end is left out; no links give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, settle_at, work_dir


def large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    found = down.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
    return found.where("a != b").distinct()


def roots(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """a, b of every vertex a that is not the smallest of its component, which is b. links: a, b (long)."""
    # links are distinct; a sum of hashes would overflow
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    spark = links.sparkSession
    path = work_dir(spark, "links")
    links = settle_at(links.where("a != b").select("a", "b").distinct(), path)
    seen = mark(links)
    for _ in range(most_rounds):
        if not seen[0]:
            return links
        before, path = path, work_dir(spark, "links")
        links = settle_at(small_star(large_star(links)), path)
        discard(spark, before)
        if (now := mark(links)) == seen:
            return links
        seen = now
    raise RuntimeError("the components did not settle")
