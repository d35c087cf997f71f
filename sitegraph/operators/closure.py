"""Spider closure: every URL reachable from the start URLs over the link graph.

A breadth-first fixpoint driven from the driver (the loop only decides
whether to go on; the data never leaves the executors):

* the distinct edges are checkpointed once, as (source, target) pairs; each round joins
  the (small) frontier with them, and a hub source is split by the skew join;
* each round's new frontier = targets of the frontier minus everything seen
  (a ``left_anti`` join), de-duplicated;
* every round's new URLs are cut from their lineage with a reliable
  ``checkpoint()`` into the shared checkpoint folder.  The seen set is one
  frame plus the rounds since; every MERGE rounds they become one
  checkpointed frame again, so a long chain neither re-plans nor re-reads
  hundreds of small frames, and a lost executor re-reads checkpoint files;
* it stops when a round adds nothing (``isEmpty``): the fixpoint is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.session import checkpoint_root


#: Rounds after which the seen set is merged into one frame.
MERGE = 8


def spider_closure(edges: DataFrame, start: DataFrame, key: str = "url", src: str = "url_from",
                   dst: str = "url_to") -> DataFrame:
    """(key, depth): reachable keys with their BFS depth (start keys at 0)."""
    checkpoint_root(edges.sparkSession)
    adj = edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst")).distinct().checkpoint()
    frontier = start.select(F.col(key).alias("_src")).distinct().checkpoint()
    seen = [frontier.select(F.col("_src").alias(key), F.lit(0).alias("depth"))]
    depth = 0
    while True:
        depth += 1
        known = reduce(DataFrame.unionByName, seen).select(key)
        found = frontier.join(adj, "_src").select(F.col("_dst").alias(key)).distinct()
        new = found.join(known, key, "left_anti").checkpoint()
        if new.isEmpty():
            return reduce(DataFrame.unionByName, seen)
        seen.append(new.select(key, F.lit(depth).alias("depth")))
        if len(seen) > MERGE:
            seen = [reduce(DataFrame.unionByName, seen).checkpoint()]
        frontier = new.select(F.col(key).alias("_src"))
