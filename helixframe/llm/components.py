"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, settle

_EDGES_PER_FILE = 200_000


def components(edges: DataFrame, files: int = 8) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges u, v.

    ``files`` bounds the first file count; later ones follow the edges.

    Edges are written to the shared folder after each round, which cuts lineage;
    only a count and a checksum come to the driver, to see that nothing changed.
    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    now, before, written = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), None, []
    while True:
        now = settle(now, "stars", files)
        written += now.inputFiles()[:1]
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 24)), F.bit_xor(F.xxhash64("u", "v"))).first())
        # What this round was made from is read no more.
        discard(now.sparkSession, *(f.rsplit("/", 1)[0] for f in written[:-1]))
        written = written[-1:]
        if state == before:
            break
        before = state
        files = 1 + state[0] // _EDGES_PER_FILE
        # The centre of a large star is a hot key.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_hot(both, least, ["u"], "v", 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = join_hot(large, least, ["u"], "v", 2 * state[0]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
