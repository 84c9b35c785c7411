"""Connected components. Links never leave the cluster.

One algorithm at every size: links are dealt to buckets, first at random, then by their larger
node, and each bucket is solved by itself, which leaves a star around the smallest node of what it
connects; a node with stars in several buckets links their centres; then every link jumps to the
smaller node that its centre is linked to. Rounds go on until nothing moves. A bucket's solve links
all smaller neighbours of a node, and the jump all larger ones, so the number of rounds grows with
the logarithm of the nodes, whatever the shape of the graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links of a bucket, about: 16 bytes each, and as much again a few times over.
BUCKET_LINKS = 50_000


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        np.minimum.at(label, high, low)
        while (label != (further := label[label])).any():
            label = further
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return nodes, nodes[label]


def _stars(links: DataFrame, buckets: int, *by: str) -> DataFrame:
    """The links (a > b) of each bucket as stars."""

    def star(_, table):
        nodes, root = solve(table.column("a").to_numpy(), table.column("b").to_numpy())
        return pa.table({"a": nodes[nodes != root], "b": root[nodes != root]})

    return links.select("a", "b", F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(star, "a long, b long")


def components(links: DataFrame, bucket_links: int = BUCKET_LINKS) -> DataFrame:
    """links (a, b) -> node, root: each node of a link with the smallest node it reaches (roots included). No links give no rows."""
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b"))
    buckets = max(1, -(-links.count() // bucket_links))
    # dealt at random first: after that no node has more links than there are buckets, however many it came with
    links = _stars(links, buckets, "a", "b")
    moved = True
    while moved:
        # a node's centres: no more than there are buckets
        centres = _stars(links, buckets, "a").groupBy("a").agg(F.collect_set("b").alias("s")).select("a", "s", F.array_min("s").alias("m"))
        joined = F.transform("s", lambda x: F.when(x == F.col("m"), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))).otherwise(F.struct(x.alias("a"), F.col("m").alias("b"))))
        links = centres.select(F.explode(joined).alias("l"), (F.size("s") > 1).alias("several")).select("l.a", "l.b", "several")
        jump = centres.select(F.col("a").alias("x"), F.col("m").alias("y"))
        links = links.join(jump, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"), (F.col("several") | F.col("y").isNotNull()).alias("moved"))
        links = cut(links)
        moved = bool(links.agg(F.max("moved")).first()[0])
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
