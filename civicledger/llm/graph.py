"""Connected groups of linked rows, by DataFrame operations alone."""

from pyspark.sql import functions as F

from civicledger.session import stored


def _stars(edges):
    """One large-star and one small-star step: every row's neighbours move to the least row known to be in its group.

    Least neighbours are found by a map-side combined minimum and joined back, so a row with very many neighbours is no group of its own.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a")
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(edges):
    """Whether every node either points at one root only, or is a root that nothing else points on from."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = edges.select(F.col("a").alias("node"), one.alias("points"), none.alias("root")).union(edges.select("b", none, one))
    return ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("root").alias("root")).where("points > 1 or points = 1 and root = 1").limit(1).count() == 0


def components(links):
    """(node, component) of every node that occurs in links (a, b); the component is its least node. Nodes are numbers."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(edges):
        edges = stored(_stars(edges), "links")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
