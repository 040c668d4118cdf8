"""Connected components of a link table by repeated contraction; nothing is gathered on the driver.

Each round every node takes the smallest of itself and its neighbours as parent (combined before the
shuffle, so a hub with very many links is no hot task), parents are followed to their roots by pointer
jumping, and the links are rewritten between roots. Links inside a component vanish; rounds stop when
none is left. Every round is cut at a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "links")
    roots = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("root"))
        parent = materialize(parent, "parents")
        while True:  # pointer jumping: paths halve each time
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialize(parent.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        lift = lambda e, c: e.join(parent.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")), c)
        edges = materialize(lift(lift(edges, "a"), "b").where("r_a <> r_b").select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).distinct(), "links")
        if roots is None:
            roots = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = materialize(roots.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def spanning_links(links: DataFrame) -> DataFrame:
    """Rows (a, b) of links that span its components: one fewer than a component has nodes.

    Rounds as of components(); each contracted link remembers a link it stands for.
    """
    best = F.min(F.struct("u", "v")).alias("l")
    edges = materialize(links.where("a <> b").select("a", "b").distinct().select("a", "b", F.col("a").alias("u"), F.col("b").alias("v")), "links")
    chosen = edges.where("false").select("u", "v")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v"))
        parent = both.groupBy("a").agg(F.min(F.struct("b", "u", "v")).alias("p")).select(F.col("a").alias("node"), F.least("a", "p.b").alias("root"), "p.u", "p.v")
        parent = materialize(parent, "parents")
        chosen = chosen.unionAll(parent.where("node <> root").select("u", "v"))
        parent = parent.select("node", "root")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialize(parent.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        lift = lambda e, c: e.join(parent.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")), c)
        lifted = lift(lift(edges, "a"), "b").where("r_a <> r_b").select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b"), "u", "v")
        edges = materialize(lifted.groupBy("a", "b").agg(best).select("a", "b", "l.u", "l.v"), "links")
    return chosen.select(F.col("u").alias("a"), F.col("v").alias("b"))
