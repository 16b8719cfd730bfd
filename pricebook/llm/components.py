"""Connected components of a link table by repeated contraction; every round starts from files in the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.llm.common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of the edges (columns a, b); root is one id of the component, the same for all of it.

    A round points every node at its least neighbour, follows the pointers twice, and relabels the edges; edges
    inside a root vanish. Null ends are no links, a self-link makes its node a component; an empty table gives none.
    """
    e = stored(edges.where("a is not null and b is not null").select("a", "b").distinct(), "cc-edges")
    own = e.select("a", "b")
    root = None
    while True:
        both = own.select("a", "b").union(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "cc-to")
        if to.isEmpty():
            break
        q = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
        to = stored(to.join(q, "p").select("a", F.col("q").alias("p")), "cc-jump")
        if root is None:
            root = to.select(F.col("a").alias("id"), F.col("p").alias("root"))
        else:
            root = stored(root.join(to.select(F.col("a").alias("root"), "p"), "root", "left")
                          .select("id", F.coalesce("p", "root").alias("root")), "cc-root")
        at = to.select(F.col("a"), F.col("p").alias("pa"))
        bt = to.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        own = stored(own.join(at, "a").join(bt, "b").where("pa <> pb")
                     .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-own")
    return root if root is not None else e.select(F.col("a").alias("id"), F.col("b").alias("root"))
