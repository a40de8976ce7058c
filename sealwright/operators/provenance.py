"""The provenance graph: edges from products to their sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import cut


class SourceNotFoundError(LookupError):
    """A source can be found neither by its link nor by its id."""


def sources_of(edges: DataFrame, products: DataFrame) -> DataFrame:
    """Direct sources of products, with their roles."""
    return products.select("product_id").join(edges, "product_id")


def closure(edges: DataFrame) -> DataFrame:
    """(from, to, steps): every node that others lead to, with the fewest steps, in as many rounds as steps have bits.

    edges: (from, to). A shortest path of more than h and up to 2 h steps is one of h steps followed by one of up to h.
    Each round's pairs are cut from their lineage; a cycle adds no pairs and ends.
    """
    pairs = cut(edges.select("from", "to").where(~F.col("from").eqNullSafe(F.col("to"))).distinct().withColumn("steps", F.lit(1)))
    h = 1
    while True:
        half = pairs.where(F.col("steps") == h)
        if half.isEmpty():
            return pairs
        rest = pairs.select(F.col("from").alias("via"), F.col("to").alias("end"), F.col("steps").alias("more"))
        longer = half.join(rest, half["to"] == rest["via"]).where(F.col("from") != F.col("end"))
        longer = longer.select("from", F.col("end").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        pairs = cut(pairs.union(longer).groupBy("from", "to").agg(F.min("steps").alias("steps")))
        h *= 2


def walk(edges: DataFrame, start: DataFrame, most: int = 1000) -> DataFrame:
    """(start, node, steps): every node reached from each start, with the fewest steps.

    edges: (from, to). Where a quarter of the nodes or more are starts, all pairs are found in a few rounds
    (:func:`closure`). Else there is one join for each level, over that level's new pairs only, so a cycle ends the walk
    instead of running on; each level is cut from its lineage.
    """
    edges = edges.select("from", "to").distinct()
    front = cut(start.select(F.col("start"), F.col("start").alias("node")).distinct().withColumn("steps", F.lit(0)))
    if 4 * front.count() >= edges.select("from").distinct().count():
        found = closure(edges).withColumnRenamed("from", "start").withColumnRenamed("to", "node")
        return front.union(found.join(front.select("start"), "start", "left_semi").select("start", "node", "steps"))
    seen = front
    for n in range(1, most + 1):
        reached = front.join(edges, F.col("node") == F.col("from")).select("start", F.col("to").alias("node")).distinct()
        front = cut(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("steps", F.lit(n)))
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    raise RuntimeError(f"a path of more than {most} steps")


def ancestry(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The complete tree of sources; edges: (product_id, source_id), start: (product_id)."""
    e = edges.select(F.col("product_id").alias("from"), F.col("source_id").alias("to"))
    return walk(e, start.select(F.col("product_id").alias("start"))).where("steps > 0")


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything that was made from a product, directly or not."""
    e = edges.select(F.col("source_id").alias("from"), F.col("product_id").alias("to"))
    return walk(e, start.select(F.col("product_id").alias("start"))).where("steps > 0")


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes on or above a cycle: what is left after nodes without remaining sources are removed again and again.

    edges: (product_id, source_id). Each round first leads edges to a node of one source on to that source, which halves
    chains and changes nothing about what reaches a cycle, then keeps the edges whose source still has sources. The graph
    is a DAG if none is left.
    """
    left = cut(edges.select("product_id", "source_id").where("product_id is not null and source_id is not null").distinct())
    while True:
        single = left.groupBy("product_id").agg(F.min("source_id").alias("next"), F.max("source_id").alias("last")).where("next = last")
        single = single.select(F.col("product_id").alias("source_id"), "next")
        left = cut(left.join(single, "source_id", "left").select("product_id", F.coalesce("next", "source_id").alias("source_id")).distinct())
        open_ = left.select(F.col("product_id").alias("source_id")).distinct()
        kept = cut(left.join(open_, "source_id", "left_semi").select("product_id", "source_id"))
        n, m = left.count(), kept.count()
        left = kept
        if m == n:
            return left.select("product_id").distinct()


def resolve(edges: DataFrame, paths: DataFrame, manifest: DataFrame, hook: Column | None = None) -> DataFrame:
    """Where each source is: where a hook says (an expression of the edge), else by its link if that path exists, else by
    its id in the manifest, else null.

    edges: (product_id, source_id, hint); paths: (path); manifest: (source_id, path).
    """
    edges = edges.withColumn("__said", F.lit(None).cast("string") if hook is None else hook)
    found = edges.join(paths.select(F.col("path").alias("hint"), F.lit(True).alias("there")), "hint", "left")
    by_id = found.join(manifest.select("source_id", F.col("path").alias("by_id")), "source_id", "left")
    said = F.col("__said")
    how = F.when(said.isNotNull(), "hook").when(F.col("there"), "link").when(F.col("by_id").isNotNull(), "manifest").otherwise("not_found")
    path = F.when(said.isNotNull(), said).when(F.col("there"), F.col("hint")).otherwise(F.col("by_id"))
    return by_id.select("product_id", "source_id", path.alias("path"), how.alias("how"))


class Resolver:
    """Resolution on the driver with hooks that are asked first, in the order in which they were added."""

    def __init__(self, links: dict[str, str], manifest: dict[str, str]):
        self.links, self.manifest, self.hooks = links, manifest, []

    def register(self, hook: Callable[[str], str | None]) -> None:
        self.hooks.append(hook)

    def __call__(self, source_id: str) -> str:
        for look in (*self.hooks, self.links.get, self.manifest.get):
            if (path := look(source_id)) is not None:
                return path
        raise SourceNotFoundError(source_id)


def stale_links(edges: DataFrame, paths: DataFrame, manifest: DataFrame) -> DataFrame:
    """Edges whose link is broken though the manifest knows the id."""
    return resolve(edges, paths, manifest).where("how = 'manifest'")


def roots(products: DataFrame, edges: DataFrame) -> DataFrame:
    """Products without sources."""
    return products.join(edges.select("product_id"), "product_id", "left_anti")


def history(products: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Versions of an id in the order of time, with the version before each."""
    w = Window.partitionBy(key).orderBy(*order)
    return products.withColumn("version", F.row_number().over(w)).withColumn("previous", F.lag(order[-1]).over(w))


def changed_sources(edges: DataFrame, products: DataFrame) -> DataFrame:
    """Edges whose recorded digest is not the source's present one (or whose source is gone)."""
    now = products.select(F.col("product_id").alias("source_id"), F.col("content_hash").alias("present"))
    return edges.join(now, "source_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("present")))
