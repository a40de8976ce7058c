"""Identity, chunk, dataset, group and content digests, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import NUL, sha256, text_of
from ..functions.tables import cut
from ..model import product_types

def identity(product: Column | str, *inputs: Column | str) -> Column:
    """``sha256:`` and the digest of the product type and its identity inputs, joined by NUL."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (product, *inputs)]
    return F.concat(F.lit("sha256:"), sha256(F.concat_ws(NUL, *map(text_of, cols))))


def identity_by_product(product: str = "product") -> Column:
    """The identity under the rule of each row's own product type; null for an unknown type."""
    out = F.lit(None).cast("string")
    for name, kind in product_types().items():
        out = F.when(F.col(product) == name, identity(product, *kind.identity)).otherwise(out)
    return out


def algorithm(seal: Column) -> Column:
    return F.split_part(seal, F.lit(":"), F.lit(1))


def hex_digest(seal: Column) -> Column:
    return F.split_part(seal, F.lit(":"), F.lit(2))


def short_id(seal: Column, digits: int = 8) -> Column:
    return F.substring(hex_digest(seal), 1, digits)


def collisions(df: DataFrame, seal: str, digits: int = 8) -> DataFrame:
    """Short ids that more than one full id has."""
    return df.groupBy(short_id(F.col(seal), digits).alias("short_id")).agg(F.count_distinct(seal).alias("n_ids")).where("n_ids > 1")


def chunk_index(position: list[Column], counts: list[int]) -> Column:
    """Row-major ordinal of a chunk from its place on each axis and the number of chunks on each axis."""
    out = position[0]
    for p, n in zip(position[1:], counts[1:]):
        out = out * n + p
    return out


def chunk_hash(data: Column) -> Column:
    """Digest of a chunk's bytes as stored, an edge chunk at its actual extent."""
    return sha256(data)


def joined(order: str, digest: str) -> Column:
    """The ordered concatenation of digests, as hex."""
    return F.expr(f"listagg({digest}, '') within group (order by {order})")


def rolled(order: str, digest: str) -> Column:
    """Digest of the ordered concatenation of raw digests."""
    return sha256(F.unhex(joined(order, digest)))


def dataset_hash(chunks: DataFrame, keys: list[str], order: str, digest: str, out: str = "dataset_hash") -> DataFrame:
    """One digest for each dataset from its chunk digests; chunk rows are hashed where they are scanned."""
    return chunks.groupBy(*keys).agg(rolled(order, digest).alias(out))


def attribute_hash(attrs: DataFrame, keys: list[str], key: str = "key", value: str = "value", out: str = "attr_hash") -> DataFrame:
    """Digest of a node's attributes: one digest for each key and canonical value, rolled up by key, without the seal."""
    own = attrs.where(F.col(key) != "content_hash").withColumn("__h", sha256(F.concat(F.col(key), text_of(F.col(value)))))
    return own.groupBy(*keys).agg(rolled(key, "__h").alias(out))


def children_of(nodes: DataFrame, parent: list[str], name: str, digest: str, out: str = "children", hardened: bool = False) -> DataFrame:
    """The digests of each group's children in name order, joined; companions of chunk digests are left out.

    ``hardened`` also hashes each child's name, so that a renaming which keeps the order shows.
    """
    rows = nodes.where(~F.endswith(F.col(name), F.lit("_chunk_hashes")))
    if hardened:
        rows = rows.withColumn(digest, sha256(F.concat(F.col(name), F.lit(NUL), F.col(digest))))
    return rows.groupBy(*parent).agg(joined(name, digest).alias(out))


def group_hash(attr_hash: Column, children: Column) -> Column:
    """Digest of a group: its attributes' digest, then its children's digests in name order; either may be absent."""
    return sha256(F.unhex(F.concat(F.coalesce(attr_hash, sha256(F.lit(""))), F.coalesce(children, F.lit("")))))


def tree_hash(nodes: DataFrame, hardened: bool = False) -> DataFrame:
    """(product_id, content_hash) from nodes (product_id, path, parent, name, depth, kind, attr_hash, dataset_hash).

    Works from the deepest level up: a level's digests are joined by parent and matched with that level's groups, one
    shuffle by (product, parent) for each level. A group without attributes counts the empty digest for them.
    """
    nodes = cut(nodes, by=("depth",))  # nodes are made once, and each level reads its own
    deepest = nodes.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is not None:
            level = level.join(children_of(below, ["product_id", "parent"], "name", "h", hardened=hardened).withColumnRenamed("parent", "path"), ["product_id", "path"], "left")
        else:
            level = level.withColumn("children", F.lit(None).cast("string"))
        data = F.col("dataset_hash")
        if hardened:
            data = sha256(F.unhex(F.concat(F.coalesce("attr_hash", sha256(F.lit(""))), "dataset_hash")))
        below = level.select("product_id", "parent", "name", F.when(F.col("kind") == "dataset", data).otherwise(group_hash(F.col("attr_hash"), F.col("children"))).alias("h"))
    if below is None:
        return nodes.select("product_id", F.lit("").alias("content_hash")).limit(0)
    return below.select("product_id", F.concat(F.lit("sha256:"), sha256(F.unhex("h"))).alias("content_hash"))


def verify(recomputed: DataFrame, stored: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Every key of either side with both digests and whether they agree."""
    a = recomputed.select(*keys, F.col(digest).alias("computed"))
    b = stored.select(*keys, F.col(digest).alias("stored"))
    return a.join(b, keys, "full").withColumn("ok", F.coalesce(F.col("computed") == F.col("stored"), F.lit(False)))


def version_diff(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Nodes added, removed or changed between two versions."""
    a, b = old.select(*keys, F.col(digest).alias("old")), new.select(*keys, F.col(digest).alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, keys, "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, state.alias("state"))


def unique_by_content(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """For each content the smallest key and the number of copies."""
    return df.groupBy(digest.alias("content_hash")).agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("copies"))


def chunk_hash_policy(n_bytes: Column, remote_or_archived: Column) -> Column:
    """Whether chunk digests are advised: above 100 MB, for remote access or long-term archives; else they do not pay."""
    return F.when(n_bytes > 100_000_000, "large").when(remote_or_archived, "access").otherwise("skip")
