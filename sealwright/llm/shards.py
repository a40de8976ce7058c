"""Extendible hashing into shards of bounded bytes.

A document's place is a string of hash bits. The directory is indexed by hash prefixes: a bucket is a prefix, and only
buckets over the byte limit are split on their next bit, until every bucket fits. The sizes of all prefixes of a few
more bits are summed at once (partial sums before the shuffle), splitting is read off these sums, and only buckets
that are still too large are summed again under longer prefixes. The directory holds leaf prefixes, not rows, and is
joined by equality on a fixed-length prefix; it is not broadcast by hand, since it grows with the data.

The hash is 60 bits of md5 over the key. Rows of equal keys cannot be parted by it; where a bucket of one hash value
is over the limit, its rows go on by 60 bits of md5 over key, size and the row's own number. A single document over the limit
is a shard of its own, marked ``oversized``. Null keys hash as the empty string; null and empty texts have 0 bytes. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS, STEP = 60, 12
LIMIT = 16 << 20


def _bits(x: Column) -> Column:
    """60 hash bits of a string as a string of 0 and 1."""
    digest = F.md5(x)
    word = lambda at: F.lpad(F.bin(F.conv(F.substring(digest, at, 10), 16, 10).cast("long")), 40, "0")
    return F.substring(F.concat(word(1), word(11)), 1, BITS)


def rows_to_place(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, bits) of every document."""
    return docs.select(F.col(key).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), _bits(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("bits"))


def _leaves(sums: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """(prefix, depth) for prefixes of ``end`` bits: the least depth from ``start`` at which the bucket fits, else null."""
    depths = sums.select("prefix", "n_bytes", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth")).withColumn("bucket", F.expr("substring(prefix, 1, depth)"))
    fits = depths.groupBy("depth", "bucket").agg(F.sum("n_bytes").alias("total")).where(F.col("total") <= limit)
    return depths.join(fits, ["depth", "bucket"], "left").groupBy("prefix").agg(F.min(F.when(F.col("total").isNotNull(), F.col("depth"))).alias("depth"))


def place(rows: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """(id, n_bytes, shard, depth, oversized): shard is the leaf's hash prefix, as bits."""
    done, left, start = None, rows, 0
    bits = BITS
    while True:
        end = min(start + step, bits)
        sums = left.groupBy(F.substring("bits", 1, end).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"))
        # one map of leaves for each round: a prefix of `end` bits to its leaf's depth
        leaves = cut(_leaves(sums, start, end, limit), "leaves")
        joined = left.withColumn("prefix", F.substring("bits", 1, end)).join(leaves, "prefix")
        fit = joined.where("depth is not null").select("id", "n_bytes", F.expr("substring(bits, 1, depth)").alias("shard"), "depth", F.lit(False).alias("oversized"))
        done = fit if done is None else done.union(fit)
        if leaves.where("depth is null").isEmpty():
            return done
        left = cut(joined.where("depth is null").select("id", "n_bytes", "bits"), "unplaced")
        if end < bits:
            start = end + 1
            continue
        # buckets of a single hash value: documents over the limit stand alone, rows of equal keys get more bits
        own = left.withColumn("row", F.monotonically_increasing_id())
        own = cut(own.withColumn("bits", F.concat("bits", _bits(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "n_bytes", "row")))), "more-bits")
        alone = own.where(F.col("n_bytes") > limit).select("id", "n_bytes", F.col("bits").alias("shard"), F.length("bits").alias("depth"), F.lit(True).alias("oversized"))
        done = done.union(alone)
        left, start, bits = own.where(F.col("n_bytes") <= limit).drop("row"), bits + 1, bits + BITS
        if left.isEmpty():
            return done


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each document: its shard, the shard's depth in bits and whether it alone is over the limit."""
    return place(rows_to_place(docs, key, text), limit)
