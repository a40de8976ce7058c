"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, its documents in an order given by a hash of their ids, are packed into blocks of
``BLOCK`` words (the last one shorter). The mix has a fixed number of slots, dealt into output shards of ``SHARD_SLOTS``.
Each source owns a range of numbers as long as its target asks, and a pseudorandom permutation deals these numbers to
the places of all shards. So a shard's source counts are a multinomial draw under the condition that every source's
total over all shards is its target: they spread from shard to shard as drawn counts do, while no source misses its
target. A source's nth slot reads the block to which the source's own permutation of block indexes maps n; after all
blocks have been read once a second pass, with another permutation, begins. Blocks and slots are joined by (source,
block index), which spreads a hot source evenly. A document's taken words are those of its parts in the blocks that
slots read; with them come the number of these slots and the first shard among theirs.

Permutations are swap-or-not shuffles of ``ROUNDS`` keyed rounds: bijections of 0 .. n - 1 for every n.

Prefix sums over a source are made in two steps: its documents are hashed into buckets of about ``ROWS`` rows, summed
inside each bucket, and bucket totals are summed over the source (one row for ``ROWS`` documents). No source is
gathered in one task.

Sizes are counts of ``[^\\x20\\x09-\\x0D]+``; null and empty texts have size 0 and are never taken. A null source is a
source of its own, after all others. Targets: sources in code point order weigh 5, 2, 1, repeating, and share 150 % of
all words; none is above twice its source's words. Since a block is read at most twice, no document exceeds twice its
size. Repeated rows are separate documents. An empty table gives an empty result. Ties in the hash order are broken by
id and size. Extra columns are ignored. Reruns agree, since nothing depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

BLOCK, ROWS, SHARD_SLOTS = 64, 2_000, 256
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
ROUNDS = 10
#: The modulus of the round functions, a prime.
PRIME = 2**31 - 1
#: Slots opened up from one row, and such rows of one task.
RUN, TASK_RUNS = 4096, 16
#: Sources whose table may be broadcast; beyond, a salted join takes its place.
FEW_SOURCES = 50_000


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, src, size, h): h is a hash of the id that orders a source's documents."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    return docs.select(F.col(key).alias("id"), F.col(source).alias("src"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"))


def targets(sized: DataFrame) -> DataFrame:
    """(src, n, no, source_size, target): one row for each source, numbered from 0 in code point order, null last.

    Sharing the excess again and again ends where every source has min(2 * size, level * weight) for one level; the
    sources at their limit are those of least limit for their weight, found by running sums.
    """
    by = sized.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").isNull(), "src")
    by = by.withColumn("no", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("no") % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("cap", F.col("source_size") * MOST)
    whole = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), "no").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("all", F.sum("source_size").over(whole) * SHARE)
    by = by.withColumn("capped", F.coalesce(F.sum("cap").over(up), F.lit(0.0))).withColumn("free_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    level = (F.col("all") - F.col("capped")) / F.col("free_w")
    # the first source, by rising limit, that the level does not exceed
    by = by.withColumn("level", F.min_by(F.when(level * F.col("w") <= F.col("cap"), level), F.when(level * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "no"))).over(whole))
    return by.select("src", "n", "no", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def _known(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its source's row; a small source table is broadcast, a large one joined under salts."""
    known = sources.withColumnRenamed("src", "s")
    same = F.col("src").eqNullSafe(F.col("s"))
    if sources.count() <= FEW_SOURCES:
        return sized.join(F.broadcast(known), same)
    salts = 64
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return sized.join(known, same & (F.pmod("h", F.lit(salts)) == F.col("salt")))


def pack(known: DataFrame) -> DataFrame:
    """(id, no, size, source_size, target, start): each document's first word in its source's stream."""
    rows = known.select("id", "no", "size", "source_size", "target", "h", F.pmod("h", F.ceil(F.col("n") / ROWS)).alias("bucket"))
    totals = rows.groupBy("no", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("no", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("no", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["no", "bucket"]).select("id", "no", "size", "source_size", "target", (F.col("base") + F.col("inside")).alias("start"))


def round_keys(seed: Column, n: Column) -> Column:
    """The keys of the rounds of a permutation of 0 .. n - 1, an array of (k, a, b), from the digests of seed and round."""
    digests = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.md5(F.concat_ws(":", seed.cast("string"), r.cast("string"))))
    part = lambda d, at, k: F.conv(F.substring(d, at, k), 16, 10).cast("long")
    return F.transform(digests, lambda d: F.struct((part(d, 1, 12) % n).alias("k"), (part(d, 13, 7) + 1).alias("a"), part(d, 20, 7).alias("b")))


def permuted(i: Column, n: Column, keys: Column) -> Column:
    """A pseudorandom bijection of 0 .. n - 1: in each round x and (k - x) mod n, partners of each other, swap or not, by
    a keyed bit of the larger one."""

    def swap_or_not(x: Column, key: Column) -> Column:
        partner = (key["k"] + n - x) % n
        top = F.greatest(x, partner)
        y = (top % PRIME * key["a"] + F.shiftright(top, 31) + key["b"]) % PRIME
        return F.when(F.shiftright(y * y % PRIME, 10).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(keys, i.cast("long"), swap_or_not)


def plan(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(no, blocks, slots, part, first): per source its number of blocks, whole slots, the part of a block that one
    more slot takes, and the first slot of its range; sources of size 0 have none."""
    rows = sources.where("source_size > 0").select("no", "source_size", "target", F.ceil(F.col("source_size") / block).alias("blocks"))
    reads = F.least(F.col("target") / F.col("source_size"), F.lit(MOST)) * F.col("blocks")
    rows = rows.withColumn("slots", F.floor(reads).cast("long")).withColumn("part", reads - F.floor(reads))
    before = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("all_slots", F.col("slots") + F.when(F.col("part") > 0, 1).otherwise(0)).withColumn("first", F.coalesce(F.sum("all_slots").over(before), F.lit(0)))


def slots(sources: DataFrame, block: int = BLOCK, per_shard: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, no, nth, block, share): what each slot of each output shard reads; share < 1 for a source's last."""
    p = plan(sources, block).withColumn("total", F.sum("all_slots").over(Window.partitionBy()))
    # runs of a source's slots: one row for RUN of them, opened up after the shuffle, in as many tasks as slots ask
    runs = p.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all_slots") - 1) / RUN))))
    n = p.agg(F.sum(F.ceil(F.col("all_slots") / RUN))).first()[0] or 0
    runs = runs.repartition(max(1, -(-int(n) // TASK_RUNS)), "no", "run")
    runs = runs.withColumn("deal", round_keys(F.lit("deal"), F.col("total"))).withColumn("keys", F.array(*[round_keys(F.concat_ws("-", "no", F.lit(k)), F.col("blocks")) for k in (0, 1, 2)]))

    def slot(nth: Column) -> Column:
        place = permuted(F.col("first") + nth, F.col("total"), F.col("deal"))
        at = permuted(nth % F.col("blocks"), F.col("blocks"), F.col("keys")[F.floor(nth / F.col("blocks")).cast("int")])
        return F.struct(nth.alias("nth"), place.alias("place"), at.alias("block"))

    # slots are made inside a run's row, so that no slot carries the keys
    own = F.transform(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN - 1, F.col("all_slots") - 1)), slot)
    each = runs.select("no", "slots", "part", F.explode(own).alias("s")).select("no", "slots", "part", "s.*")
    share = F.when(F.col("nth") < F.col("slots"), F.lit(1.0)).otherwise(F.col("part"))
    return each.select(F.floor(F.col("place") / per_shard).alias("shard"), (F.col("place") % per_shard).alias("slot"), "no", "nth", "block", share.alias("share"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(id, size, source_size, target, taken, n_slots, first_shard) of every document, repeated rows included."""
    sized = cut(sizes(docs, key, text, source), "sizes")
    sources = cut(targets(sized), "sources")
    known = _known(sized, sources)
    whole = F.col("share") == 1.0
    read = slots(sources, block).groupBy("no", "block").agg(
        F.sum(F.when(whole, 1).otherwise(0)).alias("times"), F.min(F.when(whole, F.col("shard"))).alias("shard"),
        F.max(F.when(~whole, F.col("share"))).alias("part"), F.min(F.when(~whole, F.col("shard"))).alias("part_shard"),
    )
    # the parts of documents in blocks; places in a stream are unique for documents with a word
    parts = pack(known.where("size > 0"))
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    # slots are opened up from a few rows, so Spark takes their number for small: the hint keeps it from broadcasting them
    joined = parts.withColumn("lo", lo).withColumn("hi", hi).join(read.hint("merge"), ["no", "block"], "left")
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    joined = joined.withColumn("some", F.greatest(F.least(F.col("hi"), F.floor(F.coalesce("part", F.lit(0.0)) * length)) - F.col("lo"), F.lit(0)))
    times = F.coalesce("times", F.lit(0))
    words = times * (F.col("hi") - F.col("lo")) + F.col("some")
    out = joined.groupBy("id", "no", "start", "size", "source_size", "target").agg(
        F.sum(words).cast("long").alias("taken"), F.sum(times + (F.col("some") > 0).cast("int")).cast("long").alias("n_slots"),
        F.min(F.least("shard", F.when(F.col("some") > 0, F.col("part_shard")))).alias("first_shard"),
    )
    zero = F.lit(0).cast("long")
    none = known.where("size = 0").select("id", "size", "source_size", "target", zero.alias("taken"), zero.alias("n_slots"), F.lit(None).cast("long").alias("first_shard"))
    return out.select("id", "size", "source_size", "target", "taken", "n_slots", "first_shard").union(none)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """``docs`` as whole documents in the mix: each 0, 1 or 2 times, by its taken words over its size.

    A document that is taken in part is rounded up or down by a hash, up in proportion to its part, so that a source's
    words still come near its target.
    """
    row = "__row_hash"
    name = F.col(key).cast("string")
    # 128 bits stand for a row; the key's length keeps key and text apart
    keyed = docs.withColumn(row, F.md5(F.concat(F.coalesce(F.length(name), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(name, F.lit("")), F.coalesce(F.col(text), F.lit("")))))
    took = mix(keyed, row, text, source, block).groupBy("id").agg((F.sum("taken") / F.sum("size")).alias("__times"))
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col(row)), F.lit(1_000_000)) / 1_000_000
    took = took.where("__times > 0").withColumnRenamed("id", row)
    copies = F.floor(F.col("__times") + chance).cast("int")
    out = keyed.join(took, row).withColumn("__copies", copies).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
