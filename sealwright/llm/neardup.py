"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are runs of letters and digits, lower-cased (of a text without any, its runs of non-blank characters). Every
five words in a row are a k-mer (a text of fewer words is one k-mer). For the sketches a k-mer is labelled with how
often the same one came before in the text. Each of ``SKETCHES`` sketches takes the ``PICKS`` labelled k-mers that are
least under its own hash and keeps them in text order, so texts share a sketch when they share k-mers in the same
order: that follows edit similarity, not just overlap. Texts that share a sketch are candidates. A candidate pair is
linked if the edit distance d of the two k-mer sequences, found by an alignment in a band of diagonals, gives
1 - d / max(length) >= ``SIMILARITY``, as it does for a Jaccard similarity of 0.8 in the same order.

Sketches of few k-mers are all or nothing, so texts of up to ``SHORT`` k-mers are found exactly: n of them have
floor(0.2 n) + 1 entries, their labelled k-mers that are least by hash. Linked sequences differ in at most
floor(0.2 max(length)) labelled k-mers, so they share one of these. Texts that may be linked to one of more than
``SHORT`` k-mers (0.8 ``SHORT`` and more) have sketches as well.

Classes are the connected components of links, named by their smallest doc_id.

No group is expanded into all pairs. Texts with the same words are one node. In each sketch bucket all nodes are
first compared with one leader, in a second round with another, so a large group of near copies costs a few
comparisons a node. Nodes of a bucket that are still in different classes are then compared by an exact filter: of
two linked sequences of n k-mers and more, the shorter list of n - ceil(0.8 n) + 1 rarest ones must share one with that
of the other, so only nodes that share a rare k-mer are aligned, and of these only pairs whose lists have, from that
k-mer on, as many left as linked sequences share (which their lengths must allow too; it holds at the first k-mer that
linked sequences share). Texts that merely share a long passage do not, and no linked pair is left out. Nothing is
collected to the driver; each round's tables are written to the shared folder.

Null texts and texts without a word are never linked: each row is its own class, named by its doc_id. Null doc_ids
take part but do not name a class, unless all its ids are null. Repeated rows are in one class. An empty table gives
an empty result. Only the key and the text are read; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, release

K = 5
SKETCHES = 40
PICKS = 5
SHORT = 40
SIMILARITY = 0.8
LEADER_ROUNDS = 2

_word = re.compile(r"\w+")
_odd = np.random.default_rng(20240607).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_places = _odd[:PICKS] * np.uint64(0x9E3779B97F4A7C15)
_mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

NODE = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])


def words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return _word.findall(low) or low.split()


class _Hashes(dict):
    """A 64-bit hash of each word, kept while the worker lives (about 10 MB of words at most)."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 50_000:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return v


_hashes = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))


def plain_kmers(w: np.ndarray) -> np.ndarray:
    """Hashes of all k-mers in text order."""
    if len(w) < K:
        return np.array([np.bitwise_xor.reduce(_mix(w + np.arange(1, len(w) + 1, dtype=np.uint64)))], np.uint64)
    m = len(w) - K + 1
    h = np.zeros(m, np.uint64)
    for i in range(K):
        h += w[i : i + m] * _mult[i]
    return _mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that also tell how many equal ones come before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return h
    m = len(h)
    first = np.concatenate([[0], np.flatnonzero(~same) + 1])
    occurrence = np.empty(m, np.uint64)
    occurrence[order] = (np.arange(m) - np.repeat(first, np.diff(np.append(first, m)))).astype(np.uint64)
    return np.where(occurrence > 0, _mix(h + occurrence * np.uint64(0x9E3779B97F4A7C15)), h)


def kmers(w: np.ndarray) -> np.ndarray:
    return labelled(plain_kmers(w))


def _most_edits(n: int, similarity: float) -> int:
    """The most edits between linked sequences of which the longer has n elements."""
    return int(np.floor((1 - similarity) * n + 1e-9))


def sketches(w: np.ndarray) -> np.ndarray:
    """One value for each sketch: its least k-mers, in text order; of a short text the exact entries (see above)."""
    h = kmers(w)
    exact = np.empty(0, np.int64)
    if len(h) <= SHORT:
        exact = _mix(np.sort(h)[: _most_edits(len(h), SIMILARITY) + 1] + np.uint64(0x94D049BB133111EB)).view(np.int64)
    if len(h) + _most_edits(SHORT + 1, SIMILARITY) <= SHORT:
        return exact
    take = min(PICKS, len(h))
    if len(h) > take:
        # a key's low bits hold its place in the text, so that one partial sort finds the least keys and their places
        bits = np.uint64(max(20, int(len(h)).bit_length()))
        keys = ((h[None, :] * _odd[:, None]) >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        at = (np.partition(keys, take - 1, axis=1)[:, :take] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        at.sort(axis=1)
    else:
        at = np.broadcast_to(np.arange(len(h)), (SKETCHES, len(h)))
    mixed = (h[at] * _places[:take]).sum(axis=1, dtype=np.uint64)
    made = _mix(mixed + np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    return np.concatenate([made, exact])


def _digest(w: np.ndarray) -> bytes:
    return hashlib.blake2b(w.tobytes(), digest_size=16).digest()


@F.pandas_udf(NODE)
def _node(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        w = word_hashes(t)
        if len(w):
            rows.append((_digest(w), sketches(w)))
        else:
            rows.append((None, None))
    return pd.DataFrame(rows, columns=NODE.names)


SEQUENCE = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("seq", T.BinaryType())])


@F.pandas_udf(SEQUENCE)
def _sequence(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        w = word_hashes(t)
        rows.append((_digest(w), sequence(w).tobytes() if len(w) else b""))
    return pd.DataFrame(rows, columns=SEQUENCE.names)


def sequence(w: np.ndarray) -> np.ndarray:
    """The k-mers of a text, 32 bits each: what is aligned."""
    return (plain_kmers(w) >> np.uint64(32)).astype(np.uint32)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _tokens(seqs: pd.Series) -> pd.Series:
    return pd.Series([labelled(_mix(np.frombuffer(x, np.uint32).astype(np.uint64))).view(np.int64) for x in seqs], dtype=object)


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most ``most``: rows of the alignment within ``most`` diagonals of the main one."""
    n, m = len(a), len(b)
    width, big = 2 * most + 1, np.int64(1 << 40)
    offsets = np.arange(width)
    padded = np.full(m + 2 * width + n + 2, -1, np.int64)
    padded[width : width + m] = b
    row = np.full(width, big)
    row[most:] = np.arange(most + 1)  # row 0; the cell at offset o of row i is column i - most + o
    row[most + m + 1 :] = big
    for i in range(1, n + 1):
        j0 = i - most
        lo, hi = max(0, -j0), min(width, m - j0 + 1)
        if hi <= lo:
            return False
        cand = row + (padded[width + j0 - 1 : 2 * width + j0 - 1] != a[i - 1])
        cand[:-1] = np.minimum(cand[:-1], row[1:] + 1)
        if j0 <= 0:
            cand[lo] = i  # column 0
        cand[:lo] = big
        cand[hi:] = big
        row = np.minimum.accumulate(cand - offsets) + offsets
        row[:lo] = big
        row[hi:] = big
        if row.min() > most:
            return False
    at = m - n + most
    return 0 <= at < width and row[at] <= most


def _anchored(a: np.ndarray, b: np.ndarray) -> int:
    """The cost of one alignment: elements that are unique in both, the longest run of them in the same order, and
    between two of these the longer gap. Never below the edit distance."""
    ua, ia, na = np.unique(a, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(b, return_index=True, return_counts=True)
    ua, ia, ub, ib = ua[na == 1], ia[na == 1], ub[nb == 1], ib[nb == 1]
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    i, j = ia[x], ib[y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if (np.diff(j) < 0).any():
        tops: list[int] = []
        ends: list[int] = []
        before = [-1] * len(j)
        for k, v in enumerate(j.tolist()):
            at = bisect_left(tops, v)
            before[k] = ends[at - 1] if at else -1
            tops[at : at + 1], ends[at : at + 1] = [v], [k]
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(k)
            k = before[k]
        i, j = i[chain[::-1]], j[chain[::-1]]
    i, j = np.concatenate([[-1], i, [len(a)]]), np.concatenate([[-1], j, [len(b)]])
    return int(np.maximum(np.diff(i) - 1, np.diff(j) - 1).sum())


def near(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - d / max(len) >= similarity for the edit distance d of two sequences."""
    longest = max(len(a), len(b))
    most = _most_edits(longest, similarity)
    if abs(len(a) - len(b)) > most:
        return False
    short = min(len(a), len(b))
    diff = np.flatnonzero(a[:short] != b[:short])
    head = int(diff[0]) if len(diff) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    if not short:
        return max(len(a), len(b)) <= most
    diff = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(diff[0]) if len(diff) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= most:
        return True
    if not min(len(a), len(b)):
        return False
    # what the longer one has and the other lacks takes an edit each
    both, side = np.unique(np.concatenate([a, b]), return_inverse=True)
    shared = int(np.minimum(np.bincount(side[: len(a)], minlength=len(both)), np.bincount(side[len(a) :], minlength=len(both))).sum())
    if max(len(a), len(b)) - shared > most:
        return False
    if _anchored(a, b) <= most:
        return True
    band = min(most, 64)
    while True:
        if _banded(a.astype(np.int64), b.astype(np.int64), band):
            return True
        if band == most:
            return False
        band = min(most, 4 * band)


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a, b)], dtype=bool)


def _joined(rows: DataFrame, summary: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the row of an aggregate by ``key``, so that hot keys of ``rows`` can be split.

    Spark would join in the aggregate's own partitions, and it splits only joins of two plain shuffles. Under an
    equal key of another name the aggregate, one row a key, gets a shuffle of its own.
    """
    other = summary.withColumn("__key", F.greatest(key, key)).drop(key)
    return rows.join(other, rows[key] == other["__key"], how).drop("__key")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, root), root the least node of each.

    Large-star and small-star steps in turn (each a shuffle of the edges) until nothing changes; a star or a chain is
    flat after a few rounds, log(n) in general. Each round's edges are written to the shared folder.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        return _joined(both, low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("low"))
        out = _joined(e, low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    def downward(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    now, before = cut(downward(edges).where("a <> b").distinct(), "edges"), None
    while True:
        new = cut(small(downward(large(now))), "edges")
        said = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(now)
        now = new
        if said == before:
            break
        before = said
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _verified(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The pairs (a, b) that the alignment links; a sequence travels to the pairs it is in."""
    left = seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa"))
    right = seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", _near.asNondeterministic()("sa", "sb").alias("linked")).where("linked").select("a", "b")


def _links(entries: DataFrame, seqs: DataFrame) -> DataFrame | None:
    """(node, root) of all nodes that a verified link joins to another; entries: (bucket, node)."""
    roots, tested = None, None

    def placed() -> DataFrame:
        if roots is None:
            return entries.withColumn("root", F.col("node"))
        return entries.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))

    def test(pairs: DataFrame) -> bool:
        """Align pairs not aligned yet and merge the classes they link; whether there were any."""
        nonlocal roots, tested
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return False
        tested = pairs if tested is None else tested.union(pairs)
        links = cut(_verified(pairs, seqs), "links")
        if not links.isEmpty():
            known = roots
            roots = cut(components(links if known is None else links.union(known.toDF("a", "b"))), "roots")
        return True

    for r in range(LEADER_ROUNDS):
        now = placed()
        lead = now.groupBy("bucket").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(r))).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        lead = lead.where("lo < hi").select("bucket", F.col("lead.node").alias("a"), F.col("lead.root").alias("lead_root"))
        if not test(_joined(now, lead, "bucket").where("root <> lead_root").select("a", F.col("node").alias("b"))):
            break
    now = placed()
    mixed = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    left = cut(_joined(now, mixed, "bucket").select("node", "root").distinct(), "rest")
    if not left.isEmpty():
        test(_rare_pairs(left, seqs))
    return roots


def _rare_pairs(nodes: DataFrame, seqs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with different roots that share one of their rarest k-mers (see above)."""
    tokens = seqs.join(nodes, "node").withColumn("tokens", _tokens.asNondeterministic()("seq")).select("node", "root", F.explode("tokens").alias("token"))
    tokens = cut(tokens, "tokens")
    # a k-mer of one class only cannot make a pair, but it counts as the rarest
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    often = often.where("df > 1").select("token", "df", (F.col("lo") < F.col("hi")).alias("mixed"))
    known = tokens.join(often, "token", "left").select("node", "root", "token", F.coalesce("df", F.lit(1)).alias("df"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
    ranked = known.groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("df", "token", "mixed"))).alias("t"))
    n = F.size("t")
    first = F.slice("t", 1, (n - F.ceil(n * F.lit(SIMILARITY) - 1e-9) + 1).cast("int"))
    first = F.filter(F.transform(first, lambda x, i: F.struct(x["token"], x["mixed"], (n - i).alias("rest"))), lambda x: x["mixed"])
    rare = ranked.select("node", "root", n.alias("n"), F.explode(first).alias("x")).select("node", "root", "n", "x.token", "x.rest")
    left = rare.select("token", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("rest").alias("ta"))
    right = rare.select("token", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("rest").alias("tb"))
    longer = F.greatest("na", "nb")
    shared = longer - F.floor(longer * F.lit(1 - SIMILARITY) + 1e-9)
    return left.join(right, "token").where((F.col("ra") < F.col("rb")) & (F.least("ta", "tb") >= shared)).select("a", "b")


def row_hashes(key: str, text: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's key and text, which stand for the row together."""
    return F.xxhash64(key, text), F.xxhash64(F.lit("check"), text, key)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: (doc_id, row_hash, row_check, root, class_id).

    The first two hashes (:func:`row_hashes`) tell rows apart; root is the class's least word digest, null for a text
    without words.
    """
    row_hash, row_check = row_hashes(key, text)
    rows = docs.select(F.col(key).alias("id"), row_hash.alias("row_hash"), row_check.alias("row_check"), F.col(text).alias("t"))
    base = cut(rows.withColumn("s", _node.asNondeterministic()("t")).select("id", "row_hash", "row_check", "s.node", "s.sketch"), "nodes")
    nodes = base.where("node is not null").groupBy("node").agg(F.min("id").alias("own"), F.min("row_hash").alias("row_hash"), F.first("sketch").alias("sketch"))

    entries = nodes.select("node", "row_hash", F.explode("sketch").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    entries = cut(_joined(entries, shared, "bucket"), "buckets")
    roots = None
    if not entries.isEmpty():
        wanted = entries.select("row_hash", F.col("node").alias("want")).distinct()
        seqs = rows.select("row_hash", "t").join(wanted, "row_hash").withColumn("s", _sequence.asNondeterministic()("t"))
        seqs = cut(seqs.where("s.node = want").select("s.node", "s.seq").dropDuplicates(["node"]), "sequences")
        roots = _links(entries.select("bucket", "node"), seqs)
    named = nodes.select("node", "own")
    named = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if roots is not None:
        least = named.join(roots.select("root").distinct(), "root").groupBy("root").agg(F.min("own").alias("least"))
        named = named.join(least, "root", "left").select("node", "root", F.coalesce("least", "own").alias("own"))
    out = _joined(base.select("id", "row_hash", "row_check", "node"), named, "node", "left")
    return out.select(F.col("id").alias(key), "row_hash", "row_check", "root", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("own")).alias("class_id"))
