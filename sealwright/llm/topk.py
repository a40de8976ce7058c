"""Exact top-k inner-product search with block-at-a-time pruning.

Candidates, sorted by id, are cut into cells of ``CELL`` neighbours, and a cell into blocks of ``BLOCK``: both are ranges
of documents. A cell is stored as a forward index (a row of integer weights for each vector); its largest and smallest
weight of each term are its summary. The largest score that a range can hold is the sum over terms of a query's weight
times the range's maximum (or minimum for a negative weight).

First every query meets the summaries, and is scored in the cell of highest bound: its kth score there is a floor. Then
it meets the summaries again, and goes to those other cells only whose bound reaches the floor. Inside a cell blocks are
taken in falling order of their bounds, up to ``RUN`` at a time, and scored through the forward index until the next
bound falls below the kth score; at an equal bound a range is still scored, because ties go to smaller ids. Queries are copied to the cells that
they may need, and cells to groups of ``QUERIES`` queries that need them; summaries are dealt in tiles, not broadcast. A
query's k best over all cells are taken by a ranked window, which Spark limits before its shuffle.

Vectors that are null or hold null or non-finite components take no part; so do those with a null id. Empty vectors
score 0 with each other. A query meets only candidates of its own length. Every query row is a query, and every row but
its own a candidate, rows of equal ids and repeated rows included (of one query's repeated candidates k at most can
count). Fewer than k candidates give fewer rows; an empty table none. Weights and scores beyond 64 bits are held at the
ends of the range. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidates of a block and of a cell, queries of a group, cells whose summaries make a tile.
BLOCK, CELL, QUERIES, TILE = 64, 8192, 2048, 4096
#: Most blocks that are scored between two looks at the kth score.
RUN = 32

CELLS = "cell long, dim int, kind string, ids binary, copies binary, weights binary, high binary, low binary"
_LEAST, _MOST = -(2**63), 2**63 - 1


def weights(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, w): integer weights floor(scale * x) of all valid vectors."""
    v = F.transform(vector, lambda x: x.cast("double"))
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull()
    ok = ok & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(ok).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("w"))


def _kind(q: np.ndarray, c: np.ndarray):
    """Numbers in which inner products of q's and c's rows are exact: floats if they can be (faster), else integers."""
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(q.shape[1], 1)
    return np.float64 if top < 2.0**53 else np.int64 if top < 2.0**62 else object


def _held(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, _LEAST, _MOST) if scores.dtype == object else scores


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries by ranges: the largest score that a range can hold."""
    return _held(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)


def search_cell(qid: np.ndarray, q: np.ndarray, floors: list, cid: np.ndarray, copies: np.ndarray, c: np.ndarray, k: int, block: int) -> list[tuple[int, int, int]]:
    """(query's place, candidate, score) of the k best of each query that reach its floor; candidates in order of ids."""
    kind = _kind(q, c)
    # blocks side by side, the last one filled up with rows that do not count
    n = -(-len(cid) // block)
    fill = n * block - len(cid)
    q, c = q.astype(kind), np.concatenate([c, np.repeat(c[-1:], fill, axis=0)]).astype(kind).reshape(n, block, -1)
    cid, copies = np.append(cid, np.repeat(cid[-1:], fill)).reshape(n, block), np.append(copies, np.zeros(fill, np.int64)).reshape(n, block)
    bounds = _bounds(q, c.max(axis=1), c.min(axis=1))
    out = []
    for i in range(len(qid)):
        ids, scores, kth = np.empty(0, np.int64), np.empty(0, kind), floors[i]
        order = np.argsort(-bounds[i], kind="stable")
        at, some = 0, 1
        while at < n:
            # the next blocks, more at a time as bounds fall; the first of them holds the highest bound
            run = order[at : at + some]
            if kth is not None:
                run = run[(bounds[i, run] >= kth).astype(bool)]
            if not len(run):
                break
            at, some = at + some, min(2 * some, RUN)
            got, own, times = _held(c[run] @ q[i]).ravel(), cid[run].ravel(), copies[run].ravel()
            same = np.flatnonzero(own == qid[i])
            if len(same):  # the query's own row does not count
                times[same] -= (c[run].reshape(len(own), -1)[same] == q[i]).all(axis=1) & (times[same] > 0)
            use = times > 0
            if kth is not None:
                use &= (got >= kth).astype(bool)
            if not use.any():
                continue
            times = np.minimum(times[use], k)
            ids, scores = np.concatenate([ids, np.repeat(own[use], times)]), np.concatenate([scores, np.repeat(got[use], times)])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                kth = scores[-1]
        out += [(i, int(x), int(y)) for x, y in zip(ids, scores)]
    return out


def _matrix(rows, dim: int) -> np.ndarray:
    return np.array(rows.tolist(), np.int64).reshape(len(rows), dim)


def _builder(size: int):
    """Rows (dim, id, w, copies), sorted, to cells of ``size`` rows of one length."""

    def build(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        dim, held = None, []

        def cells(last: bool):
            nonlocal held, made
            while held and (last or sum(len(x[0]) for x in held) >= size):
                ids, copies, c = (np.concatenate([x[j] for x in held]) for j in range(3))
                held = [(ids[size:], copies[size:], c[size:])] if len(ids) > size else []
                ids, copies, c = ids[:size], copies[:size], c[:size]
                kind = "<i4" if c.size == 0 or (c.min() >= -(2**31) and c.max() < 2**31) else "<i8"
                made += 1
                yield (first + made, dim, kind, ids.tobytes(), copies.tobytes(), c.astype(kind).tobytes(), c.max(axis=0).tobytes(), c.min(axis=0).tobytes())

        for pdf in batches:
            rows = []
            for own, g in pdf.groupby("dim", sort=True):
                if own != dim:
                    rows += cells(True)
                    dim = int(own)
                held.append((g["id"].to_numpy(np.int64), g["copies"].to_numpy(np.int64), _matrix(g["w"], dim)))
                rows += cells(False)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CELLS.split(", ")])
        yield pd.DataFrame(list(cells(True)), columns=[x.split()[0] for x in CELLS.split(", ")])

    return build


def _cells(vectors: DataFrame, k: int) -> DataFrame:
    # of equal rows no more than k and the query's own can count; counting them first keeps a repeated row from filling a cell
    rows = vectors.groupBy("id", "w").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select(F.size("w").alias("dim"), "id", "w", F.least("copies", F.lit(k + 1)).alias("copies"))
    rows = cut(rows, "vectors")
    parts = max(1, -(-rows.count() // (4 * CELL)))
    return cut(rows.repartitionByRange(parts, "dim", "id", "w").sortWithinPartitions("dim", "id", "w").mapInPandas(_builder(CELL), CELLS), "cells")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _summaries(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(pdf[x]), np.int64).reshape(len(pdf), dim) for x in ("high", "low"))


def _scored(asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The k best of each asked query (cell, grp, id, h, w, floor) in each of its cells: (query_id, h, vec_id, score)."""
    block = BLOCK
    wanted = cells.drop("high", "low").join(asked.select("cell", "grp").distinct(), "cell")
    wanted = wanted.toDF(*wanted.columns)  # other columns than those of ``asked``

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        for dim, kind, ids, copies, w in zip(b["dim"], b["kind"], b["ids"], b["copies"], b["weights"]):
            cid, copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
            floors = [None if pd.isna(x) else int(x) for x in a["floor"].astype(object)]
            got = search_cell(a["id"].to_numpy(np.int64), _matrix(a["w"], dim), floors, cid, copies, np.frombuffer(w, kind).reshape(len(cid), dim), k, block)
            out += [(a["id"].iat[i], a["h"].iat[i], x, y) for i, x, y in got]
        return pd.DataFrame(out, columns=["query_id", "h", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    keys = ["cell", "grp"]
    return asked.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(run, "query_id long, h string, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score); the queries are rows of the vectors, as :func:`weights` makes them."""
    cells = _cells(vectors, k)
    queries = queries.groupBy("id", "w").agg(F.count(F.lit(1)).alias("rows"))
    # h: the digest of a query's weights, which tells queries of one id apart
    queries = cut(queries.select("id", F.md5(F.concat_ws(",", F.transform("w", lambda x: x.cast("string")))).alias("h"), "w", "rows"), "queries")
    groups, tiles = max(1, -(-queries.count() // QUERIES)), max(1, -(-cells.count() // TILE))
    grp = F.pmod(F.xxhash64("id", "h"), F.lit(groups)).cast("int").alias("grp")
    keys = ["dim", "tile", "grp"]
    dealt = cells.select("dim", F.pmod(F.xxhash64("cell"), F.lit(tiles)).cast("int").alias("tile"), "cell", "high", "low").withColumn("grp", _every(groups))

    def first(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "h": [], "cell": [], "bound": []}).astype({"id": "int64", "h": str, "cell": "int64", "bound": "int64"})
        dim = int(b["dim"].iat[0])
        q, (high, low) = _matrix(a["w"], dim), _summaries(b, dim)
        kind = _kind(q, np.concatenate([high, low]))
        bounds = _bounds(q.astype(kind), high.astype(kind), low.astype(kind))
        at = bounds.argmax(axis=1)
        return pd.DataFrame({"id": a["id"], "h": a["h"], "cell": b["cell"].to_numpy()[at], "bound": bounds[np.arange(len(a)), at].astype(np.int64)})

    def reached(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(a) and len(b):
            dim = int(b["dim"].iat[0])
            q, (high, low), names = _matrix(a["w"], dim), _summaries(b, dim), b["cell"].to_numpy()
            kind = _kind(q, np.concatenate([high, low]))
            bounds = _bounds(q.astype(kind), high.astype(kind), low.astype(kind))
            for i, (own, floor) in enumerate(zip(a["cell"], a["floor"].astype(object))):
                use = names != own
                if not pd.isna(floor):
                    use &= (bounds[i] >= int(floor)).astype(bool)
                out += [(int(x), a["grp"].iat[i], a["id"].iat[i], a["h"].iat[i], a["w"].iat[i], None if pd.isna(floor) else int(floor)) for x in names[use]]
        out = pd.DataFrame(out, columns=["cell", "grp", "id", "h", "w", "floor"], dtype=object)
        return out.astype({"cell": "int64", "grp": "int32", "id": "int64", "floor": "Int64"})

    asked = queries.select(F.size("w").alias("dim"), _every(tiles).alias("tile"), grp, "id", "h", "w")
    seeds = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(first, "id long, h string, cell long, bound long")
    seeds = seeds.groupBy("id", "h").agg(F.max_by("cell", F.struct("bound", -F.col("cell"))).alias("cell"))
    seeded = cut(queries.join(seeds, ["id", "h"]).select("cell", grp, "id", "h", "w", F.lit(None).cast("long").alias("floor")), "seeded")
    near = cut(_scored(seeded, cells, k), "near")
    floors = near.groupBy(F.col("query_id").alias("id"), "h").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    known = seeded.drop("floor").join(floors, ["id", "h"], "left").select(F.size("w").alias("dim"), _every(tiles).alias("tile"), "grp", "id", "h", "w", "cell", "floor")
    others = known.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(reached, "cell long, grp int, id long, h string, w array<long>, floor long")
    found = near.union(_scored(cut(others, "reached"), cells, k))
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    copies = queries.select(F.col("id").alias("query_id"), "h", "rows")
    ranked = ranked.join(copies, ["query_id", "h"]).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return ranked.select("query_id", "rank", "vec_id", "score")
