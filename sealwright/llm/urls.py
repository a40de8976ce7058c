"""URL filtering by a sort-merge range join.

A rule's host, its labels reversed and each followed by a dot (``com.example.``), is a canonical key; a host and all
its subdomains are the keys that begin with it, an interval. Intervals of rules are nested or apart. One sweep over the
sorted rules, with a stack of those whose intervals are open, notes for each rule the one around it; sorted urls are
merged with the sorted rules, and the rules open at a url are the last one not after its key and those around that. A
rule also has a path, with which the url's path must begin. Among the rules that fit, the longest (host and path
together, then the longer host) wins; where none fits, the default verdict holds.

Up to ``CHUNK`` rules are swept in each batch of urls, so no url is shuffled and a common host does no harm. More are cut
into ranges of ``CHUNK`` by key, each with the rules open at its start. Distinct (host, path) pairs, counted together
before the shuffle, meet the rules of their range, a range with many of them in several tasks; the winners are joined
back to the rows. The rule list itself is held by the driver; a worker holds one range of it.

A null url, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict. An empty
url path fits no rule whose path is ``/``. Rule hosts are lower-cased as hosts of urls are (A-Z). Rules with a null part
or an empty host are not used; of rules of equal host and path the blocking one holds, wherever in the list they are.
Repeated rows are judged alike, an empty table gives an empty result, extra columns are passed through or ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Rules of one sweep: at about 500 bytes each, some 50 MB in a worker.
CHUNK = 100_000
#: Pairs of host and path that meet a range of rules in one task.
PAIRS = 500_000

MATCH = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(name: str) -> str:
    return ".".join(reversed(name.split("."))) + "." if name else ""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def tidy(rules: list[Rule]) -> list[tuple[str, str, str, str]]:
    """(canonical host, path, host, verdict) of all rules in use, sorted, each host and path once."""
    by: dict[tuple[str, str, str], str] = {}
    for r in rules:
        if r.host and r.path is not None and r.verdict:
            name = r.host.translate(_LOWER)
            key = (canonical(name), r.path, name)
            if by.get(key) != "block":
                by[key] = r.verdict
    return sorted((*k, v) for k, v in by.items())


class Swept:
    """Sorted rules after the sweep: of each host its rules by path, and the host around it."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        self.keys: list[str] = []
        self.around: list[int] = []
        self.own: list[dict[str, tuple[str, str]]] = []
        stack: list[int] = []
        for key, path_, name, verdict in rules:
            if not self.keys or self.keys[-1] != key:
                while stack and not key.startswith(self.keys[stack[-1]]):
                    stack.pop()
                self.around.append(stack[-1] if stack else -1)
                stack.append(len(self.keys))
                self.keys.append(key)
                self.own.append({})
            self.own[-1][path_] = (name, verdict)
        self.lengths = [sorted({len(p) for p in own}, reverse=True) for own in self.own]

    def open_at(self, key: str, start: int = 0) -> list[int]:
        """The hosts whose intervals hold the key, the inner ones first; none before ``start`` is the last one before."""
        at, out = bisect_right(self.keys, key, start) - 1, []
        while at >= 0:
            if key.startswith(self.keys[at]):
                out.append(at)
            at = self.around[at]
        return out

    def match(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each url, in one merge of the sorted urls with the rules."""
        keys = [canonical(h) for h in hosts]
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(keys)
        last, open_, start = None, [], 0
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            key, path_ = keys[i], paths[i]
            if not key:
                continue
            if key != last:
                open_, last = self.open_at(key, start), key
                start = open_[0] if open_ else start
            best = (-1, -1)
            for at in open_:
                for n in self.lengths[at]:
                    if n <= len(path_) and (found := self.own[at].get(path_[:n])):
                        size = (len(found[0]) + n, len(found[0]))
                        if size > best:
                            best, out[i] = size, (found[0] + path_[:n], found[1])
                        break
        return out


def _matcher(shared):
    built: list[Swept] = []

    def run(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        if not built:
            built.append(Swept(shared.value))
        return pd.DataFrame(built[0].match(hosts.tolist(), paths.tolist()), columns=MATCH.names, dtype=object)

    return run


def _ranged(parts: DataFrame, rules: list[tuple[str, str, str, str]], chunk: int) -> DataFrame:
    """(host, path, rule, verdict) of all distinct pairs of host and path that some rule fits."""
    spark = parts.sparkSession
    whole = Swept(rules)
    cuts = [rules[i][0] for i in range(chunk, len(rules), chunk)]
    bounds = [""] + [k for i, k in enumerate(cuts) if i == 0 or cuts[i - 1] != k]  # a host's rules stay in one range
    rows = [(bisect_right(bounds, r[0]) - 1, *r) for r in rules]
    for n, bound in enumerate(bounds):
        rows += [(n, whole.keys[at], p, name, verdict) for at in whole.open_at(bound) if bisect_right(bounds, whole.keys[at]) - 1 < n for p, (name, verdict) in whole.own[at].items()]
    # a bound for each ``chunk`` rules
    shared = spark.sparkContext.broadcast(bounds)
    where = F.pandas_udf(lambda hosts: pd.Series([bisect_right(shared.value, canonical(h)) - 1 for h in hosts], dtype="int32"), T.IntegerType())
    pairs = parts.where("host <> ''").distinct().withColumn("range", where.asNondeterministic()("host"))
    pairs = cut(pairs, "pairs")
    salts = {r["range"]: -(-r["count"] // PAIRS) for r in pairs.groupBy("range").count().collect()}  # one row for each range
    salted = spark.createDataFrame([(k, v) for k, v in salts.items()] or [(0, 1)], "range int, salts int")
    left = pairs.join(salted, "range").select("range", F.pmod(F.xxhash64("host", "path"), "salts").cast("int").alias("salt"), "host", "path")
    right = spark.createDataFrame(rows, "range int, key string, path string, name string, verdict string").join(salted, "range")
    right = right.select("range", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "path", "name", "verdict")

    def run(urls: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        swept = Swept(sorted(own[["key", "path", "name", "verdict"]].itertuples(index=False, name=None)))
        out = pd.DataFrame(swept.match(urls["host"].tolist(), urls["path"].tolist()), columns=MATCH.names, dtype=object)
        return pd.concat([urls[["host", "path"]].reset_index(drop=True), out], axis=1).dropna()

    return left.groupBy("range", "salt").cogroup(right.groupBy("range", "salt")).applyInPandas(run, "host string, path string, rule string, verdict string")


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", out: str = "__url", chunk: int = CHUNK) -> DataFrame:
    """``df`` with a struct ``out``: host, path, rule (null if none fits) and verdict."""
    known, parts, match = tidy(rules), f"{out}_parts", f"{out}_match"
    df = df.withColumn(parts, F.struct(host(F.col(url)).alias("host"), path(F.col(url)).alias("path")))
    if len(known) <= chunk:
        shared = df.sparkSession.sparkContext.broadcast(known)  # ``chunk`` rules at most
        df = df.withColumn(match, F.pandas_udf(_matcher(shared), MATCH).asNondeterministic()(F.col(parts)["host"], F.col(parts)["path"]))
    else:
        found = _ranged(df.select(f"{parts}.*"), known, chunk).select(F.struct("host", "path").alias(f"{out}_key"), F.struct("rule", "verdict").alias(match))
        df = df.join(found, F.col(parts) == F.col(f"{out}_key"), "left").drop(f"{out}_key")
    said = F.col(match)
    judged = F.struct(F.col(parts)["host"].alias("host"), F.col(parts)["path"].alias("path"), said["rule"].alias("rule"), F.coalesce(said["verdict"], F.lit(default)).alias("verdict"))
    return df.withColumn(out, judged).drop(parts, match)
