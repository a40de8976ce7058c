"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each match of the split pattern is encoded separately, without special tokens. Long texts are first cut before a
blank that stands between two non-blank characters: there the pattern always ends one match and begins the next, so
the ids are those of the whole text. A run of white space of ``RUN`` characters or more, which would overflow the stack
of the pattern's matcher, is cut out by the pattern's own rule (``\\s+(?!\\S)``): all but its last character is one match,
at the end of a text the whole run is. Null and empty texts give no ids. Rows are encoded one by one, so repeated rows
give equal results; other columns are ignored or passed through whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters after which a long text is cut at the next safe boundary.
PIECE = 50_000
#: White space in a row that is matched here, not by the pattern.
RUN = 10_000
_safe = re.compile(r"(?<=\S) (?=\S)")
#: The characters of Unicode property White_Space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CODES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; it is sent to the executors as bytes (about 1 MB, whatever the input)."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    """One encoder for each worker process and pattern."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=_table(ranks), special_tokens={})


@lru_cache(maxsize=1)
def _table(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}


@lru_cache(maxsize=1)
def _whole(enc):
    """An encoder of the same ranks that takes a whole text as one match."""
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=enc._mergeable_ranks, special_tokens={})


@lru_cache(maxsize=4)
def _runs(least: int) -> re.Pattern:
    return re.compile(f"[{_SPACE}]{{{least},}}")


def pieces(text: str, size: int = PIECE):
    """Cuts of ``text`` at safe boundaries, each of ``size`` characters or the next boundary after."""
    start = 0
    while len(text) - start > size:
        m = _safe.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def parts(text: str, run: int = RUN):
    """(part, whether it is one match): long runs of white space, and what lies between them."""
    start = 0
    for m in _runs(max(run, 2)).finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > start:
            yield text[start : m.start()], False
        yield text[m.start() : end], True
        start = end
    if start < len(text):
        yield text[start:], False


def encode(enc, text: str | None, size: int = PIECE, run: int = RUN) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part, one in parts(text, run):
        if one:
            out += _whole(enc).encode_ordinary(part)
        else:
            for x in pieces(part, size):
                out += enc.encode_ordinary(x)
    return out


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes of the ids; not necessarily whole characters when a part of a text's ids is given."""
    return enc.decode_bytes(ids)


def _encoded(spark: SparkSession, path: str, pattern: str, digest: bool):
    shared = spark.sparkContext.broadcast(read_ranks(path))

    def ids_of(texts: pd.Series) -> pd.Series:
        enc = encoder(shared.value, pattern)
        return pd.Series([encode(enc, x) for x in texts], dtype=object)

    def digests(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(shared.value, pattern)
        names = _names(enc.n_vocab)
        rows = []
        for x in texts:
            ids = encode(enc, x)
            said = ",".join([names[i] for i in ids])
            rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decode(enc, ids)).hexdigest()))
        return pd.DataFrame(rows, columns=CODES.names)

    if digest:
        return F.pandas_udf(digests, CODES).asNondeterministic()
    return F.pandas_udf(ids_of, T.ArrayType(T.IntegerType())).asNondeterministic()


@lru_cache(maxsize=2)
def _names(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array column."""
    return docs.withColumn(out, _encoded(docs.sparkSession, path, pattern, False)(F.col(text)))


def with_bytes(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``docs`` with the decoded bytes of an id column; null ids give null."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def back(col: pd.Series) -> pd.Series:
        enc = encoder(shared.value, pattern)
        return pd.Series([None if x is None else decode(enc, list(map(int, x))) for x in col], dtype=object)

    return docs.withColumn(out, F.pandas_udf(back, T.BinaryType()).asNondeterministic()(F.col(ids)))


def with_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "__bpe") -> DataFrame:
    """``docs`` with a struct of the id count, the digest of the ids and the digest of the bytes decoded from them."""
    return docs.withColumn(out, _encoded(docs.sparkSession, path, pattern, True)(F.col(text)))
