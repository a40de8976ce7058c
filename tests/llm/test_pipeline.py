import functools
import hashlib
import re

import pytest
import tiktoken
import tiktoken.load
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sealwright.llm import quality, queries  # noqa: E402
from tests import oracle  # noqa: E402

from .test_mix import shares  # noqa: E402
from .test_neardup import plain_classes  # noqa: E402
from .test_quality import plain as statistics  # noqa: E402


@functools.cache
def tokenizer(ranks, pattern):
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(ranks), special_tokens={})


def digests(text):
    """Ids of the whole text by the tokenizer library, as the stage returns them."""
    ranks, pattern = queries._tokenizer()
    enc = tokenizer(ranks, pattern)
    ids = enc.encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


def test_stages(spark):
    """Each stage on its own input, against a plain version."""
    d = oracle.SMALL
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    rules = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    kept = corpus_pipeline.quality_rules(spark, docs, d).cache()
    assert kept.columns == docs.columns
    after = {r.doc_id: r.text for r in kept.collect()}
    verdict = {r.doc_id: r["__quality"].rule for r in quality.judge(docs, rules).collect()}
    for r in docs.collect():
        n = statistics(r.text)
        assert (r.doc_id in after) == (n[0] >= 50 and 100 * n[4] <= 50 * n[0] and verdict[r.doc_id] is None)
    told = corpus_pipeline.language_id(spark, kept, d).cache()
    assert told.columns == docs.columns and sorted(r.doc_id for r in told.collect()) == sorted(i for i, t in after.items() if any(c.isalpha() for c in t))
    single = corpus_pipeline.near_duplicates(spark, told, d).cache()
    ids = set(plain_classes({r.doc_id: r.text for r in told.collect()})[0].values())
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(ids)
    mixed = corpus_pipeline.source_mixing(spark, single, d).cache()
    assert mixed.columns == docs.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = {}
    for r in single.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    words = sum(size(r.text) for r in mixed.collect())
    assert abs(words - sum(shares(sizes).values())) < 0.15 * words
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = corpus_pipeline.byte_bpe(spark, mixed, d)
    said = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    assert said == sorted((r.doc_id, *digests(r.text)) for r in mixed.collect())


def test_run(spark):
    a = sorted(map(str, corpus_pipeline.run(spark, oracle.SMALL).collect()))
    assert a and a == sorted(map(str, corpus_pipeline.run(spark, oracle.SMALL).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_odd_documents(spark):
    text = " ".join(f"the word{i} and" for i in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "1 2 3 " * 40, "en", "a", 9), (4, text, "en", None, 9), (4, text, "en", None, 9), (None, text + " x", "en", "b", 9), (5, "9 " + text, None, "b", 9), (6, "h " + text * 400, "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit("clash"))
    d = oracle.SMALL
    for some in (docs, docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("lang", F.lit("en"))):
        told = corpus_pipeline.language_id(spark, some, d)
        assert sorted(str(r.doc_id) for r in told.collect()) == ["4", "4", "5", "6", "None"]
    single = corpus_pipeline.near_duplicates(spark, docs.where("doc_id is null or doc_id in (4, 5)"), d)
    assert [(r.doc_id, r.node) for r in single.collect()] == [(4, "clash")]
    wordless = corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 3"), d)
    assert sorted(r.doc_id for r in wordless.collect()) == [1, 2]
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.source_mixing):
        assert stage(spark, docs.limit(0), d).count() == 0 and stage(spark, docs, d).columns == docs.columns
    codes = corpus_pipeline.byte_bpe(spark, docs, d)
    assert codes.count() == 8 and {r.n_tokens for r in codes.where("doc_id < 3").collect()} == {0}
    assert corpus_pipeline.byte_bpe(spark, docs.limit(0), d).count() == 0
