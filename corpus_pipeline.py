"""A corpus pipeline: quality rules, language identification, near-duplicates, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``. Stages that run Python set the session's Arrow batches to ``ROWS_PER_BATCH`` rows, which
bounds what a batch of long texts takes, in Python workers and outside the JVM's heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm import bpe, langid, mix, neardup, quality
from sealwright.llm.common import BATCH, cut, table
from sealwright.llm.queries import _tokenizer, held_out


ROWS_PER_BATCH = 2_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.

    A null or empty text has no word, fails the base rules and goes; a null doc_id has no label and is judged like any
    other row. Repeated rows are all kept or all rejected. No documents give none; columns pass through.
    """
    spark.conf.set(BATCH, ROWS_PER_BATCH)
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).where("__quality.kept").drop("__quality")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: a text that is null or has no letter goes.

    A text that fits two languages alike stays, and so does every text with a letter where no row teaches a language
    (the lang column is null, or all labelled rows are held out). Repeated rows are treated alike, columns pass through.
    """
    spark.conf.set(BATCH, ROWS_PER_BATCH)
    model = langid.train(docs.where(~held_out()))
    said = langid.with_language(docs, model)
    return said.where("__lang.letters > 0").drop("__lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest doc_id; of repeated rows one stays.

    A text without a word (null too) is a class of its own. Rows with a null doc_id stay only if no row of their class
    has one; of several rows of one smallest doc_id that of the least hash stays. Columns pass through.
    """
    found = cut(neardup.classes(docs), "classes")
    row = F.struct("row_hash", "row_check").alias("row")
    least = found.where("root is not null and doc_id <=> class_id").groupBy("root").agg(F.min(row).alias("row"))
    kept = found.where("root is null").select(row).union(least.select("row")).distinct().select("row.*")
    hashes = dict(zip(("__row", "__check"), neardup.row_hashes("doc_id", "text")))
    out = docs.withColumns(hashes).join(kept.toDF(*hashes), list(hashes))
    if not found.groupBy("row_hash", "row_check").count().where("count > 1").join(kept, ["row_hash", "row_check"]).isEmpty():
        out = out.dropDuplicates(list(hashes))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken: 0, 1 or 2 times.

    Null and empty texts are never taken; a null source is a source of its own; repeated rows count together and are
    taken alike. No documents give none; columns pass through.
    """
    return mix.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix; a null or empty text has no token. Repeated rows give
    repeated rows."""
    spark.conf.set(BATCH, ROWS_PER_BATCH)
    return bpe.with_digests(docs.select("doc_id", "lang", "source", "text"), *_tokenizer()).select("doc_id", "lang", "source", "__bpe.*")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: Learned rules, sketches and token ids cannot be written in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet in the shared folder and read again.

    The tables between stages are deleted when the driver ends.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(out, f"stage{i}")
    return out
