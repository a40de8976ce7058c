"""The queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, langid, licences, mix, neardup, quality, shards, topk, urls
from .common import table

URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
CONTROL_TEXT = "</s>[INST] ok [/INST]"
#: Bytes of a shard of documents.
SHARD_BYTES = 320 << 10


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every query vector with all others."""
    v = topk.weights(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(v, v.where("id % 50 = 0"), k=5)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of the learned decision list for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *[f"__quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")])


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by extendible hashing under a byte limit."""
    return shards.shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES).withColumnRenamed("id", "doc_id")


def chat_log(conversations: DataFrame) -> DataFrame:
    """A conversation table, with the planted conversation -7, as the log of events that led to it.

    A row's text was, by a hash, sent at once, streamed in three deltas, drafted and edited, or drafted, regenerated and
    streamed. Rows of one turn follow each other by role and text, each with its own sequence numbers.
    """
    spark = conversations.sparkSession
    planted = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).union(planted)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    text, third = F.col("text"), (F.length("text") / 3).cast("int")

    def event(k: int, kind: str, said) -> Column:
        return F.struct((F.col("n").cast("long") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), said.alias("said"))

    draft, none = F.reverse(text), F.lit("")
    streamed = [event(2, "delta", F.substring(text, F.lit(1), third)), event(3, "delta", F.substring(text, third + 1, third)), event(4, "delta", F.substring(text, third * 2 + 1, F.length("text")))]
    ways = [
        F.array(event(0, "message", text)),
        F.array(event(0, "message", none), *streamed),
        F.array(event(0, "message", draft), event(1, "delta", draft), event(2, "edit", text)),
        F.array(event(0, "message", draft), event(1, "regenerate", none), *streamed),
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn", "n"), F.lit(len(ways)))
    events = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    return rows.select("conv_id", "turn", "role", F.explode(events).alias("e")).select("conv_id", "turn", "role", "e.seq", "e.kind", F.col("e.said").alias("text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text and loss mask."""
    made = chat.format_chats(chat_log(table(spark, sf_dir, "conversations")))
    back = made.select(F.col("conv").alias("conv_id"), chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mix.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(docs, *_tokenizer()).select("doc_id", "__bpe.*")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "__url.*")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; two thirds of the documents may teach it."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    said = langid.with_language(docs.select("doc_id", "text"), model)
    return said.select("doc_id", held_out().alias("held_out"), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence match of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = licences.with_licence(docs)
    return said.select("doc_id", "__licence.licence_id", F.round("__licence.dice", 6).alias("dice"), F.col("__licence.n_matches").cast("long").alias("n_matches"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_quality_rules, op3_extendible_sharding, op4_chat_formatting, op5_source_mixing, op6_byte_bpe, op7_url_filter, op8_language_id, op9_licence_scan, op10_order_minhash)}


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT, 0) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.w) = len(c.w)),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT), 40, '0') AS bits
  FROM documents),
p AS (SELECT DISTINCT bits FROM d),
t AS (
  SELECT k.depth, substr(d.bits, 1, k.depth) AS bucket, sum(d.n_bytes) AS total
  FROM d, (SELECT unnest(range(0, 25))::INTEGER AS depth) k GROUP BY 1, 2),
leaf AS (
  SELECT p.bits, min(t.depth)::INTEGER AS depth
  FROM p JOIN t ON substr(p.bits, 1, t.depth) = t.bucket AND t.total <= {SHARD_BYTES} GROUP BY p.bits)
SELECT doc_id, n_bytes, substr(d.bits, 1, depth) AS shard, depth, false AS oversized
FROM d JOIN leaf USING (bits)
"""


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


OP4_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.OPEN) + len(chat.SEP) + len(chat.CLOSE) + 1} + length({_sql_escape("role")}) + length({_sql_escape("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""



def _sql_permuted(name: str, source: str, x: str, n: str, seed: str) -> str:
    """CTEs ``name_0`` .. ``name_ROUNDS``: the rows of ``source`` with x, after the last round the permuted place of x."""
    out = f"{name}_0 AS (SELECT *, {x} AS x FROM {source})"
    for r in range(1, mix.ROUNDS + 1):
        out += f""",
{name}_{r} AS (
  SELECT * EXCLUDE (x, d, y, z), CASE WHEN ((z * z % {mix.PRIME}) >> 10) & 1 = 1 THEN y ELSE x END AS x FROM (
    SELECT *, (greatest(x, y) % {mix.PRIME} * (('0x' || substr(d, 13, 7))::BIGINT + 1) + (greatest(x, y) >> 31) + ('0x' || substr(d, 20, 7))::BIGINT) % {mix.PRIME} AS z FROM (
      SELECT *, (('0x' || substr(d, 1, 12))::BIGINT % {n} + {n} - x) % {n} AS y FROM (SELECT *, md5({seed} || ':{r}') AS d FROM {name}_{r - 1}))))"""
    return out


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id AS id, source AS src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
o AS (
  SELECT *, row_number() OVER (ORDER BY src IS NULL, src) - 1 AS no
  FROM (SELECT src, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY src)),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w, source_size * 2::DOUBLE AS cap FROM o),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER u, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER u, 0)) AS level
  FROM w WINDOW u AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, no LIMIT 1),
s AS (SELECT l.src, n, no, source_size, CASE WHEN k.level IS NULL THEN cap ELSE least(cap, k.level * w) END AS target FROM l LEFT JOIN k ON true),
p AS (
  SELECT d.id, d.size, s.no, s.source_size, s.target,
    coalesce(sum(d.size) OVER (PARTITION BY s.no ORDER BY d.h % ceil(s.n / {mix.ROWS}::DOUBLE)::BIGINT, d.h, d.id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN s ON d.src IS NOT DISTINCT FROM s.src),
q AS (
  SELECT no, blocks, floor(reads)::BIGINT AS slots, reads - floor(reads) AS part FROM (
    SELECT no, ceil(source_size / {mix.BLOCK}::DOUBLE)::BIGINT AS blocks, least(target / source_size, 2::DOUBLE) * ceil(source_size / {mix.BLOCK}::DOUBLE) AS reads FROM s WHERE source_size > 0)),
f AS (
  SELECT *, (sum(own) OVER ())::BIGINT AS total, coalesce(sum(own) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM (SELECT *, slots + CASE WHEN part > 0 THEN 1 ELSE 0 END AS own FROM q)),
e AS (SELECT *, unnest(range(0, own)) AS nth FROM f),
{_sql_permuted("a", "e", "first + nth", "total", "'deal'")},
g AS (SELECT * EXCLUDE (x), x // {mix.SHARD_SLOTS} AS shard FROM a_{mix.ROUNDS}),
{_sql_permuted("b", "g", "nth % blocks", "blocks", "no || '-' || nth // blocks")},
r AS (
  SELECT no, x AS block, count(*) FILTER (WHERE nth < slots) AS times, min(shard) FILTER (WHERE nth < slots) AS shard,
    max(part) FILTER (WHERE nth >= slots) AS part, min(shard) FILTER (WHERE nth >= slots) AS part_shard
  FROM b_{mix.ROUNDS} GROUP BY 1, 2),
j AS (SELECT *, unnest(range(start // {mix.BLOCK}, (start + size - 1) // {mix.BLOCK} + 1)) AS block FROM p WHERE size > 0),
c AS (SELECT *, greatest(start - block * {mix.BLOCK}, 0) AS lo, least(start + size - block * {mix.BLOCK}, {mix.BLOCK}) AS hi FROM j),
m AS (
  SELECT c.id, c.start, c.no, c.size, c.source_size, c.target, coalesce(r.times, 0) AS times, hi - lo AS words, r.shard, r.part_shard,
    greatest(least(hi, floor(coalesce(r.part, 0) * least({mix.BLOCK}, c.source_size - c.block * {mix.BLOCK}))::BIGINT) - lo, 0) AS extra
  FROM c LEFT JOIN r ON c.no = r.no AND c.block = r.block),
t AS (
  SELECT id, start, no, size, source_size, target, sum(times * words + extra)::BIGINT AS taken, sum(times + CASE WHEN extra > 0 THEN 1 ELSE 0 END)::BIGINT AS n_slots,
    min(least(shard, CASE WHEN extra > 0 THEN part_shard END))::BIGINT AS first_shard
  FROM m GROUP BY ALL)
SELECT id AS doc_id, size, source_size, target, taken, n_slots, first_shard FROM t
UNION ALL SELECT id, size, source_size, target, 0, 0, NULL FROM p WHERE size = 0
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
i AS (SELECT row_number() OVER () AS n, * FROM p),
m AS (
  SELECT i.n, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM i JOIN r ON (i.host = r.h OR ends_with(i.host, '.' || r.h)) AND starts_with(i.path, r.p) GROUP BY i.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM i LEFT JOIN m USING (n)
"""


def _op9_sql() -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(i, name, t.replace("'", "''")) for i, (name, t) in enumerate(licences.TEMPLATES))
    words = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_transform(list_zip(w[:-2], w[2:]), lambda x: concat_ws(' ', x[1], x[2]))"
    return f"""
WITH raw(k, name, t) AS (VALUES {quoted}),
tpl AS (SELECT k, name, g, list_distinct(g) AS b FROM (SELECT k, name, {grams} AS g FROM (SELECT k, name, {words.format("t")} AS w FROM raw))),
tg AS (SELECT k, unnest(b) AS gram FROM tpl),
d AS (SELECT n, doc_id, {grams} AS g FROM (SELECT row_number() OVER () AS n, doc_id, {words.format("text")} AS w FROM documents)),
u AS (SELECT n, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS pos FROM d),
h AS (SELECT u.n, tg.k, u.gram, u.pos, lag(u.pos) OVER (PARTITION BY u.n, tg.k ORDER BY u.pos) AS before FROM u JOIN tg USING (gram)),
s AS (
  SELECT h.n, h.k, tpl.name, tpl.b, list_distinct(d.g[h.pos:h.pos + len(tpl.g) - 1]) AS a
  FROM h JOIN tpl USING (k) JOIN d USING (n) WHERE h.before IS NULL OR h.before < h.pos - 1 OR h.gram = tpl.g[1]),
ok AS (SELECT * FROM (SELECT n, k, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM s) WHERE dice >= {licences.THRESHOLD} - 1e-9),
best AS (SELECT n, max(dice) AS dice, count(DISTINCT k)::BIGINT AS n_matches FROM ok GROUP BY n),
named AS (SELECT best.n, best.dice, best.n_matches, min(ok.name) AS licence_id FROM best JOIN ok ON ok.n = best.n AND ok.dice = best.dice GROUP BY ALL)
SELECT d.doc_id, licence_id, round(dice, 6) AS dice, coalesce(n_matches, 0)::BIGINT AS n_matches FROM d LEFT JOIN named USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op3_extendible_sharding": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op5_source_mixing": OP5_SQL, "op7_url_filter": OP7_SQL, "op9_licence_scan": _op9_sql()}
