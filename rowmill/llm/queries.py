"""Queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rowmill.llm import bitplanes, lexical, mincut, mixing, neardup, outliers, packing, shards, spelling, topk, toxicity, warc, weaklabels
from rowmill.llm.tokens import word_tokenizer
from rowmill.llm.words import word_count
from rowmill.plans.lineage import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the session and the folder of the tables."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query(OP1_SQL)
def op1_pivot_distance_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(topk.usable(F.col("embedding")))
    return topk.top_k(rows.select("vec_id", topk.quantized(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


@query()
def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    octets = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(octets) + 16).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"))
    placed = shards.shuffle_into_shards(narrow, ["doc_id"], n_shards=40, seed=7)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op3_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


@query()
def op4_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - 3.0 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, coalesce(least(3.0 * source_size::DOUBLE, weight * max(CASE WHEN level * weight < 3.0 * source_size THEN level END) OVER ()), 3.0 * source_size::DOUBLE) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size::DOUBLE), 3)::BIGINT ELSE 0 END AS times FROM t
), c AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.times, CASE WHEN p.times < 3 THEN greatest(0.0, p.target - p.times * p.source_size::DOUBLE) ELSE 0.0 END AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target, (size * (times + CASE WHEN 2 * (rest - before) > size THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


@query(OP5_SQL)
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_count(F.col("text")))


@query()
def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", *outliers.STATISTICS, "base_failed", "kept", "distance")


@query()
def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = docs.select("doc_id", weaklabels.score(F.col("text"), weaklabels.learn(docs)).alias("score"))
    return scored.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "kept": F.col("score") >= 0.5})


@query()
def op8_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = mincut.extract_main_text(pages, mincut.fit(pages))
    return text.withColumn("n_chars", F.length("text").cast("long"))


@query()
def op9_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    bitplanes.write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, word_tokenizer(), end_id=2)
    read = bitplanes.read_token_documents(spark, path)
    return read.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_tokenizer(), end_id=1)
    return packing.pack(pieces)


OP11_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), lambda a, b: a || b) AS payload_digest FROM p
), f AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS place, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first_id END AS refers_to FROM f
"""


@query(OP11_SQL)
def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'warc')}/archives"
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, minimum_revisit=0)
    records = warc.read_warc(spark, path)
    return records.select(
        warc.key_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.key_of(F.col("refers_to")).alias("refers_to"),
    )


def typing_errors(doc_id: int | None, words: Counter) -> Iterator[tuple[bytes, bytes]]:
    """Of one in 97 of a document's words, by a checksum, one letter is left out."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for word in words:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % 97 == 0:
            at = h % len(word)
            yield word, word[:at] + word[at + 1 :]


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), own AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY 1, 2
), octets AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM own
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INTEGER, 2))::BIGINT),
    lambda c, o: xor(t[(xor(c, o) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS h FROM octets, crc_table
), changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM v
), shorter AS (
  SELECT word, n, i, substr(word, 1, i::INTEGER) || substr(word, i::INTEGER + 2) AS k FROM places
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b USING (i, k) WHERE a.word <> b.word
  UNION SELECT shorter.word, v.word, v.n FROM shorter JOIN v ON v.word = k UNION SELECT v.word, s.word, s.n FROM shorter s JOIN v ON v.word = k
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM pairs GROUP BY word
), near AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS step FROM near UNION ALL SELECT way.word, near.form FROM way JOIN near ON near.word = way.step WHERE near.form IS NOT NULL
), roots AS (
  SELECT way.word, step AS root FROM way JOIN near ON near.word = way.step WHERE near.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM near JOIN roots USING (word)
"""


@query(OP12_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), minimum_length=5, changes=typing_errors)
    return spelling.spelling_variants(counts.where("n >= 3")).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), d AS (
  SELECT row_id, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0
), c AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), tf AS (
  SELECT row_id, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term
), impact AS (
  SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS part FROM tf JOIN w USING (term), c
), q AS (
  SELECT row_number() OVER () AS query_id, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT query_id, item_id, row_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN impact USING (term) GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query(OP13_SQL)
def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "index")
    lexical.build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return lexical.search(spark, path, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
