"""The registered queries of the operators, over whole tables, and their reference SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import bpe_codec, decontaminate, lm_score, ngram_join, packing, prefix_trie, runs, token_count, token_files, topk, toxicity, url_rules, warc
from siftmill.session import shared_folder, written_table
from siftmill.sources.tables import table

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_and_read(table(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).cast("bigint")
    return captures.select(
        F.regexp_extract("metadata.extra", r"^page: (-?\d+)", 1).try_cast("bigint").alias("page_id"), "payload_bytes", F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), number("response.refers_to")).alias("refers_to"),
    )


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe_codec.encode(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)
    return bpe_codec.digests(bpe_codec.decode(ids, MULTI_RANKS))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.flag(docs, decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark")))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), BPE_JSON, public_tokenizers.PATTERN)


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/siftmill/tokens-{uuid.uuid4().hex}"
    token_files.write_files(table(spark, sf_dir, "documents"), path, BPE_JSON)
    return token_files.digests(spark, path)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by the checksum of its id, repeats p of its words from word a on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(repeated, 1, rest)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_longest(runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "longest.*", F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = written_table(packing.cut(table(spark, sf_dir, "documents"), WORD_JSON), "pieces")
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def with_shared_heads(paths: DataFrame) -> DataFrame:
    """Conversations whose first h turns are those of the one whose id is theirs less its remainder by five."""
    rows = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"))
    heads = paths.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    rows = rows.join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = written_table(prefix_trie.conversation_paths(table(spark, sf_dir, "conversations")), "turn-paths")
    return prefix_trie.prefix_trie(with_shared_heads(paths))


QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard,
    "op2_toxicity": toxic,
    "op3_warc": warc_captures,
    "op4_bpe_codec": bpe_round_trip,
    "op5_url_filter": url_filter,
    "op6_decontamination": benchmark_overlap,
    "op7_exact_top_k": exact_top_k,
    "op8_lm_score": lm_scores,
    "op9_token_counts": token_counts,
    "op10_token_files": token_id_files,
    "op11_periodic_runs": periodic_runs,
    "op12_best_fit_packing": best_fit_packing,
    "op13_prefix_trie": conversation_trie,
}

def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string of ASCII characters, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}::BIGINT[]), lambda c, b: {step}), 4294967295)"


ORACLES = {
    "op11_periodic_runs": f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, {crc32_sql("doc_id::VARCHAR")} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
e AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
w AS (
  SELECT id, n, i, CASE WHEN i >= a THEN words[a + (i - a) % p + 1] ELSE words[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM f)),
same AS (
  SELECT x.id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM same),
stretches AS (
  SELECT id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT id, start, length, min(q) AS period FROM stretches GROUP BY id, start, length),
per AS (
  SELECT id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY id),
gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (id) LEFT JOIN kept USING (id)""",
    "op13_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS size, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
u AS (
  SELECT c.conv_id, t.pos, t.size, t.digest FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= h
  UNION ALL SELECT c.conv_id, t.pos, t.size, t.digest FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
p AS (
  SELECT conv_id, row_number() OVER o AS depth, string_agg(digest, '') OVER o AS path, size FROM u WINDOW o AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
nodes AS (
  SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY path),
kids AS (SELECT left(path, 64 * (depth - 1)::BIGINT) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
sums AS (
  SELECT left(path, 64 * k) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (path) LEFT JOIN nodes a ON n.depth > 0 AND a.path = left(n.path, 64 * (n.depth - 1)::BIGINT)""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f""",
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
