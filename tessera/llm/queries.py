"""The operators applied to the fixed tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .html_text import extract
from .langid import LanguageModel, fit_language_model, identify
from .licenses import scan_licenses
from .line_dedup import drop_shared_lines
from .ngram_join import ngram_jaccard_components
from .packing import LENGTHS, pack
from .periodic import periodic_runs
from .sharding import extendible_shards
from .suffix_dedup import suffix_dedup
from .vector_codes import compress_vectors
from .vectors import embedding_dedup, vp_search

#: Bytes of a shard.
SHARD_BYTES = 1 << 20
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85, lower=True)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> LanguageModel:
    return fit_language_model(docs.where(~held_out(F.col("doc_id"))), "text", "lang", F.col("doc_id"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), limit=SHARD_BYTES)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", n_words(F.col("text")), permitted=LENGTHS)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a document in ten, by a hash of the id, the words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10).cast("long"), F.size("words").cast("long")
    a = g % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    moved = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1))).alias("words"))
    moved = moved.select("doc_id", "text", "words", a.alias("a"), period.alias("period"))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("period")).cast("int")))
    again = F.array_join(F.transform("words", word), " ")
    return moved.select("doc_id", F.when(F.size("words") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_language_id, op3_embedding_dedup, op4_substring_dedup, op5_license_scan, op6_sharding, op7_byte_bpe, op8_html_text, op9_vp_search, op10_best_fit, op11_vector_codes, op12_line_dedup, op13_periodic_runs)}

def _codes_sql() -> str:
    """op11: codebooks c0 to c4, each from the one before."""
    out = ["""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, k, q[k * len(q) // 4 + 1:(k + 1) * len(q) // 4] AS x FROM v, (SELECT unnest(range(0, 4)) AS k)),
c0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 256)"""]
    for r in range(5):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, k, min(d * 256 + e) % 256 AS e, min(d) AS d FROM (
  SELECT vec_id, label, p.k, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{r} USING (k)) GROUP BY vec_id, k)""")
        if r < 4:
            out.append(f"""m{r} AS (SELECT k, e, list(m ORDER BY i) AS c FROM (SELECT p.k, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
  FROM p JOIN a{r} USING (vec_id, k), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY p.k, e, i) GROUP BY k, e)""")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT k, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k, e))")
    return ", ".join(out) + """, f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) FROM c4) AS codebooks_sha256 FROM f"""


SQL = {
    "op4_substring_dedup": """
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE doc_id > m),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM dup),
gone AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op6_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents),
w AS (SELECT doc_id, n_bytes, CAST(concat('0x', substr(m, 1, 7)) AS BIGINT) AS h, array_to_string(list_transform(range(0, 4), lambda k: lpad(CAST(bin(CAST(concat('0x', substr(m, 1 + 7 * k, 7)) AS BIGINT)) AS VARCHAR), 28, '0')), '') AS bits FROM d),
s AS (SELECT doc_id, depth, sum(n_bytes) OVER (PARTITION BY depth, h >> (28 - depth)) AS b FROM w, (SELECT unnest(range(0, 29)) AS depth)),
l AS (SELECT doc_id, min(depth) FILTER (WHERE b <= {SHARD_BYTES}) AS depth FROM s GROUP BY doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, substr(bits, 1, coalesce(depth, 112)) AS shard, depth IS NULL AS oversize FROM w JOIN l USING (doc_id)""",
    "op11_vector_codes": _codes_sql(),
    "op12_line_dedup": """
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
hot AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, i, line, last IS NOT NULL AND last <> doc_id AS gone FROM l LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op13_periodic_runs": """
WITH c AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS w,
  xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda h, v: CASE WHEN v >= 0 THEN xor(h, v) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END), 4294967295) AS h FROM documents),
a AS (SELECT doc_id, w, h, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM c),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM d),
pairs AS (SELECT l.doc_id, l.i, r.i - l.i AS p FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND (r.i - l.i) * 3 <= l.n),
stretches AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS length FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs) GROUP BY doc_id, p, island),
runs AS MATERIALIZED (SELECT doc_id, s, length, min(p) AS p FROM stretches WHERE length >= greatest(24, 3 * p) GROUP BY doc_id, s, length),
best AS (SELECT doc_id, s, length, p FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / p DESC, s, p) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || p || chr(10), '' ORDER BY s, p) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS "start", best.length, p AS period, CAST(floor(1000 * best.length // p) AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
#: op6: a bucket that 28 bits do not split is one row over the limit; op9 has no SQL, which would sum in another order.
