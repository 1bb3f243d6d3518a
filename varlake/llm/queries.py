"""Queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, importance, line_dedup, passages, pii, piece_codec, quality, recurrent, secret_scan, similar, token_counts, topk, vector_codes


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_words__").alias("n_words"), F.col("n_removed__").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p, ws FROM d WHERE len(ws) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS key FROM w),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT k.doc_id, unnest(range(k.p, k.p + 50)) AS pos FROM k JOIN f ON k.key = f.key WHERE f.first < k.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
m AS (SELECT words.doc_id, words.pos, word, gone.pos IS NOT NULL AS out FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos),
a AS (SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT out), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines__").alias("n_lines"), F.col("n_dropped__").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op3_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.link_similar(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


PSEUDONYM_KEY = "key of this query only"  # pseudonymise() has no default: production runs pass their own secret


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join("found.kind", ",").alias("kinds"), "text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    digest = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.col("matches.item_id").alias("item_ids"),
        F.coalesce(F.array_max("matches.similarity"), F.lit(0.0)).alias("similarity"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["start"], m["end"])), ",").alias("windows"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The crc32 of a string is a fold over its bytes with a table of 256 values, which eight halvings of each number make.
OP11_SQL = r"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda j: CAST(j AS UBIGINT))), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS t),
src AS MATERIALIZED (SELECT doc_id AS id, 's' AS side, text FROM documents UNION ALL SELECT item_id, 't', text FROM benchmark),
w AS MATERIALIZED (SELECT id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
f AS MATERIALIZED (
  SELECT id, side, unnest(ws) AS g FROM w
  UNION ALL SELECT id, side, ws[p] || ' ' || ws[p + 1] FROM (SELECT id, side, ws, unnest(range(1, len(ws))) AS p FROM w)
  UNION ALL SELECT id, side, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] FROM (SELECT id, side, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
n AS MATERIALIZED (SELECT g, id, side, count(*) AS n FROM f GROUP BY ALL),
x AS MATERIALIZED (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM n)),
b AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS UBIGINT))), lambda c, e: xor(c // 256, t[CAST(xor(c % 256, e) AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM x, tab),
k AS MATERIALIZED (SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE side = 's'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS DOUBLE) AS t FROM n JOIN b ON b.g = n.g GROUP BY bucket),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM k),
gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(((k.t + 1) * (a.s + 10000)) / ((k.s + 1) * (a.t + 10000)))) AS BIGINT) AS gain FROM k, a),
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN b ON b.g = n.g JOIN gain ON gain.bucket = b.bucket WHERE side = 's' GROUP BY id),
r AS MATERIALIZED (
  SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || w.id)[1:8] AS UBIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN d ON d.id = w.id WHERE side = 's'),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT r.doc_id, n_features, weight, score, p.rank FROM r LEFT JOIN p ON p.doc_id = r.doc_id AND p.rank <= 5 * p.n // 100
"""


def op12_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The codebooks' rounds as one materialised table after another."""
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {fine})",
        f"s AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM v, range({parts}) AS r(p))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT p, entry, x AS c FROM s JOIN f ON s.vec_id = f.vec_id)",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, label, p, x, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, entry) AS place FROM (
  SELECT s.*, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM s JOIN b{i} ON b{i}.p = s.p)) WHERE place = 1)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.entry, coalesce(n.c, b{i}.c) AS c FROM b{i} LEFT JOIN (SELECT p, entry, list(m ORDER BY j) AS c FROM (
  SELECT p, entry, j, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m FROM (SELECT p, entry, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY ALL) GROUP BY ALL) n ON n.p = b{i}.p AND n.entry = b{i}.entry)""")
    return f"""WITH {", ".join(steps)},
e AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) FROM b{rounds}) AS codebooks_sha256 FROM e"""


QUERIES = {
    "op1_passages": op1_passages,
    "op2_line_dedup": op2_line_dedup,
    "op3_similar": op3_similar,
    "op4_piece_codec": op4_piece_codec,
    "op5_topk": op5_topk,
    "op6_pii": op6_pii,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_importance": op11_importance,
    "op12_language_scores": op12_language_scores,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {"op1_passages": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_similar": OP3_SQL, "op5_topk": OP5_SQL, "op11_importance": OP11_SQL, "op13_vector_codes": op13_sql()}
