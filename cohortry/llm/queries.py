"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, decontaminate, importance, language, licenses, minhash, ngram_model, piece_bpe, secrets, shard_tree, substring_dedup,
    vector_codes, vector_dedup,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
REGIONS, RACKS, SHARDS = 5, 4, 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(parts: int) -> Column:
    """Rows that a model must not learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts)) == 2


@query
def op1_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=2)


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_shard_tree(spark: SparkSession, folder: str) -> DataFrame:
    return shard_tree.shard_rows(table(spark, folder, "documents"), shard_tree.uniform(REGIONS, RACKS, SHARDS))


@query
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(table(spark, folder, "documents"))


@query
def op6_ngram_trie(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_model.scores(table(spark, folder, "documents"), held_out(7))


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, folder, "documents"), BYTE_BPE, PATTERN)


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"), BYTE_BPE, PATTERN)


@query
def op9_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings"))


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    parser = language.train(language.training_sample(docs, ~held_out(4)))
    return language.identify(docs, parser).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "bits")


@query
def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.round_trip(table(spark, folder, "documents"), PIECE_BPE)


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.coded_vectors(table(spark, folder, "embeddings"))


SQL["op1_substrings"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS seq
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35)
), repeated AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY seq) AS n FROM windows) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM repeated),
lists AS (SELECT doc_id, count(*) AS n, list(i) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: places IS NULL OR NOT list_contains(places, i)), ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""

SQL["op2_minhash"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0))
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_sets FROM shingles x JOIN shingles y USING (s)
        WHERE x.doc_id < y.doc_id GROUP BY 1, 2)
    JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * both_sets >= 80 * (p.n + q.n - both_sets)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

# The words of a text, as in the pattern of the contract, and every window of ten of them (or
# the whole of a shorter item).
SQL["op3_decontaminate"] = r"""
WITH words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS seq
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
    SELECT doc_id, i, size, string_agg(word, ' ') OVER (PARTITION BY doc_id, size ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten
    FROM words, sizes
), found AS (
    SELECT r.doc_id, r.i, r.size, w.item_id FROM runs r
    JOIN windows w ON w.size = r.size
        AND w.seq = array_to_string(string_split(r.ten, ' ')[1:r.size], ' ')
), hit AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
), total AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op4_shard_tree"] = f"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), rows AS (
    SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, octet_length(encode(coalesce(text, ''))) + 16 AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
            lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM documents, crc_table
), keys AS (SELECT DISTINCT k FROM rows),
regions AS (
    SELECT k, child, -ln((('0x' || substr(md5(k || '/' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
        / CASE WHEN child < {REGIONS} THEN {RACKS * SHARDS}.0 ELSE 1.0 END AS score
    FROM keys, range({REGIONS + 1}) c(child)
), region AS (
    SELECT k, arg_min(child, score) FILTER (child < {REGIONS}) AS region, arg_min(child, score) = {REGIONS} AS moves FROM regions GROUP BY k
), rack AS (
    SELECT k, any_value(region) AS region, any_value(moves) AS moves,
        arg_min(child, -ln((('0x' || substr(md5(k || '/' || region || '/' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) AS rack
    FROM region, range({RACKS}) c(child) GROUP BY k
), shard AS (
    SELECT k, any_value(moves) AS moves, any_value(region) * {RACKS * SHARDS} + any_value(rack) * {SHARDS}
        + arg_min(child, -ln((('0x' || substr(md5(k || '/' || region || '/' || rack || '/' || child), 1, 13))::BIGINT + 0.5)
            / 4503599627370496.0)) AS shard
    FROM rack, range({SHARDS}) c(child) GROUP BY k
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 3))::INT, doc_id, text_crc32, size) - 1 AS slot,
    CAST(CASE WHEN moves THEN {REGIONS * RACKS * SHARDS} ELSE shard END AS INTEGER) AS grown_shard
FROM rows JOIN shard USING (k)
"""

SQL["op9_vectors"] = """
WITH RECURSIVE vectors AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (
    SELECT vec_id, e FROM vectors WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x != 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id != y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9
), reach(a, b) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, with the table `t` of `crc_table` at hand."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'),
        lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""


SQL["op11_importance"] = rf"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
    SELECT row_number() OVER () AS r, true AS source, doc_id, text FROM documents
    UNION ALL SELECT -row_number() OVER (), false, NULL, text FROM benchmark
), words AS (
    SELECT r, source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), hashed AS (
    SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc_table
), places AS (SELECT r, source, bucket FROM words JOIN hashed USING (word)),
counts AS (
    SELECT bucket, (count(*) FILTER (source))::DOUBLE AS s, (count(*) FILTER (NOT source))::DOUBLE AS t FROM places GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM counts, totals
), weighed AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM places JOIN gains USING (bucket) WHERE source GROUP BY r),
scored AS (
    SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
            + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM texts LEFT JOIN weighed USING (r) WHERE source
), ranked AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round by all distances."""
    text = f"""
WITH sound AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
), whole AS (SELECT r, list_transform(e, lambda x: floor({scale} * x)::BIGINT) AS v, len(e) // {parts} AS width FROM sound),
pieces AS MATERIALIZED (
    SELECT r, p, i, v[p * width + i] AS x FROM (SELECT r, v, width, p, unnest(range(1, width + 1)) AS i FROM whole, range({parts}) q(p))
), book0 AS (SELECT p, r - 1 AS k, i, x FROM pieces WHERE r <= {entries})"""
    for n in range(rounds + 1):
        text += f""",
near{n} AS MATERIALIZED (
    SELECT r, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT a.r, p, b.k, sum((a.x - b.x) * (a.x - b.x))::BIGINT AS d FROM pieces a JOIN book{n} b USING (p, i) GROUP BY a.r, p, b.k) GROUP BY r, p
)"""
        if n < rounds:
            text += f""",
book{n + 1} AS MATERIALIZED (
    SELECT p, k, i, coalesce(((total - ((total % n) + n) % n) // n)::BIGINT, x) AS x FROM book{n} LEFT JOIN (
        SELECT p, k, i, sum(x)::BIGINT AS total, count(*) AS n FROM pieces JOIN near{n} USING (r, p) GROUP BY p, k, i) USING (p, k, i)
)"""
    return text + f""",
coded AS (
    SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r
), listed AS (SELECT sha256(coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i), '')) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM sound JOIN coded USING (r), listed
"""


SQL["op13_vector_codes"] = _vector_codes_sql()
