"""Queries of the numbered operators: each over the whole of its table, in the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, language_id, line_dedup, mixing, pii, quality_rules, secret_scan, simhash, substring_dedup, token_counts, toxicity, vector_codes
from .common import small_batches, table

SPACES = r"[\x20\x09-\x0D]"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_word_lines", "n_shouts", "rejected_by")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(pii.digest(*pii.BASE), 256).alias("base_sha256"), pii.digest(*pii.BASE, *pii.ADDED).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), str(tokenizer_path()))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.split_of(4) == 2
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, training=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.split_of(5) == 0
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(counts)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = secret_scan.find(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count(F.col("found"), k).alias(f"n_{k}") for k in secret_scan.BASE]
    base, every = (secret_scan.digest(F.col("found"), k) for k in (secret_scan.BASE, secret_scan.BASE + secret_scan.ADDED))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scan": op13_secret_scan,
}

OP3_SQL = r"""
WITH lines AS (SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
               FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
flagged AS (SELECT k.*, h.key IS NOT NULL AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY r, doc_id
"""

OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM windows JOIN repeated USING (k)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs),
kept AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.j) AS kept FROM words x LEFT JOIN gone g ON x.r = g.r AND x.j = g.j WHERE g.r IS NULL GROUP BY x.r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN n ON d.r = n.r LEFT JOIN kept k ON d.r = k.r
"""

OP5_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM rows_ GROUP BY source),
fill AS (
  SELECT 0 AS step, (SELECT sum(source_size) FROM sources)::DOUBLE / (SELECT sum(weight) FROM sources)::DOUBLE AS level
  UNION ALL
  SELECT step + 1, ((SELECT sum(source_size) FROM sources)
           - (SELECT coalesce(sum(3 * source_size), 0) FROM sources s WHERE s.weight * f.level > 3 * s.source_size))::DOUBLE
         / nullif((SELECT sum(weight) FROM sources s WHERE s.weight * f.level <= 3 * s.source_size), 0)::DOUBLE
  FROM fill f WHERE step < 50),
final AS (SELECT level FROM fill WHERE step = 50),
goal AS (SELECT source, source_size, least(weight * level, 3.0 * source_size)::DOUBLE AS target FROM sources, final),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM goal),
budgets AS (SELECT *, target - whole * source_size AS budget FROM parts),
runs AS (SELECT source, h, sum(size) AS edge, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
         FROM rows_ GROUP BY source, h),
took AS (SELECT u.source, u.h, (u.upto <= b.budget
           OR (u.upto - u.edge <= b.budget AND u.edge > 0 AND u.edge < 2 * (b.budget - (u.upto - u.edge)))) AS more
         FROM runs u JOIN budgets b ON u.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * least(b.whole + t.more::INT, 3))::BIGINT AS taken
FROM rows_ d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
JOIN took t ON d.source IS NOT DISTINCT FROM t.source AND d.h = t.h
"""

OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT p.r, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.k = x.k),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM found) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h ON d.r = h.r LEFT JOIN named m ON d.r = m.r
"""

OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT d.part, coalesce(f.good, false) AS good, coalesce(f.toxic, false) AS toxic,
                 (len(d.w) < 50)::INT + 2 * (100 * len(list_distinct(d.w)) < 65 * len(d.w))::INT
                 + 4 * (100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t))::INT
                 + 8 * regexp_matches(d.t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > x.first, false)::INT AS mask
          FROM docs d JOIN firsts x ON d.t = x.t LEFT JOIN flags f ON d.doc_id = f.doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
ranks AS (SELECT o, bits, m.mask, list_min(list_transform(range(1, 6), lambda s: CASE WHEN m.mask & bits[s] > 0 THEN s ELSE 6 END)) AS r
          FROM orders, (SELECT DISTINCT mask FROM counts) m),
steps AS (SELECT part, o, bits, s.s, sum(n) AS total,
                 coalesce(sum(n) FILTER (r > s.s), 0) AS kept, coalesce(sum(n) FILTER (r = s.s), 0) AS removed,
                 coalesce(sum(n) FILTER (r < s.s AND mask & bits[s.s] > 0), 0) AS redundant,
                 coalesce(sum(n) FILTER (mask = bits[s.s]), 0) AS unique_fails,
                 coalesce(sum(good) FILTER (r = s.s), 0) AS good_lost, coalesce(sum(toxic) FILTER (r = s.s), 0) AS toxic_lost
          FROM counts JOIN ranks USING (mask), (SELECT unnest(range(1, 6)) AS s) s GROUP BY part, o, bits, s.s)
SELECT part, array_to_string(o, '') AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, o[s]))::BIGINT AS shapley
FROM steps
"""


def _op12_sql(rounds: int = 6) -> str:
    """Assignments and refits of all rounds, one after the other."""
    out = [
        r"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, (SELECT unnest(range(8)) AS p) p)""",
        """book0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN (SELECT arg_min(r, v) AS r, row_number() OVER (ORDER BY vec_id) - 1 AS e
  FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 16) s USING (r))""",
    ]
    for k in range(rounds + 1):
        out.append(
            f"""near{k} AS MATERIALIZED (SELECT r, p, first(x) AS x, min((d, e)) AS best FROM (SELECT r, p, e, x,
  list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{k} USING (p)) GROUP BY r, p)"""
        )
        if k < rounds:
            out.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT p, e, list(mean ORDER BY j) AS c FROM (
  SELECT p, e, j, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS mean
  FROM (SELECT p, best[2] AS e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM near{k}) GROUP BY p, e, j) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
            )
    out.append(f"""coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY r)""")
    return (
        "WITH " + ",\n".join(out) + f"""
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept k JOIN coded c USING (r)
"""
    )


ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op7_decontamination": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_vector_codes": _op12_sql()}
