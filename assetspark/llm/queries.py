"""Registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import Tokenizers, align_documents
from .block_topk import exact_top_k
from .centroids import cluster_vectors
from .common import lower_ascii, table
from .exact_dedup import exact_groups
from .license_scan import license_labels
from .mixing import mix_plan
from .near_dedup import near_groups
from .packing import pack
from .quality_model import quality_selection
from .quality_rules import quality_verdicts
from .repeated_spans import cut_repeats
from .token_counts import token_counts
from .url_filter import judge_urls

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = [5, 2, 1]
URL_RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block",
}


def tokenizer_path() -> str:
    """File of the production tokenizer; ASSETSPARK_TOKENIZER names another."""
    named = os.environ.get("ASSETSPARK_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=4)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lower_ascii(F.coalesce("text", F.lit("")))
    return exact_groups(table(spark, sf_dir, "documents"), text, keep="max").withColumnRenamed("content_sha256", "text_sha256")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), WEIGHTS).drop("source", "full_takes")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed="3:").digest()


def alignment_tokenizers() -> Tokenizers:
    """Both production tokenizers of the alignment."""
    import public_tokenizers as public

    return Tokenizers.read(public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), alignment_tokenizers())


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quality_rules, op3_license_scan, op4_quality_classifier, op5_token_counts,
        op6_minhash_near_dedup, op7_exact_dedup, op8_url_filter, op9_suffix_dedup, op10_source_mix,
        op11_exact_topk, op12_centroid_clusters, op13_token_alignment,
    )
}

_SPACE = r"[\x09-\x0D ]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _lloyd_sql(k: int, rounds: int, dim: int, scale: int, seed: str) -> str:
    """The rounds of the clustering, one after the other."""
    nearest = """
d{i} AS (
  SELECT v.r, c.cluster,
         list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS distance
  FROM v, c{i} c),
a{i} AS MATERIALIZED (
  SELECT r, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"""
    mean = """
s{i} AS (
  SELECT a.cluster, p.j, sum(v.q[p.j])::BIGINT AS s, count(*) AS n
  FROM a{i} a JOIN v USING (r), (SELECT unnest(range(1, {dim} + 1)) AS j) p GROUP BY ALL),
m{i} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM s{i} GROUP BY cluster),
c{j} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}' || vec_id::VARCHAR) NULLS LAST, q) - 1)::INTEGER AS cluster, q
  FROM v QUALIFY cluster < {k})"""]
    for i in range(rounds):
        steps += [nearest.format(i=i, dim=dim), mean.format(i=i, j=i + 1, dim=dim)]
    steps.append(nearest.format(i=rounds, dim=dim))
    return ",".join(steps) + f"""
SELECT v.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c USING (cluster)"""


SQL = {
    "op2_quality_rules": rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D ]+') AS words
  FROM documents),
windows AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM w, unnest(range(1, len(words) - 1)) AS u(i) WHERE len(words) >= 3),
twice AS (SELECT r, a, b, c FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM windows JOIN twice USING (r, a, b, c), unnest([0, 1, 2]) AS v(k) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x09-\x0D ]') GROUP BY r),
f AS (
  SELECT doc_id, words, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars > 14 * n_words OR word_chars < 2 * n_words
            OR 10 * n_symbols > 2 * n_words
            OR (n_dup_lines > 3 AND 20 * n_dup_lines > n_words)
            OR 100 * n_repeat_words > 30 * n_words
            OR 10 * len([x FOR x IN words IF contains(x, '!!')]) > n_words
            OR 10 * len([x FOR x IN words IF x = '|']) > n_words) AS kept
FROM b""",
    "op7_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER} AS content FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY content) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY content) AS kept,
       sha256(content) AS text_sha256
FROM t""",
    "op10_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D ]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS nr
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE (nr - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (
  SELECT *,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY full_at, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER ()
            - coalesce(sum(weight) OVER (ORDER BY full_at, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM f),
t AS (
  SELECT source, source_size,
         coalesce(least(cap, weight * (SELECT arg_min(level, full_at) FROM l WHERE full_at > level)), cap) AS target
  FROM l),
g AS (
  SELECT s.nr, s.source, s.source_size, t.target, round(t.target)::BIGINT AS take_words, greatest(1, least(2048, floor(t.target / 256)))::BIGINT AS bw
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
h AS (
  SELECT *, ceil(source_size / bw)::BIGINT AS blocks,
         CASE WHEN source_size > 0 THEN floor(take_words / source_size) ELSE 0 END::BIGINT AS turns FROM g),
lay AS (
  SELECT *, sum(slots) OVER (ORDER BY nr) - slots AS lo, sum(slots) OVER (ORDER BY nr) AS hi FROM (
    SELECT *, (turns * blocks + ceil((take_words - turns * source_size) / bw))::BIGINT AS slots FROM h)),
n AS (SELECT sum(slots)::BIGINT AS total, (sum(slots) + floor(sum(slots) / 16) + 64 * count(*))::BIGINT AS drawn FROM lay HAVING sum(slots) > 0),
pt AS (
  SELECT slot, floor(((slot + 1)::HUGEINT * 5566755282872655 % 9007199254740992)::DOUBLE / 9007199254740992.0::DOUBLE * total)::BIGINT AS pos
  FROM n, unnest(range(drawn)) AS u(slot)),
dr AS (
  SELECT slot, nr, slots, row_number() OVER (PARTITION BY nr ORDER BY slot) - 1 AS rank
  FROM pt JOIN lay ON pt.pos >= lay.lo AND pt.pos < lay.hi),
gt AS (SELECT nr, slots, (SELECT count(*) FROM dr WHERE dr.nr = lay.nr) AS got FROM lay),
ms AS (
  SELECT drawn + skip + r - got AS slot, nr, r AS rank FROM (
    SELECT *, coalesce(sum(slots - got) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip FROM gt WHERE slots > got),
  n, unnest(range(got, slots)) AS u(r)),
sc AS (SELECT slot, nr, rank FROM dr WHERE rank < slots UNION ALL SELECT slot, nr, rank FROM ms),
tk AS (
  SELECT nr, slot, (rank % blocks) * bw AS pos,
         least(least(bw, source_size - (rank % blocks) * bw), take_words - ((rank // blocks) * source_size + (rank % blocks) * bw)) AS words
  FROM sc JOIN lay USING (nr)),
p AS (
  SELECT d.doc_id, d.size, lay.nr, lay.source_size, lay.target, row_number() OVER () AS r,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN lay ON d.source IS NOT DISTINCT FROM lay.source),
x AS (
  SELECT r, slot, least(start + size, pos + words) - greatest(start, pos) AS held
  FROM p JOIN tk ON tk.nr = p.nr AND words > 0 AND pos < start + size AND pos + words > start)
SELECT doc_id, size, source_size, target, coalesce(sum(held), 0)::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(slot)::BIGINT AS slots
FROM p LEFT JOIN x USING (r) GROUP BY r, doc_id, size, source_size, target""",
    "op11_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS query_id, b.vec_id, b.r,
         coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20""",
    "op12_centroid_clusters": _lloyd_sql(k=8, rounds=10, dim=64, scale=1024, seed="3:"),
}
