"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadgrid.llm import conversations, exact_dedup, line_dedup, mixing, near_dedup, packing, quality, secrets, substring_dedup, topk, toxicity, url_filter, whitening
from loadgrid.llm.common import table, written


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=4)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the ledger as it was before the last rule came: every blob is in it, and due for that rule alone
    before = written(secrets.update_ledger(docs, rules=secrets.RULES[:-1]))
    found = secrets.find_secrets(docs, before)
    kinds = ("assign", "access", "hex")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    n = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in kinds]  # noqa: B023
    return found.select(
        "doc_id", *n, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_kept", "n_links", F.crc32(F.array_join("kept", ",").cast("binary")).alias("kept_crc32"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_best_fit_packing, op3_secret_scan, op4_source_mix, op5_toxicity, op6_line_dedup, op7_exact_top_k, op8_quality, op10_url_filter, op9_exact_dedup, op11_embedding_whitening, op12_conversation_repair, op13_substring_dedup)}

ORACLE: dict = {}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE["op9_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_AZ})) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d"""

ORACLE["op4_source_mix"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (most::DOUBLE / weight, rank)) AS level FROM l WHERE most > level * weight),
t AS (SELECT w.source, w.source_size, CASE WHEN f.level IS NULL OR w.most <= f.level * w.weight THEN w.most::DOUBLE ELSE f.level * w.weight END AS target
      FROM w CROSS JOIN f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix:source:' || coalesce(d.source, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS start,
             row_number() OVER (ORDER BY d.source IS NULL, d.source, d.size, ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT, d.doc_id) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + floor((k + 1) * (rate - floor(rate)) + start) - floor(k * (rate - floor(rate)) + start))::BIGINT AS taken FROM x"""


def _spans_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: matches, and the texts between them, in turn."""
    return f"""
SELECT doc_id, '{kind}' AS kind, start, start + len(m) AS stop FROM (
  SELECT doc_id, m, v, sum(len(g)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(len(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {pattern}, 0)) AS m, unnest(regexp_extract_all(text, {pattern}, {group})) AS v,
               unnest(regexp_split_to_array(text, {pattern})[: len(regexp_extract_all(text, {pattern}, 0))]) AS g,
               generate_subscripts(regexp_extract_all(text, {pattern}, 0), 1) AS i
        FROM documents WHERE regexp_matches(text, {pattern})))
WHERE len(v) >= {least}"""


_KINDS = "CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END"
_SPANS = " UNION ALL ".join(_spans_sql(r.kind, "'" + r.pattern.replace("'", "''") + "'", r.group, r.least) for r in secrets.RULES)
ORACLE["op3_secret_scan"] = f"""
WITH s AS ({_SPANS}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, {_KINDS}) FILTER (kind <> 'pem') AS base,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, {_KINDS}) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""

ORACLE["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""

ORACLE["op7_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLE["op13_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w),
s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM k),
f AS (SELECT h, min(doc_id) AS m FROM s GROUP BY h),
g AS (SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 50)) AS i FROM s JOIN f ON s.h = f.h WHERE f.m < s.doc_id),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
r AS (SELECT p.doc_id, count(*) AS kept, string_agg(p.x, ' ' ORDER BY p.i) AS t FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(r.kept, 0))::BIGINT AS n_removed, sha256(coalesce(r.t, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""
