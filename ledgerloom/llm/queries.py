"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, language_id, mixing, neighbours, ngram_join, quality, sharding, token_counts, toxicity, url_filter
from ledgerloom.llm.common import crc_bucket, table


def op1_containment_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = table(spark, sf_dir, "documents"), crc_bucket("doc_id", 4) == 2
    out = language_id.identify(documents, ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_bucket("doc_id", 5) == 0
    out = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_int8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_bucket("doc_id", 5) == 0
    documents = table(spark, sf_dir, "documents")
    out = toxicity.apply(documents, toxicity.train(documents, table(spark, sf_dir, "labels"), ~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_containment_leaks": op1_containment_leaks,
    "op2_kk_sharding": op2_kk_sharding,
    "op3_ppm_language": op3_ppm_language,
    "op4_ngram_components": op4_ngram_components,
    "op5_source_mixing": op5_source_mixing,
    "op6_url_templates": op6_url_templates,
    "op7_token_counts": op7_token_counts,
    "op8_boosted_quality": op8_boosted_quality,
    "op9_int8_neighbours": op9_int8_neighbours,
    "op10_gru_toxicity": op10_gru_toxicity,
}

_OP1 = r"""
WITH b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, k, list_aggregate(w[j : j + k - 1], 'string_agg', ' ') AS s
      FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT DISTINCT k FROM i),
s AS (SELECT DISTINCT doc_id, k, list_aggregate(w[j : j + k - 1], 'string_agg', ' ') AS s
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, k WHERE len(w) >= k)),
h AS (SELECT s.doc_id, i.item_id, count(*) AS n_found FROM s JOIN i ON s.k = i.k AND s.s = i.s GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_found AS BIGINT) AS n_found, n_found / n_item AS containment
FROM h JOIN n USING (item_id) WHERE n_found >= 0.75 * n_item
"""

_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[j : j + 4], 'string_agg', ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS j FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: Source weights 3, 1, 2; 150 % of all sizes; 2 times a source's size.
_OP5 = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CAST(CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(2.0 AS DOUBLE) * source_size AS cap FROM r),
f AS (
  SELECT *, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         + cap / weight * sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS need
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN need <= budget THEN cap ELSE
    (budget - coalesce(sum(CASE WHEN need <= budget THEN cap END) OVER (), 0)) / sum(CASE WHEN need > budget THEN weight END) OVER () * weight END AS target
  FROM f),
p AS (
  SELECT doc_id, size, source_size, target, floor(target) AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(whole / source_size) END AS epochs FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, whole - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""

#: Levels of a path that the SQL of op6 unrolls; deeper paths do not occur in the tables.
_LEVELS = 8


def _op6_levels() -> str:
    """CTEs p1, p2, ...: distinct paths with all levels up to that generalised, each level seen under what the ones before became."""
    out = ""
    for i in range(_LEVELS):
        out += f"""
c{i} AS (SELECT host, done, rest[1] AS child, sum(n) AS n FROM p{i} WHERE len(rest) > 0 AND rest[1] <> '*' GROUP BY ALL),
v{i} AS (SELECT host, done FROM c{i} GROUP BY host, done HAVING count(*) >= 24 AND sum(n) < 8.0 * count(*)),
p{i + 1} AS (
  SELECT p.host, p.seg, p.n, CASE WHEN len(p.rest) = 0 THEN p.done WHEN v.host IS NULL THEN p.done || '/' || p.rest[1] ELSE p.done || '/*' END AS done, p.rest[2:] AS rest
  FROM p{i} p LEFT JOIN v{i} v ON p.host = v.host AND p.done = v.done),"""
    return out


#: The rules net/, example.net/en/, example.com/de/, org/fr/; 24 children with under 8 rows each make a position variable;
#: 2 standard errors; 4 rows' worth of the host's share, and of 0.1 for that; 0.8.
_OP6 = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
s AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS label,
         string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') AS raw FROM r),
-- a segment varies by form if, without a suffix of up to five letters or digits, it is a number, eight hex digits or more, or has three digits in a row
f0 AS (SELECT DISTINCT host, raw, list_transform(raw, lambda x: regexp_replace(x, '\.[a-z0-9]{1,5}$', '')) AS bare FROM s),
f AS (SELECT host, raw, list_transform(range(1, len(raw) + 1), lambda i: CASE
    WHEN regexp_full_match(bare[i], '[0-9]+') OR regexp_full_match(bare[i], '[0-9a-f]{8,}') OR regexp_full_match(bare[i], '[0-9a-f-]{32,}')
      OR (regexp_matches(bare[i], '[0-9]{3}') AND NOT contains(bare[i], '.')) OR (regexp_matches(raw[i], '[0-9]{3}') AND NOT contains(raw[i], '.')) THEN '*' ELSE raw[i] END) AS seg FROM f0),
g AS (SELECT s.*, f.seg FROM s JOIN f ON s.host = f.host AND s.raw = f.raw),
p0 AS (SELECT host, seg, count(*) AS n, '' AS done, seg AS rest FROM g GROUP BY host, seg),@LEVELS@
u AS (SELECT g.page_id, g.host, g.path, g.rule, g.label, t.done AS template FROM g JOIN p@LAST@ t ON g.host = t.host AND g.seg = t.seg),
k AS (SELECT host, template, regexp_replace(template, '[^/*]+(/\**)*$', '?\1') AS parent, count(label) AS k, CAST(coalesce(sum(label), 0) AS BIGINT) AS bad FROM u GROUP BY host, template),
w AS (SELECT *, sum(k) OVER (PARTITION BY host, parent) AS fk, sum(bad) OVER (PARTITION BY host, parent) AS fb, sum(k) OVER (PARTITION BY host) AS hk, sum(bad) OVER (PARTITION BY host) AS hb FROM k),
x AS (SELECT *, CASE WHEN fk > 0 THEN CAST(fb AS DOUBLE) / fk ELSE 0.0 END AS pooled FROM w),
a AS (SELECT *, k > 0 AND abs(CAST(bad AS DOUBLE) / greatest(k, 1) - pooled) <= 2.0 * sqrt(pooled * (1 - pooled) / greatest(k, 1)) AS alike FROM x),
j AS (SELECT host, template, CASE WHEN (CASE WHEN alike THEN fk ELSE k END) > 0
        AND ((CASE WHEN alike THEN fb ELSE bad END) + 4.0 * ((hb + 4.0 * 0.1) / (hk + 4.0))) / ((CASE WHEN alike THEN fk ELSE k END) + 4.0) >= 0.8 THEN 'block' ELSE 'allow' END AS judged FROM a)
SELECT u.page_id, u.host, u.path, u.rule, CASE WHEN u.label = 1 THEN 'block' WHEN u.label = 0 THEN 'allow' ELSE j.judged END AS verdict
FROM u JOIN j ON u.host = j.host AND u.template = j.template
""".replace("@LEVELS@", _op6_levels()).replace("@LAST@", str(_LEVELS))

_OP9 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op1_containment_leaks": _OP1, "op4_ngram_components": _OP4, "op5_source_mixing": _OP5, "op6_url_templates": _OP6, "op9_int8_neighbours": _OP9}
