"""One registered query for each operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callgauge.llm import (
    decontaminate,
    embed_dedup,
    html_text,
    jaccard,
    language,
    licenses,
    line_dedup,
    negatives,
    packing,
    pii,
    runs,
    url_rules,
    warc,
)
from callgauge.llm.common import prepared, table


def vocabulary_path() -> str:
    """The tokenizer file, which every machine has as part of an installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.round_trip(table(spark, sf_dir, "pages")).select(*columns)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


def _all() -> tuple[Callable[[SparkSession, str], DataFrame], ...]:
    return (
        op1_warc,
        op2_main_text,
        op3_language,
        op4_decontamination,
        op5_embedding_duplicates,
        op6_packing,
        op7_pii,
        op8_url_rules,
        op9_line_dedup,
        op10_jaccard,
        op11_licenses,
        op12_hard_negatives,
        op13_periodic_runs,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def configured(build):
        return lambda spark, sf_dir: build(prepared(spark), sf_dir)

    return {build.__name__: configured(build) for build in _all()}


_WARC_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size FROM pages),
g AS (SELECT digest, min(page_id) AS first_id FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM p LEFT JOIN g USING (digest)
"""
_REACH = """
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, low) AS (SELECT id, id FROM nodes UNION SELECT b.y, r.low FROM reach r JOIN both_ways b ON b.x = r.id WHERE r.low < b.y),
lows AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
"""
_VECTOR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nodes AS (SELECT id FROM v),
links AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
{_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM both_ways b WHERE b.x = n.id) AS n_links, l.low AS component_id, n.id = l.low AS kept FROM nodes n JOIN lows l ON l.id = n.id
"""
_JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
nodes AS (SELECT id FROM w),
sizes AS (SELECT id, count(*) AS n FROM s GROUP BY id),
common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
{_REACH}
SELECT n.id AS doc_id, coalesce(z.n, 0) AS n_shingles, l.low AS component_id FROM nodes n JOIN lows l ON l.id = n.id LEFT JOIN sizes z ON z.id = n.id
"""
_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
    CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (SELECT anchor_id, other_id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _WARC_SQL, "op5_embedding_duplicates": _VECTOR_SQL, "op9_line_dedup": line_dedup.SQL, "op10_jaccard": _JACCARD_SQL, "op11_licenses": licenses.sql(), "op12_hard_negatives": _NEGATIVES_SQL}
