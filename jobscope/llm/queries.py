"""The queries of this subpackage, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .dart_minhash import near_duplicate_classes
from .decontamination import find_contaminated
from .language_id import identify_languages
from .metric_join import jaccard_components
from .nra_topk import search_embeddings
from .ns_kmeans import cluster_embeddings
from .packing import pack_documents
from .pii import pseudonymize
from .quality import score_quality
from .ring_sharding import shard_documents
from .toxicity import toxicity_of_documents
from .url_filter import judge_urls
from .workspace import table


def op1_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_embeddings(table(spark, sf_dir, "embeddings"))


def op3_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op6_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ns_bounds_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_embeddings(table(spark, sf_dir, "embeddings"))


def op12_voronoi_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_quality": op1_hierarchical_quality,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_hyperdimensional_language": op3_hyperdimensional_language,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_dart_minhash": op5_dart_minhash,
    "op6_conv_toxicity": op6_conv_toxicity,
    "op7_ring_sharding": op7_ring_sharding,
    "op8_url_filter": op8_url_filter,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_ns_bounds_kmeans": op11_ns_bounds_kmeans,
    "op12_voronoi_jaccard_join": op12_voronoi_jaccard_join,
    "op13_merge_path_alignment": op13_merge_path_alignment,
}

#: A document's and an item's distinct five-word shingles, as in words.shingles.
_SHINGLES = """
  SELECT id, text, w, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM (SELECT {id} AS id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table}) WHERE len(w) > 0"""


def _kmeans(rounds: int = 3, k: int = 16, dim: int = 64) -> str:
    """Plain rounds of assignment and floor of the mean, without bounds."""
    parts = [
        f"""x AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS y FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "e AS (SELECT vec_id, CAST(y AS BIGINT[]) AS v, count(*) AS m FROM x WHERE len(list_filter(y, lambda x: abs(x) > 134217728)) = 0 GROUP BY ALL)",
        "r AS (SELECT vec_id, v, unnest(range(m)) FROM e)",
        f"c0 AS (SELECT j, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS j FROM r) WHERE j < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT vec_id, v, m, min(d * {k} + j) AS dj FROM (SELECT vec_id, v, m, j,
  CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM e, c{i}) GROUP BY ALL)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT j, p, CAST(sum(x * m) AS BIGINT) AS s, CAST(sum(m) AS BIGINT) AS n
  FROM (SELECT dj % {k} AS j, m, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY j, p)""")
            parts.append(f"n{i} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM s{i} GROUP BY j)")
            parts.append(f"c{i + 1} AS (SELECT c{i}.j, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} ON c{i}.j = n{i}.j)")
    parts.append(f"f AS (SELECT vec_id, dj % {k} AS j, dj // {k} AS d, unnest(range(m)) FROM a{rounds})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(f.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} ON f.j = c{rounds}.j"""


ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op10_benchmark_decontamination": f"""
WITH d AS (SELECT DISTINCT id AS doc_id, s FROM ({_SHINGLES.format(id="doc_id", table="documents")})),
b AS (SELECT DISTINCT id AS item_id, s FROM ({_SHINGLES.format(id="item_id", table="benchmark")})),
n AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id)
SELECT doc_id, item_id, CAST(shared AS INTEGER) AS shared, CAST(size AS INTEGER) AS size, shared / size AS containment
FROM (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE shared >= ceil(0.8 * size - 1e-9)""",
    "op11_ns_bounds_kmeans": _kmeans(),
    "op12_voronoi_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.id AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS id FROM r GROUP BY x) c ON c.x = d.doc_id""",
}
