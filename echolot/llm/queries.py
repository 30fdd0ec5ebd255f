"""The operators applied to whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, decontamination, licenses, neighbours, ngram_join, packing, pii, sharding, substrings, toxicity
from .common import table

#: Names of the shards that documents are placed on.
SHARDS = [f"shard-{i:02d}" for i in range(32)]
#: Vectors whose id is divisible by this are searched for, among all.
QUERY_EVERY = 20


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"), nested=True)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, "doc_id", SHARDS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=QUERY_EVERY)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_ngram_jaccard_join, op4_sharding, op5_toxicity, op6_benchmark_decontamination, op7_pii, op8_best_fit_packing, op9_nearest_neighbours, op10_html_extraction)}


def _sharding_sql() -> str:
    owners = ",".join(map(str, sharding.lookup_table(SHARDS)))
    names = ",".join(f"'{s}'" for s in SHARDS)
    return f"""
    WITH slots AS (
      SELECT doc_id, source, n_chars,
             CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot
      FROM documents)
    SELECT doc_id, source, n_chars, slot, ([{names}])[([{owners}])[slot + 1] + 1] AS shard FROM slots"""


_JACCARD_SQL = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
    s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {ngram_join.N} THEN list_transform(range(1, len(w) - {ngram_join.N} + 2), lambda i: array_to_string(w[i:i + {ngram_join.N} - 1], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
    heads AS MATERIALIZED (SELECT s, min(doc_id) AS set_id, count(*) - 1 AS copies FROM s GROUP BY s),
    inv AS (SELECT set_id, unnest(s) AS g, len(s) AS n FROM heads),
    pairs AS MATERIALIZED (
      SELECT a.set_id AS a, b.set_id AS b FROM inv a JOIN inv b ON a.g = b.g AND a.set_id < b.set_id
      GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= {ngram_join.THRESHOLD}),
    edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    linked AS (SELECT a AS set_id, count(*) AS links FROM edges GROUP BY a),
    reach AS (SELECT a AS set_id, b AS other FROM edges UNION SELECT r.set_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
    class AS (SELECT set_id, min(other) AS class_id FROM reach GROUP BY set_id)
    SELECT d.doc_id, coalesce(class_id, h.set_id, d.doc_id) AS class_id, coalesce(h.set_id, d.doc_id) AS set_id,
           CAST(coalesce(copies, 0) AS BIGINT) AS copies, CAST(coalesce(links, 0) AS BIGINT) AS links
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
    LEFT JOIN s USING (doc_id) LEFT JOIN heads h ON h.s = s.s LEFT JOIN linked ON linked.set_id = h.set_id LEFT JOIN class ON class.set_id = h.set_id"""


def oracle_sql() -> dict[str, str]:
    """Of the join the exact result, which banding reaches up to its recall."""
    return {"op3_ngram_jaccard_join": _JACCARD_SQL, "op4_sharding": _sharding_sql()}
