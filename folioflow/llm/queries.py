"""Queries of the operators in this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.clusters import cluster_rows, tie_to_known
from folioflow.llm.encoding import repair_encoding
from folioflow.llm.mixing import plan_shares, poisson_mix
from folioflow.llm.packing import fill_report, pack_documents
from folioflow.llm.pairs import broken_pairs
from folioflow.llm.pieces import split_oversized
from folioflow.llm.scans import find_noise, repair_scans
from folioflow.llm.similar import near_pairs, nearest_vectors
from folioflow.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return nearest_vectors(table(spark, root, "pgvector"), k=5)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return near_pairs(p1_neighbours(spark, root), 0.4)


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_oversized(table(spark, root, "chunk_results"), table(spark, root, "size_limits"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    # Every oversized text comes out with a first piece.
    return p2_pieces(spark, root).filter("piece = 0").select("id")


def _tied(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, root, "pgvector")
    members, clusters = cluster_rows(rows)
    tied = tie_to_known(members, rows.select("id", "doc_id"), table(spark, root, "paper_clusters"))
    return members, clusters, tied


def p3_clusters(spark: SparkSession, root: str) -> DataFrame:
    _, clusters, tied = _tied(spark, root)
    themes = table(spark, root, "paper_clusters").select("cluster_id", "theme")
    return clusters.join(tied.join(themes, "cluster_id"), "cluster", "left").select("cluster", "cluster_id", "theme", "size", "typical")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    members, _, tied = _tied(spark, root)
    return members.join(tied, "cluster").select("cluster_id", "id")


def p4_repaired(spark: SparkSession, root: str) -> DataFrame:
    return repair_scans(table(spark, root, "chunk_results"), table(spark, root, "source_papers"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    findings, _ = find_noise(table(spark, root, "chunk_results"), table(spark, root, "source_papers"))
    return findings.select("id", "noise").distinct()


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return broken_pairs(table(spark, root, "qa_pairs"))


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(table(spark, root, "documents"), table(spark, root, "pack_specs"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    return fill_report(p6_packed(spark, root), table(spark, root, "pack_specs"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_packed(spark, root).filter("parts > 1").select("spec_id", "doc_id").distinct()


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    mix, _ = poisson_mix(table(spark, root, "documents"), table(spark, root, "mix_plan"))
    return mix.select("doc_id", "source", "copy", "size", "position")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return poisson_mix(table(spark, root, "documents"), table(spark, root, "mix_plan"))[1]


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_shares(spark, root).filter("not reachable").select("source")


def p8_restored(spark: SparkSession, root: str) -> DataFrame:
    return repair_encoding(table(spark, root, "documents"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_restored(spark, root).filter("damaged").select("doc_id")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}


_USABLE = """
  select id, list_transform(embedding, lambda x: x::double) v from pgvector
  where embedding is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
with u as ({_USABLE}),
d as (select a.id a, b.id b, list_distance(a.v, b.v) d from u a join u b on a.id <> b.id),
r as (select a, b, d, row_number() over (partition by a order by d, b) r from d)
select distinct least(a, b) id_a, greatest(a, b) id_b from r where r <= 5 and d <= 0.4""",
        "p2_found": r"""
select c.id from chunk_results c
join size_limits s on s.section_category = coalesce(c.section_category, 5)
where length(trim(c.chunk_text, chr(32) || chr(9) || chr(10) || chr(13))) > s.max_chars""",
        "p6_found": """
select spec_id, doc_id from documents, pack_specs where strlen(text) + 1 > capacity""",
        "p7_found": """
with z as (select source, sum(strlen(text) + 1) s from documents group by source),
m as (select 0.8 * sum(strlen(text) + 1) m from documents)
select p.source from mix_plan p cross join m left join z using (source)
where p.max_repeats * coalesce(z.s, 0) < p.target_share * m.m""",
    }
