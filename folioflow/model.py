"""Schemas and small dimensions of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Section categories (fixed values).
SECTIONS = {0: "ABSTRACT", 1: "INTRODUCTION", 2: "METHOD", 3: "EVALUATION", 4: "CONCLUSION", 5: "OTHER", 6: "RELATED_WORK"}
ABSTRACT, INTRODUCTION, METHOD, EVALUATION, CONCLUSION, OTHER, RELATED_WORK = range(7)
DIFFICULTIES = ("easy", "medium", "hard", "expert")
ANSWER_SOURCES = ("abstract", "introduction", "method", "evaluation", "multiple")
LOAD_STATES = ("success", "already_exists", "not_found", "no_pdf_url", "download_failed", "parse_failed")
#: Index kinds with their build and search parameters (fixed values).
INDEXES = {
    "FLAT": ({}, {}),
    "HNSW": ({"M": 16, "efConstruction": 256}, {"ef": 64}),
    "IVF_FLAT": ({"nlist": 1024}, {"nprobe": 16}),
}

#: A row of the unified collection: a paper (chunk_id -1) or one of its chunks.
COLLECTION = (
    "id BIGINT, doc_id STRING, vectors ARRAY<FLOAT>, text STRING, title STRING, url STRING, pdf_url STRING, conference_name STRING, "
    "conference_year BIGINT, conference_round STRING, chunk_id BIGINT, section_category BIGINT, section_title STRING, parent_section STRING, page_number BIGINT"
)
PAPER_SOURCE = "doc_id STRING, title STRING, abstract STRING, pdf_url STRING, url STRING, conference_name STRING, conference_year INT, conference_round STRING"
CHUNK = (
    "chunk_text STRING, contextual_prefix STRING, text_for_embedding STRING, text STRING, chunk_index INT, section_title STRING, "
    "section_category INT, parent_section STRING, page_number INT"
)
CHUNK_FILE = f"doc_id STRING, title STRING, strategy STRING, chunks ARRAY<STRUCT<{', '.join(c.strip().replace(' ', ': ', 1) for c in CHUNK.split(','))}>>"
QA_PAIR = (
    "id INT, question STRING, difficulty STRING, expected_doc_ids ARRAY<STRING>, expected_chunk_ids ARRAY<INT>, answer_source STRING, "
    "reference_answer STRING, expected_section_category INT, is_multi_paper BOOLEAN"
)
GROUND_TRUTH = (
    "version STRING, created_at STRING, total_papers INT, difficulty_distribution MAP<STRING,INT>, source_distribution MAP<STRING,INT>, "
    "qa_pairs ARRAY<STRUCT<id: INT, question: STRING, difficulty: STRING, expected_doc_ids: ARRAY<STRING>, expected_chunk_ids: ARRAY<INT>, "
    "answer_source: STRING, reference_answer: STRING, is_multi_paper: BOOLEAN>>"
)
TRACE = (
    "trace_id STRING, url STRING, start_time STRING, end_time STRING, model_name STRING, "
    "tool_calls ARRAY<STRUCT<step_idx: INT, tool_name: STRING, tool_args: STRING, tool_output: STRING>>, final_selector_json_raw STRING, verify_score DOUBLE"
)


def sections(spark: SparkSession) -> DataFrame:
    """(section_category, section_name): the seven categories."""
    return spark.createDataFrame(list(SECTIONS.items()), "section_category int, section_name string")


def section_name(category: Column) -> Column:
    """Name of a category, UNKNOWN for any other value."""
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, category.cast("int")), F.lit("UNKNOWN"))


def collection(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """The unified collection, without vectors: paper rows (chunk_id -1) and chunk rows.

    ``papers`` are exported papers, ``chunks`` chunk rows; a chunk takes the scalar
    fields of its paper where it has one (the smallest of each if it is listed twice).
    """
    fields = ("title", "url", "pdf_url", "conference_name", "conference_year", "conference_round")
    one = papers.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in fields]).select("doc_id", F.struct(*fields).alias("p"))
    paper_rows = papers.select(
        "doc_id", F.col("abstract").alias("text"), "title", "url", "pdf_url", "conference_name", F.col("conference_year").cast("long"), "conference_round",
        F.lit(-1).cast("long").alias("chunk_id"), F.lit(ABSTRACT).cast("long").alias("section_category"),
        F.lit("").alias("section_title"), F.lit("").alias("parent_section"), F.lit(0).cast("long").alias("page_number"),
    )
    chunk_rows = chunks.join(one, "doc_id", "left").select(
        "doc_id", F.col("chunk_text").alias("text"), "p.title", "p.url", "p.pdf_url", "p.conference_name", F.col("p.conference_year").cast("long").alias("conference_year"), "p.conference_round",
        F.col("chunk_index").cast("long").alias("chunk_id"), F.coalesce(F.col("section_category").cast("long"), F.lit(OTHER).cast("long")).alias("section_category"),
        F.coalesce("section_title", F.lit("")).alias("section_title"), F.coalesce("parent_section", F.lit("")).alias("parent_section"),
        F.coalesce(F.col("page_number").cast("long"), F.lit(0).cast("long")).alias("page_number"),
    )
    return paper_rows.unionByName(chunk_rows)
