"""Readers and writers of the file formats: JSON lines, chunk files, ground truth, reports, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import model


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Exported papers, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(model.PAPER_SOURCE).json(path).filter("doc_id is not null")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """One JSON object a line; ``append`` adds files to what is there."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def read_chunk_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Chunk files, a JSON document for each paper (or one a line), as chunk rows; chunk_text falls back to text."""
    docs = spark.read.schema(model.CHUNK_FILE).option("multiLine", multi_line).json(path)
    flat = docs.select("doc_id", "title", "strategy", F.explode("chunks").alias("c"))
    return flat.select("doc_id", "title", "strategy", F.coalesce("c.chunk_text", "c.text").alias("chunk_text"), "c.contextual_prefix", "c.chunk_index", "c.section_title", "c.section_category", "c.parent_section", "c.page_number")


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """Chunk rows as one document for each paper and strategy, its chunks in order: the layout of chunk files.

    The layout holds a paper's chunks in one row; for corpora with very long
    documents keep chunk rows instead (:func:`write_jsonl`, partitioned by strategy).
    """
    fields = [c for c in ("chunk_text", "contextual_prefix", "chunk_index", "section_title", "section_category", "parent_section", "page_number") if c in chunks.columns]
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", *[c for c in fields if c != "chunk_index"])))
    return chunks.groupBy("doc_id", "strategy").agg(ordered.alias("chunks"))


def read_ground_truth(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The questions of ground-truth documents (one a file, or one a line), one row each."""
    return spark.read.schema(model.GROUND_TRUTH).option("multiLine", multi_line).json(path).select(F.inline("qa_pairs"))


def ground_truth(pairs: DataFrame, version: str = "1.0") -> DataFrame:
    """All questions as one document with their distributions; meant for evaluation sets, which fit one row."""
    fields = ["id", "question", "difficulty", "expected_doc_ids", "expected_chunk_ids", "answer_source", "reference_answer", "is_multi_paper"]
    papers = pairs.select(F.explode("expected_doc_ids").alias("d")).agg(F.count_distinct("d").cast("int").alias("total_papers"))
    counts = lambda c: pairs.groupBy(F.coalesce(c, F.lit("unknown")).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("count").cast("int"))))).alias(f"{c}_distribution"))
    body = pairs.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("qa_pairs"))
    return (
        papers.join(counts("difficulty"), F.lit(True))
        .join(counts("answer_source").withColumnRenamed("answer_source_distribution", "source_distribution"), F.lit(True))
        .join(body, F.lit(True))
        .select(F.lit(version).alias("version"), "total_papers", "difficulty_distribution", "source_distribution", "qa_pairs")
    )


def ground_truth_blocks(pairs: DataFrame, size: int = 500, version: str = "1.0") -> DataFrame:
    """Questions as documents of at most about ``size`` each, so that no row holds an unbounded set."""
    fields = ["id", "question", "difficulty", "expected_doc_ids", "expected_chunk_ids", "answer_source", "reference_answer", "is_multi_paper"]
    block = F.floor(F.col("id") / size)
    return pairs.groupBy(block.alias("block")).agg(F.lit(version).alias("version"), F.array_sort(F.collect_list(F.struct(*fields))).alias("qa_pairs")).drop("block")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): lines of a list, without blank ones and comments."""
    return url_lines(spark.read.text(path))


def url_lines(lines: DataFrame) -> DataFrame:
    v = F.trim("value")
    return lines.select(v.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Scraped listings, a JSON array a file, with the file's stem."""
    schema = "title string, abstract string, url string, pdf_url string"
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("stem", stem)


def line_window(texts: DataFrame, offset: int, count: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): lines [offset, offset + count) of every text, counted from 0."""
    return texts.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).filter(F.col("line_no").between(offset, offset + count - 1))


def latest_report(files: DataFrame) -> DataFrame:
    """Of file listings (path, modificationTime) the latest, ties by path."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def write_markdown(lines: DataFrame, path: str, header: list[str]) -> None:
    """Rows (line) under a Markdown table head, as text in one file."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(header) + " |"), (1, "|" + "---|" * len(header))], "n int, line string")
    rows = head.unionByName(lines.select(F.lit(2).alias("n"), "line"))
    rows.orderBy("n", "line").select("line").coalesce(1).write.mode("overwrite").text(path)
