"""Whole evaluations: data prepared by strategy, retrieval in rounds, experiments with resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import chunking, store, vectors

ROUTES = (("collect", r"\b(collect|crawl|download|scrape|fetch)\b"), ("clarify", r"^\s*\W*\s*$"))


def route(question: Column) -> Column:
    """Where a question goes: to the collector, back for clarification, else to the search."""
    low = F.lower(F.coalesce(question, F.lit("")))
    rule = F
    for name, pattern in ROUTES:
        rule = rule.when(low.rlike(pattern), F.lit(name))
    return rule.otherwise(F.lit("search"))


def sub_queries(question: Column, most: int = 4) -> Column:
    """A question's parts between "and", "vs" and commas, four at most; the question itself if it has none."""
    parts = F.filter(F.transform(F.split(question, r"(?i)\s+(?:and|vs\.?|versus)\s+|,\s*"), F.trim), lambda p: F.length(p) > 2)
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, most)).otherwise(F.array(question))


def search_in_rounds(
    questions: DataFrame,
    rows: DataFrame,
    embed: Callable[[Column], Column],
    k: int = 5,
    most_rounds: int = 4,
    enough: float = 0.6,
    text_col: str = "text",
    vec_col: str = "vectors",
) -> DataFrame:
    """(query_id, rank, doc_id, dist): hits of questions (query_id, question), gathered over rounds.

    The first round searches with the whole question, further ones with its parts;
    a question is done when its hits' texts cover ``enough`` of its words. At most
    four rounds, so the plan is bounded; every document counts once, by its best hit.
    """
    parts = questions.select("query_id", "question", F.posexplode(F.concat(F.array("question"), sub_queries(F.col("question")))).alias("round", "part"))
    parts = parts.filter(F.col("round") < most_rounds)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    open_, found = questions.select("query_id", "question"), None
    for n in range(most_rounds):
        asked = parts.filter(F.col("round") == n).join(open_.select("query_id"), "query_id", "left_semi").select("query_id", embed(F.col("part")).alias("query"))
        hits = vectors.search_each(rows, asked, k, ("doc_id", text_col), vec_col)
        found = hits if found is None else found.unionByName(hits)
        if n + 1 < most_rounds:
            seen = found.groupBy("query_id").agg(F.concat_ws(" ", F.collect_list(F.lower(text_col))).alias("t"))
            covered = open_.join(seen, "query_id", "left").select(
                "query_id", "question", F.coalesce(F.try_divide(F.size(F.filter(words(F.col("question")), lambda w: F.contains(F.col("t"), w))), F.size(words(F.col("question")))), F.lit(0.0)).alias("c")
            )
            open_ = covered.filter(F.col("c") < enough).select("query_id", "question")
    w = Window.partitionBy("query_id", "doc_id").orderBy("dist")
    best = found.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    order = Window.partitionBy("query_id").orderBy("dist", "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "dist")


def prepare(papers: DataFrame, chunks: DataFrame, strategies: tuple[str, ...] = ("paragraph", "contextual")) -> dict[str, DataFrame]:
    """For each strategy the rows to load: the chunks of all papers with an address of their PDF, merged to size, with the text to embed."""
    exported = papers.filter(store.not_blank(F.col("pdf_url"))).groupBy("doc_id").agg(F.min("title").alias("paper_title"))
    out = {}
    for s in strategies:
        own = chunks.filter(F.col("strategy") == s).join(exported, "doc_id")
        merged = chunking.sentence_merge(own, order=("doc_id", "chunk_index", "id"))
        out[s] = chunking.with_prefix(merged, F.col("contextual_prefix") if s == "contextual" else None)
    return out


def prepared_counts(prepared: dict[str, DataFrame]) -> DataFrame:
    """(strategy, documents, chunks) of prepared rows."""
    parts = [df.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks")).select(F.lit(s).alias("strategy"), "documents", "chunks") for s, df in prepared.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


def report(l1: DataFrame, l2: DataFrame, l3: DataFrame, run_id: str) -> DataFrame:
    """One row with the three levels' metrics as structs."""
    pack = lambda df, n: df.select(F.struct(*df.columns).alias(n))
    return (
        pack(l1, "l1_paper_discovery").join(pack(l2, "l2_section_retrieval"), F.lit(True)).join(pack(l3, "l3_end_to_end"), F.lit(True))
        .select(F.lit(run_id).alias("run_id"), "l1_paper_discovery", "l2_section_retrieval", "l3_end_to_end")
    )


def compare(experiments: DataFrame, done: DataFrame, run: Callable[[str, str, bool], DataFrame]) -> DataFrame:
    """Results (name, ...) of all experiments: kept ones as they are, the missing ones by ``run`` (strategy, index, agentic)."""
    todo = store.missing(experiments, done, ["name"]).orderBy("name").collect()  # a grid has a dozen rows
    out = done
    for e in todo:
        out = out.unionByName(run(e.chunk_strategy, e.index_type, e.enable_agentic_rag).withColumn("name", F.lit(e.name)).select(*done.columns))
    return out

