"""Retrieval quality: papers found, sections found, answers judged; experiments compared."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import model
from folioflow.functions import text as T


def paper_scores(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, p5, p10, r5, r10, rr, hit) of every query with expected documents.

    ``expected`` (query_id, expected array), ``hits`` (query_id, rank, doc_id). A
    precision divides by k whatever was retrieved. Repeated documents count once,
    at their first rank.
    """
    asked = expected.filter(F.size(F.coalesce("expected", F.array())) > 0).select("query_id", F.array_distinct("expected").alias("e"))
    found = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    # The rank of every expected document, by an equi-join on query and document.
    each = asked.select("query_id", F.size("e").alias("n"), F.explode("e").alias("doc_id")).join(found, ["query_id", "doc_id"], "left")
    at = lambda k: F.count_if(F.col("rank") <= k)
    return each.groupBy("query_id").agg(
        (at(5) / 5).alias("p5"), (at(10) / 10).alias("p10"), (at(5) / F.first("n")).alias("r5"), (at(10) / F.first("n")).alias("r10"),
        F.coalesce(1 / F.min(F.when(F.col("rank") <= 10, F.col("rank"))), F.lit(0.0)).alias("rr"), (at(10) > 0).cast("double").alias("hit"),
    )


def paper_metrics(scores: DataFrame) -> DataFrame:
    """Means over queries; zeros for none."""
    names = {"p5": "precision_at_5", "p10": "precision_at_10", "r5": "recall_at_5", "r10": "recall_at_10", "rr": "mrr", "hit": "hit_rate"}
    return scores.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in names.items()])


def source_category(source: Column, legacy_evaluation: int | None = None) -> Column:
    """Section in which an answer of this source stands; all (-1) for several or unknown ones."""
    evaluation = model.EVALUATION if legacy_evaluation is None else legacy_evaluation
    return (
        F.when(source == "abstract", model.ABSTRACT)
        .when(source == "introduction", model.INTRODUCTION)
        .when(source == "method", model.METHOD)
        .when(source == "evaluation", evaluation)
        .otherwise(-1)
    )


def chunk_scores(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer_source, p, r) of every query with expected chunks.

    ``expected`` (query_id, answer_source, chunks array), ``hits`` (query_id, chunk_id);
    paper rows (-1) don't count; a precision divides by what was retrieved, 0 for nothing.
    """
    asked = expected.filter(F.size(F.coalesce("chunks", F.array().cast("array<int>"))) > 0)
    got = hits.filter("chunk_id <> -1").groupBy("query_id").agg(F.collect_set(F.col("chunk_id").cast("int")).alias("got"))
    both = asked.join(got, "query_id", "left").select("query_id", "answer_source", F.array_distinct("chunks").alias("c"), F.coalesce("got", F.array().cast("array<int>")).alias("got"))
    shared = F.size(F.array_intersect("c", "got"))
    return both.select("query_id", "answer_source", F.coalesce(F.try_divide(shared, F.size("got")), F.lit(0.0)).alias("p"), (shared / F.size("c")).alias("r"))


def chunk_metrics(scores: DataFrame) -> DataFrame:
    """Means over all queries, and over those of method and evaluation."""
    of = lambda c, s: F.coalesce(F.avg(F.when(F.col("answer_source") == s, F.col(c))), F.lit(0.0))
    return scores.agg(
        F.coalesce(F.avg("p"), F.lit(0.0)).alias("overall_precision"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("overall_recall"),
        of("p", "method").alias("method_precision"), of("r", "method").alias("method_recall"),
        of("p", "evaluation").alias("eval_precision"), of("r", "evaluation").alias("eval_recall"),
    )


def lexical_judge(answers: DataFrame) -> DataFrame:
    """Adds (correctness, faithfulness, relevance), 0 to 5, by shared words: the judge used where no model is at hand.

    ``answers`` (generated, reference_answer, context, question): shares of the reference in the
    generated answer, of that in the context, of the question in the answer.
    """
    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    part = lambda a, b: F.round(5 * F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0)), 6)
    g, r, c, q = (bag(F.col(n)) for n in ("generated", "reference_answer", "context", "question"))
    return answers.withColumns({"correctness": part(r, g), "faithfulness": part(g, c), "relevance": part(q, g)})


def answer_metrics(judged: DataFrame) -> DataFrame:
    """Judged answers as shares of 5: overall, and accuracy by difficulty."""
    mean = lambda c: F.coalesce(F.avg(F.col(c) / 5), F.lit(0.0))
    by = lambda d: F.coalesce(F.avg(F.when(F.col("difficulty") == d, F.col("correctness") / 5)), F.lit(0.0))
    return judged.agg(
        mean("correctness").alias("overall_accuracy"), mean("faithfulness").alias("overall_faithfulness"), mean("relevance").alias("overall_relevance"),
        *[by(d).alias(f"{d}_accuracy") for d in model.DIFFICULTIES],
    )


def experiment_grid(spark, strategies: Iterable[str] = ("paragraph", "contextual"), indexes: Iterable[str] = ("FLAT", "HNSW", "IVF_FLAT"), agentic: Iterable[bool] = (False, True)) -> DataFrame:
    """(name, chunk_strategy, index_type, enable_agentic_rag): all combinations; a dozen rows."""
    rows = [(f"{s}_{i.lower()}_{'agentic' if a else 'simple'}", s, i, a) for s in strategies for i in indexes for a in agentic]
    return spark.createDataFrame(rows, "name string, chunk_strategy string, index_type string, enable_agentic_rag boolean")


def comparison_line(row: dict[str, Column]) -> Column:
    """A table row of a comparison, in Markdown."""
    return F.format_string(
        "| %s | %s | %s | %.3f | %.3f | %.3f | %.0f |", row["chunk_strategy"], row["index_type"], F.when(row["enable_agentic_rag"], "yes").otherwise("no"),
        row["recall_at_5"], row["mrr"], row["hit_rate"], row["latency_ms"],
    )


def rerank(hits: DataFrame, scores: DataFrame, top: int = 15, keep_from: float = 4.0, default: float = 5.0, size: int = 400) -> DataFrame:
    """Hits (query_id, rank, text, ...) with a scorer's scores (query_id, rank, score): the first ``top``, texts cut, those from ``keep_from`` on, best first.

    A hit without a score takes ``default``; equal scores keep their order.
    """
    kept = hits.filter(F.col("rank") <= top).join(scores.select("query_id", "rank", "score"), ["query_id", "rank"], "left")
    return (
        kept.withColumn("score", F.coalesce("score", F.lit(default)))
        .filter(F.col("score") >= keep_from)
        .withColumn("text", T.truncate(F.col("text"), size))
        .orderBy("query_id", F.desc("score"), "rank")
    )
