import pytest
from pyspark.sql import functions as F

from folioflow.operators import collections, evaluation, metrics


def test_collections(spark):
    rows = spark.createDataFrame([(str(k), k - 1, [float(k), 1.0] if k else None) for k in range(40)], "doc_id string, chunk_id long, vectors array<float>")
    name = collections.name_of("test_flow")
    try:
        collections.write(rows, name)
        assert collections.collections(spark) == [name] and collections.index_of(spark, name) == "FLAT"
        assert tuple(collections.describe(spark, name).head()) == (name, 40, 1, "FLAT")
        assert collections.rebuild(spark, name, "IVF_FLAT", cells=4).count() == 40
        assert collections.index_of(spark, name) == "IVF_FLAT"
        assert collections.open_store(spark, "table", name).stats().head().total_papers == 1
        with pytest.raises(ValueError):
            collections.write(rows, name, "TREE")
        with pytest.raises(ValueError):
            collections.open_store(spark, "none", name)
    finally:
        assert collections.drop(spark, name) and not collections.drop(spark, name)
        for t in spark.catalog.listTables():
            if t.name.startswith(name):
                spark.sql(f"drop table if exists `{t.name}`")


@pytest.mark.parametrize("question, to", [("Please crawl the site", "collect"), (" ? ", "clarify"), (None, "clarify"), ("What is it?", "search")])
def test_route(spark, question, to):
    assert spark.createDataFrame([(question,)], "q string").select(evaluation.route(F.col("q"))).head()[0] == to


def test_sub_queries(spark):
    df = spark.createDataFrame([("cache and queue, ledger",), ("cache",)], "q string")
    assert [r[0] for r in df.select(evaluation.sub_queries(F.col("q"))).collect()] == [["cache", "queue", "ledger"], ["cache"]]


def test_compare_runs_only_what_is_missing(spark):
    grid = metrics.experiment_grid(spark)
    done = grid.filter("index_type <> 'HNSW'").select("name", F.lit(1.0).alias("mrr"))
    ran = []

    def run(strategy, index, agentic):
        ran.append((strategy, index, agentic))
        return spark.createDataFrame([(0.5,)], "mrr double")

    assert evaluation.compare(grid, done, run).count() == 12 and len(ran) == 4


def test_report(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    assert evaluation.report(one, one, one, "r").head().l2_section_retrieval.x == 1.0


def test_prepare_takes_every_paper_with_an_address(spark):
    """More papers than an export gives; a copy and a blank address among them."""
    ids = spark.range(10_050).select(F.format_string("d%06d", "id").alias("doc_id"))
    papers = ids.select("doc_id", F.lit("t").alias("title"), F.when(F.col("doc_id") == "d000003", " ").otherwise("https://h.org/p").alias("pdf_url"))
    chunks = spark.createDataFrame(
        [(n, d, s, 0, "Some words.", "S", 1, "", 1, "c") for n, (d, s) in enumerate([("d000001", "paragraph"), ("d000003", "paragraph"), ("d010049", "paragraph"), ("d010049", "contextual")])],
        "id long, doc_id string, strategy string, chunk_index int, chunk_text string, section_title string, section_category int, parent_section string, page_number int, contextual_prefix string",
    )
    ready = evaluation.prepare(papers.unionByName(papers.limit(5)), chunks)
    assert {s: sorted(r.doc_id for r in df.select("doc_id").collect()) for s, df in ready.items()} == {"paragraph": ["d000001", "d010049"], "contextual": ["d010049"]}
