"""Queries of vector retrieval and of retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import model
from folioflow.functions import text as T
from folioflow.operators import evaluation, metrics, vectors
from folioflow.plans.registry import lines, query
from folioflow.runtime import cut, table

USABLE = (
    "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
)
#: The vector collection that stands for a loaded store: papers with one paper row and chunks.
STORE = (
    "with v as (select vec_id, (vec_id % 100)::varchar doc_id, list_transform(embedding, lambda x: x::double) v, (label % 7)::bigint section_category, vec_id // 100 - 1 chunk_id, label from embeddings) "
)


def store(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return e.select(
        "vec_id", (F.col("vec_id") % 100).cast("string").alias("doc_id"), F.col("embedding").alias("vectors"),
        (F.col("label") % 7).cast("long").alias("section_category"), F.expr("vec_id div 100 - 1").alias("chunk_id"), "label",
    )


def usable_papers(spark: SparkSession, root: str) -> DataFrame:
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return table(spark, root, "pgvector").filter(fine)


def vector_of(spark: SparkSession, root: str, vec_id: int) -> list[float]:
    """One query vector, as an embedder would give it."""
    found = table(spark, root, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").head()
    return list(found[0]) if found else [0.0] * 64


def _nearest_sql(where: str, k: int, query_id: int = 7) -> str:
    return (
        STORE + f"select doc_id, chunk_id, section_category, round(dist, 6) dist from (select *, list_distance(v, (select v from v where vec_id = {query_id})) dist from v where {where}) "
        f"order by dist, doc_id, chunk_id limit {k}"
    )


def _nearest(spark: SparkSession, root: str, condition, k: int, query_id: int = 7) -> DataFrame:
    hits = vectors.search(store(spark, root), vector_of(spark, root, query_id), k, condition, ("section_category",))
    return hits.select("doc_id", "chunk_id", "section_category", F.round("dist", 6).alias("dist"))


@query(_nearest_sql("true", 10))
def v1_o1_o3_search_all(spark: SparkSession, root: str) -> DataFrame:
    return _nearest(spark, root, None, 10)


@query(
    f"with u as (select id, doc_id, title, abstract, list_transform(embedding, lambda x: x::double) v from pgvector where {USABLE}), q as (select v from u order by id limit 1) "
    "select id, doc_id, title, abstract, round(list_distance(u.v, q.v), 6) dist from u, q order by list_distance(u.v, q.v), id limit 10"
)
def v2_o2_sql_search(spark: SparkSession, root: str) -> DataFrame:
    u = usable_papers(spark, root)
    first = u.orderBy("id").select("embedding").head()
    hits = vectors.search(u, list(first[0]) if first else [0.0] * 64, 10, None, ("doc_id", "title", "abstract"), "embedding", ("id",))
    return hits.withColumn("dist", F.round("dist", 6))


@query(_nearest_sql("doc_id = '7' and section_category >= 0", 5, 9))
def v3_search_by_section(spark: SparkSession, root: str) -> DataFrame:
    return _nearest(spark, root, F.col("doc_id") == "7", 5, 9)


@query(
    STORE + "select doc_id, chunk_id, round(dist, 6) dist from (select *, row_number() over (partition by doc_id order by dist, doc_id, chunk_id) r from "
    "(select *, list_distance(v, (select v from v where vec_id = 7)) dist from v where section_category = 0 or chunk_id = -1 order by dist, doc_id, chunk_id limit 30)) where r = 1"
)
def v4_search_abstracts(spark: SparkSession, root: str) -> DataFrame:
    """Nearest abstracts, the best hit of each document; deduplication comes after the limit, so fewer may be left."""
    scope = (F.col("section_category") == model.ABSTRACT) | (F.col("chunk_id") == -1)
    hits = vectors.search(store(spark, root), vector_of(spark, root, 7), 30, scope)
    return vectors.first_per_document(hits).select("doc_id", "chunk_id", F.round("dist", 6).alias("dist"))


@query(
    STORE + "select doc_id, chunk_id, round(dist, 6) dist from (select *, row_number() over (partition by doc_id order by dist, chunk_id) r from "
    "(select *, list_distance(v, (select v from v where vec_id = 3)) dist from v where doc_id in ('1', '2', '3', '5', '8'))) where r <= 3 order by dist, doc_id, chunk_id limit 8"
)
def v5_o4_several_documents(spark: SparkSession, root: str) -> DataFrame:
    hits = vectors.best_of_documents(store(spark, root), vector_of(spark, root, 3), ["1", "2", "3", "5", "8"], 3, 8)
    return hits.select("doc_id", "chunk_id", F.round("dist", 6).alias("dist"))


@query(STORE + "select vec_id, round(list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) dist2, round(list_distance(v, q), 6) dist from v, (select v q from v where vec_id = 0)")
def v8_distances(spark: SparkSession, root: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in vector_of(spark, root, 0)])
    s = store(spark, root)
    return s.select("vec_id", F.round(vectors.l2_squared(F.col("vectors"), q), 6).alias("dist2"), F.round(vectors.l2(F.col("vectors"), q), 6).alias("dist"))


EACH = (
    f"with u as (select id, list_transform(embedding, lambda x: x::double) v from pgvector where {USABLE}), "
    "d as (select q.id query_id, r.id, list_distance(q.v, r.v) dist from u q join u r on q.id % 20 = 0 and r.id <> q.id), "
    "n as (select *, row_number() over (partition by query_id order by dist, id) r from d) "
)


@query(EACH + "select query_id, r::int rank, id, round(dist, 6) dist from n where r <= 5")
def j8_search_each(spark: SparkSession, root: str) -> DataFrame:
    """Nearest rows of the stated query set, every row whose id is divisible by 20, against all rows."""
    u = usable_papers(spark, root).select("id", F.col("embedding").alias("vectors"))
    q = u.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vectors").alias("query"))
    found = vectors.search_each(u, q, 6, ("id",)).filter("id <> query_id")
    w = F.row_number().over(_by_query())
    return found.withColumn("rank", w).filter("rank <= 5").select("query_id", "rank", "id", F.round("dist", 6).alias("dist"))


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy("dist", "id")


def _queries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    u = cut(usable_papers(spark, root).select("id", F.col("embedding").alias("vectors")).repartition("id"))
    return u, u.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vectors").alias("query"))


@query()
def v9_ivf_recall(spark: SparkSession, root: str) -> DataFrame:
    """Recall at 10 of inverted cells, a quarter of them probed, against the exact search."""
    u, q = _queries(spark, root)
    indexed, fitted = vectors.build_ivf(u, 32)
    found = vectors.search_ivf(indexed, fitted, q, 10, 8, ("id",))
    return vectors.recall(found, vectors.search_each(u, q, 10, ("id",)), "id").select(F.lit("IVF_FLAT").alias("index"), "recall")


@query()
def v9_lsh_recall(spark: SparkSession, root: str) -> DataFrame:
    u, q = _queries(spark, root)
    found = vectors.search_lsh(u, q, 10, ("id",))
    return vectors.recall(found, vectors.search_each(u, q, 10, ("id",)), "id").select(F.lit("LSH").alias("index"), "recall")


@query()
def v12_hashing_embedding(spark: SparkSession, root: str) -> DataFrame:
    embed = vectors.embedder("hashing", dim=64)
    return table(spark, root, "documents").select("doc_id", embed(F.col("text")).alias("vectors"))


@query(
    "with t as (select * from (values (1, 'alpha', 9.0), (2, 'beta', null), (3, 'gamma', 3.9), (4, 'delta', 9.0)) t(rank, text, score)) select 1::bigint query_id, rank::int rank, text, coalesce(score, 5.0)::double score from t where coalesce(score, 5.0) >= 4"
)
def pred9_j11_o6_l5_rerank(spark: SparkSession, root: str) -> DataFrame:
    hits = lines(spark, [(1, 1, "alpha"), (1, 2, "beta"), (1, 3, "gamma"), (1, 4, "delta")], "query_id long, rank int, text string")
    given = lines(spark, [(1, 1, 9.0), (1, 3, 3.9), (1, 4, 9.0)], "query_id long, rank int, score double")
    return metrics.rerank(hits, given).select("query_id", "rank", "text", "score")


# --- Quality ----------------------------------------------------------------

#: Questions: all vectors; expected are the documents and chunks of the same label.
FOUND = (
    STORE + ", q as (select vec_id query_id, v q, label l from v), "
    "e as (select query_id, doc_id from q join v on v.label = q.l group by all), "
    "d as (select query_id, doc_id, chunk_id, list_distance(q.q, v.v) dist from q join v on v.section_category = 0 or v.chunk_id = -1), "
    "t as (select *, row_number() over (partition by query_id order by dist, doc_id, chunk_id) r from d), "
    "u as (select query_id, doc_id, min(r) r from t where r <= 10 group by all), "
    "h as (select query_id, doc_id, row_number() over (partition by query_id order by r) rank from u), "
    "s as (select e.query_id, count(*) n, count(*) filter (where rank <= 5) a, count(*) filter (where rank <= 10) b, min(rank) m from e left join h using (query_id, doc_id) group by e.query_id) "
)


def _paper_scores(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    s = cut(store(spark, root))
    q = s.select(F.col("vec_id").alias("query_id"), F.col("vectors").alias("query"), F.col("label").alias("l"))
    documents = s.groupBy(F.col("label").alias("l")).agg(F.collect_set("doc_id").alias("expected"))
    expected = q.select("query_id", "l").join(documents, "l").select("query_id", "expected")
    scope = s.filter((F.col("section_category") == model.ABSTRACT) | (F.col("chunk_id") == -1))
    hits = vectors.first_per_document(vectors.search_each(scope, q.drop("l"), 10, ("doc_id", "chunk_id")), ("query_id",))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return metrics.paper_scores(expected, hits)


@query(FOUND + "select query_id, a / 5 p5, b / 10 p10, round(a / n, 6) r5, round(b / n, 6) r10, round(coalesce(1 / case when m <= 10 then m end, 0), 6) rr, (b > 0)::double hit from s")
def w2_j6_e1_paper_scores(spark: SparkSession, root: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _paper_scores(spark, root).select("query_id", "p5", "p10", r("r5"), r("r10"), r("rr"), "hit")


@query(FOUND + "select count(*) queries, round(avg(a / 5), 6) precision_at_5, round(avg(b / 10), 6) precision_at_10, round(avg(a / n), 6) recall_at_5, round(avg(b / n), 6) recall_at_10, round(avg(coalesce(1 / case when m <= 10 then m end, 0)), 6) mrr, round(avg((b > 0)::double), 6) hit_rate from s")
def a5_e1_paper_metrics(spark: SparkSession, root: str) -> DataFrame:
    m = metrics.paper_metrics(_paper_scores(spark, root))
    return m.select("queries", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


CHUNKS_FOUND = (
    STORE + ", q as (select vec_id query_id, v q, doc_id d, section_category c, label l, case section_category when 0 then 'abstract' when 1 then 'introduction' when 2 then 'method' when 3 then 'evaluation' else 'multiple' end src from v), "
    "e as (select query_id, src, list_distinct(list(chunk_id)) ch from q join v on v.doc_id = q.d and v.label = q.l and v.chunk_id >= 0 group by all), "
    "h as (select query_id, chunk_id, row_number() over (partition by query_id order by list_distance(q.q, v.v), chunk_id) r from q join v on v.doc_id = q.d and (v.section_category = q.c or q.c > 3)), "
    "g as (select query_id, list_distinct(list(chunk_id)) got from h where r <= 10 and chunk_id <> -1 group by query_id), "
    "s as (select query_id, src, coalesce(len(list_intersect(ch, got)) / nullif(len(got), 0), 0) p, coalesce(len(list_intersect(ch, got)), 0) / len(ch) r from e left join g using (query_id)) "
)


def _chunk_scores(spark: SparkSession, root: str) -> DataFrame:
    s = cut(store(spark, root))
    src = F.when(F.col("section_category") == 0, "abstract").when(F.col("section_category") == 1, "introduction").when(F.col("section_category") == 2, "method").when(F.col("section_category") == 3, "evaluation").otherwise("multiple")
    q = s.select(F.col("vec_id").alias("query_id"), F.col("vectors").alias("query"), "doc_id", F.col("label").alias("l"), src.alias("answer_source"))
    q = q.withColumn("c", metrics.source_category(F.col("answer_source")))
    own = s.filter("chunk_id >= 0")
    expected = q.drop("query").join(own, "doc_id").filter("label = l").groupBy("query_id", "answer_source").agg(F.collect_set(F.col("chunk_id").cast("int")).alias("chunks"))
    scoped = q.filter("c >= 0").withColumn("section_category", F.col("c").cast("long"))
    hits = vectors.search_each(s, scoped, 10, ("chunk_id",), on=["doc_id", "section_category"]).unionByName(
        vectors.search_each(s, q.filter("c < 0"), 10, ("chunk_id",), on=["doc_id"])
    )
    return metrics.chunk_scores(expected, hits)


@query(CHUNKS_FOUND + "select query_id, src answer_source, round(p, 6) p, round(r, 6) r from s")
def e2_chunk_scores(spark: SparkSession, root: str) -> DataFrame:
    return _chunk_scores(spark, root).select("query_id", "answer_source", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"))


@query(
    CHUNKS_FOUND + "select round(avg(p), 6) overall_precision, round(avg(r), 6) overall_recall, round(coalesce(avg(p) filter (where src = 'method'), 0), 6) method_precision, round(coalesce(avg(r) filter (where src = 'method'), 0), 6) method_recall, "
    "round(coalesce(avg(p) filter (where src = 'evaluation'), 0), 6) eval_precision, round(coalesce(avg(r) filter (where src = 'evaluation'), 0), 6) eval_recall from s"
)
def a6_e2_chunk_metrics(spark: SparkSession, root: str) -> DataFrame:
    m = metrics.chunk_metrics(_chunk_scores(spark, root))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


JUDGED = r"""
with one as (select doc_id, min(abstract) abstract from source_papers group by doc_id),
a as (select q.id, difficulty, question, reference_answer, coalesce(left(abstract, 200), '') generated, coalesce(abstract, '') context from qa_pairs q left join one on one.doc_id = q.expected_doc_ids[1] where len(q.expected_doc_ids) > 0),
b as (select id, difficulty, list_distinct(regexp_extract_all(lower(generated), '[\p{L}\p{N}]+')) g, list_distinct(regexp_extract_all(lower(coalesce(reference_answer, '')), '[\p{L}\p{N}]+')) r,
  list_distinct(regexp_extract_all(lower(context), '[\p{L}\p{N}]+')) c, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[\p{L}\p{N}]+')) q from a),
j as (select id, difficulty, round(5 * coalesce(len(list_intersect(r, g)) / nullif(len(r), 0), 0), 6) correctness, round(5 * coalesce(len(list_intersect(g, c)) / nullif(len(g), 0), 0), 6) faithfulness,
  round(5 * coalesce(len(list_intersect(q, g)) / nullif(len(q), 0), 0), 6) relevance from b)
"""


def _judged(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "source_papers").groupBy(F.col("doc_id").alias("d")).agg(F.min("abstract").alias("abstract"))
    q = table(spark, root, "qa_pairs").filter(F.size("expected_doc_ids") > 0).withColumn("d", F.get("expected_doc_ids", 0)).join(one, "d", "left")
    a = q.select("id", "difficulty", "question", "reference_answer", F.coalesce(F.left("abstract", F.lit(200)), F.lit("")).alias("generated"), F.coalesce("abstract", F.lit("")).alias("context"))
    return metrics.lexical_judge(a)


@query(JUDGED + "select id, correctness, faithfulness, relevance from j")
def e3_judged_answers(spark: SparkSession, root: str) -> DataFrame:
    return _judged(spark, root).select("id", "correctness", "faithfulness", "relevance")


@query(
    JUDGED + "select round(avg(correctness / 5), 5) overall_accuracy, round(avg(faithfulness / 5), 5) overall_faithfulness, round(avg(relevance / 5), 5) overall_relevance, "
    + ", ".join(f"round(coalesce(avg(correctness / 5) filter (where difficulty = '{d}'), 0), 5) {d}_accuracy" for d in model.DIFFICULTIES) + " from j"
)
def a7_e3_answer_metrics(spark: SparkSession, root: str) -> DataFrame:
    m = metrics.answer_metrics(_judged(spark, root))
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@query()
def e4_e5_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Every experiment of the grid with the metrics of its index: exact for FLAT, measured for the approximate ones."""
    u, q = _queries(spark, root)
    exact = cut(vectors.search_each(u, q, 10, ("id",)))
    indexed, fitted = vectors.build_ivf(u, 32)
    ivf = vectors.recall(vectors.search_ivf(indexed, fitted, q, 10, 8, ("id",)), exact, "id").select(F.lit("IVF_FLAT").alias("index_type"), "recall")
    lsh = vectors.recall(vectors.search_lsh(u, q, 10, ("id",)), exact, "id").select(F.lit("HNSW").alias("index_type"), "recall")
    flat = lines(spark, [("FLAT", 1.0)], "index_type string, recall double")
    return metrics.experiment_grid(spark).join(F.broadcast(flat.unionByName(ivf).unionByName(lsh)), "index_type").select("name", "index_type", "chunk_strategy", "recall")


@query("select id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(question), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) > 3)))::varchar concepts, "
    "case when regexp_matches(lower(question), '(compare|contrast|differ| and | versus | vs )') then 'comparison' else 'single' end query_type from qa_pairs where question is not null")  # fmt: skip
def l2_l7_analyse_query(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "qa_pairs").filter("question is not null")
    words = F.split(F.trim(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}]+", " ")), " ")
    found = F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3)))
    kind = F.when(F.lower("question").rlike("(compare|contrast|differ| and | versus | vs )"), "comparison").otherwise("single")
    return q.select("id", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("concepts"), kind.alias("query_type"))


@query(
    r"""
with q as (select id, list_distinct(regexp_extract_all(lower(question), '[a-z]{4,}')) c, expected_doc_ids[1] d from qa_pairs where question is not null and len(expected_doc_ids) > 0),
t as (select doc_id, lower(min(title) || ' ' || coalesce(min(abstract), '')) t from source_papers group by doc_id),
m as (select id, len(c) n, len(list_filter(c, lambda w: contains(t.t, w))) k from q join t on t.doc_id = q.d)
select id, round(coalesce(k / nullif(n, 0), 0.5), 6) coverage, coalesce(k / nullif(n, 0), 0.5) >= 0.6 sufficient from m"""
)
def l4_sufficiency(spark: SparkSession, root: str) -> DataFrame:
    """Share of a question's words that its retrieved texts cover; enough from 0.6 on, else another round is worth it."""
    t = table(spark, root, "source_papers").groupBy("doc_id").agg(F.lower(F.concat(F.min("title"), F.lit(" "), F.coalesce(F.min("abstract"), F.lit("")))).alias("t"))
    q = table(spark, root, "qa_pairs").filter(F.col("question").isNotNull() & (F.size("expected_doc_ids") > 0))
    q = q.select("id", F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]{4,}"), F.lit(0))).alias("c"), F.get("expected_doc_ids", 0).alias("doc_id"))
    share = F.coalesce(F.try_divide(F.size(F.filter("c", lambda w: F.contains(F.col("t"), w))), F.size("c")), F.lit(0.5))
    return q.join(t, "doc_id").select("id", F.round(share, 6).alias("coverage"), (share >= 0.6).alias("sufficient"))


@query("select id, coalesce(question, '') hypothetical from qa_pairs")
def l3_hypothetical(spark: SparkSession, root: str) -> DataFrame:
    """Hypothetical answers to search with; without a model the question itself."""
    return table(spark, root, "qa_pairs").select("id", F.coalesce("question", F.lit("")).alias("hypothetical"))


@query(
    STORE + ", h as (select *, list_distance(v, (select v from v where vec_id = 7)) dist from v), r as (select doc_id, chunk_id, section_category, dist, row_number() over (order by dist, doc_id, chunk_id) n from h) "
    "select n::int hit, '[' || n || '] ' || doc_id || case when section_category <> 0 then chr(10) || 'Section: ' || case section_category when 1 then 'INTRODUCTION' when 2 then 'METHOD' when 3 then 'EVALUATION' when 4 then 'CONCLUSION' when 5 then 'OTHER' else 'RELATED_WORK' end else '' end || chr(10) || 'Content: ' || chunk_id block from r where n <= 10"
)
def v14_search_and_format(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    hits = vectors.search(store(spark, root), vector_of(spark, root, 7), 10, None, ("section_category",))
    n = hits.withColumn("hit", F.row_number().over(Window.orderBy("dist", "doc_id", "chunk_id")))
    none = F.lit(None)
    block = T.hit_block(F.col("hit"), F.col("doc_id"), none.cast("string"), none.cast("int"), F.col("section_category"), none.cast("string"), none.cast("int"), none.cast("string"), F.col("chunk_id").cast("string"))
    return n.select("hit", block.alias("block"))


@query("select id, case when regexp_matches(lower(question), '\\b(collect|crawl|download|scrape|fetch)\\b') then 'collect' when regexp_matches(lower(coalesce(question, '')), '^\\s*[^\\w]*\\s*$') then 'clarify' else 'search' end route from qa_pairs")
def l1_routes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "qa_pairs").select("id", evaluation.route(F.col("question")).alias("route"))


@query()
def l6_e6_search_in_rounds(spark: SparkSession, root: str) -> DataFrame:
    """Every question searched in rounds over all papers, with hashed embeddings."""
    embed = vectors.embedder("hashing", dim=64)
    papers = table(spark, root, "source_papers").groupBy("doc_id").agg(F.concat_ws(" ", F.min("title"), F.min("abstract")).alias("text"))
    rows = cut(papers.withColumn("vectors", embed(F.col("text"))))
    questions = table(spark, root, "qa_pairs").filter("question is not null and id % 20 = 0").select(F.col("id").alias("query_id"), "question")
    return evaluation.search_in_rounds(questions, rows, embed)


@query(
    "with e as (select doc_id, min(title) t from source_papers where trim(pdf_url) <> '' group by doc_id) "
    "select strategy, count(distinct c.doc_id) documents, count(distinct (c.doc_id, chunk_index)) positions from chunk_results c join e using (doc_id) where length(chunk_text) > 0 group by strategy"
)
def e7_prepared(spark: SparkSession, root: str) -> DataFrame:
    ready = evaluation.prepare(table(spark, root, "source_papers"), table(spark, root, "chunk_results").withColumn("position", F.col("chunk_index")))
    parts = [df.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("doc_id", "position").alias("positions")).select(F.lit(s).alias("strategy"), "documents", "positions") for s, df in ready.items()]
    return parts[0].unionByName(parts[1])
