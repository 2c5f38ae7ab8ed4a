"""Queries of the store: scans, filters, joins, aggregates and set operations over the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow import model
from folioflow.functions import scores
from folioflow.functions import text as T
from folioflow.operators import chunking, metrics, store, themes
from folioflow.plans.registry import lines, query, scratch
from folioflow.runtime import table
from folioflow.sources import files

COLLECTION = """
with one as (
  select doc_id, min(title) title, min(url) url, min(pdf_url) pdf_url, min(conference_name) conference_name, min(conference_year) conference_year, min(conference_round) conference_round
  from source_papers group by doc_id),
coll as (
  select doc_id, abstract as text, title, url, pdf_url, conference_name, conference_year::bigint conference_year, conference_round, -1::bigint chunk_id, 0::bigint section_category,
    '' section_title, '' parent_section, 0::bigint page_number
  from source_papers
  union all
  select c.doc_id, c.chunk_text, one.title, one.url, one.pdf_url, one.conference_name, one.conference_year::bigint, one.conference_round, c.chunk_index::bigint,
    coalesce(c.section_category, 5)::bigint, coalesce(c.section_title, ''), coalesce(c.parent_section, ''), coalesce(c.page_number, 0)::bigint
  from chunk_results c left join one using (doc_id))
"""


def rows(spark: SparkSession, root: str) -> DataFrame:
    return model.collection(table(spark, root, "source_papers"), table(spark, root, "chunk_results"))


def kept(spark: SparkSession, root: str) -> store.CorpusStore:
    return store.CorpusStore(rows(spark, root))


# --- Scans, sources, sinks --------------------------------------------------


@query(COLLECTION + "select doc_id, chunk_id, section_title, text from coll where section_category = 2 and chunk_id >= 0 order by doc_id, chunk_id, text limit 50")
def s1_scalar_query(spark: SparkSession, root: str) -> DataFrame:
    return kept(spark, root).query((F.col("section_category") == 2) & (F.col("chunk_id") >= 0), ("doc_id", "chunk_id", "section_title", "text"), ("doc_id", "chunk_id", "text"), 50)


@query("select distinct doc_id, title, conference_round from pgvector where conference_name = 'CRYSEC' and conference_year = 2021")
def s2_sql_scan(spark: SparkSession, root: str) -> DataFrame:
    return spark.sql("select distinct doc_id, title, conference_round from {t} where conference_name = 'CRYSEC' and conference_year = 2021", t=table(spark, root, "pgvector"))


@query(
    "select doc_id, title, abstract, pdf_url, url, conference_name, conference_year, conference_round from source_papers "
    "where conference_name = 'CRYSEC' and conference_year >= 2020 and conference_year < 2021 and trim(pdf_url) <> '' order by doc_id, title limit 10000"
)
def s3_export(spark: SparkSession, root: str) -> DataFrame:
    return store.export_papers(table(spark, root, "source_papers"), "CRYSEC", 2020).drop("exported_at")


@query()
def s3_export_sample(spark: SparkSession, root: str) -> DataFrame:
    return store.export_papers(table(spark, root, "source_papers"), sample=100).drop("exported_at")


@query("select doc_id, title, abstract, pdf_url, url, conference_name, conference_year, conference_round from source_papers where trim(pdf_url) <> ''")
def s4_s5_jsonl(spark: SparkSession, root: str) -> DataFrame:
    at = scratch(spark)
    papers = table(spark, root, "source_papers").filter(store.not_blank(F.col("pdf_url"))).drop("exported_at")
    files.write_jsonl(papers, at)
    return files.read_papers(spark, at)


@query("select doc_id, strategy, chunk_index, chunk_text, section_title, section_category, page_number from chunk_results")
def s6_s7_chunk_files(spark: SparkSession, root: str) -> DataFrame:
    at = scratch(spark)
    fields = ["doc_id", "strategy", "chunk_index", "chunk_text", "section_title", "section_category", "page_number"]
    files.write_jsonl(table(spark, root, "chunk_results").select(*fields), at, partition_by=("strategy",))
    schema = "doc_id string, chunk_index int, chunk_text string, section_title string, section_category int, page_number int"
    return spark.read.schema(f"{schema}, strategy string").json(at).select(*fields)


@query("select id, question, difficulty, len(expected_doc_ids)::int n_docs, answer_source, reference_answer from qa_pairs")
def s8_ground_truth(spark: SparkSession, root: str) -> DataFrame:
    at = scratch(spark)
    files.write_jsonl(files.ground_truth_blocks(table(spark, root, "qa_pairs")), at)
    return files.read_ground_truth(spark, at, multi_line=False).select("id", "question", "difficulty", F.size("expected_doc_ids").alias("n_docs"), "answer_source", "reference_answer")


@query("select 3::bigint appended")
def s10_append(spark: SparkSession, root: str) -> DataFrame:
    at = scratch(spark)
    for k in range(3):
        files.write_jsonl(lines(spark, [(k,)], "n int"), at, mode="append")
    return spark.read.schema("n int").json(at).agg(F.count("*").alias("appended"))


@query(
    "with l as (select doc_id, string_split(text, chr(10)) l from documents) "
    "select doc_id, 1::int line_no, l[2] line from l where len(l) >= 2 union all select doc_id, 2::int, l[3] from l where len(l) >= 3"
)
def s12_line_window(spark: SparkSession, root: str) -> DataFrame:
    return files.line_window(table(spark, root, "documents"), 1, 2)


@query("select distinct url, substr(md5(url), 1, 16) || '.pdf' cache_key from source_papers where url is not null")
def s14_f15_cache_key(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_papers").filter("url is not null").select("url", T.cache_key(F.col("url")).alias("cache_key")).distinct()


@query(
    "select sha256(concat_ws(chr(10), title, url)) doc_id, 'Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '') embed_text, coalesce(abstract, '') as text, "
    "title, url, coalesce(pdf_url, '') pdf_url, conference_name, conference_year::bigint conference_year, coalesce(conference_round, 'all') conference_round, -1::bigint chunk_id from source_papers"
)
def s17_insert_papers(spark: SparkSession, root: str) -> DataFrame:
    return store.paper_rows(table(spark, root, "source_papers"))


@query(
    "with one as (select doc_id, min(title) t from source_papers group by doc_id) "
    "select c.id, case when coalesce(contextual_prefix, '') <> '' then contextual_prefix || chr(10) || chr(10) || chunk_text "
    "when coalesce(section_title, '') <> '' then 'Title: ' || coalesce(t, '') || chr(10) || 'Section: ' || section_title || chr(10) || 'Content: ' || chunk_text "
    "else 'Title: ' || coalesce(t, '') || chr(10) || 'Content: ' || chunk_text end embed_text from chunk_results c left join one using (doc_id)"
)
def s18_f30_insert_chunks(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "source_papers").groupBy("doc_id").agg(F.min("title").alias("paper_title"))
    chunks = table(spark, root, "chunk_results").join(one, "doc_id", "left").withColumn("text_for_embedding", F.lit(None).cast("string"))
    names = ("text_for_embedding", "contextual_prefix", "section_title", "chunk_text")
    return chunks.select("id", chunking.embed_text({n: F.col(n) for n in names}, F.coalesce("paper_title", F.lit(""))).alias("embed_text"))


@query(
    "with s as (select distinct conference_name, conference_year, conference_round, regexp_extract(lower(trim(conference_name)), '^([a-z0-9]+)', 1) a from source_papers "
    "where conference_year is not null and trim(conference_round) <> '' and trim(conference_name) <> '') "
    "select conference_name, conference_year, a || '_' || right(conference_year::varchar, 2) || '_' || conference_round stem, "
    "case when regexp_extract(a || '_' || right(conference_year::varchar, 2) || '_' || conference_round, '_(\\d{2})_([^_]+)$', 2) <> '' "
    "then regexp_extract(a || '_' || right(conference_year::varchar, 2) || '_' || conference_round, '_(\\d{2})_([^_]+)$', 2) else 'all' end round_found from s"
)
def s19_f12_f13_listing_stems(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "source_papers").filter("conference_year is not null and trim(conference_round) <> '' and trim(conference_name) <> ''")
    s = c.select("conference_name", "conference_year", "conference_round").distinct()
    s = s.withColumn("stem", T.listing_stem(F.col("conference_name"), F.col("conference_year"), F.col("conference_round")))
    return s.select("conference_name", "conference_year", "stem", T.round_of_stem(F.col("stem"), F.lit("all")).alias("round_found"))


@query("select distinct doc_id, title, abstract from source_papers s where not exists (select 1 from pgvector p where p.doc_id = s.doc_id)")
def s20_copy_papers(spark: SparkSession, root: str) -> DataFrame:
    return store.missing(table(spark, root, "source_papers"), table(spark, root, "pgvector"), ["doc_id"]).select("doc_id", "title", "abstract").distinct()


@query(COLLECTION + "select doc_id, chunk_id, section_category, title, case when length(text) > 500 then left(text, 500) else coalesce(text, '') end as text from coll")
def s21_rebuild(spark: SparkSession, root: str) -> DataFrame:
    return rows(spark, root).select("doc_id", "chunk_id", "section_category", "title", T.truncate(F.col("text"), 500, "").alias("text"))


@query(COLLECTION + "select count(*) total_records, count(*) filter (where chunk_id = -1) total_papers from coll")
def s23_stats(spark: SparkSession, root: str) -> DataFrame:
    return kept(spark, root).stats()


@query(
    "select (select count(distinct doc_id) from source_papers) papers, (select count(distinct doc_id) from chunk_results) chunked, (select count(*) from chunk_results) chunks, (select count(*) from qa_pairs) questions"
)
def s24_status(spark: SparkSession, root: str) -> DataFrame:
    papers = table(spark, root, "source_papers").agg(F.count_distinct("doc_id").alias("papers"))
    chunks = table(spark, root, "chunk_results").agg(F.count_distinct("doc_id").alias("chunked"), F.count("*").alias("chunks"))
    pairs = table(spark, root, "qa_pairs").agg(F.count("*").alias("questions"))
    return papers.join(chunks, F.lit(True)).join(pairs, F.lit(True))


@query("select 'https://a.example/x' url union all select 'https://b.example'")
def s25_url_list(spark: SparkSession, root: str) -> DataFrame:
    return files.url_lines(lines(spark, [("  https://a.example/x ",), ("",), ("# note",), ("https://b.example",)], "value string"))


@query(
    "with g as (select s || '_' || lower(i) || '_' || a as name from (values ('paragraph'), ('contextual')) s(s), (values ('FLAT'), ('HNSW'), ('IVF_FLAT')) i(i), (values ('simple'), ('agentic')) a(a)) "
    "select name from g where name not in ('paragraph_flat_simple', 'contextual_hnsw_agentic')"
)
def s27_j5_j17_resume(spark: SparkSession, root: str) -> DataFrame:
    done = lines(spark, [("paragraph_flat_simple",), ("contextual_hnsw_agentic",)], "name string")
    return store.missing(metrics.experiment_grid(spark), done, ["name"]).select("name")


@query(
    "with a as (select distinct conference_name from source_papers where conference_name is not null) "
    "select conference_name, case when conference_name < 'M' then 'article h2' else 'h1' end selector from a"
)
def s28_selector_cache(spark: SparkSession, root: str) -> DataFrame:
    """Selectors of all conferences from files: what isn't kept yet is made, written beside the rest and read again."""
    at = f"{scratch(spark)}/selectors"
    conf = table(spark, root, "source_papers").select("conference_name").filter("conference_name is not null").distinct()
    files.write_jsonl(conf.filter("conference_name < 'M'").withColumn("selector", F.lit("article h2")), at)
    kept = lambda: spark.read.schema("conference_name string, selector string").json(at)
    files.write_jsonl(store.missing(conf, kept(), ["conference_name"]).withColumn("selector", F.lit("h1")), at, "append")
    return conf.join(kept(), "conference_name").select("conference_name", "selector")


# --- Predicates -------------------------------------------------------------


@query(COLLECTION + "select doc_id, chunk_id, text from coll where section_category = 3")
def pred1_pred2_scope(spark: SparkSession, root: str) -> DataFrame:
    return rows(spark, root).filter(store.scope(category=3)).select("doc_id", "chunk_id", "text")


@query(COLLECTION + "select doc_id, chunk_id, title from coll where section_category = 0 or chunk_id = -1")
def pred3_abstract_scope(spark: SparkSession, root: str) -> DataFrame:
    return rows(spark, root).filter(store.abstract_scope()).select("doc_id", "chunk_id", "title")


@query(COLLECTION + "select doc_id, chunk_id from coll where chunk_id between greatest(0, 2 - 3) and 2 + 3")
def pred4_range(spark: SparkSession, root: str) -> DataFrame:
    return rows(spark, root).filter(F.col("chunk_id").between(max(0, 2 - 3), 2 + 3)).select("doc_id", "chunk_id")


@query(
    COLLECTION + ", ids as (select distinct unnest(paper_ids) doc_id from paper_clusters) "
    "select doc_id, title, text, url, pdf_url, conference_name, conference_year, conference_round from coll where chunk_id = -1 and doc_id in (select doc_id from ids)"
)
def pred5_j2_v7_metadata(spark: SparkSession, root: str) -> DataFrame:
    ids = table(spark, root, "paper_clusters").select(F.explode("paper_ids").alias("doc_id"))
    return kept(spark, root).metadata(ids)


@query(
    COLLECTION + "select doc_id, title, text, url, pdf_url, conference_name, conference_year, conference_round from coll "
    "where chunk_id = -1 and conference_name = 'NETFORGE' and conference_year = 2020 order by doc_id, title limit 10"
)
def pred6_o9_conference_papers(spark: SparkSession, root: str) -> DataFrame:
    return kept(spark, root).papers("NETFORGE", 2020)


@query("select id from qa_pairs where len(coalesce(expected_doc_ids, [])) > 0 and len(coalesce(expected_chunk_ids, [])) > 0")
def pred8_valid_pairs(spark: SparkSession, root: str) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return table(spark, root, "qa_pairs").filter((size("expected_doc_ids") > 0) & (size("expected_chunk_ids") > 0)).select("id")


@query("select id, len(list_filter(list_transform(string_split(chunk_text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''))::int n from chunk_results where length(chunk_text) >= 50")
def pred10_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results").filter(F.length("chunk_text") >= 50)
    return c.select("id", F.size(chunking.paragraphs(F.col("chunk_text"))).alias("n"))


@query("select doc_id, url from pgvector where url is not null and not regexp_matches(url, '(technical-sessions|program|schedule|calendar|workshop|poster|call-for-papers)')")
def pred12_main_track(spark: SparkSession, root: str) -> DataFrame:
    bad = "(technical-sessions|program|schedule|calendar|workshop|poster|call-for-papers)"
    return table(spark, root, "pgvector").filter(F.col("url").isNotNull() & ~F.col("url").rlike(bad)).select("doc_id", "url")


@query(
    """
with l as (select cluster_id, unnest(paper_ids) doc_id, generate_subscripts(paper_ids, 1) pos from paper_clusters),
k as (select l.* from l where doc_id in (select doc_id from pgvector)),
f as (select *, row_number() over (partition by doc_id order by cluster_id, pos) r from k)
select cluster_id, string_agg(doc_id, ',' order by pos) papers from f where r = 1 group by cluster_id having count(*) >= 2"""
)
def pred13_g2_valid_groups(spark: SparkSession, root: str) -> DataFrame:
    found = themes.valid_groups(table(spark, root, "paper_clusters"), table(spark, root, "pgvector"))
    return found.select("cluster_id", F.array_join("paper_ids", ",").alias("papers"))


# --- Joins ------------------------------------------------------------------


@query("with one as (select doc_id, min(title) title, min(conference_name) conference_name from source_papers group by doc_id) select c.id, title, conference_name from chunk_results c left join one using (doc_id)")
def j1_chunk_papers(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "source_papers").groupBy("doc_id").agg(F.min("title").alias("title"), F.min("conference_name").alias("conference_name"))
    return table(spark, root, "chunk_results").join(one, "doc_id", "left").select("id", "title", "conference_name")


@query("select distinct doc_id from source_papers where doc_id not in (select doc_id from chunk_results where doc_id is not null)")
def j3_not_loaded(spark: SparkSession, root: str) -> DataFrame:
    return store.missing(table(spark, root, "source_papers").select("doc_id").distinct(), table(spark, root, "chunk_results"), ["doc_id"])


@query(
    "select conference_name, conference_year, conference_round from source_papers where trim(conference_round) <> '' and conference_name is not null and conference_year is not null "
    "except select conference_name, conference_year, conference_round from pgvector where trim(conference_round) <> ''"
)
def j4_a4_missing_rounds(spark: SparkSession, root: str) -> DataFrame:
    keys = ["conference_name", "conference_year", "conference_round"]
    of = lambda t: table(spark, root, t).filter(store.not_blank(F.col("conference_round"))).select(*keys).distinct()
    return store.missing(of("source_papers").dropna(subset=keys[:2]), of("pgvector"), keys)


@query(
    """
with h as (select distinct expected_doc_ids[1] doc_id, expected_chunk_ids[1]::bigint chunk_id from qa_pairs where len(expected_doc_ids) > 0 and len(expected_chunk_ids) > 0 and expected_doc_ids[1] is not null and expected_chunk_ids[1] is not null),
t as (select doc_id, chunk_index::bigint i, min(chunk_text) x from chunk_results where chunk_text is not null and chunk_index >= 0 group by all)
select h.doc_id, h.chunk_id, string_agg(x, chr(10) || chr(10) order by i) context from h join t on t.doc_id = h.doc_id and i between greatest(0, chunk_id - 1) and chunk_id + 1 group by all"""
)
def j9_context(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "qa_pairs").filter((F.size("expected_doc_ids") > 0) & (F.size("expected_chunk_ids") > 0))
    hits = q.select(F.get("expected_doc_ids", 0).alias("doc_id"), F.get("expected_chunk_ids", 0).cast("long").alias("chunk_id")).dropna()
    return kept(spark, root).context(hits)


@query("with p as (select cluster_id, unnest(paper_ids) doc_id from paper_clusters) select cluster_id, count(*) chunks, count(distinct p.doc_id) papers from p join chunk_results using (doc_id) group by cluster_id")
def j10_cluster_chunks(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "paper_clusters").select("cluster_id", F.explode("paper_ids").alias("doc_id"))
    return p.join(table(spark, root, "chunk_results"), "doc_id").groupBy("cluster_id").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("papers"))


@query(
    "with l as (select doc_id, title, abstract, url from source_papers where url is not null), d as (select url, min(url || '.pdf') p, min(abstract) a from pgvector where url is not null group by url) "
    "select doc_id, title, l.url, coalesce(nullif(case when trim(l.abstract) <> '' then l.abstract end, null), a, '') abstract, coalesce(p, '') pdf_url from l left join d on d.url = l.url"
)
def j13_enrich(spark: SparkSession, root: str) -> DataFrame:
    listing = table(spark, root, "source_papers").filter("url is not null").select("doc_id", "title", "abstract", "url", F.lit("").alias("pdf_url"))
    details = table(spark, root, "pgvector").filter("url is not null").groupBy("url").agg(F.min(F.concat("url", F.lit(".pdf"))).alias("pdf_url"), F.min("abstract").alias("abstract"))
    return store.enrich(listing, details)


@query("select c.id, coalesce(s.section_name, 'UNKNOWN') section_name from chunk_results c left join size_limits s using (section_category)")
def j16_section_names(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_results").select("id", model.section_name(F.col("section_category")).alias("section_name"))


@query("select doc_id, case when status then 'already_exists' when not has_paper then 'not_found' when not has_url then 'no_pdf_url' when len0 is null then 'download_failed' when len0 = 0 then 'parse_failed' else 'success' end status "
    "from (select q.doc_id, q.doc_id in (select doc_id from chunk_results where doc_id is not null) status, p.doc_id is not null has_paper, coalesce(p.u, false) has_url, v.n len0 "
    "from (select distinct unnest(expected_doc_ids) doc_id from qa_pairs) q left join (select doc_id, bool_or(coalesce(trim(pdf_url) <> '', false)) u from source_papers group by doc_id) p using (doc_id) "
    "left join (select doc_id, max(case when trim(abstract) <> '' then 1 else 0 end) n from pgvector group by doc_id) v using (doc_id))")  # fmt: skip
def c11_a12_load_plan(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "qa_pairs").select(F.explode("expected_doc_ids").alias("doc_id"))
    parsed = table(spark, root, "pgvector").groupBy("doc_id").agg(F.max(F.coalesce(store.not_blank(F.col("abstract")), F.lit(False)).cast("int")).alias("chunks"))
    return store.load_plan(asked, kept(spark, root), parsed).select("doc_id", "status")


# --- Aggregates -------------------------------------------------------------


@query(
    "select coalesce(nullif(trim(conference_name), ''), 'unknown') conference, null::int as year, count(*) n from source_papers group by 1 "
    "union all select null, coalesce(conference_year, 0), count(*) from source_papers group by 2 union all select null, null, count(*) from source_papers"
)
def a1_counts(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "source_papers").select(
        F.coalesce(F.nullif(F.trim("conference_name"), F.lit("")), F.lit("unknown")).alias("conference"), F.coalesce("conference_year", F.lit(0)).alias("year")
    )
    return p.groupingSets([[F.col("conference")], [F.col("year")], []], F.col("conference"), F.col("year")).agg(F.count("*").alias("n"))


@query("select count(*) filter (where difficulty = 'easy') easy, count(*) filter (where difficulty = 'medium') medium, count(*) filter (where difficulty = 'hard') hard, count(*) filter (where difficulty = 'expert') expert from qa_pairs")
def a2_difficulties(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "qa_pairs").agg(*[F.count_if(F.col("difficulty") == d).alias(d) for d in model.DIFFICULTIES])


@query("select answer_source, count(*) n from qa_pairs group by 1")
def a3_sources(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "qa_pairs").groupBy("answer_source").agg(F.count("*").alias("n"))


@query("with t as (select doc_id, section_title, chunk_index, min(chunk_text) x from chunk_results where chunk_text is not null and section_title is not null group by all) select doc_id, section_title, string_agg(x, chr(10) || chr(10) order by chunk_index) as text from t group by all")
def a8_section_texts(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results").filter("chunk_text is not null and section_title is not null")
    one = c.groupBy("doc_id", "section_title", "chunk_index").agg(F.min("chunk_text").alias("x"))
    return one.groupBy("doc_id", "section_title").agg(store.joined_text("chunk_index", "x").alias("text"))


@query(
    """
with t as (select doc_id, coalesce(section_title, '') s, chunk_index i, min(chunk_text) x from chunk_results where chunk_text is not null group by all),
s as (select doc_id, s, min(i) i, '## ' || s || chr(10) || string_agg(x, chr(10) order by i) x from t group by doc_id, s)
select doc_id, string_agg(x, chr(10) || chr(10) order by i, x) full_text from s group by doc_id"""
)
def a9_full_text(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results").filter("chunk_text is not null").withColumn("s", F.coalesce("section_title", F.lit("")))
    one = c.groupBy("doc_id", "s", F.col("chunk_index").alias("i")).agg(F.min("chunk_text").alias("x"))
    part = one.groupBy("doc_id", "s").agg(F.min("i").alias("i"), store.joined_text("i", "x", "\n").alias("x"))
    headed = part.select("doc_id", "i", F.concat(F.lit("## "), "s", F.lit("\n"), "x").alias("x"))
    return headed.groupBy("doc_id").agg(store.joined_text("i", "x").alias("full_text"))


@query(
    """
with m as (select coalesce(conference_name, 'unknown') c, count(*) n, count(*) filter (where trim(title) <> '') t, count(*) filter (where trim(abstract) <> '') a, count(*) filter (where trim(pdf_url) <> '') p,
  count(distinct case when trim(title) <> '' then title end) d, coalesce(avg(case when trim(title) <> '' then length(title) end), 0.0) l from source_papers group by 1),
r as (select c, n, t / n tr, p / n pr, a / n ar, case when t > 0 then 1 - d / t else 0 end dup, 1 - t / n emp, l from m),
s as (select *, case when n < 10 then 30.0 * n / 10 when n <= 200 then 30.0 else 30.0 * greatest(0.0, 1 - (n - 200) / 300.0) end i, 30 * tr + 15 * pr + 5 * ar f,
  greatest(0.0, least(20.0, 20 - least(20.0, 20 * dup) - least(20.0, 20 * emp) - case when (l > 0 and l < 5) or l > 200 then 5.0 else 0.0 end)) q from r)
select c conference, n, round(tr, 6) title_rate, round(dup, 6) duplicate_rate, round(greatest(0.0, least(100.0, i + f + q)), 6) score, n >= 5 and tr >= 0.6 ok from s"""
)
def a10_f38_listing_scores(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "source_papers").withColumn("conference", F.coalesce("conference_name", F.lit("unknown")))
    there = lambda c: F.trim(c) != ""
    m = p.groupBy("conference").agg(
        F.count("*").alias("n"), F.count_if(there("title")).alias("t"), F.count_if(there("abstract")).alias("a"), F.count_if(there("pdf_url")).alias("p"),
        F.count_distinct(F.when(there("title"), F.col("title"))).alias("d"), F.coalesce(F.avg(F.when(there("title"), F.length("title"))), F.lit(0.0)).alias("l"),
    )
    rate = lambda c: F.col(c) / F.col("n")
    dup = F.when(F.col("t") > 0, 1 - F.col("d") / F.col("t")).otherwise(0.0)
    total = scores.total_score(scores.item_score(F.col("n")), scores.field_score(rate("t"), rate("p"), rate("a")), scores.quality_score(dup, 1 - rate("t"), F.col("l")))
    return m.select("conference", "n", F.round(rate("t"), 6).alias("title_rate"), F.round(dup, 6).alias("duplicate_rate"), F.round(total, 6).alias("score"), ((F.col("n") >= 5) & (rate("t") >= 0.6)).alias("ok"))


@query("select strategy, count(distinct doc_id) documents, count(*) chunks, count(*) filter (where trim(chunk_text) <> '') filled from chunk_results group by strategy")
def a12_strategies(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_results").groupBy("strategy").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count_if(F.trim("chunk_text") != "").alias("filled"))


@query("select conference_name, arg_max(doc_id, (conference_year, doc_id)) newest from source_papers where conference_year is not null and conference_name is not null group by 1")
def a16_newest(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "source_papers").dropna(subset=["conference_year", "conference_name"])
    return p.groupBy("conference_name").agg(F.max_by("doc_id", F.struct("conference_year", "doc_id")).alias("newest"))


# --- Windows, order, sets ---------------------------------------------------


@query("select id, row_number() over (partition by doc_id order by chunk_index, id)::int - 1 running from chunk_results")
def w3_w8_numbering(spark: SparkSession, root: str) -> DataFrame:
    return chunking.numbered(table(spark, root, "chunk_results").select("doc_id", "chunk_index", "id"), "doc_id", ("chunk_index", "id"), "running").select("id", "running")


@query("select id, lead(page_number) over (partition by doc_id order by chunk_index, id) next_page, lead(section_title) over (partition by doc_id order by chunk_index, id) next_title from chunk_results")
def w4_next_section(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "id")
    return table(spark, root, "chunk_results").select("id", F.lead("page_number").over(w).alias("next_page"), F.lead("section_title").over(w).alias("next_title"))


@query("select id, list_sum(list(length(chunk_text)) over (partition by doc_id order by chunk_index range between 1 preceding and 1 following))::bigint around from chunk_results where chunk_text is not null")
def w9_frame(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rangeBetween(-1, 1)
    return table(spark, root, "chunk_results").filter("chunk_text is not null").select("id", F.sum(F.length("chunk_text").cast("long")).over(w).alias("around"))


@query("select doc_id, chunk_index, id from chunk_results where doc_id in (select doc_id from (select distinct doc_id from chunk_results order by doc_id limit 30))")
def o5_o10_first_documents(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results").select("doc_id", "chunk_index", "id")
    first = c.select("doc_id").distinct().filter("doc_id is not null").orderBy("doc_id").limit(30)
    return c.join(F.broadcast(first), "doc_id", "left_semi")


@query("with n as (select conference_name, doc_id, title, row_number() over (partition by conference_name order by doc_id, title) r from source_papers where conference_name is not null) select conference_name, doc_id, title from n where r <= 10")
def o11_head_of_listing(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("conference_name").orderBy("doc_id", "title")
    p = table(spark, root, "source_papers").filter("conference_name is not null").withColumn("r", F.row_number().over(w))
    return p.filter("r <= 10").select("conference_name", "doc_id", "title")


@query("select 'paper' kind, doc_id, title from source_papers union all select 'vector', doc_id, title from pgvector")
def u1_concat(spark: SparkSession, root: str) -> DataFrame:
    of = lambda t, k: table(spark, root, t).select(F.lit(k).alias("kind"), "doc_id", "title")
    return of("source_papers", "paper").unionByName(of("pgvector", "vector"))


@query("select doc_id from source_papers intersect select doc_id from chunk_results")
def u2_both(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_papers").select("doc_id").intersect(table(spark, root, "chunk_results").select("doc_id"))


@query("select doc_id from source_papers union select doc_id from chunk_results")
def u3_either(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_papers").select("doc_id").union(table(spark, root, "chunk_results").select("doc_id")).distinct()


@query("select id, list_sort(list_filter(list_distinct(expected_chunk_ids), lambda x: x <> -1 and x <> 0))::varchar ids from qa_pairs where expected_chunk_ids is not null")
def u4_minus(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "qa_pairs").filter("expected_chunk_ids is not null")
    left = F.array_sort(F.filter(F.array_except("expected_chunk_ids", F.array(F.lit(-1), F.lit(0))), lambda x: x.isNotNull()))
    return q.select("id", F.concat(F.lit("["), F.array_join(left, ", "), F.lit("]")).alias("ids"))


@query("select distinct strategy from chunk_results")
def u5_strategies(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_results").select("strategy").distinct()


@query("with l as (select doc_id, section_category, chunk_index, min(chunk_text) x from chunk_results where section_category = 1 and chunk_text is not null group by all), r as (select *, row_number() over (partition by doc_id order by chunk_index, x) r from l), "
    "t as (select doc_id, string_agg(x, chr(10) || chr(10) order by r) x from r where r <= 10 group by doc_id) select doc_id, case when length(x) > 1500 then left(x, 1500) || '...' else x end introduction from t")  # fmt: skip
def v6_introductions(spark: SparkSession, root: str) -> DataFrame:
    one = rows(spark, root).groupBy("doc_id", "chunk_id", "section_category").agg(F.min("text").alias("text"))
    return store.CorpusStore(one).introductions()


@query("select * from (values (50, 10, 15, 15, 10), (30, 6, 9, 9, 6), (7, 1, 2, 2, 2)) t(n, easy, medium, hard, expert)")
def f39_g4_quotas(spark: SparkSession, root: str) -> DataFrame:
    easy, medium, hard, expert = scores.quotas(F.col("n"))
    return lines(spark, [(50,), (30,), (7,)], "n int").select("n", easy.alias("easy"), medium.alias("medium"), hard.alias("hard"), expert.alias("expert"))
