"""Queries of text functions, chunking and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import chunking, metrics, themes
from folioflow.plans.registry import lines, query
from folioflow.runtime import table

W = r"[\p{L}\p{N}_]"
#: SQL of the sentence marks: the same chain without look-ahead.
CUT, SHIELD, STOP, POINT = ("chr(57344)", "chr(57345)", "chr(57346)", "chr(57347)")


def _sentence_sql(text: str, size: int = 800) -> str:
    """SQL for the list of sentences of an expression."""
    abbreviations = "|".join(T.ABBREVIATIONS)
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    safe = rf"regexp_replace({flat}, '(?i)\b({abbreviations})\.\s', {SHIELD} || '\1' || {STOP}, 'g')"
    safe = rf"regexp_replace({safe}, '(\d+)\.(\d+)', {SHIELD} || '\1' || {POINT} || '\2', 'g')"
    # Without look-behind: the sign before an initial is captured and given back.
    safe = rf"regexp_replace({safe}, '(^|[^\p{{L}}\p{{N}}_' || {STOP} || '])([A-Z])\.\s', '\1' || {SHIELD} || '\2' || {STOP}, 'g')"
    cut = rf"string_split(regexp_replace({safe}, '([.!?])\s+([A-Z\d\[\(\"])', '\1' || {CUT} || '\2', 'g'), {CUT})"
    back = f"replace(replace(replace(x, {STOP}, '. '), {POINT}, '.'), {SHIELD}, '')"
    parts = rf"list_transform(list_filter(list_transform({cut}, lambda x: trim(x)), lambda x: x <> ''), lambda x: {back})"
    simple = rf"list_filter(list_transform(string_split(regexp_replace({flat}, '([.!?])\s+', '\1' || {CUT}, 'g'), {CUT}), lambda x: trim(x)), lambda x: x <> '')"
    return f"case when len({parts}) <= 1 and length({flat}) > {size} then {simple} else {parts} end"


CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(TEXT, '\[\s*[\d\s,\-]+\s*\]', '', 'g'), '({W}+)-\n({W}+)', '\1\2', 'g'), chr(10), ' '), '\s+', ' ', 'g'), '\s+([,.;:?!])', '\1', 'g'), '^\s+|\s+$', '', 'g')"""


@query("select id, " + CLEAN.replace("TEXT", "chunk_text") + " clean from chunk_results where chunk_text is not null")
def f1_clean_text(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_results").filter("chunk_text is not null").select("id", T.clean_text(F.col("chunk_text")).alias("clean"))


@query(
    r"""
with one as (select doc_id, lower(min(title)) t from source_papers group by doc_id)
select c.id, case when lower(section_title) like '%abstract%' then 0 when lower(section_title) like '%related work%' then 6
  when regexp_matches(lower(section_title), 'introduction|background|motivation') then 1
  when regexp_matches(lower(section_title), 'method|approach|architecture|proposed|framework') then 2
  when regexp_matches(lower(section_title), 'experiment|result|evaluation|ablation|performance|comparison') then 3
  when regexp_matches(lower(section_title), 'conclusion|discussion|summary|future work') then 4
  when len(list_filter(regexp_split_to_array(coalesce(t, ''), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 2 and w not in ('a','an','the','for','and','of','in','on','with','to','at','by','from') and contains(lower(section_title), w))) > 0 then 2
  else 5 end::int category
from chunk_results c left join one using (doc_id) where section_title is not null"""
)
def f2_classify_section(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "source_papers").groupBy("doc_id").agg(F.min("title").alias("t"))
    c = table(spark, root, "chunk_results").filter("section_title is not null").join(one, "doc_id", "left")
    return c.select("id", T.classify_section(F.col("section_title"), F.coalesce("t", F.lit(""))).alias("category"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) flat from documents")
def f3_squeeze(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", T.squeeze(F.col("text")).alias("flat"))


@query("select id, array_to_string(" + _sentence_sql("chunk_text") + ", chr(10)) sentences from chunk_results where chunk_text is not null")
def f4_c2_sentences(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results").filter("chunk_text is not null")
    return c.select("id", F.array_join(T.sentences(F.col("chunk_text")), "\n").alias("sentences"))


@query(rf"select id, array_to_string(list_filter(list_transform(string_split(regexp_replace(chunk_text, '([.!?])\s+', '\1' || {CUT}, 'g'), {CUT}), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(31)) parts from chunk_results where chunk_text is not null")
def f5_simple_sentences(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_results").filter("chunk_text is not null").select("id", F.array_join(T.simple_sentences(F.col("chunk_text")), "\x1f").alias("parts"))


@query("select * from (values (1, 11), (2, 0), (3, -1), (4, 6)) t(n, place)")
def f6_f7_title_position(spark: SparkSession, root: str) -> DataFrame:
    rows = [
        (1, "intro text.\n\n3.2. Cache   Line\nbody", "Cache Line"),
        (2, "Setup\nbody of setup", "Setup"),
        (3, "the setup is in the text", "Setup"),
        (4, "before\n  What is C++?  \nafter", "what is c++?"),
    ]
    t = lines(spark, rows, "n int, page string, title string")
    return t.select("n", T.title_position(F.col("page"), F.col("title")).alias("place"))


@query(r"select id, regexp_matches(chunk_text, '\n\s*(Abstract|ABSTRACT)\s*\n') or regexp_matches(chunk_text, '(^|\n)\s*(Abstract|ABSTRACT)[:\.]?\s*\n') has_header from chunk_results where chunk_text is not null")
def f8_abstract_header(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_results").filter("chunk_text is not null").select("id", T.has_abstract_header(F.col("chunk_text")).alias("has_header"))


@query("select doc_id, case when length(text) > 300 then left(text, 300) || '...' else text end short, case when length(text) > 4000 then left(text, 4000) || '... [truncated]' else text end long from documents")
def f9_f10_truncate(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return table(spark, root, "documents").select("doc_id", T.truncate(t, 300).alias("short"), T.truncate(t, 4000, "... [truncated]").alias("long"))


KEYWORDS = (
    "with one as (select doc_id, coalesce(min(title), '') title, coalesce(min(abstract), '') abstract from source_papers group by doc_id), "
    "k as (select doc_id, title, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || abstract), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}') and w not in ("
    + ", ".join(f"'{w}'" for w in T.KEYWORD_STOP_WORDS)
    + ")))) kw from one) "
)


@query(KEYWORDS + "select doc_id, array_to_string(kw, ' ') keywords from k")
def f11_keywords(spark: SparkSession, root: str) -> DataFrame:
    return themes.keyword_sets(table(spark, root, "source_papers")).select("doc_id", F.array_join("kw", " ").alias("keywords"))


@query(
    "select * from (values (1, 'https://h.org/a/x.html'), (2, 'https://o.org/p'), (3, 'https://cdn.org/q'), (4, 'https://h.org/r'), (5, 'https://h.org/a/b'), (6, 'https://h.org/a/b?x=1')) t(n, url)"
)
def f14_url_join(spark: SparkSession, root: str) -> DataFrame:
    rows = [(1, "x.html"), (2, "https://o.org/p"), (3, "//cdn.org/q"), (4, "/r"), (5, ""), (6, "?x=1")]
    return lines(spark, rows, "n int, href string").select("n", T.url_join(F.lit("https://h.org/a/b"), F.col("href")).alias("url"))


@query(
    r"""
with r as (select *, row_number() over (order by id) n from (select c.id, p.title, p.conference_name c, p.conference_year y, coalesce(c.section_category, 5) s, coalesce(c.parent_section, '') ps, coalesce(c.page_number, 0) pg, p.url u, c.chunk_text t
  from chunk_results c join (select doc_id, min(title) title, min(conference_name) conference_name, min(conference_year) conference_year, min(url) url from source_papers group by doc_id) p using (doc_id)))
select id, '[' || id || '] ' || coalesce(title, '') ||
  case when concat_ws(' | ', case when length(c) > 0 then 'Conference: ' || c end, case when y is not null then 'Year: ' || y end, case when s <> 0 then 'Section: ' || case s when 1 then 'INTRODUCTION' when 2 then 'METHOD' when 3 then 'EVALUATION' when 4 then 'CONCLUSION' when 5 then 'OTHER' when 6 then 'RELATED_WORK' else 'UNKNOWN' end end,
    case when length(ps) > 0 then 'Parent: ' || ps end, case when pg > 0 then 'Page: ' || pg end) <> '' then chr(10) || concat_ws(' | ', case when length(c) > 0 then 'Conference: ' || c end, case when y is not null then 'Year: ' || y end,
    case when s <> 0 then 'Section: ' || case s when 1 then 'INTRODUCTION' when 2 then 'METHOD' when 3 then 'EVALUATION' when 4 then 'CONCLUSION' when 5 then 'OTHER' when 6 then 'RELATED_WORK' else 'UNKNOWN' end end, case when length(ps) > 0 then 'Parent: ' || ps end, case when pg > 0 then 'Page: ' || pg end) else '' end ||
  case when length(u) > 0 then chr(10) || 'URL: ' || u else '' end || chr(10) || 'Content: ' || coalesce(case when length(t) > 500 then left(t, 500) || '...' else t end, '') block from r"""
)
def f16_hit_blocks(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "source_papers").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("title", "conference_name", "conference_year", "url")])
    c = table(spark, root, "chunk_results").join(p, "doc_id")
    block = T.hit_block(
        F.col("id"), F.col("title"), F.col("conference_name"), F.col("conference_year"), F.coalesce("section_category", F.lit(5)),
        F.coalesce("parent_section", F.lit("")), F.coalesce("page_number", F.lit(0)), F.col("url"), F.col("chunk_text"),
    )
    return c.select("id", block.alias("block"))


@query("select '| paragraph | FLAT | no | 1.000 | 0.500 | 0.900 | 695 |' line union all select '| contextual | HNSW | yes | 0.333 | 0.250 | 0.500 | 12 |'")
def f17_s9_table_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = [("paragraph", "FLAT", False, 1.0, 0.5, 0.9, 695.1), ("contextual", "HNSW", True, 1 / 3, 0.25, 0.5, 12.4)]
    t = lines(spark, rows, "chunk_strategy string, index_type string, enable_agentic_rag boolean, recall_at_5 double, mrr double, hit_rate double, latency_ms double")
    return t.select(metrics.comparison_line({c: F.col(c) for c in t.columns}).alias("line"))


@query("select * from (values (1, true, 'ls -l;cat x'), (2, false, ''), (3, false, 'grep a')) t(n, fenced, commands)")
def f19_tags(spark: SparkSession, root: str) -> DataFrame:
    rows = [
        (1, "<bash_exec>ls -l</bash_exec> <thought>```json no```</thought> ```JSON {}``` <bash_exec> cat x </bash_exec>"),
        (2, "<thought>a ```json {}``` b</thought> done"),
        (3, "try <bash_exec>grep a"),
    ]
    t = lines(spark, rows, "n int, m string")
    return t.select("n", T.has_json_fence(F.col("m")).alias("fenced"), F.array_join(T.bash_commands(F.col("m")), ";").alias("commands"))


@query("select * from (values (1, 'plain'), (2, 'a' || chr(10) || 'b'), (3, '[not json')) t(n, content)")
def f21_message_text(spark: SparkSession, root: str) -> DataFrame:
    rows = [(1, "plain"), (2, '[{"text": "a"}, {"type": "x", "text": "b"}]'), (3, "[not json")]
    return lines(spark, rows, "n int, c string").select("n", T.message_text(F.col("c")).alias("content"))


@query(
    "select id, 'Document: ' || coalesce(title, '') || chr(10) || 'Chunk: ' || case when length(chunk_text) > 3000 then left(chunk_text, 3000) || '... [truncated]' else coalesce(chunk_text, '') end prompt "
    "from chunk_results left join (select doc_id, min(title) title from source_papers group by doc_id) using (doc_id)"
)
def f22_f23_prompts(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "source_papers").groupBy("doc_id").agg(F.min("title").alias("title"))
    c = table(spark, root, "chunk_results").join(one, "doc_id", "left")
    return c.select("id", F.concat(F.lit("Document: "), F.coalesce("title", F.lit("")), F.lit("\nChunk: "), T.truncate(F.col("chunk_text"), 3000, "... [truncated]")).alias("prompt"))


# --- Chunking ---------------------------------------------------------------

MERGE = (
    "with recursive s as (select id, " + _sentence_sql("chunk_text") + """ p, chunk_text t from chunk_results where chunk_text is not null and length(chunk_text) > 0),
f(id, k, done, cur, n) as (
  select id, 0, []::varchar[], []::varchar[], 0 from s where length(t) > 800
  union all
  select f.id, k + 1,
    case when n + length(p[k + 1]) > 800 and len(cur) > 0 then list_append(done, array_to_string(cur, ' ')) else done end,
    case when n + length(p[k + 1]) > 800 and len(cur) > 0 then list_concat(tail, [p[k + 1]]) else list_append(cur, p[k + 1]) end,
    case when n + length(p[k + 1]) > 800 and len(cur) > 0 then list_sum(list_transform(tail, lambda x: length(x)))::int + len(tail)::int - 1 + length(p[k + 1]) + 1 else n + length(p[k + 1]) + 1 end
  from (select f.*, s.p, coalesce(list_slice(cur, len(cur) - (
      select min(j) from range(1, len(cur) + 1) r(j) where list_sum(list_transform(list_slice(cur, len(cur) - j + 1, len(cur)), lambda x: length(x) + 1)) >= 100 or j = len(cur))::int + 1, len(cur)), []) tail
    from f join s using (id)) f
  where k < len(p)),
e as (select f.id, done, array_to_string(cur, ' ') l, len(cur) c from f join s using (id) where k = len(p)),
m as (select id, case when c = 0 then done when length(l) < 100 and len(done) > 0 then list_append(list_slice(done, 1, len(done) - 1), done[len(done)] || ' ' || l) else list_append(done, l) end x from e
  union all select id, [t] from s where length(t) <= 800)
"""
)


@query(MERGE + "select id, array_to_string(x, chr(31)) chunks from m")
def c1_c3_c4_sentence_merge(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results").filter("chunk_text is not null and length(chunk_text) > 0")
    t = F.col("chunk_text")
    whole = F.when(F.length(t) <= chunking.CHUNK_SIZE, F.array(t)).otherwise(chunking.merge_sentences(T.sentences(t)))
    return c.select("id", F.array_join(whole, "\x1f").alias("chunks"))


@query()
def c1_renumbered(spark: SparkSession, root: str) -> DataFrame:
    """Merged chunks with indexes that run through each document."""
    c = table(spark, root, "chunk_results").filter("doc_id is not null").select("doc_id", "chunk_index", "id", "chunk_text", "section_title")
    return chunking.sentence_merge(c, order=("doc_id", "chunk_index", "id"))


@query(
    "select id, case when coalesce(contextual_prefix, '') <> '' and strategy = 'contextual' then contextual_prefix || chr(10) || chr(10) || chunk_text else chunk_text end embedded from chunk_results"
)
def c5_strategies(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results")
    prefix = F.when(F.col("strategy") == "contextual", F.col("contextual_prefix"))
    return chunking.with_prefix(c, prefix).select("id", F.col("text_for_embedding").alias("embedded"))


@query(r"select doc_id, i - 1 chunk_index, p[i] chunk_text from (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') p from documents) t, lateral (select unnest(generate_series(1, len(p)))::int i)")
def c6_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return chunking.chunk_text(table(spark, root, "documents"), "paragraph")


@query("select doc_id, i chunk_index, substr(text, i * 500 + 1, 500) chunk_text from documents, lateral (select unnest(generate_series(0, (length(text) + 499) // 500 - 1))::int i)")
def c6_fixed_size(spark: SparkSession, root: str) -> DataFrame:
    return chunking.chunk_text(table(spark, root, "documents"), "fixed_size")


@query(r"select doc_id, i - 1 chunk_index, p[i] chunk_text from (select doc_id, list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: string_split(x, '.'))), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') p from documents) t, lateral (select unnest(generate_series(1, len(p)))::int i)")
def c6_sentence_stops(spark: SparkSession, root: str) -> DataFrame:
    return chunking.chunk_text(table(spark, root, "documents"), "sentence")


def _outline(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = [
        ("d1", 1, 1, "Introduction", 1), ("d1", 2, 1, "2 Method", 2), ("d1", 3, 2, "2.1 Results", 2), ("d1", 4, 2, "2.2 Details", 3),
        ("d1", 5, 1, "Appendix", 4), ("d1", 6, 2, "Results", 4), ("d2", 1, 1, "Background", 1), ("d2", 2, 3, "Deep", 1), ("d2", 3, 2, "Conclusion", 2),
    ]
    pages = [
        ("d1", 1, "Title\nAbstract\nshort abstract [1].\nIntroduction\nwe begin-\nning here ."),
        ("d1", 2, "more intro\n2 Method\nthe method\n2.1 Results\nfirst results"),
        ("d1", 3, "second page\n2.2 Details\nall details"),
        ("d1", 4, "Appendix\nextra\nResults\nlast results"),
        ("d2", 1, "Background\nold work\nDeep\ndeep part"),
        ("d2", 2, "goes on\nConclusion\nwe end"),
    ]
    papers = [("d1", "A Study"), ("d2", "Notes")]
    return (
        lines(spark, nodes, "doc_id string, ord int, level int, title string, page int"),
        lines(spark, pages, "doc_id string, page int, text string"),
        lines(spark, papers, "doc_id string, paper_title string"),
    )


@query("select * from (values ('d1', 1, null), ('d1', 2, null), ('d1', 3, 2), ('d1', 4, 2), ('d1', 5, null), ('d1', 6, 5), ('d2', 1, null), ('d2', 2, 1), ('d2', 3, 1)) t(doc_id, ord, parent)")
def w5_c8_outline_parents(spark: SparkSession, root: str) -> DataFrame:
    return chunking.outline_parents(_outline(spark)[0]).select("doc_id", "ord", "parent")


@query(
    "select * from (values ('d1', 0, 'Abstract', 'short abstract.'), ('d1', 1, 'Introduction', 'we beginning here. more intro'), ('d1', 2, '2 Method', 'the method'), ('d1', 3, '2.1 Results', 'first results second page'), "
    "('d1', 4, '2.2 Details', 'all details'), ('d1', 5, 'Appendix', 'extra'), ('d1', 6, 'Results', 'last results'), ('d2', 1, 'Background', 'old work'), ('d2', 2, 'Deep', 'deep part goes on'), ('d2', 3, 'Conclusion', 'we end')) t(doc_id, ord, title, body)"
)
def c8_c9_section_bodies(spark: SparkSession, root: str) -> DataFrame:
    outline, pages, _ = _outline(spark)
    return chunking.section_bodies(chunking.with_abstract(outline, pages), pages).select("doc_id", "ord", "title", "body")


@query(
    "select * from (values ('d1', 0, 'Introduction', 1, ''), ('d1', 1, '2 Method', 2, ''), ('d1', 2, '2.1 Results', 2, '2 Method'), ('d1', 3, '2.2 Details', 2, '2 Method'), ('d1', 4, 'Appendix', 5, ''), "
    "('d1', 5, 'Results', 3, 'Appendix'), ('d2', 0, 'Background', 1, ''), ('d2', 1, 'Deep', 1, 'Background'), ('d2', 2, 'Conclusion', 1, 'Background')) t(doc_id, chunk_index, section_title, section_category, parent_section)"
)
def c7_flatten_outline(spark: SparkSession, root: str) -> DataFrame:
    outline, pages, papers = _outline(spark)
    flat = chunking.flatten_outline(chunking.outline_parents(outline), chunking.section_bodies(outline, pages), papers)
    return flat.select("doc_id", "chunk_index", "section_title", "section_category", "parent_section")


@query(
    """
with p as (select doc_id, chunk_index page, min(chunk_text) t from chunk_results where chunk_text is not null and chunk_index >= 0 group by all),
c as (select doc_id, page, """ + CLEAN.replace("TEXT", "t") + """ x from p)
select doc_id, (row_number() over (partition by doc_id order by page) - 1)::int chunk_index, x chunk_text, 'Page ' || (page + 1) section_title, case when page = 0 then 0 when page <= 2 then 1 else 5 end section_category
from c where length(x) >= 50"""
)
def c10_page_fallback(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results").filter("chunk_text is not null and chunk_index >= 0")
    pages = c.groupBy("doc_id", F.col("chunk_index").alias("page")).agg(F.min("chunk_text").alias("text"))
    return chunking.page_fallback(pages).select("doc_id", "chunk_index", "chunk_text", "section_title", "section_category")


# --- Keyword groups ---------------------------------------------------------

#: Similarity from which the query lists pairs of the whole table.
PAIR_THRESHOLD = 0.1


@query(
    KEYWORDS
    + f"""
select a.doc_id id1, b.doc_id id2, round(len(list_intersect(a.kw, b.kw)) / len(list_distinct(list_concat(a.kw, b.kw))), 6) sim
from k a join k b on a.doc_id < b.doc_id where len(list_intersect(a.kw, b.kw)) / len(list_distinct(list_concat(a.kw, b.kw))) > {PAIR_THRESHOLD} and len(a.kw) > 0 and len(b.kw) > 0"""
)
def j7_f37_o7_keyword_pairs(spark: SparkSession, root: str) -> DataFrame:
    # Rounded where the pairs are made: round() takes longer for some hundred million of them than to find them.
    return themes.pair_similarities(themes.keyword_sets(table(spark, root, "source_papers")), PAIR_THRESHOLD, 6)


@query()
def g1_keyword_groups(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "paper_clusters").select(F.explode("paper_ids").alias("doc_id")).distinct()
    papers = table(spark, root, "source_papers").join(asked, "doc_id", "left_semi")
    return themes.keyword_groups(papers)


@query("select cluster_id, coalesce(nullif(left(trim(theme), 100), ''), coalesce(nullif(array_to_string(list_slice(common_keywords, 1, 3), ', '), ''), 'general security')) theme from paper_clusters")
def g3_themes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "paper_clusters").select("cluster_id", themes.theme(F.col("common_keywords"), F.col("theme")).alias("theme"))


@query(KEYWORDS + ", p as (select cluster_id, unnest(paper_ids) doc_id from paper_clusters) select cluster_id, string_agg(distinct w, ' ' order by w) words from (select cluster_id, unnest(kw) w from p join k using (doc_id)) group by cluster_id")
def a15_cluster_words(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "paper_clusters").select("cluster_id", F.explode("paper_ids").alias("doc_id")).distinct()
    w = p.join(themes.keyword_sets(table(spark, root, "source_papers")), "doc_id").select("cluster_id", F.explode("kw").alias("w")).distinct()
    return w.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("words"))
