"""Queries of model output, traces, pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import html, jsonx, scores
from folioflow.operators import traces
from folioflow.plans.registry import lines, query, scratch
from folioflow.runtime import table
from folioflow.sources.synthetic import synthetic_pages
from folioflow.streaming import flows

TICKS = "```"


def _answers(spark: SparkSession) -> DataFrame:
    rows = [
        (1, '{"a": 1}'),
        (2, f'Sure:\n{TICKS}json\n{{"a": 2}}\n{TICKS}\nand {TICKS}json\n{{"a": 9}}\n{TICKS}'),
        (3, f"{TICKS}\n[3]\n{TICKS}"),
        (4, "no json at all"),
        (5, 'text before {"parsed_paths": ["x", "y"]} text after'),
        (6, "list: [1, 2] end"),
    ]
    return lines(spark, rows, "n int, answer string")


@query("select * from (values (1, '{\"a\": 1}'), (2, '{\"a\": 2}'), (3, '[3]'), (4, null), (5, null), (6, null)) t(n, found)")
def f24_json_of_answer(spark: SparkSession, root: str) -> DataFrame:
    return _answers(spark).select("n", jsonx.json_of_answer(F.col("answer")).alias("found"))


@query("select * from (values (1, '{\"a\": 1}'), (2, '{\"a\": 2}'), (3, '[3]'), (4, null), (5, '{\"parsed_paths\": [\"x\", \"y\"]}'), (6, '[1, 2]')) t(n, found)")
def f25_best_effort(spark: SparkSession, root: str) -> DataFrame:
    return _answers(spark).select("n", jsonx.json_best_effort(F.col("answer")).alias("found"))


@query("select * from (values (1, ''), (2, ''), (3, ''), (4, ''), (5, 'x,y'), (6, '')) t(n, paths)")
def f26_parsed_paths(spark: SparkSession, root: str) -> DataFrame:
    return _answers(spark).select("n", F.array_join(jsonx.parsed_paths(F.col("answer")), ",").alias("paths"))


@query("select * from (values (1, '{\"a\": [1, 2]}'), (2, '{\"t\": \"x\\ny\"}')) t(n, mended)")
def f27_mend_json(spark: SparkSession, root: str) -> DataFrame:
    rows = [(1, '{"a": [1, 2,],}'), (2, '{"t": "x\ny"}')]
    return lines(spark, rows, "n int, raw string").select("n", jsonx.mend_json_column(F.col("raw")).alias("mended"))


@query("select * from (values (1, 2, 'q1'), (2, 0, null), (3, 1, 'only')) t(n, found, first)")
def f28_f29_f33_questions(spark: SparkSession, root: str) -> DataFrame:
    rows = [
        (1, 'text [{"question": "q1", "answer": "{x}"}, {"question": "q2",}] end'),
        (2, "nothing"),
        (3, '[{"question": "only"}, {"q": 1} '),
    ]
    q = lines(spark, rows, "n int, response string").withColumn("found", jsonx.qa_rows(F.col("response")))
    return q.select("n", F.size("found").alias("found"), F.get_json_object(F.get("found", 0), "$.question").alias("first"))


@query("select * from (values (1, 4.0, 3.0, 0.0), (2, 5.0, 2.0, 0.0), (3, 0.0, 0.0, 0.0)) t(n, correctness, faithfulness, relevance)")
def f31_judge_scores(spark: SparkSession, root: str) -> DataFrame:
    rows = [(1, 'ok {"correctness": 4, "faithfulness": 3}'), (2, "Correctness: 9\nFaithfulness = 2"), (3, "none")]
    t = lines(spark, rows, "n int, m string")
    return t.select("n", *[c.alias(k) for k, c in jsonx.judge_scores(F.col("m")).items()])


@query("select * from (values (1, '{\"a\": 1}'), (2, '[2]')) t(n, body)")
def f32_unfence(spark: SparkSession, root: str) -> DataFrame:
    rows = [(1, f'{TICKS}json\n{{"a": 1}}\n{TICKS}'), (2, " [2] ")]
    return lines(spark, rows, "n int, m string").select("n", jsonx.unfence(F.col("m")).alias("body"))


@query("select * from (values (1, 'h2', 'div.a', '.row'), (2, '.t', null, null)) t(n, title, pdf, item)")
def f34_h6_selector_fields(spark: SparkSession, root: str) -> DataFrame:
    rows = [(1, '{"title": " ", "paper_title": "h2", "pdf": "div.a", "papers": ".row"}'), (2, '{"title": ".t"}')]
    t = lines(spark, rows, "n int, s string")
    f = jsonx.selector_fields(F.col("s"))
    return t.select("n", f["title"].alias("title"), f["pdf"].alias("pdf"), jsonx.item_selector(F.col("s")).alias("item"))


@query("select * from (values (10, 30.0), (5, 15.0), (300, 20.0), (350, 15.0), (500, 0.0)) t(n, points)")
def f38_item_score(spark: SparkSession, root: str) -> DataFrame:
    return lines(spark, [(10,), (5,), (300,), (350,), (500,)], "n int").select("n", F.round(scores.item_score(F.col("n")), 6).alias("points"))


@query("select id, round(1 - abs(length(chunk_text) - 400) / 400, 6) near from chunk_results where chunk_text is not null")
def f40_closeness(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunk_results").filter("chunk_text is not null")
    return c.select("id", F.round(scores.closeness(F.length("chunk_text"), F.lit(400)), 6).alias("near"))


@query(
    """
with c as (select doc_id, chunk_index i, section_category s, chunk_text t, row_number() over (partition by doc_id, section_category order by chunk_index, id) r from chunk_results where chunk_text is not null and section_category in (2, 3)),
m as (select doc_id, left(string_agg(left(t, 300), ' ' order by r) filter (where s = 2 and r <= 3), 600) method, max(case when s = 3 and r = 1 then left(t, 200) end) evaluation from c group by doc_id),
p as (select doc_id, min(title) title, left(coalesce(min(abstract), ''), 500) abstract from source_papers group by doc_id)
select p.doc_id, title, abstract, coalesce(method, '') method, coalesce(evaluation, '') evaluation from p left join m using (doc_id)"""
)
def g5_f41_prompt_contexts(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "section_category").orderBy("chunk_index", "id")
    c = table(spark, root, "chunk_results").filter("chunk_text is not null and section_category in (2, 3)").withColumn("r", F.row_number().over(w)).filter("r <= 3")
    cut = c.select("doc_id", "section_category", "r", F.left("chunk_text", F.lit(300)).alias("t"))
    method = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section_category") == 2, F.struct("r", "t")))), lambda x: x["t"]), " ")
    first = F.max(F.when((F.col("section_category") == 3) & (F.col("r") == 1), F.left("t", F.lit(200))))
    m = cut.groupBy("doc_id").agg(F.left(method, F.lit(600)).alias("method"), first.alias("evaluation"))
    p = table(spark, root, "source_papers").groupBy("doc_id").agg(F.min("title").alias("title"), F.left(F.coalesce(F.min("abstract"), F.lit("")), F.lit(500)).alias("abstract"))
    return p.join(m, "doc_id", "left").select("doc_id", "title", "abstract", F.coalesce("method", F.lit("")).alias("method"), F.coalesce("evaluation", F.lit("")).alias("evaluation"))


@query(
    "with a as (select distinct conference_name area, doc_id from source_papers where conference_name is not null), n as (select count(distinct area) n from a), r as (select *, row_number() over (partition by area order by doc_id) r from a) "
    "select area, doc_id from r, n where r <= greatest(1, 300 // n)"
)
def g6_quota_by_area(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    a = table(spark, root, "source_papers").filter("conference_name is not null").select(F.col("conference_name").alias("area"), "doc_id").distinct()
    n = a.agg(F.count_distinct("area").alias("n"))
    r = a.withColumn("r", F.row_number().over(Window.partitionBy("area").orderBy("doc_id")))
    return r.join(F.broadcast(n), F.lit(True)).filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.lit(300) / F.col("n")))).select("area", "doc_id")


@query("select coalesce(theme, 'none') area, count(*) n, round(avg(len(common_keywords)), 6) keywords from paper_clusters group by 1")
def g7_annotation_stats(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "paper_clusters").groupBy(F.coalesce("theme", F.lit("none")).alias("area")).agg(F.count("*").alias("n"), F.round(F.avg(F.size("common_keywords")), 6).alias("keywords"))


# --- Traces -----------------------------------------------------------------


def _messages(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "parse"), (1, 2, "assistant", "<thought>look</thought> <bash_exec>ls</bash_exec>"), (1, 3, "user", "files"),
        (1, 4, "assistant", f'done {TICKS}json\n{{"title": "h2"}}\n{TICKS}'),
        (2, 0, "user", "go"), (2, 1, "assistant", f"<thought>{TICKS}json {{}}{TICKS}</thought> not yet"), (3, 0, "user", "alone"),
    ]
    return lines(spark, rows, "conv_id int, turn int, role string, content string")


@query("select * from (values (1, 5::bigint, 2::bigint, true, true, false), (2, 2, 1, true, false, true), (3, 1, 0, false, false, true)) t(conv_id, trace_length, assistant_turns, has_cot, finished, needs_repair)")
def pred14_a13_a14_conversations(spark: SparkSession, root: str) -> DataFrame:
    return traces.conversations(_messages(spark))


@query("select * from (values (1, 2, 5, true, 'h2'), (2, 1, 2, true, null), (3, 1, 1, false, null)) t(conv_id, prompts, messages, has_cot, target)")
def t1_training_records(spark: SparkSession, root: str) -> DataFrame:
    truth = lines(spark, [(1, "h2", "<html>")], "conv_id int, target_selector string, file_context string")
    r = traces.training_records(_messages(spark), truth)
    return r.select("conv_id", F.size("prompt").alias("prompts"), F.size("messages").alias("messages"), "metadata.has_cot", F.col("ground_truth.target_selector").alias("target"))


@query("select * from (values (1, false, 0::bigint), (2, true, 1), (3, true, 0)) t(conv_id, repaired, repair_turns)")
def t2_repair_flags(spark: SparkSession, root: str) -> DataFrame:
    m = _messages(spark)
    return traces.repair_flags(m.select("conv_id").distinct(), traces.conversations(m)).select("conv_id", "repaired", "repair_turns")


@query("select url, repeat::bigint repeat from (values ('https://a.example'), ('https://b.example')) u(url), range(3) r(repeat)")
def t3_url_grid(spark: SparkSession, root: str) -> DataFrame:
    urls = lines(spark, [("https://a.example",), ("https://b.example",)], "url string")
    return urls.join(F.broadcast(spark.range(3).withColumnRenamed("id", "repeat")), F.lit(True))


@query("select * from (values ('t', 1, 'get', 'u', 'page'), ('t', 2, 'read', 'f', '')) t(trace_id, step_idx, tool_name, tool_args, tool_output)")
def w7_attach_outputs(spark: SparkSession, root: str) -> DataFrame:
    rows = [("t", 1, "call", "get", "u"), ("t", 2, "output", "", "page"), ("t", 3, "output", "", "late"), ("t", 4, "call", "read", "f")]
    return traces.attach_outputs(lines(spark, rows, "trace_id string, seq int, kind string, name string, content string"))


@query("select * from (values ('t', 1, 'c1', 'r1'), ('t', 2, 'c2', null)) t(trace_id, position, call_id, content)")
def j14_link_by_order(spark: SparkSession, root: str) -> DataFrame:
    calls = lines(spark, [("t", 1, "c1"), ("t", 5, "c2")], "trace_id string, seq int, call_id string")
    return traces.link_by_order(calls, lines(spark, [("t", 3, "r1")], "trace_id string, seq int, content string"))


@query("select * from (values ('human', 'user'), ('ai', 'assistant'), ('system', 'system'), ('tool', 'tool'), ('other', 'user')) t(kind, role)")
def f36_chat_roles(spark: SparkSession, root: str) -> DataFrame:
    return lines(spark, [("human",), ("ai",), ("system",), ("tool",), ("other",)], "kind string").select("kind", traces.chat_role(F.col("kind")).alias("role"))


@query("select event_type, count(*) n, count(*) filter (where props is not null) with_props, round(avg(value), 6) mean from events group by 1")
def x_event_statistics(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.round(F.avg("value"), 6).alias("mean"))


@query("select * from (values ('0001', 'h2', 'a'), ('0002', '.t', null)) t(stem, target_selector, html)")
def j15_page_metadata(spark: SparkSession, root: str) -> DataFrame:
    pages = lines(spark, [("/x/0001.html", "a"), ("/x/0003.html", "c")], "path string, html string")
    meta = lines(spark, [("/y/0001.json", "h2"), ("/y/0002.json", ".t")], "path string, target_selector string")
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    return meta.select(stem.alias("stem"), "target_selector").join(pages.select(stem.alias("stem"), "html"), "stem", "left")


# --- Pages ------------------------------------------------------------------

PAGES = 200


@query("select 200::bigint pages, 200::bigint right_titles, 0::bigint foreign_titles")
def s26_h3_h8_synthetic_pages(spark: SparkSession, root: str) -> DataFrame:
    """The known selector of each adversarial page finds its main titles and nothing else."""
    p = synthetic_pages(spark, PAGES)
    found = F.pandas_udf(lambda h, s: h.combine(s, lambda a, b: html.extract_texts(a, {"t": b})["t"]), "array<string>")
    r = p.select("titles", found("html", "target_selector").alias("found"))
    return r.agg(
        F.count("*").alias("pages"), F.count_if(F.col("found") == F.col("titles")).alias("right_titles"),
        F.coalesce(F.sum(F.size(F.array_except("found", "titles"))), F.lit(0)).cast("long").alias("foreign_titles"),
    )


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Listing pages made from the papers: one for each conference and year, in the layout of a conference's site."""
    p = table(spark, root, "source_papers").filter("conference_name is not null and conference_year is not null and url is not null")
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit('<article class="node-paper"><h2><a href="'), "url", F.lit('">'), safe(F.col("title")), F.lit('</a></h2><p class="abstract"><b>'), safe(F.col("abstract")), F.lit("</p></article>"))
    key = F.pmod(F.xxhash64("conference_name", "conference_year"), F.lit(1 << 40))
    body = F.array_join(F.array_sort(F.collect_list(item)), "\n")
    return p.groupBy(key.alias("page_id")).agg(F.concat(F.lit("<html><body><nav><ul><li><a href='/'>x</a></ul></nav>"), body, F.lit("</body></html>")).alias("html")).select("page_id", F.lit("https://listing.example/list").alias("url"), "html")


LISTING_SELECTORS = {"title": "h2", "abstract": "p.abstract", "link": "h2 a"}


@query(
    r"select trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) title, trim(regexp_replace(coalesce(abstract, ''), '\s+', ' ', 'g')) abstract, case when trim(url) = '' then 'https://listing.example/list' else url end url from source_papers "
    r"where conference_name is not null and conference_year is not null and url is not null and (trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) <> '' or trim(regexp_replace(coalesce(abstract, ''), '\s+', ' ', 'g')) <> '')"
)
def h1_h5_listing_rows(spark: SparkSession, root: str) -> DataFrame:
    return html.listing_rows(_listing(spark, root), LISTING_SELECTORS).select("title", "abstract", "url")


@query("select * from (values (0, 't1', 'a b'), (1, 't2', 'c d')) t(pos, title, abstract)")
def h2_j12_positional(spark: SparkSession, root: str) -> DataFrame:
    page = "<div><h3>t1<h3>t2</h3></h3><p>a</p><p>b</p><p>c</p><p>d<p>e</div>"
    p = lines(spark, [(1, "https://x.example", page.replace("<h3>t1<h3>t2</h3></h3>", "<h3>t1</h3><h3>t2</h3>"))], "page_id long, url string, html string")
    return html.listing_rows(p, {"title": "h3", "abstract": "p"}).select("pos", "title", "abstract")


@query("select 1::bigint page_id, 'https://x.example/p/a.pdf' pdf_url, 'An abstract' abstract")
def h4_detail(spark: SparkSession, root: str) -> DataFrame:
    page = '<div id=m><a href="a.txt">t</a><a class="dl pdf" href="a.pdf">PDF</a><div class=abs>An\n abstract</div></div>'
    p = lines(spark, [(1, "https://x.example/p/1", page)], "page_id long, url string, html string")
    return html.detail_rows(p, {"pdf_link": "a[href$='.pdf']", "abstract": "#m > .abs"})


@query()
def h6_h7_a11_verified(spark: SparkSession, root: str) -> DataFrame:
    """Listing pages verified with an item selector found from the titles' ancestors, and their scores."""
    v = html.verified(_listing(spark, root), '{"title": "h2", "abstract": "p.abstract", "link": "h2 a"}')
    n = F.greatest(F.col("n_items"), F.lit(1))
    rate = lambda c: F.col(c) / n
    dup = F.when(F.col("title_hits") > 0, 1 - F.col("distinct_titles") / F.greatest("title_hits", F.lit(1))).otherwise(0.0)
    mean = F.coalesce(F.try_divide("title_chars", "title_hits"), F.lit(0.0))
    points = scores.total_score(scores.item_score(F.col("n_items")), scores.field_score(rate("title_hits"), rate("pdf_hits"), rate("abstract_hits")), scores.quality_score(dup, 1 - rate("title_hits"), mean))
    return v.select("page_id", "item_selector", "n_items", F.round(points, 6).alias("score"), ((F.col("n_items") >= 5) & (rate("title_hits") >= 0.6)).alias("ok"))


@query()
def l9_selector_traces(spark: SparkSession, root: str) -> DataFrame:
    """A selector run over every listing page, as the steps of its trace: read the page, propose an item selector, verify it."""
    pages = _listing(spark, root)
    v = html.verified(pages, '{"title": "h2", "abstract": "p.abstract", "link": "h2 a"}').join(pages.select("page_id", F.length("html").alias("size")), "page_id")
    ok = (F.col("n_items") >= 5) & (F.col("title_hits") >= 0.6 * F.col("n_items"))
    step = lambda n, name, args, out: F.struct(F.lit(n).alias("step_idx"), F.lit(name).alias("tool_name"), args.cast("string").alias("tool_args"), out.cast("string").alias("tool_output"))
    steps = F.array(step(1, "read_page", F.col("page_id"), F.col("size")), step(2, "propose_items", F.lit("h2"), F.col("item_selector")), step(3, "verify", F.col("item_selector"), ok))
    return v.select("page_id", F.inline(steps))


# --- Streams ----------------------------------------------------------------

WINDOWS = "select time_bucket(interval '1 hour', ts) start, event_type, count(*) events, round(sum(value), 4) total from events group by all"


@query(WINDOWS)
def x_windowed_counts(spark: SparkSession, root: str) -> DataFrame:
    return flows.windowed_counts(table(spark, root, "events")).withColumn("total", F.round("total", 4))


@query(WINDOWS)
def x_windowed_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same counts by a stream over the events as they are stored."""
    source = table(spark, root, "events")
    at = scratch(spark)
    source.write.parquet(f"{at}/events")
    events = spark.readStream.schema(source.schema).parquet(f"{at}/events")
    counts = flows.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), late="100 days").withColumn("start", F.col("start").cast("timestamp_ntz"))
    # Every batch replaces the counts in a table on shared storage.
    keep = lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/counts")
    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{at}/counts").withColumn("total", F.round("total", 4))


@query(
    "with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end n from events), "
    "g as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) g from s) select user_id, min(ts) start, max(ts) + interval '30 minutes' \"end\", count(*) events from g group by user_id, g"
)
def x_sessions(spark: SparkSession, root: str) -> DataFrame:
    return flows.session_counts(table(spark, root, "events"))


@query("select distinct doc_id from (select distinct unnest(expected_doc_ids) doc_id from qa_pairs) where doc_id in (select doc_id from source_papers where trim(pdf_url) <> '') and doc_id not in (select doc_id from chunk_results where doc_id is not null)")
def x_lazy_load_stream(spark: SparkSession, root: str) -> DataFrame:
    """Documents asked for on a stream that are loaded by it: those with an address that aren't there."""
    from folioflow.plans.corpus import kept

    at = scratch(spark)
    table(spark, root, "qa_pairs").select(F.explode("expected_doc_ids").alias("doc_id")).write.parquet(f"{at}/asked")
    asked = spark.readStream.schema("doc_id string").parquet(f"{at}/asked")
    parse = lambda ids: ids.withColumn("chunk_text", F.lit("loaded"))
    q = flows.lazy_load(asked, lambda: kept(spark, root), parse, lambda rows: rows.write.mode("append").parquet(f"{at}/loaded"), f"{at}/state")
    q.awaitTermination()
    return spark.read.schema("doc_id string, chunk_text string").parquet(f"{at}/loaded").select("doc_id").distinct()
