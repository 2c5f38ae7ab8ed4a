"""Queries of fetched and parsed documents, plain values, prompts and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import jsonx, values
from folioflow.functions import text as T
from folioflow.operators import models
from folioflow.plans.registry import query, scratch
from folioflow.runtime import table
from folioflow.sources import documents as D


@query(
    "with p as (select doc_id::varchar doc_id, string_split(replace(text, chr(10) || chr(10), chr(12)), chr(12)) l from documents) "
    "select doc_id, (n - 1)::int page, l[n] as text from p, lateral (select unnest(range(1, len(l) + 1)) n)"
)
def s16_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of every document, parsed from its bytes; blank lines part the pages."""
    text = F.replace("text", F.lit("\n\n"), F.lit("\f"))
    files = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.encode(text, "UTF-8").alias("content"))
    return D.pages(D.parse(files, D.form_feed_parser))


@query(
    "with u as (select distinct trim(pdf_url) url from source_papers where trim(pdf_url) <> ''), k as (select url, md5(url) h from u) "
    "select url, substr(h, 1, 16) || '.pdf' cache_key, case when h >= '4' then url end body, case when h >= '4' then 1 else 3 end attempts from k where h < 'c'"
)
def s11_s14_fetch(spark: SparkSession, root: str) -> DataFrame:
    """Addresses of papers fetched with retries from a transport that fails for some, without those in the cache."""
    import hashlib

    def transport(url: str) -> bytes:
        if hashlib.md5(url.encode()).hexdigest() < "4":
            raise ConnectionError("no answer")
        return url.encode()

    papers = table(spark, root, "source_papers")
    cached = papers.select(T.cache_key(F.trim("pdf_url")).alias("cache_key")).filter("cache_key >= 'c'").distinct()
    got = D.fetch(papers, transport, delay=0.0, url_col="pdf_url", cached=cached)
    return got.select("url", "cache_key", F.decode("content", "UTF-8").alias("body"), "attempts")


@query(
    "select id, coalesce(reference_answer, '') answer, case when expected_doc_ids is null then '' when len(expected_doc_ids) = 0 then '[]' "
    "else '[' || chr(10) || '  \"' || array_to_string(expected_doc_ids, '\",' || chr(10) || '  \"') || '\"' || chr(10) || ']' end listed from qa_pairs"
)
def f20_pretty_answers(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "qa_pairs")
    return q.select("id", values.pretty_answer(F.col("reference_answer")).alias("answer"), values.pretty_answer(F.to_json("expected_doc_ids")).alias("listed"))


@query("select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '... (' || (length(text) - 200) || ' more)' else text end kept from documents")
def f35_bounded_values(spark: SparkSession, root: str) -> DataFrame:
    """Texts as bounded JSON, read back."""
    held = values.bounded_json(F.to_json(F.struct(F.col("text").alias("v"))), chars=200)
    return table(spark, root, "documents").select("doc_id", F.from_json(held, "v string")["v"].alias("kept"))


@query(
    "select doc_id, substr(sha256(doc_id || chr(10) || coalesce(title, '')), 1, 8) run, 'call_' || substr(sha256(doc_id::varchar), 1, 24) call, "
    "strftime(added_at::timestamp, '%Y-%m-%dT%H:%M:%S.%gZ') moment, ((epoch_us(added_at::timestamp) - epoch_us(timestamp '2020-01-01')) / 1000.0)::double waited from documents"
)
def f42_f43_times_and_ids(spark: SparkSession, root: str) -> DataFrame:
    d, begin = table(spark, root, "documents"), F.lit("2020-01-01 00:00:00").cast("timestamp")
    return d.select(
        "doc_id", values.run_id(F.col("doc_id"), F.col("title")).alias("run"), values.call_id(F.col("doc_id")).alias("call"), values.iso_time(F.col("added_at")).alias("moment"), values.elapsed_ms(begin, F.col("added_at")).alias("waited")
    )


PROMPTS = {"question": '{% include "role" %}\nQuestion ({{ level | default("open") }}): {{ question }}{{ nothing }}', "role": "You answer from {{ source | default('the papers') }}."}


@query("select id, 'You answer from ' || coalesce(answer_source, 'the papers') || '.' || chr(10) || 'Question (' || coalesce(difficulty, 'open') || '): ' || coalesce(question, '') prompt from qa_pairs")
def f22_templates(spark: SparkSession, root: str) -> DataFrame:
    known = {"level": F.col("difficulty"), "question": F.col("question"), "source": F.col("answer_source")}
    return table(spark, root, "qa_pairs").select("id", models.template("question", PROMPTS, known).alias("prompt"))


@query("select id, length(question) || ' characters' said, question kept from qa_pairs")
def l8_e8_l3_models(spark: SparkSession, root: str) -> DataFrame:
    """A model by its usage; one that fails leaves the question, as a hypothetical answer does without a model."""

    def broken(prompts: list[str]) -> list[str]:
        raise TimeoutError("no model")

    known = models.Models(lambda prompts: [f"{len(p)} characters" for p in prompts])
    switched = known.with_settings(hypothetical=broken)
    asked = F.col("question")
    return table(spark, root, "qa_pairs").select("id", models.generate(asked, switched.get("count")).alias("said"), models.generate(asked, switched.get("hypothetical")).alias("kept"))


@query("select id, question from qa_pairs where question is not null")
def x6_object_rows(spark: SparkSession, root: str) -> DataFrame:
    """Questions from objects that stand in running text, by a table function in SQL."""
    name = jsonx.register_objects(spark)
    view = f"said_{scratch(spark).rsplit('-', 1)[1]}"
    said = F.concat(F.lit("Sure, here: "), F.to_json(F.struct("question")), F.lit(" and so on"))
    table(spark, root, "qa_pairs").filter("question is not null").select("id", said.alias("said")).createOrReplaceTempView(view)
    return spark.sql(f"select id, get_json_object(object, '$.question') question from {view}, lateral {name}(said)")
