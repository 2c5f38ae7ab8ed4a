"""The corpus store: lookups, filters, context and upkeep over the unified collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import model
from folioflow.functions import text as T
from folioflow.runtime import broadcast_within

PAPER_FIELDS = ("doc_id", "title", "text", "url", "pdf_url", "conference_name", "conference_year", "conference_round")


def all_of(*conditions: Column | None) -> Column:
    """All given conditions; none restricts nothing."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def scope(doc_id: str | None = None, category: int | None = None) -> Column:
    """Optional document and section; a category below 0 means all."""
    return all_of(
        F.col("doc_id") == doc_id if doc_id else None,
        F.col("section_category") == category if category is not None and category >= 0 else None,
    )


def is_paper() -> Column:
    return F.col("chunk_id") == -1


def abstract_scope() -> Column:
    return (F.col("section_category") == model.ABSTRACT) | is_paper()


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


class CorpusStore:
    """Read access to a collection; every method is a DataFrame of the rows asked for."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def query(self, condition: Column, fields: tuple[str, ...], order: tuple[str, ...], limit: int | None = None) -> DataFrame:
        """Rows that fit, some columns, in an order that makes a limit repeatable."""
        found = self.rows.filter(condition).select(*fields).orderBy(*order)
        return found.limit(limit) if limit else found

    def papers(self, conference: str, year: int | None = None, round_: str | None = None, limit: int | None = 10) -> DataFrame:
        fits = all_of(
            is_paper(), F.col("conference_name") == conference, F.col("conference_year") == year if year else None, F.col("conference_round") == round_ if round_ else None
        )
        return self.query(fits, PAPER_FIELDS, ("doc_id", "title"), limit)

    def conference_exists(self, conference: str, year: int, round_: str) -> bool:
        return not self.papers(conference, year, round_, 1).isEmpty()

    def rounds(self) -> DataFrame:
        """(conference_name, conference_year, conference_round): what is there, without blank rounds."""
        return self.rows.filter(is_paper() & not_blank(F.col("conference_round"))).select("conference_name", "conference_year", "conference_round").distinct()

    def metadata(self, ids: DataFrame) -> DataFrame:
        """Paper rows of the asked (doc_id)."""
        return self.rows.filter(is_paper()).join(broadcast_within(ids.select("doc_id").distinct(), 100_000), "doc_id", "left_semi").select(*PAPER_FIELDS)

    def loaded(self) -> DataFrame:
        """(doc_id): documents with chunks."""
        return self.rows.filter(F.col("chunk_id") >= 0).select("doc_id").distinct()

    def context(self, hits: DataFrame, window: int = 1) -> DataFrame:
        """(doc_id, chunk_id, context): for each hit (doc_id, chunk_id) the texts of the chunks around it, joined by blank lines.

        A chunk loaded twice counts once, with its smallest text; paper rows never
        count. The join is on document and chunk number, so a long document costs no
        more than its hits.
        """
        around = hits.select("doc_id", "chunk_id").distinct().select(
            "doc_id", "chunk_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_id") - window), F.col("chunk_id") + window)).alias("near")
        )
        one = self.rows.filter((F.col("chunk_id") >= 0) & F.col("text").isNotNull()).groupBy("doc_id", F.col("chunk_id").alias("near")).agg(F.min("text").alias("text"))
        return around.join(one, ["doc_id", "near"]).groupBy("doc_id", "chunk_id").agg(joined_text("near", "text").alias("context"))

    def introductions(self, chunks: int = 10, size: int = 1500) -> DataFrame:
        """(doc_id, introduction): the first chunks of the introduction of every document, cut at ``size`` characters."""
        w = Window.partitionBy("doc_id").orderBy("chunk_id", "text")
        first = self.rows.filter((F.col("section_category") == model.INTRODUCTION) & (F.col("chunk_id") >= 0) & F.col("text").isNotNull())
        first = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= chunks)
        return first.groupBy("doc_id").agg(T.truncate(joined_text("r", "text"), size).alias("introduction"))

    def stats(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("total_records"), F.count_if(is_paper()).alias("total_papers"))


def joined_text(order: str, text: str, mark: str = "\n\n") -> Column:
    """Aggregate: texts in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), mark)


def export_papers(papers: DataFrame, conference: str | None = None, year: int | None = None, sample: int | None = None, seed: int = 42, most: int = 10_000) -> DataFrame:
    """Papers with an address of their PDF; a sample is repeatable for its seed."""
    fits = all_of(F.col("conference_name") == conference if conference else None, F.col("conference_year") == year if year else None, not_blank(F.col("pdf_url")))
    kept = papers.filter(fits)
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"] if sample else ["doc_id"]
    return kept.orderBy(*order, "title").limit(min(sample or most, most))


def paper_rows(papers: DataFrame) -> DataFrame:
    """New paper rows: an id from title and address, the text to embed, fields' defaults."""
    return papers.select(
        F.sha2(F.concat_ws("\n", "title", "url"), 256).alias("doc_id"),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.coalesce("abstract", F.lit(""))).alias("embed_text"),
        F.coalesce("abstract", F.lit("")).alias("text"),
        "title", "url",
        F.coalesce("pdf_url", F.lit("")).alias("pdf_url"),
        "conference_name",
        F.col("conference_year").cast("long").alias("conference_year"),
        F.coalesce("conference_round", F.lit("all")).alias("conference_round"),
        F.lit(-1).cast("long").alias("chunk_id"),
    )


def missing(asked: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows asked for that aren't there yet: papers to load, rounds to collect, experiments to run."""
    return asked.join(there.select(*keys).distinct(), keys, "left_anti")


def enrich(listing: DataFrame, details: DataFrame, key: str = "url") -> DataFrame:
    """Listing rows with the PDF address of their detail page, and its abstract where they have none."""
    d = details.select(F.col(key), F.col("pdf_url").alias("_pdf"), F.col("abstract").alias("_abstract"))
    return listing.join(d, key, "left").select(
        *[c for c in listing.columns if c not in ("abstract", "pdf_url")],
        F.coalesce(F.when(not_blank(F.col("abstract")), F.col("abstract")), F.col("_abstract"), F.lit("")).alias("abstract"),
        F.coalesce("_pdf", F.lit("")).alias("pdf_url"),
    )


def load_plan(asked: DataFrame, store: CorpusStore, parsed: DataFrame) -> DataFrame:
    """(doc_id, status, chunks): what a lazy load does with each asked (doc_id), in one pass.

    ``parsed`` (doc_id, chunks) are documents that could be fetched and parsed, with
    their number of chunks, null where the fetch failed.
    """
    have = store.rows.filter(is_paper()).groupBy("doc_id").agg(F.max(not_blank(F.col("pdf_url"))).alias("has_url"))
    there = store.loaded().withColumn("there", F.lit(True))
    return (
        asked.select("doc_id").distinct()
        .join(there, "doc_id", "left")
        .join(have, "doc_id", "left")
        .join(parsed.select("doc_id", "chunks", F.lit(True).alias("fetched")), "doc_id", "left")
        .select(
            "doc_id",
            F.when(F.col("there"), "already_exists")
            .when(F.col("has_url").isNull(), "not_found")
            .when(~F.col("has_url"), "no_pdf_url")
            .when(F.col("fetched").isNull() | F.col("chunks").isNull(), "download_failed")
            .when(F.col("chunks") <= 0, "parse_failed")
            .otherwise("success").alias("status"),
            F.coalesce(F.when(F.col("there").isNull() & F.col("has_url"), F.col("chunks")), F.lit(0)).cast("long").alias("chunks"),
        )
    )
