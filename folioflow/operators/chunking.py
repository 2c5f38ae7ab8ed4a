"""Structure of documents: outlines, sections, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import model
from folioflow.functions import text as T
from folioflow.runtime import cut

CHUNK_SIZE, OVERLAP, LEAST = 800, 100, 100


def overlap_tail(parts: Column, target: int = OVERLAP) -> Column:
    """Last sentences of a chunk until their lengths, each with a space, reach ``target``; at least one."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    step = lambda acc, s: F.when(
        (acc["n"] >= target) & (F.size(acc["kept"]) > 0), acc
    ).otherwise(F.struct(F.concat(F.array(s), acc["kept"]).alias("kept"), (acc["n"] + F.length(s) + 1).alias("n")))
    return F.aggregate(F.reverse(parts), start, step)["kept"]


def _merged(parts: list[str], size: int, overlap: int, least: int) -> list[str]:
    done: list[str] = []
    cur: list[str] = []
    n = 0
    for s in parts:
        if cur and n + len(s) > size:
            done.append(" ".join(cur))
            first, tail = len(cur), 0
            while first and (tail < overlap or first == len(cur)):
                first -= 1
                tail += len(cur[first]) + 1
            cur, n = cur[first:], tail - 1
        cur.append(s)
        n += len(s) + 1
    if cur:
        last = " ".join(cur)
        if done and len(last) < least:
            done[-1] += f" {last}"
        else:
            done.append(last)
    return done


def merge_sentences(parts: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Chunks of at most ``size`` characters (but for longer sentences), each starting with the tail of the one before.

    A last chunk below ``least`` characters is appended to the one before. Runs on
    Arrow batches in time linear in the text: a fold of arrays in the JVM copies what
    is done at every sentence.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda p: None if p is None else _merged(list(p), size, overlap, least))

    return F.pandas_udf(run, "array<string>")(parts)


def numbered(df: DataFrame, key: str, order: tuple[str, ...], name: str, block: int = 1024) -> DataFrame:
    """Adds ``name``: the place of a row, from 0, within its key in the order given, whose first column is a number.

    A key may hold any share of the rows: places are counted within blocks of the
    first column's values, to which the sizes of the earlier blocks are added. ``df`` is
    evaluated twice. Nulls in the first column come first; rows with a null key are one group.
    """
    rows = df.withColumn("_block", F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(1 << 60))))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_key", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)))
    both = local.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    return both.withColumn(name, (F.col("_before") + F.col("_place") - 1).cast("int")).drop("_block", "_key", "_b", "_before", "_place")


def sentence_merge(base: DataFrame, text_col: str = "chunk_text", order: tuple[str, ...] = ("doc_id", "chunk_index"), size: int = CHUNK_SIZE) -> DataFrame:
    """Base chunks cut to ``size`` at sentences; every other column is copied, ``sub`` numbers the parts, ``chunk_index`` is renewed by document.

    A text within the size is kept as it is; null or empty texts give no chunk.
    """
    whole = F.col(text_col)
    parts = F.when(F.length(whole) <= size, F.array(whole)).otherwise(merge_sentences(T.sentences(whole, size), size))
    rest = [c for c in base.columns if c not in (text_col, "sub")]
    split = base.select(*rest, F.posexplode(parts).alias("sub", text_col)).filter(F.length(text_col) > 0)
    again = numbered(cut(split), order[0], (*order[1:], "sub"), "_index").drop("chunk_index")
    return again.withColumnRenamed("_index", "chunk_index").select(*[c for c in split.columns if c != "chunk_index"], "chunk_index")


def paragraphs(text: Column, mark: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, mark), T.strip), lambda p: p != "")


def fixed_pieces(text: Column, size: int = 500) -> Column:
    """Slices of ``size`` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def stop_pieces(text: Column) -> Column:
    """Parts of paragraphs between stops, without the stops."""
    return F.filter(F.transform(F.flatten(F.transform(paragraphs(text), lambda p: F.split(p, r"\."))), T.strip), lambda p: p != "")


STRATEGIES = {"paragraph": paragraphs, "fixed_size": fixed_pieces, "sentence": stop_pieces}


def chunk_text(docs: DataFrame, strategy: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, chunk_text) by a named strategy; ValueError for an unknown one."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(STRATEGIES[strategy](F.col(text_col))).alias("chunk_index", "chunk_text"))


def with_prefix(chunks: DataFrame, prefix: Column | None = None) -> DataFrame:
    """Contextual chunks: a prefix (a column of any origin, such as a model's answers; null or none as empty) and the text to embed."""
    made = F.coalesce(prefix if prefix is not None else F.lit(None).cast("string"), F.lit(""))
    joined = F.when(made != "", F.concat(made, F.lit("\n\n"), F.col("chunk_text"))).otherwise(F.col("chunk_text"))
    return chunks.withColumn("contextual_prefix", made).withColumn("text_for_embedding", joined)


def embed_text(row: dict[str, Column], paper_title: Column) -> Column:
    """What a chunk is embedded as: an explicit text, else prefix and text, else title, section and content."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(~blank(row["text_for_embedding"]), row["text_for_embedding"])
        .when(~blank(row["contextual_prefix"]), F.concat(row["contextual_prefix"], F.lit("\n\n"), row["chunk_text"]))
        .when(~blank(row["section_title"]), F.concat(F.lit("Title: "), paper_title, F.lit("\nSection: "), row["section_title"], F.lit("\nContent: "), row["chunk_text"]))
        .otherwise(F.concat(F.lit("Title: "), paper_title, F.lit("\nContent: "), row["chunk_text"]))
    )


def page_fallback(pages: DataFrame) -> DataFrame:
    """Chunks of documents without an outline: a page each (page from 0), pages under 50 characters left out."""
    flat = T.clean_text(F.col("text"))
    kept = pages.select("doc_id", "page", flat.alias("chunk_text")).filter(F.length("chunk_text") >= 50)
    category = F.when(F.col("page") == 0, model.ABSTRACT).when(F.col("page") <= 2, model.INTRODUCTION).otherwise(model.OTHER)
    return numbered(cut(kept), "doc_id", ("page",), "chunk_index").select(
        "doc_id",
        "chunk_index",
        "chunk_text",
        F.concat(F.lit("Page "), (F.col("page") + 1).cast("string")).alias("section_title"),
        category.alias("section_category"),
        F.lit("").alias("parent_section"),
        (F.col("page") + 1).alias("page_number"),
    )


def outline_parents(outline: DataFrame) -> DataFrame:
    """Adds ``parent`` (ord of the nearest earlier node of a lower level, null for a root) to (doc_id, ord, level, title, page).

    Within a document, for each level the last node seen so far is a window; the
    parent is the latest of those of lower levels. Levels beyond 9 count as 9.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    level = F.least(F.col("level"), F.lit(9))
    last = [F.max(F.when(level == k, F.col("ord"))).over(w) for k in range(1, 9)]
    marked = outline.withColumn("_last", F.array(*last)).withColumn("_level", level)
    lower = F.slice("_last", F.lit(1), F.greatest(F.col("_level") - 1, F.lit(0)))
    return marked.withColumn("parent", F.array_max(F.filter(lower, lambda x: x.isNotNull()))).drop("_last", "_level")


def with_abstract(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Puts a node Abstract first in outlines that have none, on the first of the first pages that shows its header."""
    first = outline.groupBy("doc_id").agg(F.min(F.when(F.col("page") > 0, F.col("page"))).alias("f"), F.max(F.lower("title").rlike("abstract").cast("int")).alias("has"))
    shown = (
        first.filter("has = 0")
        .join(pages.filter(T.has_abstract_header(F.concat(F.lit("\n"), F.col("text"), F.lit("\n")))), "doc_id")
        .filter(F.col("page") <= F.least(F.coalesce("f", F.lit(1)), F.lit(3)))
        .groupBy("doc_id")
        .agg(F.min("page").alias("page"))
    )
    node = shown.select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("level"), F.lit("Abstract").alias("title"), F.col("page").cast("int").alias("page"))
    return outline.select("doc_id", "ord", "level", "title", "page").unionByName(node)


def section_bodies(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, ord, title, page, body): the text of each outline node, up to the title of the next.

    ``outline`` (doc_id, ord, level, title, page) and ``pages`` (doc_id, page, text)
    count pages from 1; a page below 1 is taken as the first. On its first page the
    body starts after the node's own title, if it is found; on its last it ends
    before the next title.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    nodes = outline.select(
        "doc_id", "ord", "title", F.greatest(F.col("page"), F.lit(1)).alias("page"),
        F.lead(F.greatest(F.col("page"), F.lit(1))).over(w).alias("next_page"), F.lead("title").over(w).alias("next_title"),
    )
    on = (
        nodes.join(pages.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("text").alias("t")), (F.col("doc_id") == F.col("d")) & (F.col("p") >= F.col("page")))
        .filter(F.col("next_page").isNull() | (F.col("p") <= F.greatest("next_page", "page")))
        .drop("d")
    )
    own = T.title_position(F.col("t"), F.col("title"))
    begun = F.when((F.col("p") == F.col("page")) & (own >= 0), F.regexp_replace(F.substr("t", own + 1), F.concat(F.lit(r"(?i)^\s*[\d.]*\s*"), T.quoted_title(F.col("title"))), F.lit("")))
    started = on.withColumn("s", F.coalesce(begun, F.col("t")))
    end = T.title_position(F.col("s"), F.col("next_title"))
    ended = started.withColumn("e", F.when((F.col("p") == F.col("next_page")) & F.col("next_title").isNotNull() & (end >= 0), F.left("s", end)).otherwise(F.col("s")))
    texts = ended.groupBy("doc_id", "ord", "title", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "e"))), lambda x: x["e"]), "\n").alias("raw")
    )
    return texts.select("doc_id", "ord", "title", "page", T.clean_text(F.col("raw")).alias("body"))


def flatten_outline(outline: DataFrame, bodies: DataFrame, papers: DataFrame, deepest: int = 8) -> DataFrame:
    """Base chunks in outline order, one for each node with a body; categories pass down from parents that aren't OTHER.

    ``outline`` has parents (:func:`outline_parents`), ``bodies`` (doc_id, ord, body),
    ``papers`` (doc_id, paper_title). ``deepest`` bounds the levels of inheritance.
    """
    named = outline.join(papers, "doc_id", "left")
    own = named.select("doc_id", "ord", "title", "page", "parent", T.classify_section(F.col("title"), F.coalesce("paper_title", F.lit(""))).alias("category"))
    for _ in range(deepest - 1):
        above = own.select(F.col("doc_id"), F.col("ord").alias("parent"), F.col("category").alias("up"))
        own = own.join(above, ["doc_id", "parent"], "left").select(
            "doc_id", "ord", "title", "page", "parent",
            F.when(F.col("up").isNotNull() & (F.col("up") != model.OTHER), F.col("up")).otherwise(F.col("category")).alias("category"),
        )
    titles = outline.select("doc_id", F.col("ord").alias("parent"), F.col("title").alias("parent_section"))
    rows = own.join(titles, ["doc_id", "parent"], "left").join(bodies.select("doc_id", "ord", "body"), ["doc_id", "ord"]).filter("trim(body) <> ''")
    return rows.select(
        "doc_id",
        (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).alias("chunk_index"),
        F.col("body").alias("chunk_text"),
        F.col("title").alias("section_title"),
        F.coalesce("parent_section", F.lit("")).alias("parent_section"),
        F.col("category").alias("section_category"),
        F.col("page").alias("page_number"),
    )
