"""Adversarial listing pages with a known right selector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRUCTURES = (("ul", "li"), ("ol", "li"), ("div", "div"), ("section", "article"), ("div", "article"))
TITLES = ("h3", "h4", "span", "div")


def synthetic_pages(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(page_id, url, html, target_selector, titles): pages with a main list and traps, all drawn from hashes of the page number.

    Five list structures, three styles of class names; 70 % have a second list whose
    items carry the same class but not its titles', 30 % wrap the list in useless
    blocks, 30 % carry noise before it. ``target_selector`` finds the main titles only.
    """
    draw = lambda k, m: F.pmod(F.xxhash64("page_id", F.lit(seed), F.lit(k)), F.lit(m)).cast("int")
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), draw(k, len(xs)) + 1)
    word = lambda k: F.substring(F.md5(F.concat_ws(":", "page_id", F.lit(k), F.lit(seed))), 1, 6)

    def name(k: str) -> Column:
        return F.when(F.col("style") == 0, F.concat(F.lit("list__"), word(k))).when(F.col("style") == 1, F.concat(F.lit("px-4-"), word(k))).otherwise(F.concat(F.lit("c"), word(k)))

    s = draw("structure", len(STRUCTURES))
    part = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in STRUCTURES]), s + 1)
    base = spark.range(n).select(
        F.col("id").alias("page_id"),
    ).withColumns({"style": draw("style", 3), "wrap": part(0), "item": part(1), "head": pick("head", TITLES), "count": draw("count", 6) + 3})
    named = base.withColumns({"box": name("box"), "cls": name("item"), "ttl": name("title")})
    label = lambda k: F.concat(F.lit("Paper "), F.col("page_id").cast("string"), F.lit("-"), k.cast("string"))
    element = lambda tag, cls, body: F.concat(F.lit("<"), tag, F.lit(' class="'), cls, F.lit('">'), body, F.lit("</"), tag, F.lit(">"))
    body = lambda k: F.concat(element(F.col("head"), F.col("ttl"), label(k)), F.lit("<span>$9.50</span><p>note"))
    many = F.sequence(F.lit(1), F.col("count"))
    items = F.array_join(F.transform(many, lambda k: element(F.col("item"), F.col("cls"), body(k))), "\n")
    main = element(F.col("wrap"), F.col("box"), items)
    wrapped = F.when(draw("hell", 10) < 3, F.concat(F.lit("<div><div>"), main, F.lit("</div></div>"))).otherwise(main)
    trap = F.when(draw("trap", 10) < 7, element(F.col("wrap"), F.lit("related"), element(F.col("item"), F.col("cls"), F.lit("<b>Sponsored</b>")))).otherwise(F.lit(""))
    noise = F.when(draw("noise", 10) < 3, F.lit("<nav><ul><li><a href='/x'>Home</a><li>About</ul></nav>")).otherwise(F.lit(""))
    return named.select(
        "page_id",
        F.concat(F.lit("https://pages.example/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit("<html><body>"), noise, wrapped, trap, F.lit("<footer><p>end</footer></body></html>")).alias("html"),
        F.concat(F.lit("."), F.col("cls"), F.lit(" ."), F.col("ttl")).alias("target_selector"),
        F.transform(many, label).alias("titles"),
    )
