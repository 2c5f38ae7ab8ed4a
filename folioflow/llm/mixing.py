"""Mixing sources to target weights, by Poisson replication.

Each record draws a uniform number from a hash of its id and a seed, and takes
the value at which the inverted Poisson distribution, cut off at the source's
cap, passes it. The rate of a source is the one whose capped mean is the wanted
repetition rate, target size / own size. For fixed hashes the counts only grow
with the rate, so one more pass over the sizes evaluates a grid of rates beside
that value and keeps the one whose realised size is nearest to the target.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.runtime import cut

#: Rates tried beside the nominal one, as multiples of it.
GRID = tuple(float(x) for x in np.geomspace(0.7, 1.4, 21))


def byte_size(text: Column) -> Column:
    """Tokens under a byte-level tokenizer with an end token: UTF-8 bytes plus one; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def capped_cdf(rate: float, cap: int) -> list[float]:
    """P(N < j) for j = 1..cap under a Poisson distribution: the count is the number of values that u reaches."""
    if math.isinf(rate):
        return [0.0] * cap
    p, total, out = math.exp(-rate), 0.0, []
    for j in range(cap):
        total += p
        out.append(total)
        p *= rate / (j + 1)
    return out


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose mean, cut off at ``cap``, is ``mean``; infinite from ``cap`` on."""
    if mean <= 0 or cap <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    low, high = 0.0, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(1 - c for c in capped_cdf(mid, cap)) < mean else (low, mid)
    return (low + high) / 2


def plan_shares(docs: DataFrame, plan: DataFrame, fraction: float = 0.8, text_col: str = "text") -> DataFrame:
    """(source, target_share, max_repeats, own_size, target_size): what the plan asks of each source.

    The mix is to have ``fraction`` of the summed size of all documents; a planned
    source without documents has size 0. Documents with a null source
    count for the total only. A source planned twice, with a null share or a null
    cap keeps its first row by (share, cap), nulls as 0.
    """
    sizes = docs.select(F.col("source").alias("source"), byte_size(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("own"))
    total = sizes.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("total"))
    wanted = (
        plan.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r"))).alias("w"))
        .select("source", F.col("w.s").alias("target_share"), F.col("w.r").cast("int").alias("max_repeats"))
    )
    return (
        wanted.join(sizes, "source", "left")
        .join(F.broadcast(total), F.lit(True))
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("own", F.lit(0)).cast("long").alias("own_size"),
            (F.col("target_share") * fraction * F.col("total")).alias("target_size"),
        )
    )


def _uniform(id_col: str, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def _count(u: Column, steps: Column) -> Column:
    return F.size(F.filter(steps, lambda c: u >= c))


def poisson_mix(
    docs: DataFrame, plan: DataFrame, fraction: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", shuffle_parts: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    mix: every column of ``docs`` plus (size, copy, position), one row for each copy
    of a record; ``copy`` counts from 1, never beyond max_repeats; rows come in the
    global random order of ``position``, a hash of id, copy and seed. A column of
    these names in ``docs`` is replaced.
    report: the columns of :func:`plan_shares` plus (reachable, rate, mixed_size,
    mixed_records, actual_share, most_copies). A source is not reachable if no finite
    rate has the wanted mean and what is drawn without one, every record to its cap,
    stays below the target.

    Records of unplanned or null sources and with a null id are left out; unreachable
    sources are used max_repeats times throughout and fall short, as reported. Rows
    repeated under one id get equal counts. The plan (a row for each source) is
    collected: it is refused beyond 100,000 rows.
    """
    wanted = plan_shares(docs, plan, fraction, text_col).limit(100_001).collect()
    if len(wanted) > 100_000:
        raise ValueError("a mix plan may have at most 100,000 sources")
    spark = docs.sparkSession
    grid = []
    for w in wanted:
        mean = w.target_size / w.own_size if w.own_size else math.inf if w.target_size > 0 else 0.0
        cap = max(0, w.max_repeats)
        nominal = math.inf if mean > 0 and not cap else rate_for(mean, cap)
        grid.append((w.source, float(nominal), [capped_cdf(nominal * g if nominal else 0.0, cap) for g in GRID]))
    steps = spark.createDataFrame(grid, "_src string, _rate double, _steps array<array<double>>")
    # The record is packed, so that its columns can't clash with those of the plan.
    own = [c for c in docs.columns if c not in ("size", "copy", "position")]
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(id_col).alias("_id"), F.col("source").alias("_source"), byte_size(F.col(text_col)).alias("size")
    ).filter(F.col("_id").isNotNull())
    # Calibration: one narrow pass (id, source, size), a sum for each rate.
    narrow = sized.select("_id", "_source", "size").join(F.broadcast(steps), F.col("_source") == F.col("_src"))
    u = _uniform("_id", seed)
    sums = narrow.groupBy(F.col("_source").alias("source")).agg(*[F.sum(F.col("size") * _count(u, F.col("_steps")[g])).alias(f"g{g}") for g in range(len(GRID))]).collect()
    realised = {r.source: [r[f"g{g}"] for g in range(len(GRID))] for r in sums}
    final = []
    for w, (source, nominal, cdfs) in zip(wanted, grid):
        got = realised.get(source, [0] * len(GRID))
        g = min(range(len(GRID)), key=lambda i: (abs(got[i] - w.target_size), abs(GRID[i] - 1)))
        reachable = not (math.isinf(nominal) and got[g] < w.target_size)
        final.append((source, nominal * GRID[g] if nominal else 0.0, cdfs[g], w.target_share, w.max_repeats, w.own_size, w.target_size, reachable))
    chosen = spark.createDataFrame(
        final, "_src string, rate double, _steps array<double>, target_share double, max_repeats int, own_size long, target_size double, reachable boolean"
    )
    counted = sized.join(F.broadcast(chosen.select("_src", "_steps")), F.col("_source") == F.col("_src")).withColumn("_n", _count(u, F.col("_steps")))
    copies = counted.filter("_n > 0").select("_row", "_id", "size", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    placed = copies.withColumn("position", F.xxhash64("_id", "copy", F.lit(seed + 1)))
    parts = [shuffle_parts] if shuffle_parts else []
    mix = placed.repartitionByRange(*parts, "position").sortWithinPartitions("position").select("_row.*", "size", "copy", "position")
    tally = (
        counted.select(F.col("_source").alias("source"), "size", "_n")
        .groupBy("source")
        .agg(F.sum(F.col("size") * F.col("_n")).alias("mixed_size"), F.sum("_n").alias("mixed_records"), F.max("_n").alias("most_copies"))
    )
    tally = cut(tally)
    whole = tally.agg(F.sum("mixed_size").alias("whole"))
    report = (
        chosen.drop("_steps")
        .withColumnRenamed("_src", "source")
        .join(tally, "source", "left")
        .join(F.broadcast(whole), F.lit(True))
        .select(
            "source", "target_share", "max_repeats", "own_size", "target_size", "reachable", "rate",
            F.coalesce("mixed_size", F.lit(0)).alias("mixed_size"),
            F.coalesce("mixed_records", F.lit(0)).alias("mixed_records"),
            F.coalesce(F.col("mixed_size") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("most_copies", F.lit(0)).cast("int").alias("most_copies"),
        )
    )
    return mix, report
