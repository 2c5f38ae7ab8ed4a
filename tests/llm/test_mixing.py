import math

import pytest
from pyspark.sql import functions as F

from folioflow.llm.mixing import capped_cdf, plan_shares, poisson_mix, rate_for


@pytest.mark.parametrize("mean, cap", [(0.3, 1), (0.9, 1), (1.5, 2), (2.9, 3), (0.0, 4)])
def test_rate_gives_the_mean(mean, cap):
    assert abs(sum(1 - c for c in capped_cdf(rate_for(mean, cap), cap)) - mean) < 1e-6


def test_rate_beyond_the_cap():
    assert math.isinf(rate_for(2.0, 2)) and capped_cdf(math.inf, 2) == [0.0, 0.0] and rate_for(1.0, 0) == 0.0


def frames(spark):
    rows = [(k, "x" * (50 + k % 40), ("a", "b", "c", None)[k % 4]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = spark.createDataFrame([("a", 0.5, 3), ("b", 0.1, 1), ("none", 0.2, 4), ("c", 0.2, 1)], "source string, target_share double, max_repeats int")
    return docs, plan


def test_shares_are_reached(spark):
    docs, plan = frames(spark)
    clash = docs.selectExpr("*", "1 as _src", "2 as size", "3 as _n", "4 as rate", "5 as copy")
    mix, report = poisson_mix(clash, plan)
    r = {x.source: x for x in report.collect()}
    for s in "abc":
        assert abs(r[s].mixed_size - r[s].target_size) < 0.03 * r[s].target_size
        assert r[s].most_copies <= r[s].max_repeats and r[s].reachable
    assert not r["none"].reachable and r["none"].mixed_size == 0
    n = mix.groupBy("source").agg(F.sum("size").alias("s"), F.max("copy").alias("c")).collect()
    assert {x.source: x.s for x in n} == {s: r[s].mixed_size for s in "abc"}
    assert [c for c in mix.columns if c in ("size", "copy", "position")] == ["size", "copy", "position"]


def test_same_seed_same_mix(spark):
    docs, plan = frames(spark)
    key = lambda d, seed: sorted((r.doc_id, r.copy) for r in poisson_mix(d, plan, seed=seed)[0].select("doc_id", "copy").collect())
    assert key(docs, 1) == key(docs.repartition(7), 1) != key(docs, 2)


def test_bad_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "t", "a"), (2, "", None)], "doc_id long, text string, source string")
    plan = spark.createDataFrame([("a", None, None), (None, 0.5, 2), ("a", 0.4, 1)], "source string, target_share double, max_repeats int")
    (row,) = plan_shares(docs, plan).collect()
    assert (row.source, row.target_share, row.own_size) == ("a", 0.0, 3)
    assert poisson_mix(docs, plan)[0].count() == 0
    empty = docs.limit(0)
    assert poisson_mix(empty, plan)[0].count() == 0 and poisson_mix(docs, plan.limit(0))[1].count() == 0
