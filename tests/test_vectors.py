import numpy as np

from folioflow.operators import vectors


def test_blocks_of_queries_do_not_change_the_result(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(60, 4))
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, vectors array<float>")
    queries = rows.filter("id % 2 = 0").selectExpr("id query_id", "vectors query")
    found = lambda: sorted(map(tuple, vectors.search_each(rows, queries, 3, ("id",)).collect()))
    whole = found()
    monkeypatch.setattr(vectors, "QUERY_LIMIT", 7)
    assert found() == whole and len(whole) == 90


def _small(spark, n=90, dim=8):
    x = np.random.default_rng(5).normal(size=(n, dim)).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(n, None), (n + 1, [1.0, 2.0])], "id long, vectors array<float>")
    return x, rows, rows.filter("id % 2 = 0 or id > 88").selectExpr("id query_id", "vectors query")


def _ranked(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def _joins(df):
    return "Join" in df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_that_are_probed_are_searched_whole(spark, monkeypatch):
    x, rows, queries = _small(spark)
    indexed, fitted = vectors.build_ivf(rows.filter("id < 90"), 6)
    cell = {r.id: r.cell for r in indexed.collect()}
    centres = np.stack(fitted.clusterCenters())
    want = {}
    for q in (k for k in range(90) if k % 2 == 0 or k == 89):
        probed = set(np.argsort(np.square(x[q] - centres).sum(axis=1), kind="stable")[:2])
        want[q] = sorted((r for r in cell if cell[r] in probed), key=lambda r: (np.square(x[q] - x[r]).sum(), r))[:4]
    monkeypatch.setattr(vectors, "QUERY_LIMIT", 20)
    found = vectors.search_ivf(indexed, fitted, queries, 4, 2, ("id",))
    assert _ranked(found) == want and not _joins(found)


def test_buckets_that_are_probed_are_searched_whole(spark, monkeypatch):
    x, rows, queries = _small(spark)
    keys = {r.id: r.k for r in rows.select("id", vectors.sign_keys(vectors.F.col("vectors"), 2, 5).alias("k")).collect() if r.id < 90}
    want = {}
    for q in (k for k in range(90) if k % 2 == 0 or k == 89):
        meets = [r for r in keys if any((a ^ b).bit_count() <= 1 for a, b in zip(keys[q], keys[r]))]
        want[q] = sorted(meets, key=lambda r: (np.square(x[q] - x[r]).sum(), r))[:20]
    want[91] = [91]  # of another length
    monkeypatch.setattr(vectors, "QUERY_LIMIT", 20)
    found = vectors.search_lsh(rows, queries, 20, ("id",), tables=2, bits=5)
    assert _ranked(found) == want and not _joins(found)
    assert min(map(len, want.values())) < 20 < 90


def test_the_comparison_joins_no_pairs(spark, data):
    from folioflow.plans import retrieval

    found = retrieval.e4_e5_comparison(spark, data)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_cell" in plan  # no exploded probes; rows meet queries in the scan
    assert {r.recall for r in found.collect() if r.index_type == "FLAT"} == {1.0}


def test_bounds_hold_from_batch_to_batch(spark):
    x, rows, queries = _small(spark, 400)
    asked = queries.filter("size(query) = 8").toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        found = vectors._scan(rows.coalesce(1), asked, "bigint", 10, ("id",), "vectors").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = found.sort_values(["dist", "id"]).groupby("query_id")["id"].apply(lambda s: list(s[:10]))
    assert all(best[q] == sorted(range(400), key=lambda r: (np.square(x[q] - x[r]).sum(), r))[:10] for q in asked["query_id"])
    assert len(found) < 100 * len(asked)  # 400 each, if a batch of k rows sets no bound


def test_products_choose_all_that_may_be_nearest():
    rng = np.random.default_rng(2)
    for scale, offset in ((1, 0), (1, 1e3), (1e-25, 0), (1e30, 0)):
        v = (rng.normal(size=(900, 8)) * scale + offset).astype(np.float32).astype(float)
        v[::9] = v[0]  # copies
        q, who = v[::30], np.arange(30)
        keys = rng.integers(0, 8, size=(900, 2))
        for buckets in (None, vectors.Buckets(keys, keys[::30], 3)):
            best, kept = np.full((30, 5), np.inf), set()
            for a in (600, 300, 0):
                part = vectors.Buckets(keys[a : a + 300], keys[::30], 3) if buckets else None
                qi, ri, d2 = vectors._closest(q, v[a : a + 300], best[:, -1], 5, {}, part, who, 40)
                best = vectors._merged(best, qi, d2)
                kept |= set(zip(qi.tolist(), (ri + a).tolist()))
            for i in range(30):
                meets = np.flatnonzero(buckets.pairs(np.full(900, i), np.arange(900))) if buckets else np.arange(900)
                d2 = np.square(v[meets] - q[i]).sum(axis=1)
                assert np.array_equal(best[i], np.sort(d2)[:5])
                assert {(i, int(r)) for r in meets[d2 <= best[i, -1]]} <= kept
