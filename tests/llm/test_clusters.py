import numpy as np
import pytest

from folioflow.llm import clusters as C
from folioflow.llm.clusters import STEP, cluster_rows, merge_rounds, tie_to_known, within

DIM = 16


def frame(spark, x):
    return spark.createDataFrame([(k + 1, [float(c) for c in v]) for k, v in enumerate(x)], "id long, embedding array<float>")


def test_found_sets_are_those_of_the_definition(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(DIM)[:3]
    x = np.concatenate([c + 0.18 * rng.normal(size=(n, DIM)) for c, n in zip(centres, (40, 25, 12))] + [rng.normal(size=(8, DIM))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    members, clusters = cluster_rows(frame(spark, x), dim=DIM, k=5)
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster, set()).add(r.id)
    large = [s for s in got.values() if len(s) >= 10]
    assert len(large) == 3
    for s in large:
        mean = x[[i - 1 for i in s]].mean(axis=0)
        cosine = x @ (mean / np.linalg.norm(mean))
        assert s == {k + 1 for k in np.flatnonzero(cosine >= 0.5)}
    sizes = {r["cluster"]: (r["size"], len(r["typical"])) for r in clusters.collect()}
    assert all(sizes[c] == (len(s), 5) for c, s in got.items())


def merged(spark, x, pairs, threshold, counts=None):
    """{cluster: number of rows} of the rounds over unit vectors ``x`` under ``pairs`` of places from 1."""
    x = np.asarray(x, dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = counts or [1] * len(x)
    nodes = spark.createDataFrame([(i + 1, n[i], [int(round(c * STEP)) * n[i] for c in v]) for i, v in enumerate(x)], "id long, n long, s array<long>")
    edges = spark.createDataFrame([(a, b, float(x[a - 1] @ x[b - 1])) for a, b in pairs], "a long, b long, sim double")
    return {r["cluster"]: r["n"] for r in merge_rounds(nodes, edges, x.shape[1], threshold).collect()}


def turned(*degrees):
    return [[np.cos(np.radians(d)), np.sin(np.radians(d))] for d in degrees]


def test_rounds_stop_below_the_threshold(spark):
    # Cosines of neighbours: 0.95, 0.93, 0.17, 0.94; the last stands alone.
    assert merged(spark, turned(0, 18, 40, 120, 140, 260), [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)], 0.5) == {1: 3, 4: 2, 6: 1}


def test_linkage_is_the_mean_over_all_pairs(spark):
    # Neighbours 1-2 and 3-4 are 10 degrees apart. 2 and 3, the only pair of the graph between them, are
    # 50 degrees apart, the mean over all four pairs is cos 50, 60, 60, 70: 0.4962.
    x, pairs = turned(0, 10, 60, 70), [(1, 2), (3, 4), (2, 3)]
    assert merged(spark, x, pairs, 0.497) == {1: 2, 3: 2}
    assert merged(spark, x, pairs, 0.496) == {1: 4}


def test_copies_weigh_in_the_linkage(spark):
    # With 4 held three times the mean is cos 50, 60, 3 x 60, 3 x 70: 0.4587.
    x, pairs = turned(0, 10, 60, 70), [(1, 2), (3, 4), (2, 3)]
    assert merged(spark, x, pairs, 0.46, [1, 1, 1, 3]) == {1: 2, 3: 4}
    assert merged(spark, x, pairs, 0.457, [1, 1, 1, 3]) == {1: 6}


def test_rounds_in_one_task_are_those_of_the_joins(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(6, DIM)), 25, axis=0) + 0.7 * rng.normal(size=(150, DIM))
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(1, 151, size=(900, 2)).tolist() if a != b})
    counts = rng.integers(1, 4, size=150).tolist()
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "")
    found = merged(spark, x, pairs, 0.3, counts)
    jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    sc.setJobGroup("", "")
    monkeypatch.setattr(C, "FEW_NODES", -1)
    assert found == merged(spark, x, pairs, 0.3, counts) and 5 < len(found) < 100
    assert jobs < 25  # every round of joins is a dozen jobs, whose plans filled the driver


def test_a_bridge_between_large_clusters(spark):
    """Loose rows half-way between clusters of hundreds join nothing: sets are those of the definition."""
    rng = np.random.default_rng(8)
    dim, sizes = 64, (400, 300, 200)
    centres = np.eye(dim)[:3]
    x = [c + 0.1 * rng.normal(size=(n, dim)) for c, n in zip(centres, sizes)]
    bridges = [(centres[0] + centres[1]) * 0.6 + 0.125 * rng.normal(size=(3, dim)), (centres[1] + centres[2]) * 0.6 + 0.125 * rng.normal(size=(3, dim))]
    x = np.concatenate(x + bridges + [rng.normal(size=(60, dim))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    members, _ = cluster_rows(frame(spark, x), dim=dim)
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster, set()).add(r.id)
    large = sorted((s for s in got.values() if len(s) >= 50), key=len, reverse=True)
    assert len(large) == 3
    for s, first, n in zip(large, (0, 400, 700), sizes):
        assert s >= set(range(first + 1, first + n + 1)) and len(s) <= n + 6
        mean = x[[i - 1 for i in s]].astype(float).mean(axis=0)
        assert all(x[i - 1] @ mean / np.linalg.norm(mean) >= 0.5 for i in s)


def test_a_centre_beside_a_larger_one_gives_way(spark):
    own = spark.createDataFrame([(1, [1.0, 0.0], 9), (2, [0.8, 0.6], 5), (3, [0.0, 1.0], 4), (4, [-1.0, 0.0], 9)], "cluster long, centre array<double>, size long")
    rows = own.selectExpr("cluster id", "centre u", "size")
    assert {(r.id, r["cluster"]) for r in within(rows, own, 0.5, larger=True).collect()} == {(2, 1), (3, 2)}


def test_no_fixed_point_in_time(spark):
    rng = np.random.default_rng(4)
    with pytest.raises(RuntimeError):
        cluster_rows(frame(spark, rng.normal(size=(40, 3))), dim=3, most_passes=0)


def test_tie_to_known(spark):
    members = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id long, cluster long")
    papers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, doc_id string")
    known = spark.createDataFrame([(7, ["a", "b", "b", "c", "x", None]), (8, ["c", "d"]), (9, None)], "cluster_id int, paper_ids array<string>")
    assert [tuple(r) for r in tie_to_known(members, papers, known).collect()] == [(7, 10)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0] * DIM)]])
def test_too_little(spark, rows):
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    members, clusters = cluster_rows(df, dim=DIM)
    assert members.count() == 0 and clusters.count() == 0


def test_blocks_of_centres_do_not_change_the_result(spark, monkeypatch):
    from folioflow.llm import clusters as C

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, u array<double>")
    centres = spark.createDataFrame([(k, [float(c) for c in v], 5) for k, v in enumerate(x[:9])], "cluster long, centre array<double>, size long")
    key = lambda df: sorted((r.id, r.cluster, round(r.cosine, 9)) for r in df.collect())
    whole = key(C.within(units, centres, 0.3))
    monkeypatch.setattr(C, "CENTRE_BLOCK", 2)
    assert key(C.within(units, centres, 0.3)) == whole and len(whole) >= 9


def test_repeated_vectors_stay_in_their_cluster(spark):
    # Every vector is held by seven rows, more than the graph's five edges.
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.18 * rng.normal(size=(n, DIM)) for c, n in zip(np.eye(DIM)[:3], (40, 25, 12))] + [rng.normal(size=(8, DIM))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    members, clusters = cluster_rows(frame(spark, np.concatenate([x] * 7)), dim=DIM, k=5)
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster, set()).add(r.id)
    large = [s for s in got.values() if len(s) >= 70]
    assert len(large) == 3
    for s in large:
        mean = np.mean([x[(i - 1) % len(x)] for i in s], axis=0)
        cosine = x @ (mean / np.linalg.norm(mean))
        assert s == {k + 1 + c * len(x) for k in np.flatnonzero(cosine >= 0.5) for c in range(7)}


def test_copies_alone_are_a_cluster(spark):
    x = np.concatenate([np.repeat(np.eye(DIM)[:1], 6, axis=0), np.eye(DIM)[1:4]])
    members, clusters = cluster_rows(frame(spark, x), dim=DIM)
    assert {r.id for r in members.collect()} == set(range(1, 7)) and [(r["cluster"], r["size"]) for r in clusters.collect()] == [(1, 6)]


def test_sums_leave_their_batches_one_by_one(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, DIM)) + np.repeat(np.eye(DIM)[:3] * 4, 30, axis=0)
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<float>")
    units = {r.id: r.u for r in rows.mapInArrow(C._to_length_one, "id long, u array<double>").collect()}
    for k, v in enumerate(x.astype(np.float32).astype(np.float64)):
        length = 0.0
        for c in v:
            length += c * c
        assert units[k] == [c / np.sqrt(length) for c in v]
    n, s = np.ones(90, np.int64), np.array([np.floor(np.array(units[k]) * STEP + 0.5) for k in range(90)]).astype(np.int64)
    a, b = np.triu_indices(90, 1)
    w = np.array([np.dot(units[p], units[q]) for p, q in zip(a, b)])
    left, count, sums = C.merge_in_memory(n, s, a, b, w, 0.25, 0.12, 50)
    order = rng.permutation(90)
    state = spark.createDataFrame([(int(k) * 7, 1, s[k].tolist()) for k in order], "cluster long, n long, s array<long>").repartition(5)
    link = spark.createDataFrame([(int(p) * 7, int(q) * 7, float(c), 1, 1) for p, q, c in zip(a, b, w)], "a long, b long, w double, na long, nb long").repartition(3)
    got = {r.cluster: (r.n, r.s) for r in C._rest_of_rounds(state, link, 0.25, 0.12, 50).collect()}
    assert got == {int(k) * 7: (int(c), v.tolist()) for k, c, v in zip(left, count, sums)} and len(got) < 10
