import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import similar
from folioflow.llm.similar import near_pairs, nearest_vectors

DIM = 16


def frame(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids or range(1, len(vectors) + 1), vectors)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def exact(vectors, ids, k):
    out = {}
    x = np.asarray(vectors, dtype=np.float32).astype(np.float64)
    for i, a in zip(ids, x):
        ranked = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in zip(ids, x) if j != i)
        out[i] = [j for _, j in ranked[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append((r["rank"], r.neighbour))
    return {i: [n for _, n in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("cell_rows", [10_000, 60])
def test_recall_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, DIM))
    x = np.concatenate([c + 0.6 * rng.normal(size=(60, DIM)) for c in centres]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(1, len(x) + 1))
    got = found(nearest_vectors(frame(spark, x), 5, dim=DIM, rotations=4, code_radius=30, cell_rows=cell_rows))
    want = exact(x, ids, 5)
    assert np.mean([len(set(got.get(i, [])) & set(want[i])) / 5 for i in ids]) >= 0.9


def in_cells(monkeypatch, bits):
    """Cells instead of blocks, which only very large collections take of themselves."""
    monkeypatch.setattr(similar, "_cells", lambda *_: bits)


def test_blocks_and_cells_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.normal(size=(300, DIM)))
    a = found(nearest_vectors(df, 3, dim=DIM, cell_rows=10_000))
    assert a == found(nearest_vectors(df, 3, dim=DIM, cell_rows=40))
    in_cells(monkeypatch, 3)
    assert a == found(nearest_vectors(df, 3, dim=DIM, cell_rows=40))


def test_the_plan_that_sends_less():
    assert similar._cells(100_000, 8, 131_072, 3) == 0 and similar._cells(100_000_000, 8, 131_072, 3) == 0
    assert similar._cells(1_000_000_000, 8, 131_072, 3) == 13


def test_copies_and_ties(spark):
    e = np.eye(DIM)[0]
    near = e.copy()
    near[1] = 0.1
    got = found(nearest_vectors(frame(spark, [e] * 8 + [near], [5, 3, 9, 1, 7, 2, 8, 6, 4]), 5, dim=DIM))
    assert got[1] == [2, 3, 5, 6, 7]
    assert got[9] == [1, 2, 3, 5, 6]
    assert got[4] == [1, 2, 3, 5, 6]


@pytest.mark.parametrize("bits", [0, 4])
def test_a_third_of_all_rows_nearly_alike(spark, monkeypatch, bits):
    in_cells(monkeypatch, bits)
    rng = np.random.default_rng(3)
    hot = np.eye(DIM)[0] + 0.001 * rng.normal(size=(150, DIM))
    x = np.concatenate([hot, rng.normal(size=(300, DIM))])
    got = found(nearest_vectors(frame(spark, x), 5, dim=DIM, cell_rows=32))
    want = exact(x, list(range(1, 451)), 5)
    assert all(got[i] == want[i] for i in range(1, 151))


def test_unusable_rows(spark):
    nan = [float("nan")] * DIM
    df = frame(spark, [np.eye(DIM)[0], np.eye(DIM)[1], None, np.zeros(DIM), nan, np.ones(4)])
    df = df.unionByName(spark.createDataFrame([(None, [1.0] * DIM)], "id long, embedding array<float>")).withColumn("v", F.lit("x")).withColumn("rep", F.lit(1))
    assert found(nearest_vectors(df, 5, dim=DIM, code_radius=128, radius=16)) == {1: [2], 2: [1]}


def test_empty(spark):
    assert nearest_vectors(frame(spark, []), 5, dim=DIM).count() == 0


def test_near_pairs(spark):
    n = spark.createDataFrame([(1, 2, 1, 0.1), (2, 1, 1, 0.1), (3, 1, 1, 0.5)], "id long, neighbour long, rank int, distance double")
    assert [tuple(r) for r in near_pairs(n, 0.4).collect()] == [(1, 2)]


def test_blocks_of_neighbouring_rows_leave_out_what_is_far(spark, monkeypatch):
    """As probing every pair gives it, with few of the rows sent to further blocks and few products."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, DIM)) / 4
    x = np.concatenate([c + 0.05 * rng.normal(size=(120, DIM)) for c in centres]).astype(np.float32)
    x[5:60:5] = x[0] + 0.0001 * rng.normal(size=(11, DIM))
    ids = np.arange(len(x)) * 3 + 1
    code = similar.fit_rotations(x.astype(np.float64), 4)
    sub = similar._encode(*code, x.astype(np.float64))
    block = similar._Block(ids, x, sub, list(range(4)))
    want = similar._nearest(block, ids, x, sub, similar._ball(16, 3), 5, 24, 3)
    monkeypatch.setattr(similar, "GROUPS", 24)
    groups = similar._Groups(x.astype(np.float64), len(x) * 256)
    g = groups.of(x)
    extent = similar._Extent(groups)
    extent.add(groups, x)
    bounds = groups.bounds(x, g, extent)
    far = np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(axis=2))
    assert all((bounds[:, k] <= far[:, g == k].min(axis=1) + 1e-9).all() for k in np.unique(g))
    members = similar._Members(ids, x, g, groups, code, (24, 3))
    q, other, dist = members.nearest(ids, x, bounds, np.full(len(x), np.inf), 5)
    assert list(zip(ids[q], other, dist)) == list(want.itertuples(index=False, name=None))
    last = np.where(np.bincount(q, minlength=len(x)) == 5, dist[np.searchsorted(q, np.arange(len(x)), side="right") - 1], np.inf)
    assert ((bounds <= last[:, None]) @ extent.size).mean() < 0.2 * len(x)
    # The same by Spark, in blocks of 50 rows.
    df = frame(spark, x, ids.tolist())
    assert found(nearest_vectors(df, 5, dim=DIM, cell_rows=50)) == found(nearest_vectors(df, 5, dim=DIM))
