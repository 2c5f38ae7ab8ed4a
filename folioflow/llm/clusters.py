"""Similarity clusters, by reciprocal-nearest-neighbour average linkage on a sparse graph.

The graph joins every distinct vector with its nearest other ones
(:mod:`folioflow.llm.similar`); its copies are one node, weighted by their number.
Every cluster keeps its number of rows and the sum of their unit vectors, so the
linkage of two clusters, the mean cosine over *all* pairs of their rows, is the
product of the sums over that of the numbers. The graph only says for which
pairs of clusters it is computed. In each round every cluster finds its best
neighbour; all mutual best pairs merge at once. A cluster follows its best neighbour
into such a pair if it is no larger than that neighbour and their linkage is within
``slack`` of the pair's, or else a large cluster would take one row a round (and
without regard to size, a few loose rows would bring large clusters together).
Rounds end when no linkage reaches the threshold. Its default is the
square of ``bound``: a set whose rows have a mean cosine of ``bound`` to its mean
direction has exactly that mean cosine between its rows.

Sums are of whole numbers (components in steps of 2^-24), so that they don't
depend on the order of rows. A round is four joins and two aggregations of
tables that shrink from round to round; its results are written to the shared
folder. A join's hot key (a large cluster's edges) meets one row on the other
side, which adaptive execution splits. Once at most ``FEW_NODES`` clusters and
``FEW_EDGES`` edges are left, one task ends the rounds in memory, by the same arithmetic:
a round of such a size costs far more in plans, and in the driver's memory, than in work.

An exact check follows: rows belong to the centre they are nearest to if their
cosine to it reaches the bound; centres are the mean directions of their rows,
and one that lies within the bound of a larger one's gives way to it. This is
repeated until no centre moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.similar import nearest_vectors, usable
from folioflow.runtime import Kept, broadcast_within, cut

#: Centres that one pass over the rows compares (4 MB at 64 components); more are taken in further passes.
CENTRE_BLOCK = 8192
STEP = 1 << 24  # components are summed in whole numbers of 1 / STEP
FINE = 32767  # mean vectors are compared in whole numbers of 1 / FINE
FEW_NODES, FEW_EDGES = 300_000, 1_000_000  # one task's share of the rounds: about 0.5 GB at 64 components, as estimated


def steps(x: str) -> str:
    """A component of a unit vector in whole steps."""
    return f"floor(({x}) * {STEP}d + 0.5d)"


def sums_by(df: DataFrame, n: str, component: str, dim: int) -> DataFrame:
    """(cluster, n, s): sums of ``n`` and of each ``component`` (with {i} for its place) over the rows of each cluster, combined before the shuffle."""
    sums = df.groupBy("cluster").agg(F.expr(f"sum({n}) n"), *[F.expr(f"sum({component.format(i=i)}) s{i}") for i in range(dim)])
    return sums.selectExpr("cluster", "n", f"array({', '.join(f's{i}' for i in range(dim))}) s")


def directions(sums: DataFrame) -> DataFrame:
    """(cluster, centre, size) of (cluster, n, s): centres of length 1; clusters whose vectors cancel out are left out."""
    length = sums.selectExpr("cluster", "s", "n size", "sqrt(aggregate(s, 0d, (t, x) -> t + double(x) * double(x))) l").filter("l > 0")
    return length.selectExpr("cluster", "transform(s, x -> x / l) centre", "size")


def merge_rounds(nodes: DataFrame, edges: DataFrame, dim: int, threshold: float = 0.25, slack: float = 0.12, most_rounds: int = 200) -> DataFrame:
    """(cluster, n, s): average-linkage clusters of ``nodes`` (id, n, s) under ``edges`` (a, b, sim), a < b, each once.

    ``s`` is the sum of a node's n unit vectors in whole steps (:func:`steps`), ``sim`` the
    cosine of two nodes. ``cluster`` is the id of one of its nodes; nodes without an edge
    stay alone. Edges between equal or unknown ids must not be given.
    ``most_rounds`` is a guard against endless runs: RuntimeError if merges were
    still open by then.
    """
    kept = Kept(nodes.sparkSession)
    state = kept.write(nodes.selectExpr("id cluster", "n", "s"), "state0")
    link = edges.join(nodes.selectExpr("id a", "n na"), "a").join(nodes.selectExpr("id b", "n nb"), "b")
    link = kept.write(link.selectExpr("a", "b", "sim w", "na", "nb"), "link0")
    for k in range(most_rounds):
        if state.count() <= FEW_NODES and link.count() <= FEW_EDGES:
            return kept.write(_rest_of_rounds(state, link, threshold, slack, most_rounds - k), "rest")
        both = link.filter(f"w >= {threshold!r}").selectExpr("inline(array(struct(a, b, w, na as n), struct(b as a, a as b, w, nb as n)))")
        best = both.groupBy("a").agg(F.expr("max(struct(w, -b as nb)) m"), F.expr("max(n) n")).selectExpr("a", "-m.nb b", "m.w w", "n")
        pointed = best.join(best.selectExpr("a b", "b bb", "w bw", "n bn"), "b").selectExpr("a", "b", "bb = a mutual", f"w >= bw * {1 - slack!r} and n <= bn near")
        paired = pointed.filter("mutual").selectExpr("a b", "least(a, b) root")
        # A mutual pair takes its smaller id (which is moved to itself); a follower takes the pair's.
        moves = pointed.filter("mutual or near").join(paired, "b").selectExpr("a cluster", "root")
        moves = kept.write(moves, f"moves{k}")
        if moves.isEmpty():
            return state
        grown = state.join(moves, "cluster", "left").selectExpr("coalesce(root, cluster) cluster", "n", "s")
        state = kept.write(sums_by(grown, "n", "s[{i}]", dim), f"state{k + 1}")
        # Pairs of clusters that stayed as they were keep their linkage; the others get it from the new sums.
        moved = link.join(moves.selectExpr("cluster a", "root ra"), "a", "left").join(moves.selectExpr("cluster b", "root rb"), "b", "left")
        moved = moved.selectExpr("coalesce(ra, a) x", "coalesce(rb, b) y", "if(ra is null and rb is null, struct(w, na, nb), null) old").filter("x <> y")
        merged = moved.groupBy(F.expr("least(x, y) a"), F.expr("greatest(x, y) b")).agg(F.expr("max(old) old"))
        mean = f"transform(s, x -> smallint(floor(x * ({FINE}d / {STEP}d) / n + 0.5d)))"
        merged = merged.join(state.selectExpr("cluster ca", "n na", f"{mean} ma"), F.expr("old is null and a = ca"), "left")
        merged = merged.join(state.selectExpr("cluster cb", "n nb", f"{mean} mb"), F.expr("old is null and b = cb"), "left")
        product = f"aggregate(zip_with(ma, mb, (p, q) -> bigint(p) * q), 0L, (t, x) -> t + x) / {FINE * FINE}d"
        link = kept.write(merged.selectExpr("a", "b", f"coalesce(old.w, {product}) w", "coalesce(old.na, na) na", "coalesce(old.nb, nb) nb"), f"link{k + 1}")
        for name in (f"link{k}", f"state{k}", f"moves{k}"):
            kept.drop(name)
    raise RuntimeError(f"merges were still open after {most_rounds} rounds")


def _rest_of_rounds(state: DataFrame, link: DataFrame, threshold: float, slack: float, most_rounds: int) -> DataFrame:
    """The rounds of :func:`merge_rounds` from (cluster, n, s) and (a, b, w, na, nb) on, in one task."""
    nodes = state.selectExpr("cluster a", "cast(null as long) b", "cast(null as double) w", "n", "s")
    every = nodes.unionByName(link.selectExpr("a", "b", "w", "cast(null as long) n", "cast(null as array<long>) s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums leave their batches one by one, so that they are held twice at most.
        nodes, edges = [], []
        for x in batches:
            own = pc.is_valid(x["n"])
            if len(y := x.filter(own)):
                nodes.append((y["a"].to_numpy(), y["n"].to_numpy(), y["s"].flatten().to_numpy().reshape(len(y), -1).copy()))
            if len(y := x.filter(pc.invert(own)).select(["a", "b", "w"])):
                edges.append(y)
        if not nodes:
            return
        ids, n = (np.concatenate([x[k] for x in nodes]) for k in (0, 1))
        order = np.argsort(ids)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        ids, n, s = ids[order], n[order], np.empty((len(ids), nodes[0][2].shape[1]), np.int64)
        start = 0
        for k, (own_ids, _, sums) in enumerate(nodes):
            s[place[start : start + len(own_ids)]] = sums
            start, nodes[k] = start + len(own_ids), None
        get = lambda c, kind: np.concatenate([np.zeros(0, kind), *[x[c].to_numpy() for x in edges]])
        a, b = (np.searchsorted(ids, get(c, np.int64)) for c in "ab")
        left, n, s = merge_in_memory(n, s, a, b, get("w", np.float64), threshold, slack, most_rounds)
        for k in range(0, len(left), 10_000):
            part = s[k : k + 10_000]
            offsets = np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[left[k : k + 10_000]]), pa.array(n[k : k + 10_000]), pa.ListArray.from_arrays(offsets, part.ravel())], ["cluster", "n", "s"])

    return every.coalesce(1).mapInArrow(run, "cluster long, n long, s array<long>")


def merge_in_memory(n: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, threshold: float, slack: float, most_rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, n, s) of the clusters left of those with numbers ``n`` and sums ``s``, under edges of places ``a`` < ``b``; places are in the order of ids."""
    n, s, here = n.copy(), s.copy(), np.arange(len(n))
    alive = np.ones(len(n), bool)
    for _ in range(most_rounds):
        fits = w >= threshold
        x, y, v = np.concatenate([a[fits], b[fits]]), np.concatenate([b[fits], a[fits]]), np.concatenate([w[fits], w[fits]])
        order = np.lexsort((y, -v, x))
        x, y, v = x[order], y[order], v[order]
        first = np.ones(len(x), bool)
        first[1:] = x[1:] != x[:-1]
        x, y, v = x[first], y[first], v[first]
        best, top = np.full(len(n), -1), np.zeros(len(n))
        best[x], top[x] = y, v
        near = (v >= top[y] * (1 - slack)) & (n[x] <= n[y])
        paired = best[best[y]] == y
        goes = ((best[y] == x) | near) & paired
        if not goes.any():
            return here[alive], n[alive], s[alive]
        x, y = x[goes], y[goes]
        root, moved = here.copy(), np.zeros(len(n), bool)
        root[x], moved[x] = np.minimum(y, best[y]), True
        gone = x[root[x] != x]
        np.add.at(s, root[gone], s[gone])
        np.add.at(n, root[gone], n[gone])
        alive[gone] = False
        changed = moved[a] | moved[b]
        p, q = root[a[changed]], root[b[changed]]
        pairs = np.unique(np.minimum(p, q)[p != q] * len(n) + np.maximum(p, q)[p != q])
        p, q = pairs // len(n), pairs % len(n)
        new = np.empty(len(p))
        for k in range(0, len(p), 50_000):
            mean = lambda at: np.floor(s[at] * (FINE / STEP) / n[at, None] + 0.5).astype(np.int64)
            new[k : k + 50_000] = (mean(p[k : k + 50_000]) * mean(q[k : k + 50_000])).sum(axis=1) / float(FINE * FINE)
        a, b, w = np.concatenate([a[~changed], p]), np.concatenate([b[~changed], q]), np.concatenate([w[~changed], new])
    raise RuntimeError(f"merges were still open after {most_rounds} rounds")


def within(units: DataFrame, centres: DataFrame, bound: float, larger: bool = False) -> DataFrame:
    """(id, u, cluster, cosine): for each row the centre it is nearest to, if within ``bound``; ties by the smaller cluster.

    ``larger``: the rows (id, u, size) are themselves centres, held only against those of
    more rows or, with as many, a smaller id.

    Centres (cluster, centre, size) are compared in blocks of about ``CENTRE_BLOCK``,
    drawn by hash: only one block at a time is on the driver and broadcast, and
    their number doesn't limit the method. Each block is one pass over the rows,
    of which only those within the bound come out.
    """
    blocks = -(-centres.count() // CENTRE_BLOCK)
    spark = units.sparkSession
    found = []
    for k in range(blocks):
        block = centres.filter(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == k).toPandas().sort_values("cluster")
        if len(block):
            shared = spark.sparkContext.broadcast((block["cluster"].to_numpy(), np.stack(block["centre"].to_numpy()), block["size"].to_numpy()))
            found.append(_within_block(units, shared, bound, larger))
    if not found:
        return units.select("id", "u", F.lit(None).cast("long").alias("cluster"), F.lit(None).cast("double").alias("cosine")).filter("false")
    if len(found) == 1:
        return found[0]
    best = F.max(F.struct("cosine", (-F.col("cluster")).alias("nc"))).alias("m")
    every = reduce(DataFrame.unionByName, found).groupBy("id").agg(best, F.first("u").alias("u"))
    return every.select("id", "u", (-F.col("m.nc")).alias("cluster"), F.col("m.cosine").alias("cosine"))


def _within_block(units: DataFrame, shared: Broadcast, bound: float, larger: bool) -> DataFrame:
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, centres, sizes = shared.value
        for x in batches:
            if not len(x):
                continue
            cosine = np.stack(x["u"].to_numpy()) @ centres.T
            if larger:
                ids, own = x["id"].to_numpy()[:, None], x["size"].to_numpy()[:, None]
                cosine[~((sizes > own) | ((sizes == own) & (names < ids)))] = -2
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(x)), best]
            keep = top >= bound
            yield pd.DataFrame({"id": x["id"][keep], "u": x["u"][keep], "cluster": names[best[keep]], "cosine": top[keep]})

    return units.mapInPandas(compare, "id long, u array<double>, cluster long, cosine double")


def _to_length_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, u) of (id, v). In an expression of columns the length would be inlined, and so computed for every component."""
    for x in batches:
        if len(x):
            v = x["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
            square = np.zeros(len(x))
            for k in range(v.shape[1]):  # one after another, as sums of other orders would differ in their last digit
                square += v[:, k] * v[:, k]
            u = v / np.sqrt(square)[:, None]
            offsets = np.arange(0, u.size + 1, u.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([x["id"], pa.ListArray.from_arrays(offsets, u.ravel())], ["id", "u"])


def cluster_rows(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    dim: int = 64,
    k: int = 5,
    bound: float = 0.5,
    threshold: float | None = None,
    least: int = 5,
    most_passes: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """(members, clusters).

    members (id, cluster, cosine): the rows of every cluster of at least ``least``
    rows, with the cosine to its mean direction; a row is in one cluster at most,
    rows near none are left out.
    clusters (cluster, size, typical): size and the ids of the five rows nearest to
    the mean direction. ``cluster`` is an id of the merged core.

    Rows with a null id or an unusable vector are left out; copies count for
    themselves; an empty table gives two empty results; other columns are ignored.
    Every pass of the check raises the sum of (cosine - bound) over the members or
    lowers the number of centres, so the passes end; ``most_passes`` is a guard:
    RuntimeError if centres still moved by then.
    """
    rows = usable(df, id_col, vec_col, dim)
    units = cut(rows.mapInArrow(_to_length_one, "id long, u array<double>"))
    # Copies are one node: among rows, a vector's own copies would take up all its edges.
    nodes = cut(units.groupBy(F.transform("u", lambda x: x.cast("float")).alias("v")).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    # The graph is searched among unit vectors: the order by distance is that by cosine.
    near = nearest_vectors(nodes, k=k, id_col="id", vec_col="v", dim=dim)
    edges = near.select(
        F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), (1 - F.col("distance") * F.col("distance") / 2).alias("sim")
    ).dropDuplicates(["a", "b"])
    weighted = nodes.select("id", "n", F.expr(f"transform(v, x -> {steps('x')} * n) s"))
    cores = merge_rounds(weighted, edges, dim, bound * bound if threshold is None else threshold)
    members = _settle(units, directions(cores.filter(F.col("n") >= least)), dim, bound, least, most_passes)
    # Most typical members in two steps, so that a large cluster isn't gathered in one task.
    ranked = members.select("cluster", "id", F.struct((-F.col("cosine")).alias("w"), "id").alias("e")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = ranked.groupBy("cluster", "salt").agg(F.slice(F.array_sort(F.collect_list("e")), 1, 5).alias("l"), F.count("*").alias("n"))
    clusters = few.groupBy("cluster").agg(F.sum("n").alias("size"), F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, 5).alias("l"))
    return members, clusters.select("cluster", "size", F.transform("l", lambda e: e["id"]).alias("typical"))


def _settle(units: DataFrame, centres: DataFrame, dim: int, bound: float, least: int, most_passes: int) -> DataFrame:
    """(id, cluster, cosine) at the fixed point of centres and members."""
    centres = cut(centres)
    for _ in range(most_passes):
        own = centres.select(F.col("cluster").alias("id"), F.col("centre").alias("u"), "size")
        beside = within(own, centres, bound, larger=True).select(F.col("id").alias("cluster"))
        apart = cut(centres.join(broadcast_within(cut(beside), 100_000), "cluster", "left_anti"))
        members = within(units, apart, bound)
        sums = sums_by(members, "1L", steps("u[{i}]"), dim)
        again = cut(directions(sums.filter(F.col("n") >= least)))
        moved = again.exceptAll(centres).unionByName(centres.exceptAll(again))
        if moved.isEmpty():
            return cut(members.select("id", "cluster", "cosine"))
        centres = again
    raise RuntimeError(f"centres still moved after {most_passes} passes")


def tie_to_known(members: DataFrame, papers: DataFrame, known: DataFrame) -> DataFrame:
    """(cluster_id, cluster): the found cluster in which most papers of each known one lie.

    ``papers`` (id, doc_id) names the paper of each row; a paper of ``known``
    (cluster_id, paper_ids) counts once, unknown ones don't count. More than half of
    the papers that are known must lie in the cluster; a cluster wanted by several
    known ones goes to the one with most papers in it, then the smaller cluster_id.
    """
    listed = known.select("cluster_id", F.explode("paper_ids").alias("doc_id")).filter("doc_id is not null").distinct()
    placed = papers.join(members.select("id", "cluster"), "id", "left").select("doc_id", "cluster")
    found = listed.join(placed, "doc_id").distinct()
    papers_of = found.groupBy("cluster_id").agg(F.count_distinct("doc_id").alias("all"))
    votes = found.filter("cluster is not null").groupBy("cluster_id", "cluster").agg(F.count_distinct("doc_id").alias("n"))
    best = votes.groupBy("cluster_id").agg(F.max(F.struct("n", (-F.col("cluster")).alias("c"))).alias("m")).join(papers_of, "cluster_id")
    best = best.filter(F.col("m.n") * 2 > F.col("all")).select("cluster_id", (-F.col("m.c")).alias("cluster"), F.col("m.n").alias("n"))
    return best.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("w"), "cluster_id")).alias("m")).select(F.col("m.cluster_id").alias("cluster_id"), "cluster")
