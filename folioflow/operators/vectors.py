"""Vector retrieval with scalar filters: exact, by inverted cells, by random projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.runtime import broadcast_within, cut

QUERY_LIMIT = 20_000  # queries that are broadcast to the scan at a time; more go block by block


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(l2_squared(a, b))


def l2_squared(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def search(rows: DataFrame, vector: list[float], k: int, condition: Column | None = None, fields: tuple[str, ...] = (), vec_col: str = "vectors", tie: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """The ``k`` rows nearest to one vector among those that fit, filtered before they are ranked; ties by key."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    kept = rows.filter(condition) if condition is not None else rows
    scored = kept.filter(F.col(vec_col).isNotNull()).select(*tie, *[f for f in fields if f not in tie], l2(F.col(vec_col), query).alias("dist"))
    return scored.orderBy("dist", *tie).limit(k)


def search_each(rows: DataFrame, queries: DataFrame, k: int, fields: tuple[str, ...], vec_col: str = "vectors", on: list[str] | None = None) -> DataFrame:
    """(query_id, rank, *fields, dist): the ``k`` nearest rows of every query (query_id, query), ties by the fields.

    ``on`` names columns of both sides that must agree; then it is an equi-join.
    Without it a stated query set meets all rows: the queries go to the scan of the
    rows in blocks of about ``QUERY_LIMIT``, drawn by hash, each one pass over the rows.
    Either way each task keeps the top k per query before anything is shuffled. Null vectors, and
    those of another length than the query, are nobody's neighbour.
    """
    if on:
        pairs = rows.join(queries.select("query_id", F.col("query").alias("_q"), *on), on)
        fits = F.col(vec_col).isNotNull() & (F.size(vec_col) == F.size("_q"))
        scored = pairs.filter(fits).select("query_id", *fields, l2(F.col(vec_col), F.col("_q")).alias("dist"))
    else:
        asked = queries.filter("query is not null").select("query_id", F.col("query").cast("array<double>").alias("query"))
        scored = _scans(rows, asked, k, fields, vec_col)
    return _best(scored, k, fields)


def _blocks(asked: DataFrame) -> Iterator[pd.DataFrame]:
    """The queries in blocks for the driver, one at a time; those of one query_id come together."""
    first = asked.limit(QUERY_LIMIT + 1).toPandas()
    if len(first) <= QUERY_LIMIT:
        yield first
        return
    del first
    asked = cut(asked)
    blocks = -(-asked.count() // QUERY_LIMIT)
    for b in range(blocks):
        yield asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()


class Buckets:
    """Which queries and rows of a batch share a bucket: of their keys, in some table, at most one bit differs."""

    def __init__(self, keys: np.ndarray, own: np.ndarray, bits: int):
        self.keys, self.own, self.flips = keys, own, [0, *(1 << b for b in range(bits))]

    def bits(self, who: np.ndarray) -> np.ndarray:
        """For each of these queries the packed bits of the rows that it meets."""
        return _in_buckets(self.keys, self.own[who], self.flips)

    def pairs(self, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of these pairs of a query and a row, which meet."""
        apart = self.keys[at] ^ self.own[who]
        return (apart & (apart - 1) == 0).any(axis=1)


#: (vectors of queries) -> (vectors of rows, their cells) -> parts (places of rows, of queries, the buckets in which they meet, or None if all meet).
Meeting = Callable[[np.ndarray], Callable[[np.ndarray, np.ndarray | None], Iterator[tuple[np.ndarray, np.ndarray, Buckets | None]]]]


def _scans(rows: DataFrame, asked: DataFrame, k: int, fields: tuple[str, ...], vec_col: str, meeting: Meeting | None = None, cell: str | None = None) -> DataFrame:
    """(query_id, *fields, dist) of all queries (query_id, query), by block and length."""
    kind = asked.schema["query_id"].dataType.simpleString()
    found = []
    for block in _blocks(asked):
        length = block["query"].map(len)
        found += [_scan(rows, block[length == n], kind, k, fields, vec_col, meeting, cell) for n in sorted(length.unique())] or [_scan(rows, block, kind, k, fields, vec_col)]
    return reduce(DataFrame.unionByName, found)


def _scan(
    rows: DataFrame, asked: pd.DataFrame, kind: str, k: int, fields: tuple[str, ...], vec_col: str, meeting: Meeting | None = None, cell: str | None = None, block: int = 1024
) -> DataFrame:
    """(query_id, *fields, dist): of every batch of rows the best for each query, by matrix products.

    Products only choose: whatever comes within their rounding error of the
    k-th best of its task so far gets its distance from differences.
    ``meeting`` says which rows and queries meet, else all do.
    """
    kinds = rows.schema
    names = [f"_f{i}" for i in range(len(fields))]
    schema = ", ".join([f"query_id {kind}", *(f"{n} {kinds[f].dataType.simpleString()}" for n, f in zip(names, fields)), "dist double"])
    back = ["query_id", *[F.col(n).alias(f) for n, f in zip(names, fields)], "dist"]
    slim = rows.select(*[F.col(f).alias(n) for n, f in zip(names, fields)], F.col(vec_col).alias("_v"), *([F.col(cell).alias("_cell")] if cell else []))
    if not len(asked):
        return slim.select(F.lit(None).cast(kind).alias("query_id"), *names, F.lit(0.0).alias("dist")).filter("false").select(*back)
    dim = len(asked["query"].iloc[0])
    shared = rows.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), np.stack(asked["query"].to_numpy())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best = np.full((len(q), k), np.inf)  # squares of the least distances of each query so far
        meets = meeting(q) if meeting else lambda v, _: [(np.arange(len(v)), np.arange(len(q)), None)]
        for x in batches:
            if not len(x):
                continue
            v = np.stack(x["_v"].to_numpy()).astype(np.float64)
            for at, asking, buckets in meets(v, x["_cell"].to_numpy() if cell else None):
                near = v[at]
                sides = {}
                for a in range(0, len(asking), block):
                    who = asking[a : a + block]
                    qi, ri, d2 = _closest(q[who], near, best[who, -1], k, sides, buckets, who)
                    best[who] = _merged(best[who], qi, d2)
                    keep = (d2 <= best[who[qi], -1] * (1 + SAME)) & (d2 < np.inf)
                    out = x[names].iloc[at[ri[keep]]].reset_index(drop=True)
                    out.insert(0, "query_id", ids[who[qi[keep]]])
                    out["dist"] = np.sqrt(d2[keep])
                    if len(out):
                        yield out

    return slim.filter(F.col("_v").isNotNull() & (F.size("_v") == dim)).mapInPandas(run, schema).select(*back)


SAME = 1e-12  # squares of distances this close, as a share, may have the same root
PAIRS = 1 << 16  # pairs whose differences are in memory at a time


def _closest(
    q: np.ndarray, near: np.ndarray, best: np.ndarray, k: int, sides: dict[type, np.ndarray], buckets: Buckets | None, who: np.ndarray, first: int = 2048
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row, square of distance) that meet, with all that are no farther than the k-th nearest row of the query or ``best``.

    One product gives lower bounds of the squares, in single precision; where those
    leave more than a sixteenth of the pairs, it is done again in double. A query that ``best`` leaves many rows
    takes the k-th of the ``first`` rows for its bound. ``sides`` keeps the rows' side of the product for the next queries.
    """
    norms, dim, width = (q * q).sum(axis=1), q.shape[1], -(-len(near) // 8)
    first = max(first, 4 * k)
    for kind in (np.float32, np.float64):
        share = 1 - 2 * (dim + 8) * np.finfo(kind).eps  # of both lengths; the rest is more than the product's rounding
        if kind not in sides:
            own = (near * near).sum(axis=1)
            sides[kind] = np.column_stack([-2 * near, own * share, np.ones(len(near))]).astype(kind) if kind is np.float64 or own.max() < 1e30 else None
        if sides[kind] is None or kind is np.float32 and norms.max() >= 1e30:
            continue
        low = np.column_stack([q, np.ones(len(q)), norms * share]).astype(kind) @ sides[kind].T
        within = lambda d2: np.nextafter((d2 * (1 + SAME) + 8 * dim * np.finfo(kind).tiny).astype(kind), kind(np.inf))[:, None]  # noqa: B023, E731
        packed = np.packbits(low <= within(best), axis=1)
        many = np.flatnonzero(np.bitwise_count(packed).sum(axis=1, dtype=np.int64) > 4 * k)
        if len(many):
            if buckets:
                packed[many] &= buckets.bits(who[many])
            all_of, part = low[many], low[many, :first]
            part[np.unpackbits(packed[many], axis=1, count=len(near))[:, :first] == 0] = np.inf
            at = np.argpartition(part, k - 1, axis=1)[:, :k]
            d2 = np.square(near[at] - q[many, None]).sum(axis=2)
            d2 = np.where(np.isfinite(np.take_along_axis(part, at, 1)), d2, np.inf).max(axis=1)
            packed[many] &= np.packbits(all_of <= within(d2), axis=1)
            del all_of, part
        place = np.flatnonzero(packed)
        if kind is np.float64 or len(place) <= max(low.size // 16, 4 * k * len(q)):
            break
    del low
    i, j = np.nonzero(np.unpackbits(packed.ravel()[place][:, None], axis=1))
    qi, ri = place[i] // width, place[i] % width * 8 + j
    if buckets:
        meet = [buckets.pairs(who[qi[s : s + PAIRS]], ri[s : s + PAIRS]) for s in range(0, len(qi), PAIRS)]
        keep = np.concatenate([np.zeros(0, bool), *meet])
        qi, ri = qi[keep], ri[keep]
    d2 = [np.square(near[ri[s : s + PAIRS]] - q[qi[s : s + PAIRS]]).sum(axis=1) for s in range(0, len(qi), PAIRS)]
    return qi, ri, np.concatenate([np.zeros(0), *d2])


def _merged(best: np.ndarray, qi: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """The least squares of each query, in order, with those of more pairs."""
    k = best.shape[1]
    order = np.lexsort((d2, qi))
    qi, d2 = qi[order], d2[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    more = np.full(best.shape, np.inf)
    more[qi[rank < k], rank[rank < k]] = d2[rank < k]
    return np.sort(np.concatenate([best, more], axis=1), axis=1)[:, :k]


def _best(scored: DataFrame, k: int, fields: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("dist", *fields)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", *fields, "dist")


def first_per_document(hits: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("dist", "doc_id", "chunk_id")) -> DataFrame:
    """Of hits that were already limited, the nearest of each document; so fewer than k may be left."""
    w = Window.partitionBy(*keys, "doc_id").orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best_of_documents(rows: DataFrame, vector: list[float], documents: list[str], per_document: int, k: int, category: int = -1, vec_col: str = "vectors") -> DataFrame:
    """Search within several documents in one scan: the nearest of each, then the nearest of all."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    kept = rows.filter(F.col("doc_id").isin(*documents))
    if category >= 0:
        kept = kept.filter(F.col("section_category") == category)
    scored = kept.select("doc_id", "chunk_id", l2(F.col(vec_col), query).alias("dist"))
    w = Window.partitionBy("doc_id").orderBy("dist", "chunk_id")
    return scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_document).drop("_r").orderBy("dist", "doc_id", "chunk_id").limit(k)


# ---------------------------------------------------------------------------
# Indexes


def build_ivf(rows: DataFrame, cells: int, vec_col: str = "vectors", sample_rows: int = 50_000, seed: int = 1) -> tuple[DataFrame, KMeansModel]:
    """Every row with the ``cell`` of its nearest centre; centres are fitted on a bounded sample.

    Written partitioned by ``cell``, the table answers a probe by reading only its cells.
    """
    vectors = rows.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    sample = cut(vectors.select("_v").orderBy(F.xxhash64("_v")).limit(sample_rows))
    fitted = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=15).fit(sample)
    return fitted.transform(vectors).drop("_v"), fitted


def search_ivf(indexed: DataFrame, model: KMeansModel, queries: DataFrame, k: int, probe: int, fields: tuple[str, ...], vec_col: str = "vectors") -> DataFrame:
    """The ``k`` nearest rows of every query in its ``probe`` nearest cells.

    Rows come together by cell, a large cell in parts, and each part meets the queries that
    probe its cell, which go to the scan in blocks as in :func:`search_each`.
    """
    centres = np.stack(model.clusterCenters())

    def meeting(q: np.ndarray) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, None]]]:
        apart = np.stack([np.square(q - c).sum(axis=1) for c in centres], axis=1)
        probes = np.argsort(apart, axis=1, kind="stable")[:, :probe]
        asking = {c: np.flatnonzero((probes == c).any(axis=1)) for c in range(len(centres))}
        return lambda v, cells: ((np.flatnonzero(cells == c), asking[c], None) for c in np.unique(cells))

    asked = queries.filter(F.size("query") == centres.shape[1]).select("query_id", F.col("query").cast("array<double>").alias("query"))
    placed = indexed.select(*fields, vec_col, "cell").repartition("cell", F.pmod(F.xxhash64(*fields), F.lit(8))).sortWithinPartitions("cell")
    return _best(_scans(placed, asked, k, fields, vec_col, meeting, "cell"), k, fields)


def sign_keys(vector: Column, tables: int, bits: int, seed: int = 1) -> Column:
    """For each table the signs of ``bits`` random projections, as a number; null for null vectors."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            length = s.map(lambda v: -1 if v is None else len(v))
            for dim in length[length > 0].unique():
                at = s.index[length == dim]
                for i, keys in zip(at, _keys(np.stack(s[at].to_numpy()).astype(np.float64), tables, bits, seed)):
                    out[i] = keys
            yield out

    return F.pandas_udf(run, "array<long>")(vector)


def _keys(v: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng(seed).normal(size=(v.shape[1], tables * bits))
    return (v @ planes >= 0).reshape(len(v), tables, bits) @ (1 << np.arange(bits))


def _in_buckets(keys: np.ndarray, own: np.ndarray, flips: list[int]) -> np.ndarray:
    """For each query (keys ``own`` by table) the packed bits of the rows (``keys``) of which a key, in some table, is its own under one of ``flips``."""
    n = len(keys)
    met = np.zeros((len(own), -(-n // 8)), np.uint8)
    for t in range(keys.shape[1]):
        held, where = np.unique(keys[:, t], return_inverse=True)
        rows = np.zeros((len(held), met.shape[1]), np.uint8)
        for j in range(min(8, n)):  # rows of one pass have a byte each
            at = np.arange(j, n, 8)
            rows[where[at], at >> 3] |= 128 >> j
        probed, whose = np.unique(own[:, t], return_inverse=True)
        found = np.zeros((len(probed), met.shape[1]), np.uint8)
        for f in flips:
            place = np.minimum(np.searchsorted(held, probed ^ f), len(held) - 1)
            there = held[place] == probed ^ f
            found[there] |= rows[place[there]]
        met |= found[whose]
    return met


def search_lsh(rows: DataFrame, queries: DataFrame, k: int, fields: tuple[str, ...], tables: int = 32, bits: int = 12, vec_col: str = "vectors", seed: int = 1) -> DataFrame:
    """Approximate neighbours by buckets of random projections; stands in for a graph index, whose walk isn't a plan of joins.

    A query probes, in each table, the bucket of its signs and those that differ in one.
    Queries go to the scan of the rows in blocks as in :func:`search_each`; only rows that share
    a bucket count, which is found in bits until a query has ``k`` of them, and pair by pair for what comes
    nearer than those. At a sixth of all pairs, products of whole blocks take less than joining the pairs.
    """

    def meeting(q: np.ndarray) -> Callable[[np.ndarray, np.ndarray | None], Iterator[tuple[np.ndarray, np.ndarray, Buckets]]]:
        own = _keys(q, tables, bits, seed)
        return lambda v, _: iter([(np.arange(len(v)), np.arange(len(q)), Buckets(_keys(v, tables, bits, seed), own, bits))])

    asked = queries.filter("query is not null").select("query_id", F.col("query").cast("array<double>").alias("query"))
    return _best(_scans(rows, asked, k, fields, vec_col, meeting), k, fields)


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(recall): share of the exact neighbours that were found."""
    hit = found.select("query_id", key).distinct().withColumn("_hit", F.lit(1))
    return exact.select("query_id", key).join(hit, ["query_id", key], "left").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


# ---------------------------------------------------------------------------
# Embeddings


def hashing_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding in the JVM: counts of hashed words, scaled to length 1; zeros without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    # Bound to a variable each, as a lambda evaluates what it refers to for every element.
    count = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.size(s) - F.size(F.array_remove(s, k.cast("long")))).cast("double"))
    counts = F.transform(F.array(slots), count)[0]
    unit = lambda c: F.transform(c, lambda x: F.coalesce(F.try_divide(x, F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y))), F.lit(0.0)).cast("float"))
    return F.transform(F.array(counts), unit)[0]


_PROVIDERS: dict[str, Callable[..., Callable[[Column], Column]]] = {}


def provider(name: str) -> Callable:
    """Registers a maker of embedders under a name: a function that turns a text column into a vector column."""

    def register(make: Callable) -> Callable:
        _PROVIDERS[name] = make
        return make

    return register


def providers() -> list[str]:
    return sorted(_PROVIDERS)


def embedder(name: str, **settings: object) -> Callable[[Column], Column]:
    """An embedder of a registered provider; ValueError for an unknown name."""
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {', '.join(providers())}")
    return _PROVIDERS[name](**settings)


@provider("hashing")
def _hashing(dim: int = 64) -> Callable[[Column], Column]:
    return lambda text: hashing_embedding(text, dim)


@provider("function")
def _function(encode: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """Any batch encoder, such as a local model's, called with whole Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(encode(s.fillna("").tolist()), index=s.index)

    return lambda text: F.pandas_udf(run, "array<float>")(text)


__all__ = [
    "array_to_vector", "best_of_documents", "broadcast_within", "build_ivf", "embedder", "first_per_document", "hashing_embedding", "l2", "l2_squared",
    "provider", "providers", "recall", "search", "search_each", "search_ivf", "search_lsh", "sign_keys", "vector_to_array",
]
