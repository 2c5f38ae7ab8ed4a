"""Most similar vectors for every vector, by multi-index hashing.

Codes. A bounded sample fits ``rotations`` learned rotations (centred PCA basis,
then iterative quantisation: alternate sign codes and an orthogonal Procrustes
fit). Every vector gets the sign bits of each rotation as one binary code.

Index. The code is cut into substrings of 16 bits. A vector is filed under every
substring. By the pigeonhole principle, with ``m`` substrings, probing each one
within ``radius`` bits retrieves *every* code within Hamming distance
``m * (radius + 1) - 1``, and most codes somewhat beyond. Retrieved codes within
``code_radius`` bits are reranked by their float distance in double precision.

Distribution. There are two ways to bring queries to members, with one result;
the one that sends a query to fewer places is taken. In *blocks* of at most
``cell_rows`` rows: rows lie in groups around centres of the sample, those close to their centre
apart from those on its rim; a block is some groups or a share of one. Every query meets its own
block first, and then only those blocks and groups that can hold something nearer than
its ``k``-th so far: between two centres a group ends at a known place, and what the query is
beyond that is a lower bound of its distance to all of the group. For distances that aren't small
beside a group's radius a higher one is taken, from the mean and the variance of its distances to a row.
Within a group, products of
matrices leave the pairs that are near enough, and of these the ones count that the index
retrieves, so the result is that of probing.
Or in *cells*, a table and a prefix of its substring as long as
needed for cells of about ``cell_rows`` rows: a query visits the cells whose prefix
is within ``radius`` bits of its own, for every table. Cells send less from about
2,000 blocks on (a quarter of a billion rows). A cell that stays too large (many
near copies share a substring) is salted into blocks that each take all of the
cell's queries. Exact copies are collapsed before the search and
given back after it, so a vector held by a third of all rows is searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.runtime import cut

SUB_BITS = 16
BLOCK_ROWS = 4096  # rows of queries that one task takes at a time
QUERY_ROWS = 1 << 17  # rows of queries that one task of the block plan reads in all
GROUPS = 128  # centres of groups, at most
NEAR = 0.7  # of a group's radius: nearer rows than that are only left out for certain
SIGMAS = 5
SOME = 32  # pairs of a query from which its first bound is taken


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): rows whose vector isn't null, has ``dim`` finite components and isn't all zero."""
    v = F.col("v")
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) == dim))
        .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .filter(F.exists(v, lambda x: x != 0))
    )


def fit_rotations(sample: np.ndarray, rotations: int, rounds: int = 25, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, bases): learned rotations, ``bases`` of shape (rotations, dim, dim).

    The first rotation starts from the principal axes, further ones from random
    orthogonal bases; each is then fitted by iterative quantisation.
    """
    mean = sample.mean(axis=0)
    x = sample - mean
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    bases = []
    for k in range(rotations):
        r = axes[:, ::-1] if k == 0 else np.linalg.qr(rng.normal(size=(x.shape[1],) * 2))[0]
        for _ in range(rounds):
            b = np.where(x @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(x.T @ b)
            r = u @ vt
        bases.append(r)
    return mean, np.stack(bases)


def _encode(mean: np.ndarray, bases: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Substrings, (rows, tables) of uint16."""
    bits = np.concatenate([(x - mean) @ r >= 0 for r in bases], axis=1)
    pad = -bits.shape[1] % SUB_BITS
    bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u2").astype(np.uint16)


def _ball(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits`` bits."""
    out = [0]
    for r in range(1, min(radius, bits) + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(bits), r)]
    return np.array(out, dtype=np.uint16)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, 0))


def _words(sub: np.ndarray) -> np.ndarray:
    """Substrings as 64-bit words, for fast Hamming distances."""
    pad = -sub.shape[1] % 4
    return np.ascontiguousarray(np.pad(sub, ((0, 0), (0, pad)))).view(np.uint64)


class _Block:
    """A block of the index in memory: one bucket list for each substring table."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, sub: np.ndarray, tables: list[int]):
        self.ids, self.vec, self.sub, self.words, self.tables = ids, vec, sub, _words(sub), tables
        self.order, self.start = {}, {}
        for t in tables:
            o = np.argsort(sub[:, t], kind="stable").astype(np.int32)
            self.order[t] = o
            self.start[t] = np.searchsorted(sub[o, t], np.arange((1 << SUB_BITS) + 1)).astype(np.int32)

    def probe(self, sub: np.ndarray, masks: np.ndarray, code_radius: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, member position), each once: of the first table that retrieves it."""
        words, qs, ms = _words(sub), [], []
        for t in self.tables:
            probes = sub[:, t, None] ^ masks[None, :]
            lo = self.start[t][probes]
            n = (self.start[t][probes.astype(np.int32) + 1] - lo).ravel()
            hit = np.flatnonzero(n)
            lo, n = lo.ravel()[hit], n[hit]
            total = int(n.sum())
            if not total:
                continue
            q = np.repeat((hit // len(masks)).astype(np.int32), n)
            at = np.arange(total, dtype=np.int32) + np.repeat(lo - (np.cumsum(n) - n).astype(np.int32), n)
            m = self.order[t][at]
            far = np.zeros(total, dtype=np.uint8)
            for w in range(words.shape[1]):
                far += np.bitwise_count(words[q, w] ^ self.words[m, w])
            keep = far <= code_radius
            q, m = q[keep], m[keep]
            first = np.ones(len(q), dtype=bool)
            for e in self.tables[: self.tables.index(t)]:
                first &= np.bitwise_count(sub[q, e] ^ self.sub[m, e]) > radius
            qs.append(q[first])
            ms.append(m[first])
        if not qs:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        return np.concatenate(qs), np.concatenate(ms)


def _nearest(block: _Block, ids: np.ndarray, vec: np.ndarray, sub: np.ndarray, masks: np.ndarray, k: int, code_radius: int, radius: int) -> pd.DataFrame:
    """The ``k`` best members of the block for each query, by (distance, id)."""
    out = []
    for a in range(0, len(ids), 128):
        b = slice(a, a + 128)
        q, m = block.probe(sub[b], masks, code_radius, radius)
        other = block.ids[m] != ids[b][q]
        q, m = q[other], m[other]
        # Single precision picks what is worth the double-precision distance. The
        # components of a difference are exact to a rounding of their own size, so
        # the margin is relative.
        rough = np.empty(len(q), dtype=np.float32)
        for c in range(0, len(q), 1 << 15):
            d = slice(c, c + (1 << 15))
            diff = vec[b][q[d]] - block.vec[m[d]]
            rough[d] = np.einsum("ij,ij->i", diff, diff)
        order = np.argsort(q, kind="stable")
        q, m, rough = q[order], m[order], rough[order]
        edge = np.flatnonzero(np.diff(q, prepend=-1))
        keep = np.ones(len(q), dtype=bool)
        for x, y in zip(edge, [*edge[1:], len(q)]):
            if y - x > k:
                keep[x:y] = rough[x:y] <= np.partition(rough[x:y], k - 1)[k - 1] * 1.0001
        q, m = q[keep], m[keep]
        dist = np.empty(len(q))
        for c in range(0, len(q), 1 << 15):
            d = slice(c, c + (1 << 15))
            dist[d] = np.sqrt(np.square(vec[b][q[d]].astype(np.float64) - block.vec[m[d]].astype(np.float64)).sum(axis=1))
        order = np.lexsort((block.ids[m], dist, q))
        q, m, dist = q[order], m[order], dist[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        top = place < k
        out.append(pd.DataFrame({"id": ids[b][q[top]], "other": block.ids[m[top]], "dist": dist[top]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame([], columns=["id", "other", "dist"])


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    """A column of binary values, or of lists, as a matrix."""
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        offsets = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_binary(col.type) else np.int64)
        a, b = offsets[col.offset], offsets[col.offset + len(col)]
        return np.frombuffer(col.buffers()[2], np.uint8)[a:b].view(np.float32).reshape(-1, dim)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _binary(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def _codes(code: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.concatenate([_encode(*code, x[a : a + 16_384].astype(np.float64)) for a in range(0, max(len(x), 1), 16_384)])


def _square(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class _Groups:
    """Centres of a sample. Group 2c holds the rows that are close to centre c, 2c + 1 the others that are nearest to it."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 7):
        count = max(1, min(GROUPS, n // 256, len(sample) // 16))
        c = sample[np.random.default_rng(seed).choice(len(sample), count, replace=False)]
        for _ in range(12):
            near = self._near(sample, c)
            size = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, sample)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        left, chain = list(range(1, len(c))), [0]
        while left:  # centres beside each other get numbers beside each other, and so lie in one block
            chain.append(left.pop(int(_square(c[left] - c[chain[-1]]).argmin())))
        self.centres = c[chain]
        near = self._near(sample, self.centres)
        far = np.sqrt(_square(sample - self.centres[near]))
        self.close = np.array([1.25 * np.median(far[near == k]) if (near == k).any() else 0.0 for k in range(len(c))])
        # Lengths between centres; no bound is taken between equal ones.
        apart = np.sqrt(np.maximum(_square((self.centres[:, None] - self.centres[None]).reshape(-1, c.shape[1])), 0)).reshape(len(c), len(c))
        self.apart = np.where(apart > 1e-6 * (1 + np.abs(c).max()), apart, np.inf)
        # How the sample lies around its centres, for all groups together: the variance along w is the squared length of w @ spread.
        rest = sample - self.centres[near]
        worth, axes = np.linalg.eigh(rest.T @ rest / max(np.square(rest).sum(), 1e-300))
        self.spread = axes * np.sqrt(np.maximum(worth, 0))

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (x @ c.T - _square(c) / 2).argmax(axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Groups of the rows."""
        x = x.astype(np.float64)
        near = self._near(x, self.centres)
        return 2 * near + (np.sqrt(_square(x - self.centres[near])) > self.close[near])

    def bounds(self, x: np.ndarray, group: np.ndarray, extent: _Extent) -> np.ndarray:
        """Lower bounds of the distance of each row to all of each group, (rows, groups); rows are of ``group``.

        Sound up to ``NEAR`` of the group's own radius. Beyond, squared distances to a group's rows also
        count as at least ``SIGMAS`` standard deviations below their mean, which is far below any that was seen.
        """
        x = x.astype(np.float64)
        own, some, c = group // 2, extent.size > 0, self.centres
        to, long = x @ c.T, _square(x)
        ahead = np.repeat(to[np.arange(len(x)), own][:, None] - to, 2, axis=1)
        sound = np.where(some, (ahead - np.where(some[:, None], extent.reach, 0)[:, own].T) / np.repeat(self.apart[own], 2, axis=1), np.inf)
        sound = np.maximum(sound - 1e-9 * (1 + np.sqrt(long))[:, None], 0)
        count = np.maximum(extent.size, 1)
        mean = extent.square / count
        var = np.maximum(extent.fourth / count - np.square(mean), 0)
        lx, lc = x @ self.spread, c @ self.spread
        way = np.repeat(np.maximum(long[:, None] + _square(c) - 2 * to, 0), 2, axis=1)
        along = np.repeat(np.maximum(_square(lx)[:, None] + _square(lc) - 2 * lx @ lc.T, 0), 2, axis=1)
        likely = np.sqrt(np.maximum(way + mean - SIGMAS * np.sqrt(var + 4 * along * mean), 0))
        return np.where(sound <= NEAR * np.sqrt(mean), sound, np.maximum(sound, likely))


class _Extent:
    """Of each group the number of its rows, the sums of the squared and fourth powers of their distances to their centre, and how far it reaches from there towards each centre (-inf: empty)."""

    def __init__(self, groups: _Groups):
        k = len(groups.close)
        self.size, self.square, self.fourth, self.reach = np.zeros(2 * k), np.zeros(2 * k), np.zeros(2 * k), np.full((2 * k, k), -np.inf)

    def add(self, groups: _Groups, x: np.ndarray) -> None:
        g, x = groups.of(x), x.astype(np.float64)
        square = _square(x - groups.centres[g // 2])
        towards = x @ groups.centres.T
        towards -= towards[np.arange(len(x)), g // 2][:, None]
        order = np.argsort(g, kind="stable")
        start = np.flatnonzero(np.diff(g[order], prepend=-1))
        reach = np.full_like(self.reach, -np.inf)
        if len(start):
            reach[g[order][start]] = np.maximum.reduceat(towards[order], start)
        count = [np.bincount(g, weights, minlength=len(reach)) for weights in (None, square, np.square(square))]
        self.join([np.concatenate([np.stack(count, axis=1), reach], axis=1)])

    def table(self) -> np.ndarray:
        return np.concatenate([np.stack([self.size, self.square, self.fourth], axis=1), self.reach], axis=1)

    def join(self, tables: Iterable[np.ndarray]) -> None:
        for x in tables:
            self.size, self.square, self.fourth = self.size + x[:, 0], self.square + x[:, 1], self.fourth + x[:, 2]
            self.reach = np.maximum(self.reach, x[:, 3:])


class _Members:
    """A block's members in memory, by group, as differences from their centre."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, group: np.ndarray, groups: _Groups, code: tuple[np.ndarray, np.ndarray], index: tuple[int, int]):
        order = np.argsort(group, kind="stable")
        self.ids, self.vec, group = ids[order], vec[order], group[order]
        self.groups, self.code = groups, code
        self.code_radius, self.radius = index
        self.sub = _codes(code, self.vec)
        self.words = _words(self.sub)
        self.kind = np.float32 if not len(vec) or np.abs(vec).max() < 1e15 else np.float64
        start = np.flatnonzero(np.diff(group, prepend=-1))
        self.parts = {int(group[a]): slice(a, b) for a, b in zip(start, [*start[1:], len(group)])}
        # The last component makes a product half of the squared length of q less the squared distance.
        diff = self.vec.astype(self.kind) - groups.centres[group // 2].astype(self.kind)
        self.half = _square(diff) / 2
        self.diff = np.concatenate([diff, -self.half[:, None]], axis=1)

    def _retrieved(self, sub: np.ndarray, words: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        far = np.bitwise_count(words[q] ^ self.words[m]).sum(axis=1, dtype=np.int32) <= self.code_radius
        at = np.flatnonzero(far)
        far[at] = (np.bitwise_count(sub[q[at]] ^ self.sub[m[at]]) <= self.radius).any(axis=1)
        return far

    def nearest(self, ids: np.ndarray, vec: np.ndarray, bounds: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(q, other, dist) by (q, dist, other): the ``k`` best retrieved members for each query, as far as they are within ``limit``.

        ``bounds`` of the queries' distances to groups. Products of limited precision only choose; they are taken with a margin.
        """
        sub = _codes(self.code, vec)
        words, n = _words(sub), len(ids)
        best = np.full((n, k), np.inf)  # squared distances with their margins
        top = np.square(limit)
        qs, ms, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        kind = self.kind if not n or np.abs(vec).max() < 1e15 else np.float64
        for g in sorted(self.parts, key=lambda g: float(bounds[:, g].mean())):
            part = self.parts[g]
            near = np.flatnonzero(np.square(bounds[:, g]) <= top)
            if not len(near):
                continue
            diff = np.ascontiguousarray(vec[near].astype(kind) - self.groups.centres[g // 2].astype(kind))
            length = _square(diff).astype(np.float64)
            diff = np.concatenate([diff, np.ones((len(near), 1), kind)], axis=1)
            for a in range(part.start, part.stop, 4096):
                m = slice(a, min(a + 4096, part.stop))
                margin = 1e-5 * (length + 2 * float(self.half[m].max())) + 1e-36
                product = diff @ self.diff[m].T
                new = np.flatnonzero(np.isinf(top[near]))
                if len(new) and m.stop - m.start > SOME:
                    # A bound from some of the pairs, so that not all of them have to be looked at.
                    cols = np.argpartition(product[new], -SOME, axis=1)[:, -SOME:]
                    rows = np.repeat(new, SOME)
                    other = cols.ravel() + a
                    ok = (self.ids[other] != ids[near[rows]]) & self._retrieved(sub, words, near[rows], other)
                    d = length[rows] - 2.0 * product[rows, cols.ravel()] + margin[rows]
                    some = np.sort(np.where(ok, d, np.inf).reshape(-1, SOME), axis=1)[:, k - 1] if k <= SOME else np.full(len(new), np.inf)
                    top[near[new]] = np.minimum(top[near[new]], some * (1 + 1e-9))
                # The least product that is still near enough, rounded down.
                least = (length - top[near] - margin) / 2
                least = (least - np.abs(least) * 1e-6).astype(kind)
                hit = np.flatnonzero(product >= least[:, None])
                if not len(hit):
                    continue
                r, other = hit // product.shape[1], hit % product.shape[1] + a
                d = length[r] - 2.0 * product.ravel()[hit]
                q = near[r]
                ok = (self.ids[other] != ids[q]) & self._retrieved(sub, words, q, other)
                q, other, r, d = q[ok], other[ok], r[ok], d[ok]
                if not len(q):
                    continue
                qs.append(q)
                ms.append(other)
                ds.append(d - margin[r])
                order = np.lexsort((d, q))
                q, d = q[order], (d + margin[r])[order]
                place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
                few = place < k
                fresh = np.full((n, k), np.inf)
                fresh[q[few], place[few]] = d[few]
                rows = np.unique(q)
                best[rows] = np.sort(np.concatenate([best[rows], fresh[rows]], axis=1), axis=1)[:, :k]
                top[rows] = np.minimum(top[rows], best[rows, k - 1] * (1 + 1e-9))
        q, m, d = np.concatenate(qs), np.concatenate(ms), np.concatenate(ds)
        keep = d <= top[q]
        q, m = q[keep], m[keep]
        dist = np.empty(len(q))
        for c in range(0, len(q), 1 << 15):
            s = slice(c, c + (1 << 15))
            dist[s] = np.sqrt(np.square(vec[q[s]].astype(np.float64) - self.vec[m[s]].astype(np.float64)).sum(axis=1))
        order = np.lexsort((self.ids[m], dist, q))
        q, m, dist = q[order], m[order], dist[order]
        few = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        return q[few], self.ids[m[few]], dist[few]


def _in_blocks(reps: DataFrame, n: int, sample: np.ndarray, code: tuple[np.ndarray, np.ndarray], k: int, dim: int, cell_rows: int, index: tuple[int, int]) -> DataFrame:
    """(id, l): for each of ``reps`` (id, v) candidates (dist, other), its ``k`` best retrieved ones among them, by blocks."""
    spark = reps.sparkSession
    groups = _Groups(sample, n)
    kinds = 2 * len(groups.close)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if len(x):
                v = _vectors(x["v"], dim)
                yield pa.RecordBatch.from_arrays([x["id"], _binary(v), pa.array(groups.of(v).astype(np.int32))], ["id", "v", "g"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Extent(groups)
        for x in batches:
            if len(x):
                part.add(groups, _vectors(x["v"], dim))
        yield pa.RecordBatch.from_arrays([pa.array([part.table().tobytes()])], ["x"])

    placed = cut(reps.select("id", "v").mapInArrow(place, "id long, v binary, g int"))
    few = placed.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(measure, "x binary")
    extent = _Extent(groups)
    extent.join(np.frombuffer(r["x"]).reshape(kinds, -1) for r in few.toLocalIterator())
    size = extent.size.astype(np.int64)
    # Groups in order, those close to their centres first, fill blocks; a large one is drawn into several by hash.
    room = min(cell_rows, max(BLOCK_ROWS, -(-n // (3 * spark.sparkContext.defaultParallelism))))
    first, shares, last, left = np.zeros(kinds, np.int64), np.ones(kinds, np.int64), -1, 0
    held: list[list[int]] = []  # groups of each block
    for g in [*range(0, kinds, 2), *range(1, kinds, 2)]:
        if size[g] > left:
            shares[g] = max(1, -(-size[g] // room))
            first[g], last, left = last + 1, last + shares[g], room - size[g] if shares[g] == 1 else 0
            held += [[g] for _ in range(shares[g])]
        elif size[g]:
            first[g], left = last, left - size[g]
            held[last].append(g)
    holds = np.zeros((len(held), kinds), bool)
    for b, gs in enumerate(held):
        holds[b, gs] = True
    at = F.col("g") + 1
    table = lambda x: F.array(*[F.lit(int(i)) for i in x])
    home = (F.element_at(table(first), at) + F.pmod(F.xxhash64("id"), F.element_at(table(shares), at))).cast("int")

    def answers(x: pa.Table, members: pa.Table, limits: np.ndarray, block: int, on: bool) -> Iterator[pa.RecordBatch]:
        """For the queries ``x`` the best of ``members``, and ``on``: the other blocks that can hold better ones."""
        here = _Members(members["id"].to_numpy(), _vectors(members["v"].combine_chunks(), dim), members["g"].to_numpy(), groups, code, index)
        ids, vec, g = x["id"].to_numpy(), _vectors(x["v"].combine_chunks(), dim), x["g"].to_numpy()
        order = np.argsort(g, kind="stable")
        for a in range(0, len(order), 512):
            o = order[a : a + 512]
            v, bounds = vec[o], groups.bounds(vec[o], g[o], extent)
            q, other, dist = here.nearest(ids[o], v, bounds, limits[o], k)
            offsets = np.searchsorted(q, np.arange(len(o) + 1)).astype(np.int32)
            found = [pa.array(ids[o]), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(dist))]
            if not on:
                yield pa.RecordBatch.from_arrays(found, ["id", "other", "dist"])
                continue
            full = np.diff(offsets) >= k
            limit = np.where(full, dist[np.maximum(offsets[1:] - 1, 0)] if len(dist) else 0.0, np.inf) * (1 + 1e-9)
            open_ = (bounds <= limit[:, None]) & np.isfinite(bounds)
            visit = (open_.astype(np.float32) @ holds.T.astype(np.float32)) > 0
            visit[:, block] = False
            starts = np.concatenate([[0], np.cumsum(visit.sum(axis=1))]).astype(np.int32)
            visits = pa.ListArray.from_arrays(starts, pa.array(np.nonzero(visit)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*found, _binary(v), pa.array(g[o]), pa.array(limit), visits], ["id", "other", "dist", "v", "g", "far", "visits"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if every := [x for x in batches if len(x)]:
            x = pa.Table.from_batches(every)
            yield from answers(x, x, np.full(len(x), np.inf), x["b"][0].as_py(), True)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if every := [x for x in batches if len(x)]:
            got = pa.Table.from_batches(every)
            member = got["far"].is_null()
            x, members = got.filter(got["far"].is_valid()), got.filter(member)
            if len(x):
                yield from answers(x, members, x["far"].to_numpy(), -1, False)

    result = "id long, other array<long>, dist array<double>"
    begun = placed.withColumn("b", home).repartitionById(len(held), F.col("b")).mapInArrow(own, f"{result}, v binary, g int, far double, visits array<int>")
    begun = cut(begun)
    asking = begun.select("id", "v", "g", "far", F.explode("visits").alias("b"))
    asked = {r["b"]: r["n"] for r in asking.groupBy("b").agg(F.count("*").alias("n")).collect()}
    found = begun.select("id", "other", "dist")
    if asked:
        # A block meets its visitors in as many parts as keep a task below about QUERY_ROWS of them and all cores busy.
        most = min(QUERY_ROWS, max(BLOCK_ROWS, -(-sum(asked.values()) // (3 * spark.sparkContext.defaultParallelism))))
        parts = np.array([-(-asked.get(b, 0) // most) for b in range(len(held))])
        start, b1 = np.cumsum(parts) - parts, F.col("b") + 1
        asking = asking.select("id", "v", "g", "far", (F.element_at(table(start), b1) + F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.element_at(table(parts), b1), F.lit(1)))).cast("int").alias("t"))
        members = placed.withColumn("b", home).filter(F.element_at(table(parts), b1) > 0)
        members = members.select("id", "v", "g", F.lit(None).cast("double").alias("far"), F.explode(F.sequence(F.element_at(table(start), b1), F.element_at(table(start + parts), b1) - 1)).alias("t"))
        later = asking.unionByName(members).repartitionById(int(parts.sum()), F.col("t")).mapInArrow(others, result)
        found = found.unionByName(later.filter(F.size("other") > 0))
    return found.select("id", F.arrays_zip("dist", "other").alias("l"))


def _cells(n: int, tables: int, cell_rows: int, radius: int) -> int:
    """Bits of the prefix that names a cell; 0 where blocks send a query to no more places than cells would."""
    blocks = -(-n // cell_rows)
    bits = min(SUB_BITS, math.ceil(math.log2(max(1, blocks))))
    return bits if blocks > tables * len(_ball(bits, radius)) else 0


def _in_cells(reps: DataFrame, code: tuple[np.ndarray, np.ndarray], bits: int, k: int, cell_rows: int, code_radius: int, radius: int) -> DataFrame:
    """What :func:`_in_blocks` gives, by cells that a prefix of ``bits`` bits names."""
    mean, bases = code
    masks, near = _ball(SUB_BITS, radius), _ball(bits, radius)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                sub = _encode(mean, bases, _matrix(x["v"]).astype(np.float64))
                yield pd.DataFrame({"id": x["id"], "v": x["v"], "sub": list(sub.astype(np.int32))})

    coded = reps.select("id", "v").mapInPandas(encode, "id long, v array<float>, sub array<int>")
    shift = SUB_BITS - bits
    members = coded.select("id", "v", "sub", F.posexplode("sub").alias("t", "x")).select(
        "id", "v", "sub", (F.col("t").cast("long") * (1 << SUB_BITS) + F.shiftright("x", shift)).alias("cell")
    )
    flips = F.array(*[F.lit(int(x)) for x in near])
    visits = (
        coded.select("id", "v", "sub", F.posexplode("sub").alias("t", "x"))
        .select("id", "v", "sub", "t", "x", F.explode(flips).alias("f"))
        .select("id", "v", "sub", (F.col("t").cast("long") * (1 << SUB_BITS) + F.shiftright("x", shift).bitwiseXOR(F.col("f"))).alias("cell"))
    )
    # Members of a cell in blocks of bounded size: a task holds one block of members. The counts are at most tables * 2^16 rows.
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(cell_rows))).cast("int").alias("salts"))
    salted = members.join(F.broadcast(sizes), "cell").select(
        "cell",
        F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"),
        "id", "v", "sub", F.lit(True).alias("member"),
    )
    asking = visits.join(F.broadcast(sizes), "cell").select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        "id", "v", "sub", F.lit(False).alias("member"),
    )

    def search(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members come first (sorted), then queries, block by block."""
        table = [int(key[0]) >> SUB_BITS]
        held: list[pd.DataFrame] = []
        block, queries, waiting = None, [], 0

        def answer(x: pd.DataFrame) -> pd.DataFrame:
            sub = _matrix(x["sub"]).astype(np.uint16)
            return _nearest(block, x["id"].to_numpy(), _matrix(x["v"]), sub, masks, k, code_radius, radius)

        for x in batches:
            m = x[x["member"]]
            if len(m):
                held.append(m)
            q = x[~x["member"]]
            if len(q):
                if block is None:
                    if not held:
                        return
                    all_ = pd.concat(held, ignore_index=True)
                    held = []
                    block = _Block(all_["id"].to_numpy(), _matrix(all_["v"]), _matrix(all_["sub"]).astype(np.uint16), table)
                queries.append(q)
                waiting += len(q)
                if waiting >= BLOCK_ROWS:
                    yield answer(pd.concat(queries, ignore_index=True))
                    queries, waiting = [], 0
        if waiting:
            yield answer(pd.concat(queries, ignore_index=True))

    joint = salted.unionByName(asking)
    tasks = joint.repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("member"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cuts a sorted partition into its (cell, salt) groups without holding one whole."""
        def pieces() -> Iterator[tuple[tuple, pd.DataFrame]]:
            for x in batches:
                for key, y in x.groupby(["cell", "salt"], sort=True):
                    yield key, y.sort_values("member", ascending=False, kind="stable")

        stream = pieces()
        ahead = next(stream, None)
        while ahead is not None:
            key, rest = ahead[0], []

            def group(first: pd.DataFrame = ahead[1], key: tuple = key, rest: list = rest) -> Iterator[pd.DataFrame]:
                yield first
                for kk, y in stream:
                    if kk != key:
                        rest.append((kk, y))
                        return
                    yield y

            own = group()
            yield from search(key, own)
            for _ in own:  # what the search left unread
                pass
            ahead = rest[0] if rest else None

    partial = tasks.mapInPandas(walk, "id long, other long, dist double")
    pairs = partial.dropDuplicates(["id", "other"])
    return pairs.groupBy("id").agg(F.collect_list(F.struct("dist", "other")).alias("l"))


def nearest_vectors(
    df: DataFrame,
    k: int = 5,
    id_col: str = "id",
    vec_col: str = "embedding",
    dim: int = 64,
    rotations: int = 2,
    radius: int = 3,
    code_radius: int = 52,
    sample_rows: int = 10_000,
    cell_rows: int = 131_072,
) -> DataFrame:
    """(id, neighbour, rank, distance): the ``k`` most similar other rows of every usable row.

    Distances are Euclidean in double precision; equal distances are ranked by
    the smaller id. Rows with a null id or an unusable vector (null, other
    length, null or non-finite components, all zero) neither ask nor answer; an
    empty table gives no rows. ids are taken as unique; exact copies of a vector
    under other ids are neighbours at distance 0. Columns other than id and
    vector are ignored, whatever their names. With fewer than ``k`` other rows
    in reach, fewer come out.

    ``sample_rows`` bounds only the sample that fits the rotations; every row is
    indexed. The measured recall is in the README.
    """
    rows = cut(usable(df, id_col, vec_col, dim))
    spark = rows.sparkSession
    # One representative for each distinct vector, with its k + 1 smallest ids.
    copies = rows.groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    reps = cut(copies.select(F.col("rep").alias("id"), "v", "n"))
    n = reps.count()
    bounded = reps.orderBy(F.xxhash64("id")).limit(sample_rows).select("v").toPandas()
    tables = -(-rotations * dim // SUB_BITS)
    if n == 0:
        return spark.createDataFrame([], "id long, neighbour long, rank int, distance double")
    mean, bases = fit_rotations(_matrix(bounded["v"]).astype(np.float64), rotations)
    bits = _cells(n, tables, cell_rows, radius)
    if bits == 0:
        lists = _in_blocks(reps, n, _matrix(bounded["v"]).astype(np.float64), (mean, bases), k, dim, cell_rows, (code_radius, radius))
    else:
        lists = _in_cells(reps, (mean, bases), bits, k, cell_rows, code_radius, radius)
    # Distinct vectors -> rows: every row takes the copies of its own vector
    # first, then those of the near ones; of a vector's copies the k + 1 smallest
    # ids are enough.
    best = (
        lists.groupBy("id")
        .agg(F.array_sort(F.flatten(F.collect_list("l"))).alias("l"))
        .select("id", F.explode(F.slice("l", 1, k)).alias("e"))
        .select(F.col("id").alias("rep"), F.col("e.other").alias("near"), F.col("e.dist").alias("dist"))
    )
    return _expand(rows, reps, best, k)


def _expand(rows: DataFrame, reps: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Neighbours among rows from neighbours among distinct vectors."""
    single = reps.filter(F.col("n") == 1).select(F.col("id").alias("rep"), F.array("id").alias("ids"))
    # A hash of the vector comes first among the keys, as sorting by long arrays is slow.
    shared = reps.filter(F.col("n") > 1).select(F.xxhash64("v").alias("h"), "v", F.col("id").alias("rep"))
    member = rows.withColumn("h", F.xxhash64("v")).join(shared, ["h", "v"]).select("rep", "id")
    # Smallest ids of a group in two steps, so that no task gathers a hot group.
    few = member.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = few.groupBy("rep", "salt").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    groups = few.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    ids = single.unionByName(groups)
    near = best.join(ids.withColumnRenamed("rep", "near"), "near").select(
        "rep", F.explode(F.transform("ids", lambda i: F.struct(F.col("dist").alias("d"), i.alias("i")))).alias("e")
    )
    own = groups.select("rep", F.explode(F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("i")))).alias("e"))
    lists = (
        near.unionByName(own)
        .groupBy("rep")
        .agg(F.slice(F.array_sort(F.collect_list("e")), 1, k + 1).alias("l"))
    )
    everyone = single.select("rep", F.col("rep").alias("id")).unionByName(member)
    return (
        everyone.join(lists, "rep")
        .select("id", F.filter("l", lambda e: e["i"] != F.col("id")).alias("l"))
        .select("id", F.posexplode(F.slice("l", 1, k)).alias("p", "e"))
        .select("id", F.col("e.i").alias("neighbour"), (F.col("p") + 1).cast("int").alias("rank"), F.col("e.d").alias("distance"))
    )


def near_pairs(neighbours: DataFrame, limit: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs within ``limit`` of which one row has the other among its neighbours."""
    return (
        neighbours.filter(F.col("distance") <= limit)
        .select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
        .distinct()
    )
