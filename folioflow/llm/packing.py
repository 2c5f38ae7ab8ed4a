"""Filling fixed-capacity containers with texts, by swap-based local search.

Texts are spread by hash over shards of bounded size and every shard is packed on
its own: best fit in falling order gives a start, then a local search works on the
underfull containers. It moves one item, exchanges one for one or two for one,
each time so that the sum of squared fills grows, and so drains the emptiest
containers until they vanish. A shard of tens of thousands of texts leaves at
most a few containers part-filled, so sharding costs next to nothing while no
task ever sees more than a shard.

Only texts above the capacity are divided, at white space where possible and
never within a character.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.mixing import byte_size


def divide(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, size) of parts of at most ``capacity`` tokens (UTF-8 bytes plus an end token each).

    Each part is as long as it can be, cut back to white space in its last tenth;
    a part never ends within a character. Raises ValueError below a capacity of 5,
    which a single character may need.
    """
    if capacity < 5:
        raise ValueError("a container must hold at least one character and its end token")
    out, a, room = [], 0, capacity - 1
    while a < len(text):
        b, used = a, 0
        step = text[a : a + room]
        raw = step.encode("utf-8", "surrogatepass")
        if len(raw) <= room:
            b, used = a + len(step), len(raw)
        else:
            kept = raw[:room].decode("utf-8", "ignore")
            b = a + len(kept)
            if b < len(text):
                for c in range(b, max(a + 1, b - max(1, len(kept) // 10)), -1):
                    if text[c - 1].isspace():
                        b = c
                        break
            used = len(text[a:b].encode("utf-8", "surrogatepass"))
        out.append((a, b, used + 1))
        a = b
    return out or [(0, 0, 1)]


class _Bins:
    """Containers of one capacity, with items as indices into ``size``."""

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def start(self) -> None:
        """Best fit in falling order."""
        gaps: list[tuple[int, int]] = []
        for i in sorted(range(len(self.size)), key=lambda i: (-self.size[i], i)):
            s = self.size[i]
            p = bisect_left(gaps, (s, -1))
            if p < len(gaps):
                room, b = gaps.pop(p)
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([])
                self.free.append(self.capacity)
            self.items[b].append(i)
            self.free[b] = room - s
            if room - s:
                insort(gaps, (room - s, b))

    def improve(self, rounds: int) -> None:
        """Drains the emptiest containers into the other underfull ones, ``rounds`` times over at most."""
        for _ in range(rounds):
            order = sorted((b for b in range(len(self.items)) if self.items[b] and self.free[b]), key=lambda b: (-self.free[b], b))
            if len(order) < 2 or not any([self._drain(b, order) for b in order[: max(2, len(order) // 4)]]):
                return

    def _drain(self, low: int, order: list[int]) -> bool:
        """Moves fill out of ``low``; every step makes a fuller container fuller."""
        changed = False
        for b in order:
            if b == low or not self.items[b] or not self.items[low]:
                continue
            if self.capacity - self.free[b] < self.capacity - self.free[low]:
                continue
            while self.free[b] and self.items[low] and self._step(low, b):
                changed = True
        return changed

    def _step(self, low: int, b: int) -> bool:
        """The move or exchange between ``low`` and ``b`` that fills ``b`` most."""
        gap = self.free[b]
        mine = sorted((self.size[i], i) for i in self.items[low])
        theirs = sorted((self.size[i], i) for i in self.items[b])
        best = (0, None, None)
        p = bisect_right(mine, (gap, math.inf))
        if p:  # one item moves
            best = (mine[p - 1][0], [mine[p - 1][1]], [])
        for s, i in theirs:  # one for one: a larger item comes in
            p = bisect_right(mine, (s + gap, math.inf))
            if p and mine[p - 1][0] - s > best[0]:
                best = (mine[p - 1][0] - s, [mine[p - 1][1]], [i])
        if best[0] < gap and len(mine) > 1:  # two of low for one of b (or for none)
            for s, i in [(0, -1), *theirs]:
                want, x, y = s + gap, 0, len(mine) - 1
                while x < y:
                    t = mine[x][0] + mine[y][0]
                    if t > want:
                        y -= 1
                        continue
                    if t - s > best[0]:
                        best = (t - s, [mine[x][1], mine[y][1]], [i] * (i >= 0))
                    x += 1
        if best[0] < gap and len(theirs) > 1:  # one of low for two of b
            for s, i in mine:
                x, y = 0, len(theirs) - 1
                while x < y:
                    t = theirs[x][0] + theirs[y][0]
                    if t < s - gap:
                        x += 1
                        continue
                    if s - t > best[0]:
                        best = (s - t, [i], [theirs[x][1], theirs[y][1]])
                    y -= 1
        gain, out, back = best
        if not gain:
            return False
        for i in out:
            self.items[low].remove(i)
            self.items[b].append(i)
        for i in back:
            self.items[b].remove(i)
            self.items[low].append(i)
        self.free[b] -= gain
        self.free[low] += gain
        return True


def pack_sizes(size: list[int], capacity: int, rounds: int = 6) -> list[int]:
    """The container of each item, numbered from 0 without gaps; no container exceeds ``capacity``.

    Items must not exceed the capacity (ValueError).
    """
    if any(s > capacity for s in size):
        raise ValueError("an item exceeds the capacity")
    bins = _Bins(size, capacity)
    bins.start()
    bins.improve(rounds)
    out, k = [0] * len(size), 0
    for items in bins.items:
        for i in items:
            out[i] = k
        k += bool(items)
    return out


def pack_documents(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 20_000, rounds: int = 6) -> DataFrame:
    """(spec_id, shard, bin, doc_id, part, parts, start, end, size): every text in a container of every spec.

    A container is named by (spec_id, shard, bin). ``size`` is the size of the part
    in tokens, [start, end) its characters; a text within the capacity is one part.
    A null text counts as empty (size 1); rows with a null id are left out; ids are
    taken as unique. Specs with a null id or capacity are left out, a capacity below
    5 raises. An empty table gives no rows; other columns are ignored.
    ``shard_rows`` bounds what a task packs; all texts are packed at any size.
    """
    wanted = specs.select("spec_id", "capacity").dropna().distinct().orderBy("spec_id", "capacity").limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("at most 10,000 specs")
    if any(w.capacity < 5 for w in wanted):
        raise ValueError("a container must hold at least one character and its end token")
    spark = docs.sparkSession
    out = "spec_id int, shard int, bin int, doc_id long, part int, parts int, start int, end int, size int"
    if not wanted:
        return spark.createDataFrame([], out)
    least = min(w.capacity for w in wanted)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).filter("doc_id is not null")
    sized = texts.select("doc_id", F.char_length("_text").alias("end"), byte_size(F.col("_text")).alias("size"), "_text")
    caps = F.array(*[F.struct(F.lit(w.spec_id).cast("int").alias("spec_id"), F.lit(w.capacity).cast("long").alias("capacity")) for w in wanted])
    whole = (
        sized.drop("_text")
        .select("doc_id", "end", "size", F.explode(caps).alias("c"))
        .filter("size <= c.capacity")
        .select(
            "c.spec_id", "c.capacity", "doc_id",
            F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(0).alias("start"), F.col("end").cast("int").alias("end"), F.col("size").cast("int").alias("size"),
        )
    )
    pairs = [(int(w.spec_id), int(w.capacity)) for w in wanted]

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for i, text, n in zip(x["doc_id"], x["_text"], x["size"]):
                for spec, capacity in pairs:
                    if n > capacity:
                        parts = divide(text, capacity)
                        rows += [(spec, capacity, i, k, len(parts), a, b, s) for k, (a, b, s) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["spec_id", "capacity", "doc_id", "part", "parts", "start", "end", "size"])

    large = sized.filter(F.col("size") > least).select("doc_id", "_text", "size")
    divided = large.mapInPandas(cut_up, "spec_id int, capacity long, doc_id long, part int, parts int, start int, end int, size int")
    shards = max(1, -(-texts.select("doc_id").count() // shard_rows))
    items = whole.unionByName(divided).withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int"))

    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc_id", "part"], ignore_index=True)
        x["bin"] = pack_sizes(x["size"].tolist(), int(x["capacity"].iloc[0]), rounds)
        return x[["spec_id", "shard", "bin", "doc_id", "part", "parts", "start", "end", "size"]]

    # An explicit number of partitions, as packing costs time far beyond its bytes.
    spread = items.repartition(max(1, min(8 * shards * len(wanted), 4096)), "spec_id", "capacity", "shard")
    return spread.groupBy("spec_id", "capacity", "shard").applyInPandas(pack, out)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, containers, used, fill): fill is the used share of all containers' room."""
    bins = packed.groupBy("spec_id", "shard", "bin").agg(F.sum("size").alias("used"))
    per = bins.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("used"))
    caps = specs.select("spec_id", "capacity").dropna().distinct()
    return per.join(F.broadcast(caps), "spec_id").select(
        "spec_id", "capacity", "containers", "used", (F.col("used") / (F.col("containers") * F.col("capacity"))).alias("fill")
    )
