"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text starts as atomic segments: words, each with the white space after it
(a word longer than the limit is first cut hard). Between neighbours lies a
boundary with a strength: nothing, word, clause, line, sentence, paragraph.
A heap holds the adjacent pairs; the weakest boundary is merged first, of equally
weak ones the pair with the smaller union, as long as the union and the overlap
that it must carry fit into the limit. What can't be merged any more stays
a boundary between pieces, so cuts fall on the strongest ones.

Every piece but the first starts with text of the piece before: about the wanted
number of characters, from the best boundary in that neighbourhood.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.runtime import broadcast_within

#: Characters taken off both ends of a text before its length counts.
EDGE = " \t\r\n"
NOTHING, WORD, CLAUSE, LINE, SENTENCE, PARAGRAPH = range(6)

_SEGMENT = re.compile(r"\S+\s*|\s+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:–—][\"'”’»)\]]*$")
#: Abbreviations after which a stop doesn't end a sentence (fixed values).
_ABBREVIATED = re.compile(r"^(?:Dr|Prof|Mr|Mrs|Ms|Fig|Sec|Eq|Tab|Nr|cf|vs|etc|al|bzw|ca|z\.B|e\.g|i\.e|p|pp|[A-Z])\.$", re.IGNORECASE)


def boundary(segment: str) -> int:
    """Strength of the boundary after a segment (a word and the white space behind it)."""
    word = segment.rstrip()
    space = segment[len(word) :]
    if not space:
        return NOTHING
    breaks = space.count("\n")
    if breaks > 1:
        return PARAGRAPH
    if _SENTENCE_END.search(word) and not _ABBREVIATED.match(word.lstrip("([\"“'")):
        return SENTENCE
    if breaks or "\r" in space:
        return LINE
    return CLAUSE if _CLAUSE_END.search(word) else WORD


def atoms(text: str, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of the atomic segments."""
    out = []
    for m in _SEGMENT.finditer(text):
        a, b = m.span()
        while b - a > limit:
            out.append((a, a + limit, NOTHING))
            a += limit
        out.append((a, b, boundary(text[a:b])))
    return out


def _seam(text: str, start: int, end: int, want: int, room: int) -> int:
    """Where the overlap taken from text[start:end] begins; ``end`` for none.

    Looks in the last half to one and a half times ``want`` characters, never
    more than ``room``: the strongest boundary wins, then the one nearest to ``want``.
    """
    most = min(room, want + want // 2, end - start)
    if want <= 0 or most <= 0:
        return end
    best, at = None, end - min(want, most)
    for m in re.finditer(r"\s+", text[end - most - 1 if end - most > start else start : end]):
        p = (end - most - 1 if end - most > start else start) + m.end()
        if not end - most <= p < end or end - p < want // 2:
            continue
        a = p - len(m.group()) - 1
        while a > start and not text[a - 1].isspace():
            a -= 1
        rank = (boundary(text[max(a, start) : p]), -abs(end - p - want))
        if best is None or rank > best:
            best, at = rank, p
    return at


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(overlap start, core start, core end) of each piece; cores tile the text.

    ``text`` must have been stripped; the piece is text[overlap start:core end].
    A text within the limit gives one piece. Raises ValueError unless limit > 0.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    room = limit - overlap  # every core leaves room for the overlap before it
    parts = atoms(text, room)
    n = len(parts)
    start, end = [p[0] for p in parts], [p[1] for p in parts]
    strength = [p[2] for p in parts]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def size(i: int, j: int) -> int:
        # White space at the end of a piece is not part of it.
        e = end[j]
        while e > start[i] and text[e - 1] in EDGE:
            e -= 1
        return e - start[i]

    heap = [(strength[i], size(i, i + 1), i, start[i], end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, total, i, a, e = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or start[i] != a or end[j] != e or total > room:
            continue  # out of date, or too large: sizes only grow
        end[i], strength[i], right[i], alive[j] = end[j], strength[j], right[j], False
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (strength[i], size(i, right[i]), i, start[i], end[right[i]]))
        if left[i] >= 0:
            h = left[i]
            heapq.heappush(heap, (strength[h], size(h, i), h, start[h], end[i]))
    out, before = [], None
    i = 0
    while i < n:
        a, e = start[i], end[i]
        core = size(i, i)
        seam = a if before is None else _seam(text, before, a, overlap, limit - core)
        out.append((seam, a, e))
        before, i = a, right[i]
    return out


def split_oversized(
    chunks: DataFrame,
    limits: DataFrame,
    default_category: int = 5,
    text_col: str = "chunk_text",
    category_col: str = "section_category",
    keep: tuple[str, ...] = ("section_title", "parent_section"),
) -> DataFrame:
    """(id, piece, pieces, start, core_start, end, piece_text, max_chars, *keep): pieces of the texts above their limit.

    ``limits`` has a row (section_category, max_chars, overlap_chars) for each
    section; a null category, and one without a limit, takes that of
    ``default_category``. Texts are measured and cut without spaces, tabs and
    line breaks at both ends; ``start``, ``core_start`` and ``end`` are character
    positions in the stripped text, the cores [core_start, end) tile it, and
    [start, core_start) is the overlap with the piece before. Null and short
    texts give no row; an empty table gives none. Repeated rows are each split.
    A null id stays null. Other columns are ignored, whatever their names; white space at the end of a
    piece is left out of ``piece_text``.
    """
    sizes = limits.select(
        F.col("section_category").alias("_cat"), F.col("max_chars").alias("_max"), F.col("overlap_chars").alias("_over")
    ).dropDuplicates(["_cat"])
    sizes = broadcast_within(sizes, 10_000)
    fallback = sizes.filter(F.col("_cat") == default_category).select(F.col("_max").alias("_dmax"), F.col("_over").alias("_dover"))
    stripped = F.regexp_replace(F.col(text_col), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    large = (
        chunks.select(F.col("id").cast("string").alias("id"), stripped.alias("_text"), F.col(category_col).cast("int").alias("_section"), *keep)
        .join(sizes, F.col("_section") == F.col("_cat"), "left")
        .join(F.broadcast(fallback), F.lit(True), "left")
        .select(
            "id", "_text", *keep,
            F.coalesce("_max", "_dmax").cast("int").alias("_m"),
            F.coalesce("_over", "_dover", F.lit(0)).cast("int").alias("_o"),
        )
        .filter(F.col("_text").isNotNull() & (F.col("_m") > 0) & (F.char_length("_text") > F.col("_m")))
    )

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for i, text, m, o in zip(x["id"], x["_text"], x["_m"], x["_o"]):
                spans = split_text(text, int(m), int(o))
                rows.append([(i, k, len(spans), s, c, e, text[s:e].rstrip(EDGE), int(m)) for k, (s, c, e) in enumerate(spans)])
            flat = pd.DataFrame([r for g in rows for r in g], columns=["id", "piece", "pieces", "start", "core_start", "end", "piece_text", "max_chars"])
            for c in keep:
                flat[c] = [v for v, g in zip(x[c], rows) for _ in g]
            yield flat

    kinds = dict(large.dtypes)
    out = "id string, piece int, pieces int, start int, core_start int, end int, piece_text string, max_chars int"
    pieces = large.mapInPandas(cut_up, ", ".join([out, *(f"`{c}` {kinds[c]}" for c in keep)]))
    return pieces.withColumn("id", F.col("id").cast("long"))
