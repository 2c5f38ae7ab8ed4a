"""Garbled text from a wrong character encoding: found and, where nothing was lost, restored.

1. Corpus statistics. Every document is counted into a table of adjacent
   character pairs. Characters that no single-byte code page contains are counted
   by their Unicode category, so that the alphabet, and with it the table that is
   broadcast, has a proven bound whatever the corpus.
2. Improbable runs. A pair's score is its mutual information in the corpus,
   limited by its evidence: a pair seen hardly ever proves no association. The
   maximum-scoring segments of (threshold - score) are the runs under suspicion.
3. Inverse mappings. Only inside those runs, the wrong decoding is undone: encode
   with the code page that was wrongly used, decode with the right one, up to
   three times over. The result stands if it is more probable under the corpus
   pairs, by a margin that is wider for single-byte encodings, which any
   string survives, than for UTF-8, which hardly any string obeys by chance.

Runs that stand alone between intact quotation marks are quoted, not damaged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages that texts are wrongly decoded with, and those they were written in (fixed values).
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")
RIGHT = ("cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "cp850", "cp437", "cp1250")
QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", '"': '"', "'": "'", "‘": "’", "‚": "‘’", "`": "`", "‹": "›"}
LOST = "\ufffd"
#: Signs that stand between two letters of a word or of a pair of words.
JOINING = "’‘–—"
#: Characters that stand for lost ones, and control characters that no text holds.
_GONE = re.compile("[\ufffd\x80-\x84\x86-\x9f]+")
_CITED = re.compile("[“„«»\"'‘‚`‹]([^\x00-\x7f“”„«»‘‚`‹›]+)(?=[“”„«»\"'’‘`›])")
_WORD = re.compile(r"\S+")
_HIGH = re.compile(r"[^\x00-\x7f]+")


def _pages() -> tuple[dict[str, dict[str, int]], list[str]]:
    """For each wrong code page its characters above ASCII with their bytes; all such characters."""
    maps: dict[str, dict[str, int]] = {}
    for page in WRONG:
        m = {}
        for b in range(128, 256):
            try:
                m[bytes([b]).decode(page)] = b
            except UnicodeDecodeError:
                m[chr(b)] = b  # decoders that pass unassigned bytes through give C1 controls
        maps[page] = m
    for page in ("cp1252", "cp1250", "cp1251"):
        for b in range(128, 160):
            maps[page].setdefault(chr(b), b)
    return maps, sorted({c for m in maps.values() for c in m} | {LOST})


PAGES, MARKS = _pages()
_CATEGORIES = sorted({unicodedata.category(chr(c)) for c in range(0x3000)} | {"Cs", "Co", "Cn"})
#: Symbols: ASCII, code page characters, then a symbol for each category of anything else.
SYMBOL = {chr(c): c for c in range(128)} | {c: 128 + k for k, c in enumerate(MARKS)}
_OTHER = {c: 128 + len(MARKS) + k for k, c in enumerate(_CATEGORIES)}
WIDTH = 128 + len(MARKS) + len(_CATEGORIES)


def symbol(c: str) -> int:
    s = SYMBOL.get(c)
    return _OTHER.get(unicodedata.category(c), _OTHER["Cn"]) if s is None else s


def symbols(text: str) -> np.ndarray:
    """The text as symbol numbers; the table over pairs of them has at most WIDTH^2 cells."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = codes.astype(np.int32)
    high = np.flatnonzero(codes > 127)
    for k in high:
        out[k] = symbol(text[k])
    return out


def pair_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(pair, n): counts of adjacent symbol pairs over all texts; at most WIDTH^2 rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(WIDTH * WIDTH, dtype=np.int64)
        for x in batches:
            s = symbols("\n".join(t for t in x[text_col] if t))
            if len(s) > 1:
                total += np.bincount(s[:-1] * WIDTH + s[1:], minlength=WIDTH * WIDTH)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen, "n": total[seen]})

    return docs.select(text_col).mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Pair statistics of a corpus, and the search for damage with them."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, suspicion: float = 4.0, rare: float = 1e-5):
        self.size = float(max(1, counts.sum()))
        c = np.zeros((WIDTH, WIDTH))
        c.ravel()[pairs] = counts
        left, right = c.sum(axis=1), c.sum(axis=0)
        # Mutual information, limited by the evidence for the pair.
        info = np.log2((c + 0.5) / (np.outer(left, right) / self.size + 0.5))
        proof = np.log2((c + 0.01) / (rare * self.size + 0.01))
        self.score = np.minimum(info, proof + suspicion).astype(np.float32)
        # Probability of the next symbol, smoothed by its own frequency.
        prior = (right + 0.02) / (self.size + 0.02 * WIDTH)
        self.next = np.log2((c + 2.0 * prior) / (left[:, None] + 2.0)).astype(np.float32)
        self.suspicion = suspicion
        self.table = self.next.tolist()
        self.seen = (c > 0).tolist()
        self.memo: dict = {}
        self.single = single_bytes()

    def likelihood(self, text: str) -> float:
        """Bits (negative) of the text's characters after the first, each given the one before."""
        table, total, last = self.table, 0.0, -1
        for c in text:
            s = symbol(c)
            if last >= 0:
                total += table[last][s]
            last = s
        return total

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments, [start, end) in characters, each with a character above ASCII."""
        s = symbols(text)
        if len(s) < 2 or not (s > 127).any():
            return [(0, len(text))] if len(s) == 1 and s[0] > 127 else []
        high = s > 127
        touch = high[:-1] | high[1:]
        gain = np.where(touch, self.suspicion + 2.0 - self.score[s[:-1], s[1:]], -2.0)
        # Disjoint maximal segments: cut wherever the running sum falls to zero, and
        # from there end each at its highest sum.
        out, total, best, a, e = [], 0.0, 0.0, 0, 0
        hot = np.flatnonzero(gain > 0)
        k = 0
        while k < len(hot):
            a = p = int(hot[k])
            total = best = 0.0
            e = a
            while p < len(gain):
                total += float(gain[p])
                if total <= 0:
                    break
                if total > best:
                    best, e = total, p
                p += 1
            # gain[p] is the pair (p, p + 1).
            b, f = a, e + 2
            while b < f and not high[b]:
                b += 1
            while f > b and not high[f - 1]:
                f -= 1
            if b < f:
                out.append((b, f))
            k = int(np.searchsorted(hot, e + 1))
        return out

    def attested(self, text: str) -> bool:
        """Whether most pairs of the text above ASCII occur in the corpus."""
        s = [symbol(c) for c in text]
        pairs = [(a, b) for a, b in zip(s, s[1:]) if a > 127 or b > 127]
        return sum(self.seen[a][b] for a, b in pairs) >= 0.6 * len(pairs)

    def joins(self, joint: str, run: str) -> bool:
        """Whether all that was changed is signs between two letters, in pairs that the corpus holds."""
        if len(joint) != len(run) + 2 or joint[1:-1].isascii() or any((c > "\x7f") != (x in JOINING) for c, x in zip(run, joint[1:-1])):
            return False
        at = [k for k in range(1, len(joint) - 1) if joint[k] in JOINING]
        s = [symbol(c) for c in joint]
        return all(joint[k - 1].isalpha() and joint[k + 1].isalpha() and self.seen[s[k - 1]][s[k]] and self.seen[s[k]][s[k + 1]] for k in at)

    def quoted(self, text: str, a: int, b: int) -> bool:
        """Whether text[a:b] stands alone between intact quotation marks."""
        return 0 < a and b < len(text) and text[b] in QUOTES.get(text[a - 1], "")

    def better(self, before: str, run: str, after: str, known: frozenset[tuple[str, str]] = frozenset()) -> tuple[str, tuple[str, str]] | None:
        """The most probable undoing of ``run`` between its neighbours, with its mapping.

        ``known`` are mappings that other runs of the text have proved: for them a
        single-byte encoding needs no proof by adjacent letters.
        """
        key = (before, run, after, known)
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[key] = self._better(before, run, after, known)
        return self.memo[key]

    def _better(self, before: str, run: str, after: str, known: frozenset[tuple[str, str]]) -> tuple[str, tuple[str, str]] | None:
        now, controls = self.likelihood(before + run + after), any("\x7f" < c < "\xa0" for c in run)
        found, most = None, 0.0
        for wrong in WRONG:
            new = undo_bytes(run, wrong)
            if new is not None and new != run:
                gain = self.likelihood(before + new + after) - now
                # Hardly any string is valid UTF-8 by chance, so little else is asked.
                if gain > (most if found else -4.0):
                    found, most = (new, (wrong, "utf-8")), gain
        if found:
            return found
        for mapping, change in self.single.items():
            new = "".join([change.get(c, "\x00") if c > "\x7f" else c for c in run])
            if "\x00" in new or new == run:
                continue
            joint = before[-1:] + new + after[:1]
            proved = mapping in known or controls
            letters = proved or any(x.isalpha() and y.isalpha() and not (x + y).isascii() for x, y in zip(joint, joint[1:]))
            if not letters and not self.joins(joint, run):
                continue
            if before and self.table[symbol(before[-1])][symbol(new[0])] < -20:
                continue
            gain = self.likelihood(before + new + after) - now
            if gain > max(most, 1.0 if proved else 5.0 if letters else 8.0) and (proved or self.attested(before[-1:] + new + after[:1])):
                found, most = (new, mapping), gain
        return found

    def inspect(self, text: str, depth: int = 3) -> tuple[bool, bool, str]:
        """(damaged, lost, restored text)."""
        damaged = lost = False
        known: frozenset[tuple[str, str]] = frozenset()
        for _ in range(depth):
            out, at, before = [], 0, known
            for a, b in self._unquoted(text, self.runs(text)):
                for c, d, new, mapping in self._undone(text, a, b, known):
                    if c < at or self.quoted(text, c, d):
                        continue
                    out += [text[at:c], new]
                    at = d
                    known |= {mapping}
            if not out and known == before:
                break
            damaged = damaged or bool(out)
            text = "".join(out) + text[at:]
        for m in _GONE.finditer(text):
            if not self.quoted(text, m.start(), m.end()):
                damaged = True
                lost = lost or LOST in m.group()
        return damaged, lost, text

    def _unquoted(self, text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Runs without the stretches above ASCII that stand alone between intact quotation marks."""
        held = [m.span(1) for m in _CITED.finditer(text) if self.quoted(text, *m.span(1))]
        for a, b in runs:
            for c, d in held:
                if a < d and c < b:
                    if a < c - 1:
                        yield a, c - 1
                    a = d + 1
            if a < b:
                yield a, b

    def _undone(self, text: str, a: int, b: int, known: frozenset[tuple[str, str]]) -> Iterator[tuple[int, int, str, tuple[str, str]]]:
        """Undoings in a run: of the whole, else word by word, else of each stretch above ASCII."""

        def attempt(c: int, d: int) -> tuple[int, int, str, tuple[str, str]] | None:
            if LOST in text[c:d]:
                return None
            found = self.better(text[max(0, c - 2) : c], text[c:d], text[d : d + 2], known)
            return (c, d, *found) if found else None

        if whole := attempt(a, b):
            yield whole
            return
        for m in _WORD.finditer(text, a, b):
            if m.group().isascii():
                continue
            c, d = m.span()
            if (c, d) != (a, b) and (word := attempt(c, d)):
                yield word
                continue
            for n in _HIGH.finditer(text, c, d):
                if n.span() != (c, d) and (part := attempt(*n.span())):
                    yield part


def undo_bytes(run: str, wrong: str) -> str | None:
    """``run`` as it was before its UTF-8 bytes were decoded as ``wrong``; None if it can't have been."""
    page, raw = PAGES[wrong], bytearray()
    for c in run:
        if c < "\x80":
            raw.append(ord(c))
        elif c in page:
            raw.append(page[c])
        else:
            return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def single_bytes() -> dict[tuple[str, str], dict[str, str]]:
    """For each pair (wrong, right) of code pages: each wrong character and the right one."""
    out = {}
    for wrong in WRONG:
        for right in RIGHT:
            change = {}
            for c, byte in PAGES[wrong].items():
                new = bytes([byte]).decode(right, "replace")
                if new != LOST and not "\x7f" < new < "\xa0":
                    change[c] = new
            if wrong != right:
                out[wrong, right] = change
    return out


def repair_encoding(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, damaged, lost, restored): every document with its text restored as far as possible.

    ``damaged`` marks texts that hold wrongly decoded characters outside quotation
    marks; ``lost`` those where characters were replaced and are gone for good;
    ``restored`` is the original text where nothing was lost, else the text with the
    rest restored; it equals the text where nothing is damaged. A null text is not
    damaged and restored as null; an empty one likewise stays empty. Ids may repeat
    or be null: each row is answered. Other columns are ignored.
    """
    spark = docs.sparkSession
    # Ids travel as strings: a null among numbers would turn them into floats.
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    table = pair_counts(texts, "text").toPandas()  # at most WIDTH^2 rows
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.float64)))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for x in batches:
            if not len(x):
                continue
            rows = [(False, False, t) if t is None or t.isascii() else model.inspect(t) for t in x["text"]]
            yield pd.DataFrame(
                {"doc_id": x["doc_id"], "damaged": [r[0] for r in rows], "lost": [r[1] for r in rows], "restored": [r[2] for r in rows]}
            )

    return texts.mapInPandas(check, "doc_id string, damaged boolean, lost boolean, restored string").withColumn("doc_id", F.col("doc_id").cast(kind))
