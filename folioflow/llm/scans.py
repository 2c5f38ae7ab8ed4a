"""Noise in the text of scanned pages: found, and repaired into continuous paragraphs.

1. Lexicon: one pass counts words and adjacent word pairs over the whole corpus.
2. Misread words: every word is filed under its symmetric-delete keys (its folded
   form and that form without one letter; folding writes signs that are read for
   letters, and letter groups read for one letter, as that letter). Words that
   share a key are candidates; a weighted edit distance in which confusion pairs
   are cheap and anything else is dear decides, together with the frequencies: a
   misreading is far rarer than the word it stands for. Where several words are
   left, the counts of the pairs with the neighbouring words pick the repair.
3. Lines: page numbers, and candidates for running heads, which are held against
   the paper's title and the conferences' names by joins on the paper; halves of
   words cut at the end of a line, between which other noise may stand.
4. Repair: noise lines are taken out, halves are joined (with the hyphen if the
   pair is more frequent than the joined word), misread words replaced, and lines
   run together into paragraphs.

Only findings travel between executors, never texts, but for the repair itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.runtime import broadcast_within, cut

# What a scanner reads for what, with the cost of each confusion.
SIGNS = {"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "@": "a", "†": "t", "¢": "c", "€": "e", "ı": "i", "|": "l", "$": "s", "!": "i", "ſ": "s"}
CONFUSIONS = {
    ("0", "o"): 0.2, ("1", "l"): 0.2, ("1", "i"): 0.3, ("5", "s"): 0.2, ("6", "b"): 0.2, ("8", "b"): 0.3, ("9", "g"): 0.2, ("9", "q"): 0.3, ("@", "a"): 0.2,
    ("†", "t"): 0.2, ("¢", "c"): 0.2, ("¢", "e"): 0.3, ("€", "e"): 0.2, ("ı", "i"): 0.2, ("|", "l"): 0.2, ("|", "i"): 0.3, ("$", "s"): 0.2, ("!", "l"): 0.2, ("!", "i"): 0.2,
    ("c", "e"): 0.4, ("e", "c"): 0.4, ("b", "h"): 0.4, ("h", "b"): 0.4, ("li", "h"): 0.4, ("h", "li"): 0.4, ("cl", "d"): 0.4, ("d", "cl"): 0.4, ("rn", "m"): 0.4, ("m", "rn"): 0.4,
    ("ii", "u"): 0.4, ("u", "ii"): 0.4, ("vv", "w"): 0.4, ("w", "vv"): 0.4, ("l", "i"): 0.5, ("i", "l"): 0.5, 
    ("n", "u"): 0.5, ("u", "n"): 0.5, ("f", "e"): 0.5, ("e", "f"): 0.5, ("o", "c"): 0.6, ("c", "o"): 0.6, ("ri", "n"): 0.5, ("n", "ri"): 0.5,
    ("nn", "m"): 0.5, ("in", "m"): 0.5, ("tl", "d"): 0.6, ("g", "q"): 0.5, ("q", "g"): 0.5, ("v", "y"): 0.6, ("y", "v"): 0.6, ("j", "i"): 0.6, ("i", "j"): 0.6,
}
#: Letter groups written as one letter in folded forms, in this order.
GROUPS = (("cl", "d"), ("li", "h"), ("rn", "m"), ("vv", "w"), ("ii", "u"))
#: Words that follow a hyphen left hanging on purpose ("pre- and post-").
HANGING = frozenset("and or to nor versus vs as und oder bis sowie beziehungsweise bzw et ou à y o u e и или до".split())
#: Words of head lines beside the name of a conference.
HEAD_WORDS = frozenset("proceedings of the in track preprint copy vol volume pp draft annual conference workshop symposium on session paper papers".split())

_SIGN = "@†¢€$|"
TOKEN = re.compile(rf"[{_SIGN}]?[^\W_]+(?:[{_SIGN}!][^\W_]+)*[@†¢]?")
_PAGE = re.compile(r"^\W*(?:page|seite|p\.|s\.|pág\.)?\s*(\d{1,4})(?:\s*(?:/|of|von|sur|de)\s*\d{1,4})?\W*$", re.IGNORECASE)
_NUMBER = r"\d{1,4}(?:\s*/\s*\d{1,4})?|(?-i:[ivxlc]{1,7})"
_BETWEEN = r"(?:\s{2,}|\t|\s*[|·—–]\s*|\s+-\s+)[\s|·—–-]*"
_LEAD = re.compile(rf"[\W_]*?(?:page\s+)?({_NUMBER}){_BETWEEN}", re.IGNORECASE)
_TRAIL = re.compile(rf"{_BETWEEN}(?:page\s+)?({_NUMBER})[\W_]*$", re.IGNORECASE)
_WIDE = re.compile(r"\s{3,}")
#: The end of a line, written backwards: at most four words.
_END = re.compile(r"(?:[\W_]*[^\W_]+){0,4}[\W_]*")
_RUNNING = re.compile(r"^[a-z]+(?: [a-z]|$)")
_SPACED = re.compile(r"^(?:\w\W? {1,3}){3,}\w?")
_YEAR = re.compile(r"(?:19|20)\d\d|[’']\d\d")
_LETTERS = re.compile(r"[^\W\d_]")
_APART = re.compile(r"[\t|·—–]| - ")
_ROMAN = re.compile(r"^\W*(?=[ivxlc])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})\W*$")
_CUT = re.compile(r"([^\W\d_]+)[-‐‑¬­]\s*$")
_GOES_ON = re.compile(r"^[\s>|*•]*([^\W\d_][^\W_]*)")
_REJOIN = re.compile(r"(?<=[^\W\d_])[-‐‑¬\xad][ \t\r]*\n[ \t]*(?=[^\W\d_])")
#: A line that starts in lower case and still is a head: a name with its year.
_LOW_HEAD = re.compile(r"^\w+-(?:\w\w)?\d\d\b.*\w{4}")
_DATA = re.compile(r"\t|\S {2,}\S|\|.*\|")


LONG = 40  # letters from which a word is filed under its ends


def fold(word: str, groups: tuple[tuple[str, str], ...] = ()) -> str:
    """The lower-case word with signs as the letters they stand for and letter groups as one letter."""
    out = "".join(SIGNS.get(c, c) for c in word)
    for group, letter in groups or GROUPS:
        out = out.replace(group, letter)
    return out


def keys(word: str) -> list[str]:
    """The folded word and each form of it with one letter less; groups are folded from either end of their order.

    Of long words the two ends are filed instead (near the border, as well): of two forms
    that differ in one letter, one end agrees.
    """
    out = set()
    for f in {fold(word), fold(word, GROUPS[::-1])}:
        if len(f) < LONG + 2:
            out |= {f, *(f[:k] + f[k + 1 :] for k in range(len(f)))} if len(f) > 2 else {f}
        if len(f) >= LONG:
            out |= {f"^{f[: LONG // 2]}", f"{f[-(LONG // 2) :]}$"}
    return list(out)


def misreading_cost(seen: str, meant: str, limit: float = 1.3) -> float:
    """Weighted edit distance from what was read to what was meant, infinite beyond ``limit``.

    Confusion pairs cost what the table says, any other replaced, lost or added letter 2.
    What costs no more than ``limit`` stays within three places of the diagonal, and
    nothing else is computed.
    """
    n, m = len(seen), len(meant)
    if abs(n - m) > 2:
        return float("inf")
    if seen == meant:
        return 0.0
    inf, band = float("inf"), 4
    d = [[inf] * (m + 1) for _ in range(n + 1)] if n <= LONG else [_Row() for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(max(0, i - band), min(m, i + band) + 1):
            best = d[i][j]
            if i and j:
                a, b = seen[i - 1], meant[j - 1]
                best = min(best, d[i - 1][j - 1] + (0.0 if a == b else CONFUSIONS.get((a, b), 2.0)))
                if i > 1:
                    best = min(best, d[i - 2][j - 1] + CONFUSIONS.get((seen[i - 2 : i], b), 9.0))
                if j > 1:
                    best = min(best, d[i - 1][j - 2] + CONFUSIONS.get((a, meant[j - 2 : j]), 9.0))
            if i:
                best = min(best, d[i - 1][j] + 2.0)
            if j:
                best = min(best, d[i][j - 1] + 2.0)
            d[i][j] = best
    return d[n][m] if d[n][m] <= limit else inf


class _Row(dict):
    """A row of which only places near the diagonal are held."""

    def __missing__(self, _: int) -> float:
        return float("inf")


# ---------------------------------------------------------------------------
# Lexicon


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(first, second, n): lower-case words (second empty) and adjacent pairs of them, counted over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one: Counter = Counter()
        two: Counter = Counter()

        def rows() -> pd.DataFrame:
            first = [*one, *(a for a, _ in two)]
            second = [""] * len(one) + [b for _, b in two]
            return pd.DataFrame(list(zip(first, second, [*one.values(), *two.values()])), columns=["first", "second", "n"])

        for x in batches:
            for t in x["text"]:
                if t:
                    low = t.lower()
                    w = TOKEN.findall(_REJOIN.sub("", low) if "\n" in low else low)
                    one.update(w)
                    two.update(zip(w, w[1:]))
            if len(one) + len(two) > flush:
                yield rows()
                one.clear()
                two.clear()
        yield rows()

    return texts.select("text").mapInPandas(count, "first string, second string, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))


def misreadings(words: DataFrame, ratio: float = 12.0, shortest: int = 3) -> DataFrame:
    """(word, meant, cost, seen): words that stand for a far more frequent one.

    ``words`` (word, n). A word is a misreading of ``meant`` if the weighted distance
    allows it and ``meant``, a word of letters only, is at least ``ratio`` times as
    frequent: a third of that for words with signs or digits among letters, five
    times that for words of letters seen more than twice, which may be words.
    """

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(k, w, n) for w, n in zip(x["word"], x["n"]) for k in keys(w)]
            yield pd.DataFrame(rows, columns=["key", "word", "n"])

    odd = F.col("word").rlike(rf"[{_SIGN}!0-9ı]")
    # Words around a digit or sign must hold letters, and not look like names of things (v2, 0x1f).
    plain = words.filter((F.length("word") >= shortest) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"^0x|^v\d"))
    filed = plain.mapInPandas(file, "key string, word string, n long")
    spread = filed.repartition("key")
    left = spread.select("key", "word", F.col("n").alias("seen"))
    right = spread.filter(~odd).select("key", F.col("word").alias("meant"), F.col("n").alias("n_meant"))
    pairs = (
        left.join(right, "key")
        .filter((F.col("word") != F.col("meant")) & (F.col("n_meant") >= F.when(odd, ratio / 3).when(F.col("seen") > 2, 5 * ratio).otherwise(ratio) * F.col("seen")) & (F.col("n_meant") >= 3))
        .select("word", "meant", "seen", "n_meant")
        .distinct()
    )

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["cost"] = [misreading_cost(a, b) for a, b in zip(x["word"], x["meant"])]
            yield x[x["cost"] <= 0.22 * x["meant"].str.len()][["word", "meant", "cost", "seen", "n_meant"]]

    return pairs.mapInPandas(weigh, "word string, meant string, cost double, seen long, n_meant long")


# ---------------------------------------------------------------------------
# Lines


def head_parts(line: str) -> tuple[str, bool]:
    """(the line without page number and ornament, whether a page number stands beside it)."""
    flat = line.strip()
    lead = trail = None
    core = flat
    if "  " in flat or _APART.search(flat):
        core = _WIDE.sub("  ", flat)
        if m := _LEAD.match(core):
            lead, core = m.group(1), core[m.end() :]
        if m := _TRAIL.search(core, len(core) - _END.match(core[::-1]).end()):
            trail, core = m.group(1), core[: m.start()]
    core = core.strip(" \t|·—–-")
    if trail and len(trail) == 4 and _YEAR.match(trail) and not _YEAR.search(core):
        core, trail = f"{core} {trail}", None
    return core, bool(lead or trail) and bool(_LETTERS.search(core))


def head_form(text: str) -> str:
    """Letters of a head or title, folded so that misread and spaced forms agree; c stands for c, e and f."""
    flat = _FLAT.sub("", text.lower().translate(_SIGNED))
    for group, letter in GROUPS:
        flat = flat.replace(group, letter)
    return flat.translate(_ALIKE)


_SIGNED = str.maketrans(SIGNS)
_FLAT = re.compile(r"[\W_]+")
_ALNUM = re.compile(r"[^\W_]+")
_DATED = re.compile(r"\d|proc|pr0c")


_FORMS: dict[str, str] = {}  # forms of words seen by this worker


def _word_form(word: str) -> str:
    if word not in _FORMS:
        if len(_FORMS) > 100_000:
            _FORMS.clear()
        _FORMS[word] = head_form(word)
    return _FORMS[word]


def head_name(core: str) -> str:
    """The form of the one word of a head line that is no usual head word, number or letter; else nothing."""
    if not _DATED.search(core.lower()):
        return ""
    found = ""
    for m in _ALNUM.finditer(core):
        w = m.group()
        if len(w) > 1 and not w.isdigit() and _word_form(w) not in _HEAD_FORMS:
            if found:
                return ""
            found = w
    return _word_form(found) if found else ""


_ALIKE = str.maketrans({"e": "c", "f": "c", "h": "b", "i": "l", "t": "l"})


_HEAD_FORMS = frozenset(head_form(w) for w in HEAD_WORDS)


def line_findings(text: str, longest: float = math.inf) -> tuple[list[tuple[str, int, str, str]], list[str]]:
    """(findings, lines): (kind, line, a, b) for page numbers, cut words and candidates for heads.

    page_number: a is the number. hyphen_break: a and b are the halves, b's line is
    where the text goes on. head: a is the candidate's form, b tells of a number beside it
    and of capital or spaced letters, then the form of the name in it. ``longest`` is the
    length of the longest form of a title: longer ones are no candidates unless they
    hold a name.
    """
    lines = text.split("\n")
    out: list[tuple[str, int, str, str]] = []
    noise: set[int] = set()
    table: bool | None = None
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            continue
        m = _PAGE.match(s) or (len(lines) > 2 and _ROMAN.match(s))
        if m and s[-1] not in ",;%" and s[0] != "+" and not any(x in s for x in "()[]"):
            if table is None:
                table = sum(bool(_DATA.search(x)) for x in lines) * 2 > len(lines)
            if not table:
                out.append(("page_number", k, s, ""))
                noise.add(k)
                continue
        if s[-1] in ".;,:?!" and not s.endswith("...") or s[0].islower() and _RUNNING.match(s):
            continue
        core, beside = head_parts(s)
        if len(core) >= 4:
            form = head_form(core)
            name = head_name(core)
            if len(form) >= 4 and (len(form) <= longest or name):
                spaced = core.isupper() or bool(_SPACED.match(core))
                out.append(("head", k, form, ("n" if beside else "") + ("s" if spaced else "") + " " + name))
    maybe = noise | {k for kind, k, _, _ in out if kind == "head"}
    goes_on = _continuations(lines, noise, maybe)
    for k, line in enumerate(lines[:-1]):
        m = _CUT.search(line)
        if not m or k in noise:
            continue
        j = k + 1
        g = _GOES_ON.match(lines[j]) if lines[j].strip() and not _stands_between(lines, j, noise, maybe) else None
        if not (g and (g.group(1)[0].islower() or j not in maybe)):
            # The next line is a word's second half in capitals, or something between the halves, or neither.
            j = goes_on[j]
            g = _GOES_ON.match(lines[j]) if j is not None else None
        if g and g.group(1).lower() not in HANGING:
            out.append(("hyphen_break", k, m.group(1), f"{j} {g.group(1)}"))
    return out, lines


def _stands_between(lines: list[str], j: int, noise: set[int], maybe: set[int]) -> bool:
    return j in noise or j in maybe and bool(_LOW_HEAD.match(lines[j].strip()))


def _continuations(lines: list[str], noise: set[int], maybe: set[int]) -> list[int | None]:
    """For each line the first one from it on that goes on in lower case, if only blank lines and noise stand before it."""
    out: list[int | None] = [None] * (len(lines) + 1)
    for j in range(len(lines) - 1, -1, -1):
        s = lines[j].strip()
        if not s or _stands_between(lines, j, noise, maybe):
            out[j] = out[j + 1]
        elif (g := _GOES_ON.match(lines[j])) and g.group(1)[0].islower():
            out[j] = j
        else:
            out[j] = out[j + 1] if j in maybe else None
    return out


def find_noise(
    chunks: DataFrame, papers: DataFrame, text_col: str = "chunk_text", common_words: int = 20_000, ratio: float = 12.0
) -> tuple[DataFrame, DataFrame]:
    """(findings, counts).

    findings (id, noise, line, a, b): noise is hyphen_break (a, b: the halves, b
    after the number of its line), misread (a: the word as it stands, b: the repair),
    running_head or page_number. counts: the lexicon of :func:`word_counts`.

    ``papers`` (doc_id, title, conference_name) gives what heads are held against;
    a paper listed more than once keeps all its titles. Chunks with a null id or
    text, and blank ones, have no findings; empty tables give none; repeated chunks
    count for themselves. Other columns are ignored.
    """
    spark = chunks.sparkSession
    texts = chunks.select(F.col("id").cast("long").alias("id"), F.col("doc_id").alias("doc_id"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & (F.length(F.trim("text")) > 0)
    )
    counts = cut(word_counts(texts))
    words = counts.filter("second = ''").select(F.col("first").alias("word"), "n")
    wrong = cut(misreadings(words, ratio))
    # Frequent words are skipped when texts are searched for misreadings: a bounded
    # set of those that are none; everything else goes through the join.
    usual = words.join(wrong.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(common_words).select("word").toPandas()
    skip = spark.sparkContext.broadcast(frozenset(usual["word"]))

    # Heads are held against titles and names further below; their longest form bounds what can be one.
    forms = F.pandas_udf(lambda s: s.map(lambda t: head_form(t) if t else ""), "string")
    titles = papers.filter("doc_id is not null and trim(title) <> ''").select("doc_id", "title").distinct()
    titles = cut(titles.select("doc_id", forms("title").alias("full"), forms(F.regexp_extract("title", r"^([^:]+):", 1)).alias("short")).distinct())
    longest = titles.agg(F.coalesce(F.max(F.length("full")), F.lit(0))).head()[0]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = skip.value
        for x in batches:
            rows = []
            for i, doc, t in zip(x["id"], x["doc_id"], x["text"]):
                found = line_findings(t, longest)[0]
                halves = set()
                for kind, k, a, b in found:
                    rows.append((i, doc, kind, k, a, b, ""))
                    if kind == "hyphen_break":
                        halves |= {a.lower(), b.split(" ", 1)[1].lower()}
                low = t.lower()
                w = TOKEN.findall(_REJOIN.sub("", low) if "\n" in low else low)
                odd = [p for p, token in enumerate(w) if token not in known and token not in halves]
                if odd:
                    where = {} if "\n" not in low else {token: k for k, line in reversed(list(enumerate(low.split("\n")))) for token in TOKEN.findall(line)}
                    rows += [(i, doc, "word", where.get(w[p], 0), w[p], w[p - 1] if p else "", w[p + 1] if p + 1 < len(w) else "") for p in odd]
            yield pd.DataFrame(rows, columns=["id", "doc_id", "kind", "line", "a", "b", "c"])

    raw = cut(texts.mapInPandas(scan, "id long, doc_id string, kind string, line int, a string, b string, c string"))
    plain = raw.filter("kind in ('page_number', 'hyphen_break')").select("id", F.col("kind").alias("noise"), "line", "a", "b")
    # Heads: the form begins a title of the paper, or names a conference.
    heads = raw.filter("kind = 'head'").select("id", "doc_id", "line", F.col("a").alias("form"), "b")
    heads = cut(heads)
    by_title = heads.join(titles, "doc_id").filter(
        (F.length("form") >= 8) & F.col("full").startswith(F.col("form")) | (F.col("form") == F.col("short")) & F.col("b").rlike("^n?s")
    )
    names = papers.filter("trim(conference_name) <> ''").select(forms(F.trim(F.col("conference_name"))).alias("name")).distinct()
    named = heads.withColumn("name", F.split_part("b", F.lit(" "), F.lit(2))).filter("name <> ''")
    by_name = named.join(broadcast_within(names, 10_000), "name")
    headed = by_title.select("id", "line", "b").unionByName(by_name.select("id", "line", "b")).distinct()
    head_rows = headed.select("id", F.lit("running_head").alias("noise"), "line", F.lit("").alias("a"), "b")
    beside = headed.filter(F.col("b").startswith("n")).select("id", F.lit("page_number").alias("noise"), "line", F.lit("").alias("a"), F.lit("").alias("b"))
    # Misread words outside heads; among several meanings the neighbours decide.
    spots = raw.filter("kind = 'word'").join(headed.select("id", "line").distinct(), ["id", "line"], "left_anti")
    spots = spots.select("id", F.col("line").alias("at"), F.col("a").alias("word"), F.col("b").alias("before"), F.col("c").alias("after"))
    meant = spots.join(wrong, "word")
    pairs = counts.filter("second <> ''")
    meant = (
        meant.join(pairs.select(F.col("first").alias("before"), F.col("second").alias("meant"), F.col("n").alias("n_before")), ["before", "meant"], "left")
        .join(pairs.select(F.col("first").alias("meant"), F.col("second").alias("after"), F.col("n").alias("n_after")), ["meant", "after"], "left")
        .withColumn("fit", F.log1p(F.coalesce("n_before", F.lit(0))) + F.log1p(F.coalesce("n_after", F.lit(0))) + 0.3 * F.log("n_meant") - 4 * F.col("cost"))
    )
    best = meant.groupBy("id", "at", "word").agg(F.max(F.struct("fit", "meant", "cost")).alias("m"), F.first("before").alias("before"), F.first("after").alias("after"))
    misread = best.select("id", F.lit("misread").alias("noise"), F.col("at").alias("line"), F.col("word").alias("a"), F.col("m.meant").alias("b"))
    return plain.unionByName(head_rows).unionByName(beside).unionByName(misread), counts


def repair_text(text: str, findings: list[tuple[str, int, str, str, bool]]) -> str:
    """The text without its noise, as paragraphs parted by blank lines.

    ``findings``: (noise, line, a, b, joined); ``joined`` tells of a hyphen break
    whether the halves make one word.
    """
    lines = text.split("\n")
    gone = {k for noise, k, *_ in findings if noise in ("running_head", "page_number")}
    swaps = {a: b for noise, _, a, b, _ in findings if noise == "misread"}
    ties = {k: joined for noise, k, _, _, joined in findings if noise == "hyphen_break"}

    def mend(m: re.Match) -> str:
        word = m.group()
        new = swaps.get(word.lower())
        if new is None:
            return word
        return new.upper() if word.isupper() and len(word) > 1 else new.capitalize() if word[0].isupper() else new

    out: list[str] = []
    para, glue = "", " "
    for k, line in enumerate(lines):
        if k in gone:
            continue
        s = line.strip()
        if not s:
            if glue == " " and para and not any(x in gone for x in (k - 1, k + 1)):
                out.append(para)
                para = ""
            continue
        s = TOKEN.sub(mend, s) if swaps else s
        para = f"{para}{glue if para else ''}{s}"
        glue = " "
        if k in ties:
            para = re.sub(r"[-‐‑¬­]$", "" if ties[k] else "-", para)
            glue = ""
    if para:
        out.append(para)
    return "\n\n".join(re.sub(r"[ \t]+", " ", p) for p in out)


def repair_scans(chunks: DataFrame, papers: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """(id, noise, repaired): every chunk with the kinds of noise found in it and its text without them.

    ``noise`` is a sorted array, empty for a clean chunk, whose text is kept as it
    is. A null text stays null, a null id likewise. Conventions are those of :func:`find_noise`.
    """
    findings, counts = find_noise(chunks, papers, text_col)
    findings = cut(findings)
    halves = findings.filter("noise = 'hyphen_break'").withColumns({"l": F.lower("a"), "r": F.lower(F.regexp_extract("b", r"^\d+ (.*)$", 1))})
    one = counts.filter("second = ''").select(F.col("first").alias("whole"), F.col("n").alias("n_one"))
    two = counts.filter("second <> ''").select(F.col("first").alias("l"), F.col("second").alias("r"), F.col("n").alias("n_two"))
    judged = (
        halves.withColumn("whole", F.concat("l", "r"))
        .join(one, "whole", "left")
        .join(two, ["l", "r"], "left")
        # The cut word itself was counted once as joined.
        .select("id", "noise", "line", "a", "b", (F.coalesce("n_one", F.lit(0)) - 1 >= F.coalesce("n_two", F.lit(0))).alias("joined"))
    )
    rest = findings.filter("noise <> 'hyphen_break'").withColumn("joined", F.lit(True))
    lists = (
        judged.unionByName(rest)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("noise", "line", "a", "b", "joined"))).alias("found"), F.sort_array(F.collect_set("noise")).alias("noise"))
    )
    texts = chunks.select(F.col("id").cast("string").alias("id"), F.col(text_col).alias("text"))

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            new = [
                t if f is None or t is None else repair_text(t, [(r["noise"], r["line"], r["a"], r["b"], r["joined"]) for r in f])
                for t, f in zip(x["text"], x["found"])
            ]
            yield pd.DataFrame({"id": x["id"], "noise": [[] if n is None else list(n) for n in x["noise"]], "repaired": new})

    lists = lists.withColumn("id", F.col("id").cast("string"))
    mended = texts.join(lists, "id", "left").mapInPandas(mend, "id string, noise array<string>, repaired string")
    return mended.withColumn("id", F.col("id").cast("long"))
