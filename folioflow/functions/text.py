"""Text functions, all as column expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import model

#: A word character as Python's ``\w`` has it.
W = r"[\p{L}\p{N}_]"

# Lists that results depend on.
TITLE_STOP_WORDS = ("a", "an", "the", "for", "and", "of", "in", "on", "with", "to", "at", "by", "from")
KEYWORD_STOP_WORDS = (
    "the a an in on at to for of and or is are was were be been being have has this that these those we our they their "
    "with by from as it its can which how what when where who why using based paper propose present show use approach "
    "method system work study research results analysis evaluation"
).split()
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Jr", "Sr", "Fig", "Eq", "Ref", "Sec", "Ch", "Vol", "No", "pp", "vs", "etc", "ca", "al", "approx", r"e\.g", r"i\.e", "et al",
)
SECTION_RULES = (
    (model.ABSTRACT, "abstract"),
    (model.RELATED_WORK, "related work"),
    (model.INTRODUCTION, "introduction|background|motivation"),
    (model.METHOD, "method|approach|architecture|proposed|framework"),
    (model.EVALUATION, "experiment|result|evaluation|ablation|performance|comparison"),
    (model.CONCLUSION, "conclusion|discussion|summary|future work"),
)
ACRONYMS = {
    "USENIX Security": "usenix", "OSDI": "osdi", "NDSS": "ndss", "IEEE S&P": "sp", "ACM CCS": "ccs", "ISSTA": "issta",
    "ICSE": "icse", "CVPR": "cvpr", "NeurIPS": "neurips", "ICML": "icml", "ICLR": "iclr",
}


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Bracket citations out, words cut at line ends joined, lines run together, no space before punctuation."""
    steps = (
        (r"\[\s*[\d\s,\-]+\s*\]", ""),
        (rf"({W}+)-\n({W}+)", "$1$2"),
        (r"\n", " "),
        (r"\s+", " "),
        (r"\s+([,.;:?!])", "$1"),
    )
    return strip(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))


def classify_section(section_title: Column, paper_title: Column | None = None) -> Column:
    """Category of a section by its title; else METHOD if a telling word of the paper's title is in it; else OTHER."""
    low = F.lower(section_title)
    rule = F
    for category, pattern in SECTION_RULES:
        rule = rule.when(low.rlike(pattern), F.lit(category))
    if paper_title is None:
        return rule.otherwise(F.lit(model.OTHER))
    words = F.filter(
        F.split(F.lower(paper_title), rf"[^\p{{L}}\p{{N}}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOP_WORDS)
    )
    return rule.when(F.exists(words, lambda w: F.contains(low, w)), F.lit(model.METHOD)).otherwise(F.lit(model.OTHER))


def truncate(text: Column, size: int, mark: str = "...") -> Column:
    """The first ``size`` characters and a mark if there are more; nothing for null."""
    return F.coalesce(F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit(mark))).otherwise(text), F.lit(""))


def keywords(text: Column) -> Column:
    """Distinct words of three letters a-z or more, in order, without stop words."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(rf"{W}+"), F.lit(0)), lambda w: w.rlike("^[a-z]{3,}$"))
    return F.array_distinct(F.array_except(found, F.array(*[F.lit(w) for w in KEYWORD_STOP_WORDS])))


#: Private-use marks: a cut, the start of a protected token, its stop and space, the point of a decimal.
CUT, SHIELD, STOP, POINT = "\ue000", "\ue001", "\ue002", "\ue003"


def simple_sentences(text: Column) -> Column:
    """Parts after . ! or ? and white space, trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", f"$1{CUT}"), CUT)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(text: Column, fallback_above: int = 800) -> Column:
    """Sentences; abbreviations, decimals and initials don't end one.

    A protected token starts with a private-use mark, which is no letter, so nothing
    is split right before a protected token either. An initial right after a
    protected token isn't protected. A text longer than ``fallback_above`` that gives
    at most one part is split by :func:`simple_sentences`.
    """
    flat = squeeze(F.regexp_replace(text, f"[{CUT}-{POINT}]", ""))
    safe = F.regexp_replace(flat, rf"(?iU)\b({'|'.join(ABBREVIATIONS)})\.\s", f"{SHIELD}$1{STOP}")
    safe = F.regexp_replace(safe, r"(\d+)\.(\d+)", f"{SHIELD}$1{POINT}$2")
    safe = F.regexp_replace(safe, rf"(?<![\p{{L}}\p{{N}}_{STOP}])([A-Z])\.\s", f"{SHIELD}$1{STOP}")
    cut = F.split(F.regexp_replace(safe, r'([.!?])\s+(?=[A-Z\d\[\("])', f"$1{CUT}"), CUT)
    back = lambda p: F.replace(F.replace(F.replace(p, F.lit(STOP), F.lit(". ")), F.lit(POINT), F.lit(".")), F.lit(SHIELD), F.lit(""))
    parts = F.transform(F.filter(F.transform(cut, strip), lambda p: p != ""), back)
    return F.when((F.size(parts) <= 1) & (F.length(flat) > fallback_above), simple_sentences(flat)).otherwise(parts)


def quoted_title(title: Column) -> Column:
    """The title as a pattern: its signs as themselves, its spaces as any white space."""
    return F.array_join(F.transform(F.split(title, " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+")


def title_position(text: Column, title: Column) -> Column:
    """Where a section title stands, from 0: after a section number, else alone on its line, else -1."""
    plain = quoted_title(title)
    numbered = F.concat(F.lit(r"(?i)(?:^|\n)\s*(\d+\.(?:\d+\.?)*)\s*"), plain)
    alone = F.concat(F.lit(r"(?i)(?:^|\n)\s*"), plain, F.lit(r"\s*(?:\n|$)"))
    # What stands before the match, as the position of a match isn't its own function.
    before = lambda p: F.when(F.regexp_like(text, p), F.length(F.element_at(F.split(text, p, 2), 1)))
    return F.coalesce(before(numbered), before(alone), F.lit(-1))


def has_abstract_header(page: Column) -> Column:
    """Whether a page has a line that is only the word Abstract."""
    return page.rlike(r"\n\s*(Abstract|ABSTRACT)\s*\n") | page.rlike(r"(^|\n)\s*(Abstract|ABSTRACT)[:\.]?\s*\n")


def acronym(conference: Column) -> Column:
    """Listed short name of a conference, else its first word in lower case letters and digits."""
    table = F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(conference)), F.regexp_extract(F.lower(F.trim(conference)), r"^([a-z0-9]+)", 1))


def listing_stem(conference: Column, year: Column, round_: Column) -> Column:
    """File stem of a listing: acronym, two-digit year, round."""
    return F.concat_ws("_", acronym(conference), F.right(year.cast("string"), F.lit(2)), round_)


def round_of_stem(stem: Column, asked: Column) -> Column:
    """Round in a stem whose last but one part is a two-digit year, else the asked one."""
    found = F.regexp_extract(stem, r"_(\d{2})_([^_]+)$", 2)
    return F.when(found != "", found).otherwise(asked)


def cache_key(url: Column) -> Column:
    return F.concat(F.substring(F.md5(url), 1, 16), F.lit(".pdf"))


def strip_thoughts(text: Column) -> Column:
    """Without thought blocks, whatever their case."""
    return F.regexp_replace(text, r"(?is)<thought>.*?</thought>", "")


def has_json_fence(text: Column) -> Column:
    return strip_thoughts(text).rlike(r"(?i)```json")


def bash_commands(text: Column) -> Column:
    """Commands in bash_exec tags; a missing last closing tag is supplied."""
    opened, closed = F.regexp_count(text, F.lit("<bash_exec>")), F.regexp_count(text, F.lit("</bash_exec>"))
    whole = F.when(opened > closed, F.concat(text, F.lit("</bash_exec>"))).otherwise(text)
    return F.transform(F.regexp_extract_all(whole, F.lit(r"(?s)<bash_exec>(.*?)</bash_exec>"), F.lit(1)), strip)


def message_text(content: Column) -> Column:
    """Text of a message: of a JSON list of blocks the texts by line, else the content itself."""
    blocks = F.from_json(content, "array<struct<text string>>", {"mode": "PERMISSIVE"})
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull())
    return F.when(content.startswith("[") & blocks.isNotNull() & (F.size(texts) > 0), F.array_join(texts, "\n")).otherwise(content)


def hit_block(number: Column, title: Column, conference: Column, year: Column, category: Column, parent: Column, page: Column, url: Column, content: Column) -> Column:
    """A hit as text: numbered title, details joined by bars, address, content."""
    meta = F.concat_ws(
        " | ",
        F.when(F.length(conference) > 0, F.concat(F.lit("Conference: "), conference)),
        F.when(year.isNotNull(), F.concat(F.lit("Year: "), year.cast("string"))),
        F.when(category != model.ABSTRACT, F.concat(F.lit("Section: "), model.section_name(category))),
        F.when(F.length(parent) > 0, F.concat(F.lit("Parent: "), parent)),
        F.when(page > 0, F.concat(F.lit("Page: "), page.cast("string"))),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit(""))),
        F.when(meta != "", meta),
        F.when(F.length(url) > 0, F.concat(F.lit("URL: "), url)),
        F.concat(F.lit("Content: "), truncate(content, 500)),
    )


def url_join(base: Column, href: Column) -> Column:
    """``href`` as an absolute address: complete, scheme-relative, from the root, or beside the base."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path.rlike(r"://[^/]*$"), F.concat(path, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(href.isNull() | (href == ""), base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(path, href))
        .otherwise(F.concat(folder, href))
    )
