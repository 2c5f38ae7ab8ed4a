"""Semi-structured model output: found, repaired and parsed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FENCE = "```"


def _valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def fenced(text: Column, label: str = "") -> Column:
    """Content of the first fence (with this label, whatever its case); null if there is none."""
    found = F.regexp_extract(text, rf"(?is){FENCE}{label}\s*(.*?){FENCE}", 1)
    return F.when(found != "", F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")))


def json_of_answer(text: Column) -> Column:
    """The answer if it is JSON, else its first json fence, else its first fence without a leading label; null if that isn't JSON."""
    whole = F.trim(text)
    labelled = fenced(text, "json")
    other = F.regexp_replace(fenced(text), r"(?i)^json\s*", "")
    found = F.coalesce(F.when(_valid(whole), whole), labelled, other)
    return F.when(_valid(found), found)


def _between(text: Column, left: str, right: str) -> Column:
    a, b = F.instr(text, left), F.length(text) - F.instr(F.reverse(text), right) + 1
    return F.when((a > 0) & (F.instr(text, right) > 0) & (b > a), F.substring(text, a, b - a + 1))


def json_best_effort(text: Column) -> Column:
    """A fenced object or array, else what lies between the outer braces, else between the outer brackets, if it is JSON."""
    block = F.regexp_extract(text, rf"(?is){FENCE}(?:json)?\s*(\{{.*?\}}|\[.*?\])\s*{FENCE}", 1)
    tries = [F.when(block != "", block), _between(text, "{", "}"), _between(text, "[", "]")]
    return F.coalesce(*[F.when(_valid(t), t) for t in tries])


def parsed_paths(text: Column) -> Column:
    """The list parsed_paths of the JSON in an answer, empty if there is none."""
    return F.coalesce(F.from_json(F.get_json_object(json_best_effort(text), "$.parsed_paths"), "array<string>"), F.array().cast("array<string>"))


def unfence(text: Column) -> Column:
    """Without the first and last line if the text starts with a fence."""
    body = F.trim(text)
    return F.when(body.startswith(FENCE), F.trim(F.regexp_replace(F.regexp_replace(body, rf"^{FENCE}[^\n]*\n?", ""), rf"\n?{FENCE}\s*$", ""))).otherwise(body)


# The names under which selector objects give each field, and the item selector, in order of preference.
FIELD_KEYS = {
    "title": ("title", "paper_title", "paperTitle"),
    "abstract": ("abstract", "paper_abstract", "summary"),
    "pdf": ("pdf_link", "pdf", "pdf_url", "pdfUrl"),
    "authors": ("authors", "author", "paper_authors"),
    "link": ("link", "url", "paper_url", "paper_link"),
}
ITEM_KEYS = ("item_selector", "paper_item_selector", "paper_selector", "list_item_selector", "papers", "paper_list")


def selector_fields(text: Column) -> dict[str, Column]:
    """Field selectors of a selector object: for each field the first non-blank of its names."""
    get = lambda n: F.nullif(F.trim(F.get_json_object(text, f"$.{n}")), F.lit(""))
    return {field: F.coalesce(*map(get, keys)) for field, keys in FIELD_KEYS.items()}


def item_selector(text: Column) -> Column:
    """Explicit item selector of a selector object, by a fixed order of its names; null if none."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(text, f"$.{n}")), F.lit("")) for n in ITEM_KEYS])


def judge_scores(text: Column, keys: tuple[str, ...] = ("correctness", "faithfulness", "relevance")) -> dict[str, Column]:
    """Scores of a judge's answer: of its first flat object, else a number after each name, at most 5; else 0."""
    flat = F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0)
    valid = (flat != "") & _valid(F.when(flat != "", flat))
    out = {}
    for k in keys:
        named = F.regexp_extract(text, rf"(?i){k}\D*(\d+(?:\.\d+)?)", 1)
        loose = F.least(F.lit(5.0), F.coalesce(named.try_cast("double"), F.lit(0.0)))
        inside = F.coalesce(F.get_json_object(flat, f"$.{k}").try_cast("double"), F.lit(0.0))
        out[k] = F.when(valid, inside).otherwise(loose)
    return out


# ---------------------------------------------------------------------------
# What expressions can't do: scans that keep a state.


def mend_json(text: str) -> str:
    """Trailing commas out; raw line breaks and tabs in strings escaped, other control characters out."""
    text = re.sub(r",(\s*[\]}])", r"\1", text)
    out, inside, escaped = [], False, False
    for c in text:
        if escaped:
            out.append(c)
            escaped = False
            continue
        if c == "\\" and inside:
            out.append(c)
            escaped = True
            continue
        if c == '"':
            inside = not inside
        if inside and c in "\n\r\t":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
        elif c < " " and c not in "\n\r\t":
            continue
        else:
            out.append(c)
    return "".join(out)


def balanced(text: str, start: int = 0) -> tuple[int, int] | None:
    """[start, end) of the next object whose braces balance outside strings."""
    a = text.find("{", start)
    if a < 0:
        return None
    depth, inside, k = 0, False, a
    while k < len(text):
        c = text[k]
        if inside:
            if c == "\\":
                k += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return a, k + 1
        k += 1
    return None


def objects(text: str, key: str = "question") -> list[str]:
    """Balanced objects in a text, mended where needed, that have ``key``; each as JSON."""
    out, at = [], 0
    while (span := balanced(text, at)) is not None:
        a, b = span
        for candidate in (text[a:b], mend_json(text[a:b])):
            try:
                value = json.loads(candidate)
            except ValueError:
                continue
            if isinstance(value, dict) and key in value:
                out.append(json.dumps(value, ensure_ascii=False))
            break
        at = b
    return out


def _series(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else f(t))

    return run


def mend_json_column(text: Column) -> Column:
    return F.pandas_udf(_series(mend_json), "string")(text)


def objects_column(text: Column, key: str = "question") -> Column:
    """Array of the JSON objects in a text that have ``key``."""
    return F.pandas_udf(_series(lambda t: objects(t, key)), "array<string>")(text)


def first_object_column(text: Column) -> Column:
    """The first balanced object of a text as it stands; null if there is none."""
    return F.pandas_udf(_series(lambda t: (lambda s: t[s[0] : s[1]] if s else None)(balanced(t))), "string")(text)


def qa_rows(response: Column) -> Column:
    """Questions of a response: the outermost array, mended if needed, else its single objects, as JSON strings."""

    def parse(t: str) -> list[str]:
        a, b = t.find("["), t.rfind("]")
        for candidate in (t[a : b + 1], mend_json(t[a : b + 1])) if 0 <= a < b else ():
            try:
                value = json.loads(candidate)
            except ValueError:
                continue
            if isinstance(value, list):
                return [json.dumps(v, ensure_ascii=False) for v in value if isinstance(v, dict) and "question" in v]
        return objects(t)

    return F.pandas_udf(_series(parse), "array<string>")(response)


def register_objects(spark: SparkSession, name: str = "json_objects", key: str = "question") -> str:
    """Registers a table function (text) -> object: the objects with ``key`` in a text, for lateral joins in SQL."""

    class Objects:
        def eval(self, text: str) -> Iterator[tuple[str]]:
            for found in objects(text or "", key):
                yield (found,)

    spark.udtf.register(name, F.udtf(Objects, returnType="object string"))
    return name
