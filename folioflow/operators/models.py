"""Language models by usage, with fallback, and prompts for them.

A model is a function from a list of prompts to a list of texts; it runs on Arrow
batches, and where it fails the fallback's text stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Model = Callable[[list[str]], list[str]]


class Models:
    """Models registered under usages; an unknown usage gets the default one."""

    def __init__(self, default: Model):
        self._by_usage: dict[str, Model] = {"default": default}

    def register(self, usage: str, model: Model) -> None:
        self._by_usage[usage] = model

    def usages(self) -> list[str]:
        return sorted(self._by_usage)

    def get(self, usage: str) -> Model:
        return self._by_usage.get(usage, self._by_usage["default"])

    def with_settings(self, **models: Model) -> Models:
        """A copy with other models under some usages; this one stays as it is."""
        other = Models(self._by_usage["default"])
        other._by_usage = {**self._by_usage, **models}
        return other


def generate(prompt: Column, model: Model, fallback: Column | None = None) -> Column:
    """The model's texts for a column of prompts; the fallback's, by default the prompt's, where there is none.

    A batch that the model fails on, or answers with another number of texts, and
    null or blank answers take the fallback. Null prompts are not asked.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            asked = s[s.notna()]
            try:
                texts = list(model(asked.tolist())) if len(asked) else []
            except Exception:  # noqa: BLE001  (whatever a model raises, the fallback stands)
                texts = []
            if len(texts) != len(asked):
                texts = [None] * len(asked)
            yield pd.Series(texts, index=asked.index, dtype=object).reindex(s.index)

    said = F.pandas_udf(run, StringType())(prompt)
    return F.coalesce(F.when(F.trim(said) != "", said), prompt if fallback is None else fallback)


_TAG = re.compile(r"\{%-?\s*include\s+[\"']([^\"']+)[\"']\s*-?%\}|\{\{\s*(\w+)(?:\s*\|\s*default\(\s*(?:\"([^\"]*)\"|'([^']*)')\s*\))?\s*\}\}")


def template(name: str, templates: dict[str, str], values: dict[str, Column], within: tuple[str, ...] = ()) -> Column:
    """A prompt from a template: ``{{ name }}``, ``{{ name | default("x") }}`` and ``{% include "other" %}``.

    Values are columns; a null or unknown one takes its default, else nothing. The
    template is taken apart once, here: what runs is one concatenation. KeyError
    for an unknown template, ValueError for one that includes itself.
    """
    if name in within:
        raise ValueError(f"template {name} includes itself")
    text, parts, at = templates[name], [], 0
    for m in _TAG.finditer(text):
        parts.append(F.lit(text[at : m.start()]))
        included, key, *given = m.groups()
        if included:
            parts.append(template(included, templates, values, (*within, name)))
        else:
            default = F.lit(next((g for g in given if g is not None), ""))
            parts.append(F.coalesce(values[key].cast("string"), default) if key in values else default)
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
