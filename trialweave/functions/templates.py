"""Prompt templates compiled to Column expressions: ``{{ name | filter }}`` and ``\\{{``."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_TAG = re.compile(r"(?<!\\)\{\{\s*([^{}]*?)\s*\}\}")

_WHOLE = re.compile(r"\s*" + _TAG.pattern.removeprefix(r"(?<!\\)") + r"\s*")


def _json(x: Column, indent: int | None = None) -> Column:
    """A column's values as JSON with sorted keys; Arrow carries what JSON functions of SQL can't space or sort."""

    @F.pandas_udf("string")
    def dumped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t)[0], ensure_ascii=False, sort_keys=True, indent=indent))

    return dumped(F.to_json(F.array(x), {"ignoreNullFields": "false"}))


# The names of filters.
FILTERS = {
    "json": _json,
    "json_pretty": lambda x: _json(x, 2),
    "upper": F.upper,
    "lower": F.lower,
    "strip": strip,
    "trim": strip,
    "int": lambda x: x.cast("double").cast("bigint").cast("string"),
    "len": lambda x: F.length(x).cast("string"),
}


class TemplateError(ValueError):
    """A tag without a name, or with an unknown variable or filter."""


def variables(template: str) -> list[str]:
    """Names that a template refers to, in order, each once."""
    return list(dict.fromkeys(tag.split("|")[0].strip() for tag in _TAG.findall(template)))


def variables_of(template: Column) -> Column:
    """The same of a column of templates, sorted."""
    tags = F.regexp_extract_all(template, F.lit(r"(?<!\\)\{\{\s*([^{}|]*?)\s*(?:\|[^{}]*)?\}\}"), 1)
    return F.array_sort(F.array_distinct(tags))


def missing(needed: Column, given: Column) -> Column:
    """Names that are needed and not among those given, sorted."""
    return F.array_sort(F.array_except(needed, given))


def _value(tag: str, template: str, values: Mapping[str, Column], kinds: Mapping[str, str]) -> Column:
    name, *filters = (p.strip() for p in tag.split("|"))
    if not name:
        raise TemplateError(f"empty tag in {template!r}")
    if name not in values:
        raise TemplateError(f"unknown variable {name!r}; there are {', '.join(sorted(values))}")
    value, many = values[name], kinds.get(name, "").startswith(("array", "map"))
    for f in filters:
        if f not in FILTERS:
            raise TemplateError(f"unknown filter {f!r}; there are {', '.join(sorted(FILTERS))}")
        value = F.size(value).cast("string") if f == "len" and many else FILTERS[f](value)
        many = False
    return value


def render_value(template: str, values: Mapping[str, Column], kinds: Mapping[str, str] = {}) -> Column:
    """Like render(); a template that is one tag and no more is the value itself, with its type (a list stays a list)."""
    whole = _WHOLE.fullmatch(template)
    return _value(whole[1], template, values, kinds) if whole else render(template, values, kinds)


def render_deep(config: Any, values: Mapping[str, Column], kinds: Mapping[str, str] = {}) -> Any:
    """config with every string that has a tag, however deep, as the Column that it renders to; all else as it is."""
    if isinstance(config, str):
        return render_value(config, values, kinds) if _TAG.search(config) else config.replace("\\{{", "{{")
    if isinstance(config, Mapping):
        return {k: render_deep(v, values, kinds) for k, v in config.items()}
    return [render_deep(v, values, kinds) for v in config] if isinstance(config, list | tuple) else config


def render(template: str, values: Mapping[str, Column], kinds: Mapping[str, str] = {}) -> Column:
    """The template with values (columns by variable) filled in; unknown names fail before anything runs.

    kinds: types of variables that aren't text, for ``len``.
    """
    parts: list[Column] = []
    at = 0
    for tag in _TAG.finditer(template):
        if tag.start() > at:
            parts.append(F.lit(template[at : tag.start()].replace("\\{{", "{{")))
        parts.append(_value(tag[1], template, values, kinds).cast("string"))
        at = tag.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:].replace("\\{{", "{{")))
    return F.concat(*parts)
