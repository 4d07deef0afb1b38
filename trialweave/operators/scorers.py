"""Scorers: (response, configuration) to a struct<value double, passed boolean>, as Column expressions."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.templates import TemplateError, render_deep
from . import structural


class ScoringError(ValueError):
    """A scorer that can't be built from its options."""


def score(value: Column, passed: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), passed.alias("passed"))


Texts = Sequence[str | int | float | Column] | Column


def _as_column(text: Any) -> Column:
    """A text, number or truth value of a spec as text; a Column as it is."""
    if isinstance(text, Column):
        return text
    if isinstance(text, float) and text.is_integer():
        text = int(text)
    return F.lit(str(text).lower() if isinstance(text, bool) else str(text))


def _as_array(texts: Texts, target: Any = None, to: Callable[[Column], Column] = lambda c: c) -> Column | None:
    """What ``to`` makes of texts (literals and columns, or one column of arrays) and target, as an array; None if there are none."""
    one = [] if target is None else [to(_as_column(target))]
    if isinstance(texts, Column):
        many = F.transform(texts, to)
        return F.concat(F.array(*one), many) if one else many
    every = one + [to(_as_column(t)) for t in texts]
    return F.array(*every) if every else None


def exact_match(response: Column, target: Any = None, any_of: Texts = (), case_sensitive: bool = True, normalize: Sequence[str] = T.DEFAULT_CHAIN) -> Column:
    """1 if the normalized response is one of the normalized targets."""
    fold = (lambda x: x) if case_sensitive else F.lower
    targets = _as_array(any_of, target, lambda t: fold(T.normalize(t, normalize)))
    if targets is None:
        raise ScoringError("exact_match needs target or any_of")
    hit = F.array_contains(targets, fold(T.normalize(response, normalize)))
    return score(hit.cast("int"), hit)


def contains(response: Column, target: Any = None, any_of: Texts = (), all_of: Texts = (), case_sensitive: bool = False, normalize: Sequence[str] = ()) -> Column:
    """0 if none of any_of occurs; else the share of all_of that occurs (1 without any)."""
    some_of, each_of = _as_array(any_of, target), _as_array(all_of)
    if some_of is None and each_of is None:
        raise ScoringError("contains needs target, any_of or all_of")
    fold = (lambda x: x) if case_sensitive else F.lower
    text = fold(T.normalize(response, normalize))
    found = lambda needle: F.contains(text, fold(needle))
    share, ok = F.lit(1.0), F.lit(True)
    if each_of is not None:
        share = F.coalesce(F.size(F.filter(each_of, found)) / F.nullif(F.size(each_of), F.lit(0)), F.lit(1.0))
        ok = share == 1.0
    if some_of is not None:
        some = F.exists(some_of, found)
        share, ok = F.when(some, share).otherwise(0.0), some & ok
    return score(share, ok)


def not_contains(response: Column, **options: Any) -> Column:
    """1 - value and not passed of contains()."""
    got = contains(response, **options)
    return score(F.lit(1.0) - got["value"], ~got["passed"])


# The names of flags.
_FLAGS = {"i": "i", "ignorecase": "i", "m": "m", "multiline": "m", "s": "s", "dotall": "s", "x": "x", "verbose": "x"}


def regex(response: Column, pattern: str, flags: Sequence[str] = (), group: int | str | None = None, target: Any = None, expect: bool = True, normalize: Sequence[str] = ("strip_thinking",)) -> Column:
    """Whether the pattern is found (or isn't, with expect=False); with a target, whether the group (a number or name; all by default) is it."""
    unknown = [f for f in flags if f.lower() not in _FLAGS]
    if unknown:
        raise ScoringError(f"unknown regex flag {unknown[0]!r}")
    java = "".join(sorted({_FLAGS[f.lower()] for f in flags}))
    try:
        groups = re.compile(pattern)
    except re.error as e:
        raise ScoringError(f"invalid pattern {pattern!r}: {e}") from e
    at = 0 if group is None else groups.groupindex.get(group, -1) if isinstance(group, str) else group
    if not 0 <= at <= groups.groups:
        raise ScoringError(f"the pattern {pattern!r} has no group {group!r}")
    pattern = (f"(?{java})" if java else "") + pattern.replace("(?P<", "(?<")
    text = T.normalize(response, normalize)
    found = text.rlike(pattern)
    if target is not None and expect:
        got = T.strip(F.regexp_extract(text, pattern, at))
        found = found & (got == T.normalize(_as_column(target), normalize))
    ok = found if expect else ~found
    return score(ok.cast("int"), ok)


def close(v: Column, target: Column, tolerance: Column | float, rel_tolerance: Column | float) -> Column:
    """Whether v is target, or no further from it than a tolerance."""
    return ~F.isnan(v) & ((v == target) | (F.abs(v - target) <= tolerance) | ((target != 0) & (F.abs(v - target) <= F.abs(target) * rel_tolerance)))


def numeric(response: Column, target: float | Column, tolerance: float = 0.0, rel_tolerance: float = 0.0, extract: str = "last") -> Column:
    """Whether a number of the response is close to target: the last, the first, any (all), or the only one (strict)."""
    target = F.lit(float(target)) if isinstance(target, int | float) else target.cast("double")
    text = T.extract_boxed(T.strip_thinking(response))
    values = F.filter(F.transform(T.numbers(text), lambda n: n.try_cast("double")), lambda v: v.isNotNull())
    chosen = {"last": F.slice(values, -1, 1), "first": F.slice(values, 1, 1), "all": values, "strict": F.when(F.size(values) == 1, values).otherwise(F.slice(values, 1, 0))}
    if extract not in chosen:
        raise ScoringError(f"extract is {extract!r}, not one of {', '.join(chosen)}")
    # slice() from the end fails on nothing
    values = F.when(F.size(values) > 0, chosen[extract]).otherwise(F.slice(values, 1, 0))
    ok = F.exists(values, lambda v: close(v, target, tolerance, rel_tolerance))
    return score(ok.cast("int"), ok)


def choice(response: Column, target: Any, options: Sequence[str] = ("A", "B", "C", "D")) -> Column:
    """Whether the letter chosen in the response is the target."""
    options = [o.upper() for o in options]
    if isinstance(target, str) and target.upper() not in options:
        raise ScoringError(f"target {target!r} is not among {options}")
    got = T.extract_choice(response)
    got = F.when(got.isin(options), got).otherwise(F.when(F.left(F.upper(got), F.lit(1)).isin(options), F.left(F.upper(got), F.lit(1))).otherwise(got))
    ok = got == F.upper(_as_column(target))
    return score(ok.cast("int"), ok)


def _parsed(text: str) -> Any:
    """The JSON value of a text: whole, else from the widest braces, else the widest brackets; ValueError without any."""
    for opening, closing in ((None, None), ("{", "}"), ("[", "]")):
        lo, hi = (0, len(text)) if opening is None else (text.find(opening), text.rfind(closing) + 1)
        if 0 <= lo < hi:
            try:
                return json.loads(text[lo:hi])
            except (ValueError, RecursionError):
                continue
    raise ValueError("no JSON")


def _leaves(value: Any) -> int:
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else None
    return sum(map(_leaves, inner)) if inner else 1


def _wrong(want: Any, got: Any) -> int:
    """How many leaves of want are missing in or differ from got."""
    if isinstance(want, dict):
        return sum(_wrong(v, got[k]) if k in got else _leaves(v) for k, v in want.items()) if isinstance(got, dict) else _leaves(want)
    if isinstance(want, list):
        return sum(map(_wrong, want, got)) if isinstance(got, list) and len(got) == len(want) else _leaves(want)
    return int(want != got)


def json_result(want: Any, got: Any, mode: str, partial_credit: bool) -> tuple[float, bool]:
    """(value, passed) of a reply's JSON by a target."""
    wrong = _wrong(want, got)
    if mode == "exact" and isinstance(want, dict) and isinstance(got, dict):
        wrong += len(set(got) - set(want))
    n = _leaves(want)
    return 1.0 if not wrong else max(0.0, (n - wrong) / n) if partial_credit else 0.0, not wrong


def json_text_result(text: str, target: str, mode: str, partial_credit: bool) -> tuple[float | None, bool | None]:
    """json_result of texts; (None, None) if the target is no JSON."""
    try:
        want = json.loads(target)
    except (ValueError, RecursionError):
        return None, None
    try:
        return json_result(want, _parsed(text), mode, partial_credit)
    except (ValueError, RecursionError):
        return 0.0, False


def _json_target(target: str | dict | list | Column, mode: str) -> Column:
    if mode not in ("subset", "exact"):
        raise ScoringError(f"mode is {mode!r}, not subset or exact")
    try:
        return target if isinstance(target, Column) else F.lit(json.dumps(json.loads(target) if isinstance(target, str) else target))
    except ValueError as e:
        raise ScoringError(f"the target is no JSON: {e}") from e


def _json_compared(mode: str, partial_credit: bool) -> Callable[[Column], Column]:
    """A function of struct<text, target>, null where either is null."""

    @F.pandas_udf("value double, passed boolean")
    def compare(pairs: pd.DataFrame) -> pd.DataFrame:
        rows = [(None, None) if t is None or want is None else json_text_result(t, want, mode, partial_credit) for t, want in zip(pairs["text"], pairs["target"])]
        return pd.DataFrame(rows, columns=["value", "passed"]).astype({"value": "float64", "passed": "boolean"})

    return compare


def json_match(response: Column, target: str | dict | list | Column, mode: str = "subset", partial_credit: bool = True) -> Column:
    """How much of the JSON target the response's JSON has; exact: without further keys at the top.

    A target that is a column is JSON; value and passed are null where that is null or no JSON.
    """
    text = F.coalesce(T.strip_code_fence(T.strip_thinking(response)), F.lit(""))
    wanted = _json_target(target, mode)
    return _json_compared(mode, partial_credit)(F.struct(text.alias("text"), wanted.alias("target")))


def json_match_variant(response: Column, target: str | dict | list | Column, mode: str = "subset", partial_credit: bool = True) -> Column:
    """json_match() inside the row, by VARIANT values: Python sees only texts that its parser reads otherwise than the JVM's.

    For short replies the plain one is several times faster; this one needs no memory for Python workers where replies are plain.
    """
    wanted = _json_target(target, mode)
    text = F.coalesce(T.strip_code_fence(T.strip_thinking(response)), F.lit(""))
    fast = structural.verdict(structural.reply(text), structural.target(wanted), F.lit(mode == "exact"), F.lit(partial_credit))
    odd = structural.odd_target(wanted) | structural.odd_reply(text)
    return F.coalesce(fast, _json_compared(mode, partial_credit)(F.when(odd, F.struct(text.alias("text"), wanted.alias("target")))))


SCORERS: dict[str, Callable[..., Column]] = {"exact_match": exact_match, "contains": contains, "not_contains": not_contains, "regex": regex, "numeric": numeric, "choice": choice, "json_match": json_match}
# The other names that these scorers go by.
ALIASES = {"exact": "exact_match", "match": "exact_match", "includes": "contains", "substring": "contains", "number": "numeric", "mcq": "choice", "multiple_choice": "choice", "json": "json_match"}


def register(name: str, scorer: Callable[..., Column]) -> None:
    SCORERS[name] = scorer


def build(kind: str, response: Column, **options: Any) -> Column:
    """The scorer of a name or alias, any case."""
    name = kind.strip().lower()
    name = ALIASES.get(name, name)
    if name not in SCORERS:
        raise ScoringError(f"unknown scorer {kind!r}; there are {', '.join(sorted(SCORERS))}")
    allowed = [p.name for p in inspect.signature(SCORERS[name]).parameters.values() if p.kind is not p.VAR_KEYWORD][1:]
    allowed += [p for p in inspect.signature(contains).parameters if name == "not_contains" and p != "response"]
    if unknown := sorted(set(options) - set(allowed)):
        raise ScoringError(f"unknown option {unknown[0]!r} of {name}; there are {', '.join(sorted(allowed))}")
    return SCORERS[name](response, **options)


#: What every scorer's mapping may have beside its options.
COMMON = ("type", "name", "weight", "required")


def stack(scoring: Sequence[Mapping[str, Any]], response: Column, values: Mapping[str, Column], where: str, kinds: Mapping[str, str] = {}) -> Column:
    """Components of a response, array<struct<name, type, value, passed, weight, required>>, by a spec's list of scorers.

    Options that hold tags are rendered by values (columns by variable). Whatever is wrong with a scorer is said with its place.
    """
    made = []
    for i, spec in enumerate(scoring):
        at = f"{where} scoring[{i}]"
        try:
            if not isinstance(spec, Mapping) or not isinstance(spec.get("type"), str):
                raise ScoringError("a mapping with a type is needed")
            weight, required = spec.get("weight", 1.0), spec.get("required", True)
            if isinstance(weight, bool) or not isinstance(weight, int | float) or weight < 0 or not isinstance(required, bool):
                raise ScoringError("weight is a number from 0, required true or false")
            got = build(spec["type"], response, **render_deep({k: v for k, v in spec.items() if k not in COMMON}, values, kinds))
        except (ScoringError, TemplateError, TypeError, ValueError) as e:
            raise ScoringError(f"{at}: {e}") from e
        made.append(F.struct(F.lit(spec.get("name") or spec["type"]).alias("name"), F.lit(spec["type"]).alias("type"), got["value"].alias("value"), got["passed"].alias("passed"), F.lit(float(weight)).alias("weight"), F.lit(required).alias("required")))
    return F.array(*made)


def verdict_of(components: Column, threshold: Column | float = 0.0) -> Column:
    """verdicts() of a row's own array of components, without a shuffle: struct<score, passed>; null of an empty one."""
    total = lambda f: F.aggregate(components, F.lit(0.0), lambda acc, c: acc + f(c))
    weight = total(lambda c: c["weight"])
    mean = F.when(weight > 0, total(lambda c: c["value"] * c["weight"]) / weight).otherwise(total(lambda c: c["value"]) / F.size(components))
    ok = F.forall(components, lambda c: ~c["required"] | c["passed"]) & (mean >= threshold)
    made = F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("score"), ok.alias("passed"))
    return F.when(F.size(components) > 0, made)


def verdicts(components: DataFrame, keys: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """A score and a pass for each key, from components (value, passed, weight, required).

    The score is the weighted mean (the plain mean if all weights are 0), the pass that all
    required components passed and the score reaches the threshold.
    """
    weighted = F.sum(F.col("value") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))
    mean = F.coalesce(weighted, F.avg("value"))
    required = F.coalesce(F.bool_and(F.when(F.col("required"), F.col("passed"))), F.lit(True))
    return components.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("score"), (required & (mean >= threshold)).alias("passed"), F.count("*").alias("components"))
