"""JSON compared with JSON inside the row: VARIANT values, level by level, without Python.

A reply's text is read as a whole, else from its widest braces, else from its widest brackets. What the JVM's parser and
Python's read differently (NaN, lone surrogates, very long numbers, repeated keys, more levels than a parser takes) is called
``odd`` and left to the caller, who has Python for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = "\x01end"
_ODD = r"NaN|Infinity|\\u[dD][89a-fA-F]|[0-9]{16}|[eE][+-]?[0-9]{3}"
_PAIRS = "array<struct<want: variant, got: variant>>"


def _as(v: Column, kind: str) -> Column:
    return F.call_function("try_variant_get", v, F.lit("$"), F.lit(kind))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once however often f reads it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def _wrapped(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"\\u0001end"]')))


def strict(text: Column) -> Column:
    """The JSON value of a whole text, null unless it is one value and nothing else (the parser itself stops after a value)."""
    return _let(_as(_wrapped(text), "array<variant>"), lambda a: F.when((F.size(a) == 2) & (_as(F.get(a, F.lit(1)), "string") == _END), F.get(a, F.lit(0))))


def _reads(text: Column) -> Column:
    """Whether strict() finds a value, without a lambda: Python functions can take what hangs on it."""
    at = lambda path, kind: F.call_function("try_variant_get", _wrapped(text), F.lit(path), F.lit(kind))
    return F.coalesce((at("$[1]", "string") == _END) & at("$[2]", "variant").isNull(), F.lit(False))


def _cut(text: Column) -> tuple[Column, Column]:
    """The widest braces and the widest brackets of a text, null without any."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def _looks_whole(text: Column) -> Column:
    return text.rlike(r'^\s*[\[{"]')


def _may_be_whole(text: Column) -> Column:
    """No other text is JSON as it stands; a parser that fails costs more than the pattern."""
    return text.rlike(r'^\s*[\[{"0-9tfn-]')


def odd_reply(text: Column) -> Column:
    """Whether reply() calls a text odd, without a lambda."""
    part = F.coalesce(*_cut(text))
    return text.rlike(_ODD) | (~(_may_be_whole(text) & _reads(text)) & part.isNotNull() & (_looks_whole(text) | ~_reads(part)))


def odd_target(text: Column) -> Column:
    """Whether target() calls a text odd, without a lambda."""
    return text.rlike(_ODD) | ~_reads(text)


def reply(text: Column) -> Column:
    """struct<json variant, odd boolean> of a response's text; json is null where there is none, or where it is odd. A null text has none."""

    def read(x: Column) -> Column:
        braces, brackets = _cut(x)
        parts = F.struct(x.alias("x"), F.when(_may_be_whole(x), strict(x)).alias("whole"), F.coalesce(braces, brackets).alias("part"))

        def chosen(p: Column) -> Column:
            missed = _let(strict(p["part"]), lambda v: F.struct(v.alias("json"), (p["part"].isNotNull() & v.isNull()).alias("odd")))
            nothing = F.struct(F.lit(None).cast("variant").alias("json"), F.lit(True).alias("odd"))
            whole = F.struct(p["whole"].alias("json"), F.lit(False).alias("odd"))
            return F.when(p["x"].rlike(_ODD), nothing).when(p["whole"].isNotNull(), whole).when(_looks_whole(p["x"]) & p["part"].isNotNull(), nothing).otherwise(missed)

        return _let(parts, chosen)

    return _let(F.coalesce(text, F.lit("")), read)


def target(text: Column) -> Column:
    """struct<json variant, odd boolean, depth int> of a target's text; depth is at least its number of levels."""
    return _let(text, lambda x: F.struct(F.when(~x.rlike(_ODD), strict(x)).alias("json"), (x.isNotNull() & (x.rlike(_ODD) | strict(x).isNull())).alias("odd"), F.regexp_count(x, F.lit(r"[\[{]")).alias("depth")))


def _number(v: Column, kind: Column) -> Column:
    """A number as a double; truth values are 1 and 0, as they are in Python."""
    return F.when(kind == "BOOLEAN", _as(v, "boolean").cast("double")).when((kind == "DOUBLE") | (kind == "BIGINT") | kind.startswith("DECIMAL"), _as(v, "double"))


def _same(want: Column, got: Column) -> Column:
    """Whether two scalars are one value; a missing one (null) is none."""

    def by_kind(k: Column) -> Column:
        numbers = _number(want, k["want"]) == _number(got, k["got"])
        texts = (k["want"] == "STRING") & (k["got"] == "STRING") & (_as(want, "string") == _as(got, "string"))
        return F.coalesce(numbers, F.lit(False)) | F.coalesce(texts, F.lit(False)) | F.coalesce((k["want"] == "VOID") & (k["got"] == "VOID"), F.lit(False))

    return _let(F.struct(F.schema_of_variant(want).alias("want"), F.schema_of_variant(got).alias("got")), by_kind)


def leaves(want: Column, got: Column, depth: Column) -> Column:
    """struct<n, wrong>: the leaves of want, and those that are missing in got or differ there.

    Empty objects and lists are leaves. A list must have its length, or all its leaves are wrong. Each turn opens one level of
    all pairs that are left, so that depth + 1 turns are enough; turns on no pairs cost next to nothing.
    """

    def opened(p: Column) -> Column:
        return F.struct(p["want"].alias("want"), p["got"].alias("got"), _as(p["want"], "map<string,variant>").alias("wm"), _as(p["want"], "array<variant>").alias("wa"), _as(p["got"], "map<string,variant>").alias("gm"), _as(p["got"], "array<variant>").alias("ga"))

    inner = lambda o: F.coalesce((F.size(o["wm"]) > 0) | (F.size(o["wa"]) > 0), F.size(o["wm"]) > 0, F.size(o["wa"]) > 0, F.lit(False))

    def children(o: Column) -> Column:
        named = F.transform(F.map_keys(o["wm"]), lambda k: F.struct(F.try_element_at(o["wm"], k).alias("want"), F.try_element_at(o["gm"], k).alias("got")))
        listed = F.transform(o["wa"], lambda w, i: F.struct(w.alias("want"), F.when(F.size(o["ga"]) == F.size(o["wa"]), F.get(o["ga"], i)).alias("got")))
        return F.when(F.size(o["wm"]) > 0, named).otherwise(listed)

    def wrong(o: Column) -> Column:
        return F.when(o["wm"].isNotNull(), o["gm"].isNull()).when(o["wa"].isNotNull(), F.coalesce(F.size(o["ga"]) != 0, F.lit(True))).otherwise(~_same(o["want"], o["got"]))

    def turn(acc: Column, _: Column) -> Column:
        def level(os: Column) -> Column:
            ends = F.filter(os, lambda o: ~inner(o))
            pairs = F.flatten(F.transform(F.filter(os, inner), children))
            return F.struct(pairs.alias("pairs"), (acc["n"] + F.size(ends)).alias("n"), (acc["wrong"] + F.size(F.filter(ends, wrong))).alias("wrong"))

        return F.when(F.size(acc["pairs"]) == 0, acc).otherwise(_let(F.transform(acc["pairs"], opened), level))

    start = F.struct(F.array(F.struct(want.alias("want"), got.alias("got"))).cast(_PAIRS).alias("pairs"), F.lit(0).alias("n"), F.lit(0).alias("wrong"))
    return F.aggregate(F.sequence(F.lit(0), depth), start, turn, lambda acc: F.struct(acc["n"].alias("n"), acc["wrong"].alias("wrong")))


def verdict(got: Column, want: Column, exact: Column, partial_credit: Column) -> Column:
    """struct<value, passed> of a reply() by a target(); null where one of them is odd or the target null.

    exact: keys at the top that the target hasn't count as wrong too. A text without JSON has value 0.
    """

    def rated(n: Column, wrong: Column) -> Column:
        share = F.greatest(F.lit(0.0), (n - wrong) / n)
        return F.struct(F.when(wrong == 0, 1.0).when(partial_credit, share).otherwise(0.0).alias("value"), (wrong == 0).alias("passed"))

    def compared(g: Column, w: Column) -> Column:
        keys = lambda v: F.map_keys(_as(v, "map<string,variant>"))
        more = F.when(exact, F.coalesce(F.size(F.array_except(keys(g["json"]), keys(w["json"]))), F.lit(0))).otherwise(0)
        return _let(F.struct(leaves(w["json"], g["json"], w["depth"]).alias("of"), more.alias("more")), lambda r: rated(r["of"]["n"], r["of"]["wrong"] + r["more"]))

    none = F.struct(F.lit(0.0).alias("value"), F.lit(False).alias("passed"))
    return _let(F.struct(got.alias("g"), want.alias("w")), lambda p: F.when(~p["g"]["odd"] & ~p["w"]["odd"] & p["w"]["json"].isNotNull(), F.when(p["g"]["json"].isNull(), none).otherwise(compared(p["g"], p["w"]))))
