"""Lists of scorers as data: every case may have its own, and the plan has one expression for each type of scorer.

A list is JSON: objects of ``type``, ``name``, ``weight``, ``required`` and the type's options,
whose strings may hold tags that the case's variables fill. It is read as VARIANT, options
become arrays of texts, and types are branches over them, within the row: however many lists
there are, the plan has one size, and responses meet their cases in one join and no more.

Only what SQL has no function for goes to Python, in Arrow batches, and null where a row has
none of it: JSON targets, ``normalize_unicode`` and the ``json`` filters.

Defined cases: a response whose case has no list, or an unknown case, has null components; an
empty list gives no components. A list that is no JSON array, or a scorer with a fault (see
``faults``) fails when its row is scored, with ``task/case scoring[i]`` and what is wrong, or
has null components with ``on_fault="null"``. JSON null options are as if left out.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import scorers as S

_TAG = r"(?<!\\)\{\{\s*([^{}]*?)\s*\}\}"
_WHOLE = rf"^\s*{_TAG.removeprefix('(?<!' + chr(92) * 2 + ')')}\s*$"
_QUOTED = r'"\{\{\s*([^{}|"\\]*?)\s*\}\}"'
_FILTERS = ("json", "json_pretty", "upper", "lower", "strip", "trim", "int", "len")
_BUILT_IN = ("exact_match", "contains", "not_contains", "regex", "numeric", "choice", "json_match")
#: Components of a response.
COMPONENTS = "array<struct<name: string, type: string, value: double, passed: boolean, weight: double, required: boolean>>"


def _fn(name: str, *args) -> Column:
    return F.call_function(name, *args)


def _get(v: Column, kind: str) -> Column:
    return _fn("try_variant_get", v, F.lit("$"), F.lit(kind))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


_let = T.let


def _is(v: Column, *kinds: str) -> Column:
    found = F.lit(False)
    for k in kinds:
        found = found | _kind(v).startswith(k)
    return found


# --- tags --------------------------------------------------------------------------------


def _filtered(start: Column, v: Column, dumps: Column, names: Column) -> Column:
    """A value's text through filters; dumps: struct<json, pretty> of the value, for what comes first."""
    size = F.when(_is(v, "ARRAY"), F.size(_get(v, "array<variant>"))).when(_is(v, "OBJECT"), F.size(_get(v, "map<string,variant>"))).otherwise(F.length(start))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    whole = lambda x: x.cast("double").cast("bigint").cast("string")

    def step(acc, name):
        x, first = acc["x"], acc["first"]
        plain = first & ~_is(v, "STRING")
        to = (
            F.when(name == "upper", F.upper(x)).when(name == "lower", F.lower(x)).when(name.isin("strip", "trim"), T.strip(x)).when(name == "int", whole(x))
            .when(name == "len", F.when(first, size).otherwise(F.length(x)).cast("string"))
            .when(name == "json", F.when(plain, dumps["json"]).otherwise(quoted(x))).when(name == "json_pretty", F.when(plain, dumps["pretty"]).otherwise(quoted(x)))
        )
        return F.struct(to.alias("x"), F.lit(False).alias("first"))

    return F.aggregate(names, F.struct(start.alias("x"), F.lit(True).alias("first")), step, lambda acc: acc["x"])


def _tag_parts(tag: Column) -> tuple[Column, Column]:
    """(name, filters) of what a tag holds."""
    parts = F.transform(F.split(tag, r"\|"), lambda x: F.trim(x))
    return F.get(parts, F.lit(0)), F.slice(parts, 2, 99)


def _tag_value(tag: Column, variables: Column, dumps: Column) -> Column:
    name, filters = _tag_parts(tag)
    v = F.try_element_at(variables, name)
    text = v.cast("string")
    spelled = F.when(_is(v, "VOID"), "None").when(_is(v, "BOOLEAN"), F.initcap(text)).otherwise(text)
    return F.when(F.size(filters) == 0, spelled).otherwise(_filtered(text, v, F.try_element_at(dumps, name), filters))


def _woven(text: Column, pattern: str, value) -> Column:
    """text with each match of pattern replaced by value() of its first group."""
    between, tags = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.array_join(F.zip_with(between, F.concat(F.transform(tags, value), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def render(text: Column, variables: Column, dumps: Column) -> Column:
    """A template's text. variables: map<string, variant>; dumps: map<string, struct<json, pretty>>, read by the json filters alone."""
    return F.replace(F.when(text.contains("{{"), _woven(text, _TAG, lambda t: _tag_value(t, variables, dumps))).otherwise(text), F.lit("\\{{"), F.lit("{{"))


def _rendered_json(text: Column, variables: Column, dumps: Column) -> Column:
    """JSON whose strings hold tags: one that is a tag and no more gives way to the value with its type."""
    typed = _woven(text, _QUOTED, lambda t: F.coalesce(F.to_json(F.try_element_at(variables, t)), F.lit("null")))
    escaped = lambda x: F.regexp_replace(F.to_json(F.array(x)), r'^\["|"\]$', "")
    return F.when(text.contains("{{"), _woven(typed, _TAG, lambda t: escaped(_tag_value(t, variables, dumps)))).otherwise(text)


def _texts(v: Column, variables: Column, dumps: Column) -> Column:
    """An option as an array of texts: lists have several, all else has one."""

    def tagged(v):
        one = lambda e: F.when(_is(e, "STRING"), render(e.cast("string"), variables, dumps)).when(_is(e, "OBJECT", "ARRAY"), _rendered_json(F.to_json(e), variables, dumps)).otherwise(e.cast("string"))
        tag = F.regexp_extract(v.cast("string"), _WHOLE, 1)
        name, filters = _tag_parts(tag)
        named = F.try_element_at(variables, name)
        whole = _is(v, "STRING") & v.cast("string").rlike(_WHOLE) & (F.size(filters) == 0)
        listed = F.when(whole & _is(named, "ARRAY"), _get(named, "array<string>")).when(whole & ~_is(named, "VOID"), F.array(named.cast("string")))
        return F.when(_is(v, "ARRAY"), F.transform(_get(v, "array<variant>"), one)).when(whole, listed).otherwise(F.array(one(v)))

    plain = F.when(_is(v, "ARRAY"), _get(v, "array<string>")).otherwise(F.array(v.cast("string")))
    return F.when(F.to_json(v).contains("{{"), tagged(v)).otherwise(plain)


def _json_target(v: Column, variables: Column, dumps: Column) -> Column:
    """A JSON scorer's target as one JSON text; a string is JSON itself, a tag and no more stands for its value."""
    named = F.try_element_at(variables, _tag_parts(F.regexp_extract(v.cast("string"), _WHOLE, 1))[0])
    whole = v.cast("string").rlike(_WHOLE) & ~_is(named, "STRING")
    text = F.when(~_is(v, "STRING"), _rendered_json(F.to_json(v), variables, dumps)).when(whole, F.to_json(named)).otherwise(render(v.cast("string"), variables, dumps))
    return F.array(text)


# --- lists -------------------------------------------------------------------------------


def _options_of() -> dict[str, dict[str, inspect.Parameter]]:
    """The options of each type, as its function says."""
    own = {n: {p.name: p for p in list(inspect.signature(f).parameters.values())[1:] if p.kind is not p.VAR_KEYWORD} for n, f in S.SCORERS.items()}
    return own | {"not_contains": own["contains"]}


def _type_of(raw: Column) -> Column:
    """The type that an object names, by alias."""
    name = F.lower(F.trim(F.when(_is(F.try_element_at(raw, F.lit("type")), "STRING"), F.try_element_at(raw, F.lit("type")).cast("string"))))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in S.ALIASES.items() for x in kv)), name), name)


def _tags_of(options: Column) -> Column:
    """What the tags of all options hold."""
    return F.flatten(F.transform(F.map_values(options), lambda v: F.when(F.to_json(v).contains("{{"), F.regexp_extract_all(F.to_json(v), F.lit(_TAG.replace(r"(?<!\\)", r"(?<!\\\\)")), 1)).otherwise(F.array())))


def _fault(spec: Column, variables: Column) -> Column:
    """What is wrong with a scorer (struct<kind, all, options>), null if nothing is."""
    kind, raw, options, known = spec["kind"], spec["all"], spec["options"], _options_of()
    has = lambda k: F.map_contains_key(options, F.lit(k))
    weight, required = F.try_element_at(raw, F.lit("weight")), F.try_element_at(raw, F.lit("required"))
    allowed = F.create_map(*(x for n, o in known.items() for x in (F.lit(n), F.array(*map(F.lit, o)))))
    extra = F.array_sort(F.array_except(F.map_keys(options), F.try_element_at(allowed, kind)))
    none = F.array().cast("array<string>")

    def odd_tags(tags):
        names = F.transform(tags, lambda t: _tag_parts(t)[0])
        unknown = F.get(F.array_except(names, F.coalesce(F.map_keys(variables), none)), F.lit(0))
        odd = F.get(F.array_except(F.flatten(F.transform(tags, lambda t: _tag_parts(t)[1])), F.array(*map(F.lit, _FILTERS))), F.lit(0))
        return F.when(F.array_contains(names, ""), "empty tag").when(unknown.isNotNull(), F.concat(F.lit("unknown variable '"), unknown, F.lit("'"))).when(odd.isNotNull(), F.concat(F.lit("unknown filter '"), odd, F.lit("'")))

    of_tags = F.when(F.exists(F.map_values(options), lambda v: F.to_json(v).contains("{{")), _let(_tags_of(options), odd_tags))
    chain = F.coalesce(_get(F.try_element_at(options, F.lit("normalize")), "array<string>"), none)
    odd_step = F.array_except(chain, F.array(*map(F.lit, T.NORMALIZERS)))
    text = lambda k: F.lower(F.try_element_at(options, F.lit(k)).cast("string"))
    flags = F.coalesce(_get(F.try_element_at(options, F.lit("flags")), "array<string>"), none)
    odd_flag = F.array_except(F.transform(flags, lambda f: F.lower(f)), F.array(*map(F.lit, S._FLAGS)))
    needs = F.when(kind.isin("exact_match") & ~has("target") & ~has("any_of"), "exact_match needs target or any_of")
    needs = needs.when(kind.isin("contains", "not_contains") & ~has("target") & ~has("any_of") & ~has("all_of"), "contains needs target, any_of or all_of")
    needs = needs.when(kind.isin("numeric", "choice", "json_match") & ~has("target"), F.concat(kind, F.lit(" needs a target"))).when((kind == "regex") & ~has("pattern"), "regex needs a pattern")
    one_of = lambda k, n, *names: (kind == k) & has(n) & ~text(n).isin(*names)
    first = lambda a: F.get(a, F.lit(0))
    return (
        F.when(kind.isNull(), "a mapping with a type is needed")
        .when(~kind.isin(*known), F.concat(F.lit("unknown scorer '"), kind, F.lit(f"'; there are {', '.join(sorted(known))}")))
        .when((weight.isNotNull() & ~(_is(weight, "BIGINT", "DECIMAL", "DOUBLE") & (weight.cast("double") >= 0))) | (required.isNotNull() & ~_is(required, "BOOLEAN")), "weight is a number from 0, required true or false")
        .when(F.size(extra) > 0, F.concat(F.lit("unknown option '"), first(extra), F.lit("' of "), kind, F.lit("; there are "), F.array_join(F.array_sort(F.try_element_at(allowed, kind)), ", ")))
        .when(of_tags.isNotNull(), of_tags)
        .when(F.size(odd_step) > 0, F.concat(F.lit("unknown normalizer '"), first(odd_step), F.lit("'")))
        .when(F.size(F.filter(chain, lambda c: c == "normalize_unicode")) > 1, "normalize_unicode is in a chain once at most")
        .when((kind == "regex") & (F.size(odd_flag) > 0), F.concat(F.lit("unknown regex flag '"), first(odd_flag), F.lit("'")))
        .when(one_of("numeric", "extract", "first", "last", "all", "strict"), "extract is not one of last, first, all, strict")
        .when(one_of("json_match", "mode", "subset", "exact"), "mode is not subset or exact")
        .when(needs.isNotNull(), needs)
    )


def _own_lists(cases: DataFrame, task_scorers: DataFrame) -> DataFrame:
    """task_id, case_id, vars, scoring, and parsed: variables (map<string, variant>), raw (array<map<string, variant>>) and faults, an array."""
    own = cases.join(task_scorers, "task_id", "left").select("task_id", "case_id", "vars", F.coalesce("case_scoring", "task_scoring").alias("scoring"))
    parsed = own.withColumns({
        "variables": _get(F.try_parse_json("vars"), "map<string,variant>"),
        "raw": F.transform(_get(F.try_parse_json("scoring"), "array<variant>"), lambda v: F.when(_is(v, "OBJECT"), _get(v, "map<string,variant>"))),
    })
    given = lambda r: F.map_filter(r, lambda k, v: ~k.isin(*S.COMMON) & ~_is(v, "VOID"))
    parsed = parsed.withColumn("raw", F.transform("raw", lambda r: F.struct(_type_of(r).alias("kind"), r.alias("all"), given(r).alias("options"))))
    place = lambda i: F.concat(F.col("task_id"), F.lit("/"), F.col("case_id"), F.lit(" scoring["), i.cast("string"), F.lit("]: "))
    each = F.transform("raw", lambda r, i: F.concat(place(i), _fault(r, F.col("variables"))))
    none = F.when(F.col("raw").isNull() & F.col("scoring").isNotNull(), F.array(F.concat(F.col("task_id"), F.lit("/"), F.col("case_id"), F.lit(" scoring: a JSON list is needed"))))
    return parsed.withColumn("faults", F.coalesce(F.filter(each, lambda x: x.isNotNull()), none))


def faults(cases: DataFrame, task_scorers: DataFrame) -> DataFrame:
    """task_id, case_id and fault: what is wrong with the scorers of cases, before anything is scored."""
    return _own_lists(cases, task_scorers).select("task_id", "case_id", F.explode("faults").alias("fault"))


# --- types -------------------------------------------------------------------------------


def _one(options: Column, name: str) -> Column:
    return F.get(F.try_element_at(options, F.lit(name)), F.lit(0))


def _many(options: Column, *names: str) -> Column:
    """All texts of the named options; empty without any."""
    none = F.array().cast("array<string>")
    return F.concat(*(F.coalesce(F.try_element_at(options, F.lit(n)), none) for n in names))


def _flag(options: Column, name: str, default: bool) -> Column:
    return F.coalesce(_one(options, name).cast("boolean"), F.lit(default))


def _chain(kind: Column, options: Column) -> Column:
    own = F.try_element_at(options, F.lit("normalize"))
    default = F.when(kind == "exact_match", F.array(*map(F.lit, T.DEFAULT_CHAIN))).when(kind == "regex", F.array(F.lit("strip_thinking"))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(own, default)


def _normalized(texts: Column, chain: Column) -> Column:
    """texts through the normalizers that chain names, one after another; normalize_unicode isn't among them."""

    def step(x, name):
        out = F.when(name.isNull(), x)
        for n, f in T.NORMALIZERS.items():
            if n != "normalize_unicode":
                out = out.when(name == n, f(x))
        return out

    return F.transform(texts, lambda t: F.aggregate(chain, t, step))


def _nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    form = lambda t: None if t is None else unicodedata.normalize("NFKC", t)
    return texts.map(lambda rows: None if rows is None else [None if r is None else [form(t) for t in r] for r in rows])


def _dumps(objects: pd.Series) -> pd.Series:
    def both(v):
        return {"json": json.dumps(v, ensure_ascii=False, sort_keys=True), "pretty": json.dumps(v, ensure_ascii=False, sort_keys=True, indent=2)}

    return objects.map(lambda text: None if text is None else {k: both(v) for k, v in json.loads(text).items()})


def _json_matches(texts: pd.Series, specs: pd.Series) -> pd.Series:
    """For each response the results of its JSON scorers (structs of target, mode, partial), null for others."""

    def one(text, specs):
        return None if specs is None else [None if s is None else S.json_text_result(text, s["target"], s["mode"], s["partial"]) for s in specs]

    return pd.Series([one(t, s) for t, s in zip(texts, specs)], index=texts.index, dtype=object)


def _group(pattern: Column, wanted: Column) -> Column:
    """The number of a regular expression's group by number or name, 0 without one, null if there is no such group."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[\^?\]?[^\]]*\]", ""), r"\(\?P<", "(?<")
    opened = lambda c: F.regexp_count(c, F.lit(r"\((?!\?)|\(\?<[A-Za-z]"))
    name = F.concat(F.lit("(?<"), wanted, F.lit(">"))
    named = F.when(F.contains(bare, name), opened(_fn("substring_index", bare, name, F.lit(1))) + 1)
    number = F.when(wanted.rlike("^[0-9]+$"), wanted.try_cast("int")).otherwise(named)
    return F.when(wanted.isNull(), 0).when(number <= opened(bare), number)


def _result(kind: Column, options: Column, texts: Column, numbers: Column, letter: Column, matched: Column, response: str) -> Column:
    """struct<value, passed> of a scorer: one branch for each type. texts: the normalized response and targets."""
    fold = lambda sensitive: lambda x: F.when(sensitive, x).otherwise(F.lower(x))
    said, targets = F.get(texts, F.lit(0)), F.slice(texts, 2, 1 << 20)
    case = fold(_flag(options, "case_sensitive", True))
    exact = F.array_contains(F.transform(targets, case), case(said))

    loose = fold(_flag(options, "case_sensitive", False))
    some, every = _many(options, "target", "any_of"), _many(options, "all_of")

    def there(said):
        """struct<share, any> of what is in a text."""
        found = lambda needle: F.contains(said, loose(needle))
        share = F.coalesce(F.size(F.filter(every, found)) / F.nullif(F.size(every), F.lit(0)), F.lit(1.0))
        return F.struct(share.alias("share"), ((F.size(some) == 0) | F.exists(some, found)).alias("any"))

    def contains(kind):
        """The text is folded and searched once."""

        def scored(t):
            value, ok = F.when(t["any"], t["share"]).otherwise(0.0), t["any"] & (t["share"] == 1.0)
            return F.when(kind == "contains", S.score(value, ok)).otherwise(S.score(F.lit(1.0) - value, ~ok))

        return _let(_let(loose(said), there), scored)

    flags = F.array_join(F.array_sort(F.array_distinct(F.transform(_many(options, "flags"), lambda f: F.try_element_at(F.create_map(*(F.lit(x) for kv in S._FLAGS.items() for x in kv)), F.lower(f))))), "")
    plain = F.replace(_one(options, "pattern"), F.lit("(?P<"), F.lit("(?<"))
    pattern = F.when(flags == "", plain).otherwise(F.concat(F.lit("(?"), flags, F.lit(")"), plain))
    expect, group = _flag(options, "expect", True), _group(_one(options, "pattern"), _one(options, "group"))
    got = F.rlike(said, pattern)
    aimed = F.when(expect & (F.size(targets) > 0), got & (T.strip(_fn("regexp_extract", said, pattern, group)) == F.get(targets, F.lit(0)))).otherwise(F.when(expect, got).otherwise(~got))
    aimed = F.when(group.isNull(), F.raise_error(F.concat(F.lit("the pattern has no such group: "), _one(options, "pattern"))).cast("boolean")).otherwise(aimed)

    number = lambda n: F.coalesce(_one(options, n).try_cast("double"), F.lit(0.0))
    extract = F.coalesce(_one(options, "extract"), F.lit("last"))
    n = F.size(numbers)
    chosen = F.when(n == 0, numbers).when(extract == "last", F.slice(numbers, F.greatest(n, F.lit(1)), F.lit(1))).when(extract == "first", F.slice(numbers, 1, 1)).when((extract == "strict") & (n != 1), F.slice(numbers, 1, 0)).otherwise(numbers)
    close = F.exists(chosen, lambda v: S.close(v, _one(options, "target").try_cast("double"), number("tolerance"), number("rel_tolerance")))

    letters = F.transform(F.when(F.size(_many(options, "options")) > 0, _many(options, "options")).otherwise(F.array(*map(F.lit, "ABCD"))), lambda x: F.upper(x))
    initial = F.left(F.upper(letter), F.lit(1))
    picked = F.when(F.array_contains(letters, letter), letter).when(F.array_contains(letters, initial), initial).otherwise(letter) == F.upper(_one(options, "target"))

    plain_score = lambda passed: _let(passed, lambda p: S.score(p.cast("int"), p))
    out = F.when(kind == "exact_match", plain_score(exact)).when(kind.isin("contains", "not_contains"), contains(kind))
    out = out.when(kind == "regex", plain_score(aimed)).when(kind == "numeric", plain_score(close)).when(kind == "choice", plain_score(picked)).when(kind == "json_match", matched)
    for name, scorer in S.SCORERS.items():
        if name not in _BUILT_IN:
            out = out.when(kind == name, scorer(F.col(response), **{p: _argument(options, p, x.default) for p, x in _options_of()[name].items()}))
    return out


def _argument(options: Column, name: str, default) -> Column:
    """An option of a registered scorer as a column: its default where it isn't given, a list where the default is one."""
    if isinstance(default, list | tuple):
        return F.coalesce(F.try_element_at(options, F.lit(name)), F.array(*map(F.lit, default)).cast("array<string>"))
    if isinstance(default, bool):
        return _flag(options, name, default)
    if isinstance(default, int | float):
        return F.coalesce(_one(options, name).try_cast("double"), F.lit(float(default)))
    return F.coalesce(_one(options, name), F.lit(default)) if isinstance(default, str) else _one(options, name)


def score_cases(responses: DataFrame, cases: DataFrame, task_scorers: DataFrame, response: str = "response_text", on_fault: str = "raise", keys: Sequence[str] = ("task_id", "case_id")) -> DataFrame:
    """responses (task_id, case_id) with ``components``, by their cases' scorers: a case's own (case_scoring) or its task's (task_scoring), JSON lists.

    Variables are those of the case (vars, a JSON object).
    """
    if on_fault not in ("raise", "null"):
        raise ValueError(f"on_fault is {on_fault!r}, not raise or null")
    own = _own_lists(cases, task_scorers).withColumn("dumps", F.pandas_udf(_dumps, "map<string, struct<json: string, pretty: string>>")(F.when(F.col("scoring").rlike(r"\|\s*json"), F.col("vars"))))
    known = F.col("variables"), F.col("dumps")

    def options(r):
        texts = lambda k, v: F.when((k == "target") & (r["kind"] == "json_match"), _json_target(v, *known)).otherwise(_texts(v, *known))
        return F.transform_values(r["options"], texts)

    def scorer(r):
        text = lambda k: F.try_element_at(r["all"], F.lit(k)).cast("string")
        weight, required = F.coalesce(text("weight").try_cast("double"), F.lit(1.0)), F.coalesce(text("required").try_cast("boolean"), F.lit(True))
        fixed = F.coalesce(text("name"), text("type")).alias("name"), text("type").alias("type"), weight.alias("weight"), required.alias("required")
        chained = lambda o: F.struct(r["kind"].alias("kind"), *fixed, o.alias("options"), _chain(r["kind"], o).alias("chain"))
        composed = lambda c: F.array_position(c["chain"], "normalize_unicode").cast("int").alias("composed")
        return _let(_let(options(r), chained), lambda c: F.struct(*(c[f].alias(f) for f in ("kind", "name", "type", "weight", "required", "options", "chain")), composed(c)))

    sound = F.size("faults") == 0
    specs = F.when(sound, F.transform("raw", scorer))
    if on_fault == "raise":
        specs = F.when(~sound, F.raise_error(F.array_join("faults", "; ")).cast(specs_type())).otherwise(specs)
    own = own.select("task_id", "case_id", specs.alias("__specs"))
    rows = responses.join(own, list(keys), "left")

    of = lambda *kinds: F.exists("__specs", lambda s: s["kind"].isin(*kinds))
    unicode = lambda s: s["composed"] > 0
    targets = lambda s: F.when(s["kind"].isin("exact_match", "regex"), _many(s["options"], "target", "any_of")).otherwise(F.array().cast("array<string>"))
    texts = lambda s: F.concat(F.array(F.col(response)), targets(s))
    before = lambda s: F.when(unicode(s), F.slice(s["chain"], F.lit(1), s["composed"] - 1)).otherwise(s["chain"])
    after = lambda s: F.slice(s["chain"], s["composed"] + 1, F.size(s["chain"]))
    rows = rows.withColumn("__texts", F.transform("__specs", lambda s: _normalized(texts(s), before(s))))
    composed = F.pandas_udf(_nfkc, "array<array<string>>")(F.when(F.exists("__specs", unicode), F.zip_with("__specs", "__texts", lambda s, t: F.when(unicode(s), t))))
    targeted = lambda s: F.struct(F.coalesce(_one(s["options"], "target"), F.lit("null")).alias("target"), F.coalesce(_one(s["options"], "mode"), F.lit("subset")).alias("mode"), _flag(s["options"], "partial_credit", True).alias("partial"))
    wanted = F.when(of("json_match"), F.transform("__specs", lambda s: F.when(s["kind"] == "json_match", targeted(s))))
    said = F.when(of("json_match"), F.coalesce(T.strip_code_fence(T.strip_thinking(F.col(response))), F.lit("")))
    rows = rows.withColumns({"__composed": composed, "__matched": F.pandas_udf(_json_matches, "array<struct<value: double, passed: boolean>>")(said, wanted)})
    numbers = F.filter(F.transform(T.numbers(_let(T.strip_thinking(F.col(response)), T.extract_boxed)), lambda x: x.try_cast("double")), lambda v: v.isNotNull())
    rows = rows.withColumns({"__numbers": F.when(of("numeric"), numbers), "__letter": F.when(of("choice"), T.extract_choice(F.col(response)))})
    ready = F.zip_with("__specs", "__texts", lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    rows = rows.withColumn("__ready", F.transform(ready, lambda r, i: F.struct(r["s"].alias("s"), F.when(unicode(r["s"]), _normalized(F.get("__composed", i), after(r["s"]))).otherwise(r["t"]).alias("t"))))

    def component(r, i):
        s = r["s"]
        got = _result(s["kind"], s["options"], r["t"], F.col("__numbers"), F.col("__letter"), F.get("__matched", i), response)
        return F.struct(s["name"].alias("name"), s["type"].alias("type"), got["value"].alias("value"), got["passed"].alias("passed"), s["weight"].alias("weight"), s["required"].alias("required"))

    rows = rows.withColumn("components", F.transform("__ready", component).cast(COMPONENTS))
    return rows.drop("__specs", "__texts", "__composed", "__matched", "__numbers", "__letter", "__ready")


def specs_type() -> str:
    return "array<struct<kind: string, name: string, type: string, weight: double, required: boolean, options: map<string, array<string>>, chain: array<string>, composed: int>>"
