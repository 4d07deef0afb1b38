"""Small derived columns: identities, tokens, money, times, statuses, prompts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, characters as they are: the text that fingerprints are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def unit_id(task: Column, case: Column) -> Column:
    return F.concat_ws("/", task, case)


def side_label(run: Column, model: Column) -> Column:
    return F.concat_ws(":", F.left(run, F.lit(22)), model)


def token_estimate(text: Column) -> Column:
    """0 for an empty text, else a quarter of its code points, rounded up."""
    return F.when(F.length(text) == 0, 0).otherwise(F.floor((F.length(text) + 3) / 4)).cast("long")


def cost_usd(input_tokens: Column, output_tokens: Column, input_per_mtok: Column, output_per_mtok: Column, cached: Column) -> Column:
    return F.when(cached, F.lit(0.0)).otherwise((input_tokens * input_per_mtok + output_tokens * output_per_mtok) / F.lit(1e6))


def tag_union(*tags: Column) -> Column:
    out = tags[0]
    for t in tags[1:]:
        out = F.array_union(out, t)
    return F.array_sort(F.array_distinct(out))


def merge_params(*layers: Column) -> Column:
    """Maps merged key by key; later layers win."""
    out = layers[0]
    for layer in layers[1:]:
        kept = F.map_filter(out, lambda k, v: ~F.map_contains_key(layer, k))
        out = F.map_concat(kept, layer)
    return out


def prompt_text(system: Column, messages: Column) -> Column:
    """``system``, then ``role: content`` of each message (an array of structs), blank lines between."""
    said = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")
    return F.concat_ws("\n\n", F.when(system != "", system), said)


def cache_key(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of the JSON object of fields, by name; nulls are written."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def suite_fingerprint(fingerprints: Column) -> Column:
    """An aggregate: SHA-256 of the JSON list of a group's fingerprints in order."""
    return F.sha2(F.to_json(F.sort_array(F.collect_list(fingerprints))), 256)


def duration_seconds(x: Column) -> Column:
    """``90``, ``30m``, ``12h``, ``7d``, ``2w`` in seconds; null for anything else."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([smhdw])?\s*$"
    unit = F.lower(F.regexp_extract(x, pattern, 2))
    size = F.when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0).when(unit == "w", 604800.0).otherwise(1.0)
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1).try_cast("double") * size)


def retry_after_seconds(x: Column) -> Column:
    """``1.5``, ``3s`` and ``500ms`` in seconds; null for dates and anything else."""
    number = r"^\s*(\d+(?:\.\d+)?)\s*(ms|s)?\s*$"
    value = F.regexp_extract(x, number, 1).try_cast("double")
    return F.when(F.regexp_extract(x, number, 2) == "ms", value / 1000).otherwise(value)


def http_outcome(status: Column) -> Column:
    # The statuses that are tried again.
    again = [408, 409, 425, 500, 502, 503, 504, 529]
    return F.when(status < 400, "ok").when(status == 429, "rate_limited").when(status.isin(again), "transient").otherwise("fatal")


def text_blocks(blocks: Column) -> Column:
    """The texts of blocks of type text, joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 64 bits of the SHA-256 of parts, joined by U+001F."""
    joined = F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    bits = F.conv(F.left(F.sha2(joined, 256), F.lit(16)), 16, 10).cast("decimal(20,0)").cast("double")
    return bits / F.lit(float(2**64))


def draw(k: Column, *parts: Column | str) -> Column:
    """An index in [0, k) from 48 bits of the SHA-256 of parts: the same on any partitioning."""
    joined = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    bits = F.conv(F.left(F.sha2(joined, 256), F.lit(12)), 16, 10).cast("double")
    return F.floor(bits / F.lit(float(2**48)) * k).cast("long")


def retry_after(headers: Column) -> Column:
    """Seconds to wait by a map of headers (names in lower case): the first of three that is a number."""
    # The headers, in order of precedence.
    names = ("retry-after", "x-ratelimit-reset-requests", "x-ratelimit-reset-tokens")
    return F.coalesce(*(retry_after_seconds(F.lower(F.try_element_at(headers, F.lit(name)))) for name in names))


def split_params(params: Column) -> Column:
    """A map of parameters as struct<common, extra>: those that all providers know, and the rest."""
    # The parameters that all providers know.
    common = ["temperature", "max_tokens", "top_p", "stop", "seed"]
    return F.struct(F.map_filter(params, lambda k, _: k.isin(common)).alias("common"), F.map_filter(params, lambda k, _: ~k.isin(common)).alias("extra"))


def as_text(value: Column, kind: str) -> Column:
    """A scalar as specs write it: true and false, whole numbers without a point. kind: the column's type."""
    if kind in ("float", "double"):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def rounded(rows: DataFrame, digits: int = 6, **others: int) -> DataFrame:
    """rows for output: doubles rounded to ``digits`` places; others: places of single columns."""
    doubles = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "double"]
    return rows.withColumns({c: F.round(c, others.get(c, digits)) for c in doubles})


def percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.bround(value * 100, digits))


def interval_cell(low: Column, high: Column, method: Column, digits: int = 1) -> Column:
    """Half the interval's width in points, or n/a where there is none."""
    return F.when(method.isin("empty", "degenerate"), "n/a").otherwise(F.format_string(f"±%.{digits}f", F.bround((high - low) / 2 * 100, digits)))


def money(value: Column) -> Column:
    return F.when(value == 0, "$0").when(value < 0.01, F.format_string("$%.4f", F.bround(value, 4))).otherwise(F.format_string("$%.2f", F.bround(value, 2)))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    minutes, hours = F.floor(whole / 60).cast("bigint"), F.floor(whole / 3600).cast("bigint")
    return F.when(seconds < 60, F.format_string("%.1fs", F.bround(seconds, 1))).when(minutes < 60, F.format_string("%dm%02ds", minutes, whole % 60)).otherwise(F.format_string("%dh%02dm", hours, minutes % 60))


#: What the scores of a scale of 4 stand for, where a caller says nothing else.
ANCHORS = {0: "not met at all", 1: "mostly not met", 2: "met in part", 3: "met with small flaws", 4: "met in full"}


def judge_prompt(
    response: Column,
    rubric: Sequence[tuple[str, str] | tuple[str, str, float]],
    scale: int,
    question: Column | None = None,
    reference: Column | None = None,
    instructions: str | None = None,
    anchors: Mapping[int, str] | None = None,
) -> Column:
    """The text that asks a judge to score a response by the rubric's criteria (name, description, perhaps weight).

    anchors: what scores stand for; by default ANCHORS, as far as they go and for the top of the scale.
    """
    parts = []
    if question is not None:
        parts.append(F.concat(F.lit("QUESTION\n"), question))
    parts.append(F.concat(F.lit("RESPONSE\n"), response))
    if reference is not None:
        parts.append(F.concat(F.lit("REFERENCE\n"), reference))
    if instructions:
        parts.append(F.lit("INSTRUCTIONS\n" + instructions))
    weight = lambda c: f" (weight {c[2]:g})" if len(c) > 2 else ""
    parts.append(F.lit("RUBRIC\n" + "\n".join(f"- {c[0]}{weight(c)}: {c[1]}" for c in rubric)))
    known = ANCHORS if anchors is None else anchors
    stands = ", ".join(f"{n} = {known.get(n, 'in between')}" for n in range(scale + 1) if n in known or n == scale)
    parts.append(F.lit(f"SCALE\nInteger scores from 0 to {scale}: {stands}."))
    parts.append(F.lit("FORMAT\n" + canonical_json({"scores": {c[0]: "score" for c in rubric}, "rationale": "one sentence"})))
    return F.concat_ws("\n\n", *parts)
