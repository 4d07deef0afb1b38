"""Answer normalizers as Column expressions, by name and as chains.

White space is what Java calls so with Unicode classes on, in every normalizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define these normalizers.
NUMBER = r"(?U)[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
#: The white space of a regular expression with (?U), as trims take it.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BEFORE, BEHIND = WHITE + "\"'`([{<.,;:!?*_-", WHITE + "\"'`)]}>.,;:!?*_-"
ARTICLE = r"(?iU)\b(a|an|the)\b"
FENCE = r"(?sU)^\s*```[a-zA-Z0-9_+-]*\s*\n?(.*?)\n?\s*```\s*$"
THINKING = r"(?isU)<(think|thinking|scratchpad|reasoning)>.*?</\1>"
BOXED = r"\\boxed\{([^{}]*)\}"
ANSWER = r"(?iU)^(?:the\s+)?(?:final\s+)?answer\s*(?:is|:)\s*"
CHOICE = r"(?U)\b([A-Ja-j])\b(?=[).:,\s]|$)"
EMPHASIS = r"(?s)(\*{1,3}|_{1,3})(.+?)\1"
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once however often f reads it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def collapse_whitespace(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def strip_punctuation(x: Column) -> Column:
    return F.rtrim(F.ltrim(x, F.lit(BEFORE)), F.lit(BEHIND))


def strip_articles(x: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(x, ARTICLE, " "))


def strip_code_fence(x: Column) -> Column:
    return F.when(strip(x).rlike(FENCE), F.regexp_extract(strip(x), FENCE, 1)).otherwise(x)


def strip_thinking(x: Column) -> Column:
    return strip(F.regexp_replace(x, THINKING, ""))


def strip_markdown(x: Column) -> Column:
    """Emphasis unwrapped until there is none: each pass that changes a text takes two of its marks at least."""
    marks = F.length(x) - F.length(F.translate(x, "*_", ""))

    def once(held, _):
        less = F.regexp_replace(held["text"], EMPHASIS, "$2")
        return F.when(held["done"], held).otherwise(F.struct(less.alias("text"), (less == held["text"]).alias("done")))

    start = F.struct(x.alias("text"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(marks / 2).cast("int")), start, once, lambda held: held["text"])


def strip_quotes(x: Column) -> Column:
    """One layer of quotes, if the text begins and ends with a pair."""
    x = strip(x)
    inner = strip(F.substring(x, F.lit(2), F.length(x) - 2))
    paired = F.lit(False)
    for opening, closing in QUOTES:
        paired = paired | (x.startswith(opening) & x.endswith(closing))
    return F.when((F.length(x) >= 2) & paired, inner).otherwise(x)


def strip_answer_prefix(x: Column) -> Column:
    return F.regexp_replace(strip(x), ANSWER, "")


def strip_trailing_period(x: Column) -> Column:
    return F.when(x.endswith("."), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)


def _lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, LINE_END), strip), lambda line: line != "")


def first_line(x: Column) -> Column:
    return F.coalesce(F.get(_lines(x), F.lit(0)), F.when(x.isNotNull(), ""))


def last_line(x: Column) -> Column:
    return F.coalesce(F.try_element_at(_lines(x), F.lit(-1)), F.when(x.isNotNull(), ""))


def extract_boxed(x: Column) -> Column:
    return F.coalesce(strip(F.try_element_at(F.regexp_extract_all(x, F.lit(BOXED), 1), F.lit(-1))), x)


def numbers(x: Column) -> Column:
    """All numbers in a text, as strings without thousands separators."""
    return F.transform(F.regexp_extract_all(x, F.lit(NUMBER), 0), lambda n: F.replace(n, F.lit(","), F.lit("")))


def extract_last_number(x: Column) -> Column:
    return F.coalesce(F.try_element_at(numbers(x), F.lit(-1)), x)


def extract_first_number(x: Column) -> Column:
    return F.coalesce(F.get(numbers(x), F.lit(0)), x)


def extract_choice(x: Column) -> Column:
    """The last letter A to J that stands alone: of the last line, else of the whole text; else the text itself."""
    last = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(CHOICE), 1), F.lit(-1))
    line = strip_answer_prefix(last_line(x))
    line = F.when(line != "", line).otherwise(x)
    return F.coalesce(F.upper(last(line)), F.upper(last(x)), strip(x))


def _nfkc(texts: pa.Array, size: int = 1 << 20) -> pa.Array:
    """NFKC of texts, about ``size`` bytes of them at a time as Python strings; a slice in ASCII stays as it is."""
    import unicodedata

    done, start = [], 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        some = texts.slice(start, stop - start)
        if not pc.all(pc.string_is_ascii(some), min_count=0).as_py():
            some = pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in some.to_pylist()], texts.type)
        done.append(some)
        start = stop
    return pa.concat_arrays(done) if done else texts


def normalize_unicode(x: Column) -> Column:
    """NFKC, which Spark has no function for."""

    @F.arrow_udf("string")
    def nfkc(texts: pa.Array) -> pa.Array:
        out = _nfkc(texts)
        pa.default_memory_pool().release_unused()
        return out

    return nfkc(x)


# The names that specs call normalizers by, and the chain that they have by default.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "strip": strip,
    "collapse_whitespace": collapse_whitespace,
    "lower": F.lower,
    "upper": F.upper,
    "strip_punctuation": strip_punctuation,
    "strip_articles": strip_articles,
    "strip_code_fence": strip_code_fence,
    "strip_thinking": strip_thinking,
    "strip_markdown": strip_markdown,
    "strip_quotes": strip_quotes,
    "strip_answer_prefix": strip_answer_prefix,
    "strip_trailing_period": strip_trailing_period,
    "first_line": first_line,
    "last_line": last_line,
    "extract_boxed": extract_boxed,
    "extract_last_number": extract_last_number,
    "extract_first_number": extract_first_number,
    "extract_choice": extract_choice,
    "normalize_unicode": normalize_unicode,
}

_IN_SQL = frozenset(NORMALIZERS.values()) - {normalize_unicode}
DEFAULT_CHAIN = ("strip_thinking", "strip_code_fence", "strip_markdown", "strip_answer_prefix", "strip_quotes", "collapse_whitespace", "strip_punctuation")


def register(name: str, normalizer: Callable[[Column], Column]) -> None:
    NORMALIZERS[name] = normalizer


def normalize(x: Column, chain: Sequence[str] = DEFAULT_CHAIN) -> Column:
    """x through the named normalizers, left to right; an empty chain leaves it as it is.

    Most of them read their text several times: what a step of Spark's functions reads is computed once. Others, which may
    be Python and so can't stand in a lambda, read x as it is.
    """
    for name in chain:
        if name not in NORMALIZERS:
            raise ValueError(f"unknown normalizer {name!r}; there are {', '.join(sorted(NORMALIZERS))}")
        f = NORMALIZERS[name]
        x = let(x, f) if f in _IN_SQL else f(x)
    return x


def slug(x: Column, length: int = 32) -> Column:
    dashes = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    return dashes(F.left(dashes(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "-")), F.lit(length)))


def run_id(name: Column, at: Column, salt: Column) -> Column:
    """``YYYYmmdd-HHMMSS-slug-6hex`` of a run's name and its start (a UTC timestamp); ids sort by time."""
    stamp, named = F.date_format(at, "yyyyMMdd-HHmmss"), F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("run"))
    return F.concat_ws("-", stamp, named, F.left(F.sha2(F.concat(stamp, named, salt.cast("string")), 256), F.lit(6)))


def truncate(x: Column, length: int) -> Column:
    return F.when(F.length(x) > length, F.concat(F.left(x, F.lit(length)), F.lit(" ...[+"), (F.length(x) - length).cast("string"), F.lit(" chars]"))).otherwise(x)


def glob_pattern(glob: str) -> str:
    """A regular expression that matches what the shell pattern matches."""
    out = ""
    for token in re.findall(r"\[!?[^\]]+\]|.", glob, re.DOTALL):
        out += {"*": ".*", "?": "."}.get(token) or (token.replace("[!", "[^") if len(token) > 1 else re.escape(token))
    return f"(?s)^{out}$"
