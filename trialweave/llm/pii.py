"""Personal data in texts, in SQL functions only: patterns propose, checksums confirm, nearby words weigh.

Each kind has a pattern whose leftmost matches that don't overlap are candidates, a check
(Luhn's of cards, mod 97 of IBANs, mod 23 of Spanish ids, ranges of addresses and numbers) and
a score: what the kind is worth by itself, more with a word such as *phone* around it, less
with one such as *invoice*. A candidate that fails its check goes, and nothing is looked for
again in its place. The first four kinds (``BASE``) stay whatever their score; of the others
(``ADDED``) those of ``LEAST`` and more that don't lie within one of the first four.

Spans count code points from 0, ends excluded. A text is cut around the matches of a pattern
and the lengths of its parts are summed in blocks, so that a text with very many matches costs
little more than its length; matches are looked for from where their leading class begins,
so that a long run of letters or digits is read once and not from each of its places.

Defined cases: a null or empty text has no spans. Repeated rows give repeated results, a null
doc_id is kept, other columns aren't read, an empty table gives no rows. U+0001, which marks
cuts, is read as U+0002 in texts; neither is in any pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn", "tel", "nif")
KINDS = BASE + ADDED
#: Code points of context before and after a candidate, parts whose lengths are summed together, the least score of what is added.
BEFORE, AFTER, TOGETHER, LEAST = 40, 20, 64, 0.5
#: What a kind is worth by itself, and by a word around it.
WORTH = {"email": (0.9, 0.05), "ip": (0.6, 0.2), "card": (0.7, 0.2), "phone": (0.7, 0.2), "iban": (0.8, 0.1), "ssn": (0.4, 0.4), "tel": (0.3, 0.4), "nif": (0.45, 0.4)}
AGAINST = 0.3

# A class that begins a match is entered at its start alone, or where the last match ended; what can't gain from backtracking gives nothing back.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The added kinds are looked for together.
MORE = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{8}[A-Z]"

ADDRESS = r"^(?:0*(?:1?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])(?:[.]|$)){4}$"
SSN = r"^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9][0-9]|[1-9][0-9][0-9][0-9])$"
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed values
_WORDS = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|addr|adresse|client",
    "card": "card|visa|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte",
    "phone": "tel|phone|call|mobile|cell|fax|telefon|tel[eé]fono|t[eé]l[eé]phone|handy|m[oó]vil",
    "iban": "iban|account|bank|bic|swift|konto|cuenta|compte",
    "ssn": "ssn|social security|social sec",
    "nif": "nif|dni|nie|documento",
}
_WORDS["tel"] = _WORDS["phone"]
_NOT = "order|invoice|serial|version|isbn|sku|build|bestellung|factura|facture"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def around(words: str) -> str:
    """A pattern of one of words by itself, in lower-case text."""
    return f"(^|[^a-z])(?:{words})([^a-z]|$)"


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def candidates(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """df with the matches of pattern in the column text as ``name``: array<struct<start, end, value, before, after>>, null without any."""
    marked = F.split(F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01$0\x01"), "\x01")
    df = df.withColumn("__parts", F.when(F.col(text).rlike(pattern), marked)).withColumn("__lengths", F.transform("__parts", F.length))
    # Columns that lambdas read more than once are computed once a row. Sums of the lengths before each block of parts:
    blocks = F.sequence(F.lit(0), F.floor((F.size("__lengths") - 1) / TOGETHER).cast("int"))
    block = lambda b: _sum(F.slice("__lengths", b * TOGETHER + 1, F.lit(TOGETHER)))
    sums = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + block(b))))
    df = df.withColumn("__sums", F.when(F.col("__lengths").isNotNull(), sums))
    part = lambda i: F.when(i >= 0, F.get("__parts", i))

    def one(i):
        b = F.floor(i / TOGETHER).cast("int")
        start = F.get("__sums", b) + _sum(F.slice("__lengths", b * TOGETHER + 1, i - b * TOGETHER))
        before = F.concat(*(F.right(F.coalesce(part(i - k), F.lit("")), F.lit(BEFORE)) for k in (3, 2, 1)))
        after = F.concat(*(F.left(F.coalesce(part(i + k), F.lit("")), F.lit(AFTER)) for k in (1, 2, 3)))
        return F.struct(start.alias("start"), (start + F.get("__lengths", i)).alias("end"), F.get("__parts", i).alias("value"), F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))

    found = F.transform(F.sequence(F.lit(1), F.size("__parts") - 2, F.lit(2)), one)
    return df.withColumn(name, F.when(F.col("__sums").isNotNull() & (F.size("__sums") > 0), found)).drop("__parts", "__lengths", "__sums")


def iban_ok(value: Column) -> Column:
    """mod 97 of an IBAN, whose spaces don't count."""
    plain = F.translate(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def step(acc, c):
        v = F.ascii(c)
        return F.when(v < 65, acc * 10 + v - 48).otherwise(acc * 100 + v - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def nif_ok(value: Column) -> Column:
    """The letter of a Spanish id by its number mod 23."""
    at = F.left(value, F.lit(8)).cast("int") % 23
    return F.substring(F.lit(NIF_LETTERS), at + 1, F.lit(1)) == F.right(value, F.lit(1))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


#: Whether a candidate's value holds.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(ADDRESS),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _score(kind: str, c: Column) -> Column:
    """A candidate's score by the words around it."""
    near = F.translate(F.concat(c["before"], F.lit(" "), c["after"]), LETTERS, LETTERS.lower())
    worth, more = WORTH[kind]
    score = F.lit(worth) + F.when(near.rlike(around(_WORDS[kind])), more).otherwise(0.0) - F.when(near.rlike(around(_NOT)), AGAINST).otherwise(0.0)
    return F.greatest(score, F.lit(LEAST)) if kind in BASE else score


def _span(kind: str, c: Column, value: Column | None = None) -> Column:
    value = c["value"] if value is None else value
    return F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (c["start"] + F.length(value)).alias("end"), value.alias("value"), _score(kind, c).alias("score"))


def _added(c: Column) -> Column:
    """The span of a candidate of MORE, null if its check fails: a kind follows from the form of the match."""
    value, shorter = c["value"], F.regexp_replace(c["value"], " [A-Z0-9]{1,4}$", "")
    alone = ~F.right(c["before"], F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(c["after"], F.lit(1)).rlike("[A-Za-z0-9]")
    apart = alone & ~c["before"].rlike(r"[0-9+][ ().-]{0,2}$") & ~c["after"].rlike("^[.-]?[0-9]")
    iban = F.when(iban_ok(value), _span("iban", c)).when(iban_ok(shorter), _span("iban", c, shorter))
    return (
        F.when(value.rlike("^[A-Z]"), F.when(~F.right(c["before"], F.lit(1)).rlike("[A-Za-z0-9]"), iban))
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-"), F.when(apart & value.rlike(SSN), _span("ssn", c)))
        .when(value.rlike("[A-Z]$"), F.when(alone & nif_ok(value), _span("nif", c)))
        .otherwise(F.when(apart, _span("tel", c)))
    )


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans, array<struct<start, rank, kind, end, value, score>> by start and kind, of each row of docs (doc_id, text)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in BASE:
        df = candidates(df, "text", PATTERNS[kind], f"c_{kind}")
    df = candidates(df, "text", MORE, "c_more")
    none = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int, value: string, score: double>>")
    confirmed = lambda kind: F.transform(F.filter(f"c_{kind}", lambda c: CHECKS[kind](c["value"])), lambda c: _span(kind, c))
    base = [F.coalesce(confirmed(kind), none) for kind in BASE]
    df = df.select("doc_id", F.concat(*base).alias("base"), F.coalesce(F.filter(F.transform("c_more", _added), lambda s: s["score"] >= LEAST), none).alias("more"))
    within = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return df.select("doc_id", F.array_sort(F.concat("base", F.filter("more", lambda s: ~within(s)))).alias("spans"))


def redacted(docs: DataFrame, keep: str = "[{}]") -> DataFrame:
    """docs (doc_id, text) with ``redacted``: every span's characters give way to its kind; of spans that overlap, the first."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find(df.select(F.struct("doc_id", "text").alias("doc_id"), "text")).select("doc_id.*", "spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc, s):
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        made = F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.format_string(keep.replace("{}", "%s"), s["kind"])).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(made)

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.select("doc_id", "text", F.aggregate("spans", start, put, rest).alias("redacted"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts and sha-256 of the first four kinds, and all spans as text, of what find() returns."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def _sql() -> str:
    """digests(find(documents)) in DuckDB's SQL: its patterns have neither bounds nor possessive repeats, and no need of them."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": PATTERNS["phone"], "more": MORE}
    parts = " UNION ALL ".join(f"SELECT r, {i} AS k, string_split(regexp_replace(t, '{p}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM d" for i, p in enumerate(patterns.values()))
    digits, near = "regexp_replace(value, '[^0-9]', '', 'g')", f"translate(before || ' ' || after, '{LETTERS}', '{LETTERS.lower()}')"
    worth = " ".join(f"WHEN rank = {KINDS.index(k)} THEN {w} + CASE WHEN regexp_matches(near, '{around(_WORDS[k])}') THEN {m} ELSE 0 END" for k, (w, m) in WORTH.items() if k in ADDED)
    mod = lambda v: f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(replace({v}, ' ', ''), 5) || left(replace({v}, ' ', ''), 4), ''), lambda c: CAST(CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), lambda a, x: (CASE WHEN x < 10 THEN a * 10 ELSE a * 100 END + x) % 97) = 1"
    name = "CASE rank " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    text = f"{name} || ':' || s || ':' || e"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
parts AS ({parts}),
cut AS (SELECT r, k, generate_subscripts(p, 1) AS i, unnest(p) AS value FROM parts WHERE len(p) > 1),
placed AS (SELECT *, sum(length(value)) OVER w - length(value) AS s, right({", ".join(f"lag(right(value, {BEFORE}), {n}, '') OVER w" for n in (3, 2, 1)).join(("concat(", ")"))}, {BEFORE}) AS before,
 left({", ".join(f"lead(left(value, {AFTER}), {n}, '') OVER w" for n in (1, 2, 3)).join(("concat(", ")"))}, {AFTER}) AS after FROM cut WINDOW w AS (PARTITION BY r, k ORDER BY i)),
found AS (SELECT r, k, CAST(s AS BIGINT) AS s, value, before, after, {near} AS near, right(before, 1) AS b1, left(after, 1) AS a1 FROM placed WHERE i % 2 = 0),
base AS (SELECT r, k AS rank, s, s + length(value) AS e FROM found WHERE k = 0
 OR (k = 1 AND regexp_matches(value, '{ADDRESS}')) OR (k = 3 AND length({digits}) BETWEEN 9 AND 15)
 OR (k = 2 AND length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, j: CASE WHEN j % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN c >= '5' THEN 9 ELSE 0 END END)) % 10 = 0)),
kinds AS (SELECT r, s, near, CASE
  WHEN regexp_matches(value, '^[A-Z]') THEN CASE WHEN NOT regexp_matches(b1, '[A-Za-z0-9]') AND ({mod('value')} OR {mod('shorter')}) THEN 4 END
  WHEN regexp_matches(value, '^[0-9]{{3}}-[0-9]{{2}}-') THEN CASE WHEN apart AND regexp_matches(value, '{SSN}') THEN 5 END
  WHEN regexp_matches(value, '[A-Z]$') THEN CASE WHEN alone AND substr('{NIF_LETTERS}', CAST(left(value, 8) AS INT) % 23 + 1, 1) = right(value, 1) THEN 7 END
  WHEN apart THEN 6 END AS rank, CASE WHEN regexp_matches(value, '^[A-Z]') AND NOT {mod('value')} THEN shorter ELSE value END AS value
 FROM (SELECT *, alone AND NOT regexp_matches(before, '[0-9+][ ().-]{{0,2}}$') AND NOT regexp_matches(after, '^[.-]?[0-9]') AS apart
  FROM (SELECT *, NOT regexp_matches(b1, '[A-Za-z0-9]') AND NOT regexp_matches(a1, '[A-Za-z0-9]') AS alone, regexp_replace(value, ' [A-Z0-9]{{1,4}}$', '') AS shorter FROM found WHERE k = 4))),
more AS (SELECT r, rank, s, s + length(value) AS e FROM kinds m WHERE rank IS NOT NULL AND CASE {worth} END - CASE WHEN regexp_matches(near, '{around(_NOT)}') THEN {AGAINST} ELSE 0 END >= {LEAST}
 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.s <= m.s AND m.s + length(m.value) <= b.e)),
both_ AS (SELECT * FROM base UNION ALL SELECT * FROM more),
sums AS (SELECT r, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(BASE))}, string_agg({text}, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg({text}, ',' ORDER BY s, rank) AS spans, count(*) FILTER (rank > 3) AS n_added FROM both_ GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added FROM d LEFT JOIN sums USING (r)"""


SQL = _sql()
