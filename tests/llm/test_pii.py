"""op11: spans against plain regular expressions and against DuckDB."""

import hashlib
import re

import duckdb
import pytest

from trialweave.llm import pii, queries

LONG = "x" * 30000 + "@a.b" + " 1" * 2000 + " 1.1.1.1" * 1000
ROWS = [
    (1, "tel: (838) 555-7235, DE89 3704 0044 0532 0130 00 THEN my SSN is 123-45-6789 dni 12345678Z call +1 (838) 555-7235 x"),
    (2, None), (3, ""), (3, ""), (None, "BE68539007547034 iban GB82 WEST 1234 5698 7654 32."),
    (4, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111, 4111-1111-1111-1112 😀 x@y.zz 0007.1.1.255"),
    (5, "order 838-555-7235 phone; version 1.2.3.4"), (10, "phone 838-555-7235"), (6, "\x01\x01 1\x012 +1\x01 234567890 +1((((((((( +12345678 +1234567890123456"),
    (7, LONG), (8, "DE89 3704 0044 0532 0130 01 account, 666-12-3456 ssn 000-12-3456 ssn, 12345678A dni"), (11, "code 123-45-6789"), (9, "é@é.é a@b a@b. @b.c 日本a.b-c@d-e.f.g-h"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    """The first four kinds as the patterns say, and nothing else."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(d, t, 1, "k", 0) for d, t in ROWS], "doc_id long, text string, c_email int, spans string, base int").repartition(3)


def test_base_spans_are_those_of_the_patterns(spark, table, sf_dir):
    for df in (table, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = sorted(((r["doc_id"] or 0, r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.digests(pii.find(df)).collect()))
        want = []
        for r in df.collect():
            spans = plain(r["text"])
            want.append((r["doc_id"] or 0, hashlib.sha256(",".join(spans).encode()).hexdigest(), *(sum(s.startswith(f"{k}:") for s in spans) for k in pii.BASE)))
        assert got == sorted(want)


def test_checks_and_context_decide_on_what_is_added(table):
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.digests(pii.find(table)).collect()}
    assert got[1] == ["tel:5:19", "iban:21:48", "ssn:64:75", "nif:80:89", "phone:95:112"]
    assert got[None] == ["iban:0:16", "iban:22:49"]
    assert got[5] == ["ip:34:41"] and got[10] == ["tel:6:18"]  # beside "order" a number isn't one's own
    assert not any(x.startswith(("iban", "ssn", "nif")) for x in got[8] + got[11])  # checks fail, or no word says what it is


def test_agrees_with_its_sql(spark, table, sf_dir):
    for df in (table, spark.read.parquet(f"{sf_dir}/documents.parquet"), table.limit(0)):
        con = duckdb.connect(config={"temp_directory": ""})
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        if rows := [(r["doc_id"], r["text"]) for r in df.collect()]:
            con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        found = con.execute(queries.oracle_sql()["op11_pii_spans"])
        names = [c[0] for c in found.description]
        assert sorted(map(repr, map(tuple, pii.digests(pii.find(df)).select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_redaction_takes_out_what_was_found(table):
    got = {r["doc_id"]: r["redacted"] for r in pii.redacted(table).collect()}
    assert got[1] == "tel: [tel], [iban] THEN my SSN is [ssn] dni [nif] call [phone] x"
    assert got[4].startswith("[email][email] [ip].[ip] 256.1.1.1 [card], 4111-1111-1111-1112 😀 [email]") or got[4].startswith("[email][email] [ip].[ip] 256.1.1.1 4111")


def test_no_python_and_no_shuffle_in_the_plan(spark, sf_dir):
    plan = queries.op11_pii_spans(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange"))
