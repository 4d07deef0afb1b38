"""op12: ranked search against scores of all documents."""

import collections
import math
import re

import duckdb
import pytest

from trialweave.llm import queries, ranked

FIXTURE = [(1, "the cat sat on the mat"), (2, "The CAT, the cat!"), (3, None), (4, ""), (5, "..."), (6, "é É naïve 日本語 x1"), (None, "cat cat cat"), (7, "dog"), (7, "dog"), (9, "zebra " * 5000 + "cat")]
ITEMS = [(0, "Cat, the cat"), (1, None), (2, "?"), (3, "É x1 日本語"), (3, "unseen"), (4, "dog dog zebra mat"), (4, "dog dog zebra mat"), (None, "the")]


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k=10):
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, length in held:
            m = 25 + (75 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    many = FIXTURE * 3 + [(1000 + i, f"cat {'the ' * (i % 7)} w{i % 13} {'pad ' * (i % 40)}") for i in range(900)] + [(5000 + i, "one text that is many rows") for i in range(700)]
    docs = spark.createDataFrame([(d, t, 0, 1, 2, "x") for d, t in many], "doc_id long, text string, n int, m long, shard long, terms string").repartition(5)
    items = ITEMS + [(10 + i, f"w{i} the pad text rows w{i + 1}") for i in range(20)]
    return many, docs, items, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string").repartition(2)


def test_equals_the_scores_of_all_documents(tables, monkeypatch):
    many, docs, items, asked = tables
    monkeypatch.setattr(ranked, "MOST_DOCS", 64)  # strata in several blocks
    monkeypatch.setattr(ranked, "LEAST_DOCS", 16)
    assert sorted(map(tuple, ranked.search(docs, asked).collect()), key=repr) == plain(many, items)


def test_groups_of_items_and_small_slices_change_nothing(tables, monkeypatch):
    many, docs, items, asked = tables
    for name, n in (("ITEM_TERMS", 40), ("TOGETHER", 50), ("FIRST", 1)):
        monkeypatch.setattr(ranked, name, n)
    assert sorted(map(tuple, ranked.search(docs, asked, 3).collect()), key=repr) == plain(many, items, 3)


def test_empty_tables(spark, tables):
    _, docs, _, asked = tables
    assert ranked.search(docs.limit(0), asked).collect() == [] and ranked.search(docs, asked.limit(0)).collect() == []
    assert ranked.search(docs.where("text = '...'"), asked).collect() == []


def test_agrees_with_its_sql(spark, sf_dir):
    con = duckdb.connect(config={"temp_directory": ""})
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op12_stratified_search"]).fetchall()
    assert sorted(map(tuple, queries.op12_stratified_search(spark, sf_dir).collect())) == sorted(want)


def test_bounds_hold_for_every_document_of_a_block(spark, tables):
    many, docs, items, asked = tables
    found = ranked.index(docs, sorted({t.encode() for _, x in items for t in terms(x)}))
    assert sum(len(r["docs"]) // 8 for r in found.blocks.collect()) <= sum(bool(terms(t)) for _, t in many)
    assert found.n_documents == sum(bool(terms(t)) for _, t in many) and found.n_terms == sum(len(terms(t)) for _, t in many)
