"""The judge's calls through the cache: asked once, kept, costed; stale and failed ones are asked again."""

from pyspark.sql import functions as F

from trialweave.operators import judge_calls
from trialweave.sources import cache

JUDGE = judge_calls.Endpoint("p", "j", input_per_mtok=1e6, output_per_mtok=1e6)


def ask(seen):
    def asked(rows):
        seen.append(rows)
        return rows.withColumns({"reply": F.when(F.col("prompt") != "bad", F.concat(F.lit("re "), "prompt")), "input_tokens": F.lit(2), "output_tokens": F.lit(1)})

    return asked


def table(spark):
    return spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate([("a", 0), ("a", 0), ("a", 1), ("b", 0), ("bad", 0), ("bad", 0), (None, 0)])] + [(100 + i, "hot", 0) for i in range(200)], "n long, prompt string, sample_index long")


def stats(calls):
    return tuple(calls.stats().first())


def test_each_key_is_asked_once_and_kept(spark):
    seen = []
    first = judge_calls.call(table(spark), cache.empty(spark), ask(seen), JUDGE, ["n"], now=10.0)
    assert sorted((r["prompt"] or "", r["sample_index"]) for r in seen[0].collect()) == [("", 0), ("a", 0), ("a", 1), ("b", 0), ("bad", 0), ("hot", 0)]
    # calls, hits, misses, failed (prompt "bad" twice, and a null one), tokens, cost
    assert stats(first) == (207, 201, 6, 3, 18, 18.0)
    got = {r["n"]: (r["reply"], r["cached"]) for r in first.replies.collect()}
    assert got[0] == ("re a", False) and got[1] == ("re a", True) and got[4] == (None, False) and got[150] == ("re hot", True) and len(got) == 207
    rows = first.cache.collect()
    assert len(rows) == 4 and sum(r["hits"] for r in rows) == 200 and all('"re ' in r["payload"] for r in rows)
    again = judge_calls.call(table(spark), first.cache, ask(seen), JUDGE, ["n"], now=20.0)
    assert sorted(r["prompt"] or "" for r in seen[1].collect()) == ["", "bad"] and stats(again)[:4] == (207, 205, 2, 3)
    stale = judge_calls.call(table(spark), first.cache, ask(seen), JUDGE, ["n"], now=20.0, ttl=5.0)
    assert stats(stale)[2] == 6 and stale.cache.count() == 4 and stale.cache.agg(F.min("created_at")).first()[0] == 20.0


def test_other_judges_and_candidates_share_nothing(spark):
    rows = table(spark).where("prompt = 'a'")
    key = lambda e: {r["cache_key"] for r in judge_calls.requests(rows, e).collect()}
    assert not key(JUDGE) & key(judge_calls.Endpoint("p", "j2")) and not key(JUDGE) & key(judge_calls.Endpoint("p", "j", '{"t":1}'))
    assert judge_calls.requests(rows.withColumn("system", F.lit("s")), JUDGE).first()["cache_key"] not in key(JUDGE)


def test_nothing_to_ask(spark):
    none = judge_calls.call(table(spark).limit(0), cache.empty(spark), ask([]), JUDGE, ["n"])
    assert stats(none) == (0, 0, 0, 0, 0, 0.0) and none.cache.count() == 0
