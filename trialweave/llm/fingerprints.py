"""Document fingerprints: the bottom-k sketch of a text's word-shingle hashes, in SQL functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's
five-word shingles. Sketches of parts merge into that of the whole; two sketches give
estimates of resemblance and containment, one gives the distinct shingle count. With
fewer than k shingles all three are exact.

Defined cases: words are runs between spaces and 09-0D, in lower case. A text of fewer
words than the width has one shingle, its whole sequence; a null or empty text, or one
without words, has the empty sketch and the fingerprint ''. Two empty sketches have the
resemblance 1, an empty and another one 0. Equal texts have equal sketches. Other columns of
the input are not read; repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import array_literal, places_in, shuffle_partitions

#: Hashes in a sketch: the standard error of a resemblance of 0.5 is 0.044.
K = 128
WIDTH = 5
#: Rows that follow one another are dealt out in so many runs for each shuffle partition, whose bounds come from so many sampled rows each.
RUNS, SAMPLED = 4, 16
_ORDER = "nameless: int, place: bigint, head: string, hash: bigint, row: bigint"


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """df with the sketch of the column ``text`` as ``name``, array<bigint>."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn("__words", F.transform(words, lambda w: F.xxhash64(w)))
    # The words' hashes are a column of their own, so that the lambda below reads and doesn't recompute them.
    h, n = F.col("__words"), F.size("__words")
    many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))
    hashes = F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(n, h))).otherwise(F.lit([]).cast("array<bigint>"))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("__words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two shingle sets, from 0 to 1."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared.cast("double") / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k-1) over the share of the range that k hashes fill."""
    share = (F.element_at(a, -1).cast("double") + float(2**63)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, from 0 to 1; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each row with the next one by descending doc_id, the last with the first.

    Rows of one doc_id follow in order of their texts' first 32 characters, then of the texts'
    hashes; null doc_ids come last. Rows are dealt out in runs of that order, with bounds from
    a sample, so that no id or text, however often it occurs, is bound to one run. The first
    row of a run goes along with the run before it too. What comes to the driver are
    ``SAMPLED`` keys and one head for each run.
    """
    spark = docs.sparkSession
    runs = RUNS * shuffle_partitions(spark)
    text = F.coalesce("text", F.lit(""))
    key = F.struct(
        F.col("doc_id").isNull().cast("int").alias("nameless"),
        F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).alias("place"),  # descends as doc_id ascends
        F.hex(F.encode(F.substring(text, 1, 32), "UTF-8")).alias("head"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),  # of equal rows, any may come first
    )
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"))
    n = docs.count()
    share = min(1.0, SAMPLED * runs / max(1, n))
    some = sorted(tuple(r["key"]) for r in docs.where(F.xxhash64("key.row", "key.hash") <= min(2**63 - 1, int(share * 2**64) - 2**63)).select("key").collect())
    names = [x.split(":")[0] for x in _ORDER.split(", ")]
    bounds = [dict(zip(names, b)) for b in some[SAMPLED::SAMPLED]]
    docs = docs.withColumn("run", places_in(bounds, f"array<struct<{_ORDER}>>", F.col("key")))
    heads = docs.groupBy("run").agg(F.min("key").alias("head")).orderBy("run").collect()
    if not heads:
        return with_sketch(docs, "text", "sketch", k).select("doc_id", "text", "sketch", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    to, row = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, r in enumerate(heads):
        to[r["run"]], row[r["run"]] = heads[i - 1]["run"], r["head"]["row"]
    to = F.when(F.col("key.row") == F.get(array_literal(row, "array<bigint>"), F.col("run")), F.get(array_literal(to, "array<int>"), F.col("run")))
    places = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("ahead")), F.struct(to.alias("run"), F.lit(True).alias("ahead")))
    dealt = docs.select("doc_id", "text", "key", F.explode(F.filter(places, lambda p: p["run"].isNotNull())).alias("p")).select("doc_id", "text", "key", "p.run", "p.ahead").repartition(shuffle_partitions(spark), "run")
    order = Window.partitionBy("run").orderBy("ahead", "key")
    with_both = with_sketch(dealt, "text", "sketch", k).withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return with_both.where("not ahead").drop("run", "ahead", "key")


def fingerprints_of_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """For each row of docs (doc_id, text): fingerprints of the text and of the text with its last third replaced.

    The last floor(n_chars/3) code points give way to the first as many, or all, of the next document.
    """
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 3).cast("int")))
    df = with_sketch(with_next(docs, k).withColumn("edited", edited), "edited", "edited_sketch", k)
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles_estimate"),
    )
