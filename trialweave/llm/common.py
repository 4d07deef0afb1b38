"""What the operators of this subpackage share: inputs, the shared folder, splits."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session whose driver is its one executor (tests) may have none: a temporary one is made. On a cluster that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a folder that they share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="trialweave-"))
    return _own_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and a lost executor costs nothing.

    Results are read from these tables, so they stay until remove_tables() or whoever owns the folder removes them.
    """
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_folder(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder."""
    return f"{shared_folder(spark)}/trialweave/{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Removes what written() has written in this application; DataFrames that read it fail afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def least_hashed(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The ``most`` rows with the least values of key, a 64-bit hash that spreads evenly.

    Rows are filtered by a threshold first, which some two times as many pass, so that what meets
    in one task is bounded by ``most`` and not by ``most`` for each partition.
    """
    rows = rows.withColumn("__h", key)
    share = 2.0 * most / max(1, rows.count())
    some = rows
    while share < 1:
        some = rows.where(F.col("__h") <= int(share * 2**64) - 2**63)
        if some.count() >= most:
            break
        some, share = rows, 4 * share
    return some.orderBy("__h").limit(most).drop("__h")


def joined_to_few(rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """rows joined to ``few`` (unique by key), where one key may hold much of rows: its rows are dealt over ``salts`` by the column spread.

    few isn't broadcast: its size has no bound of its own.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def array_literal(values: Sequence, kind: str) -> Column:
    """values as one array literal: a plan that holds it has one node for it, however long it is."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def places_in(bounds: Sequence, kind: str, key: Column) -> Column:
    """How many of the ascending bounds are below key, by halving; kind: an array type."""
    held = array_literal(bounds, kind)
    steps = max(1, len(bounds).bit_length())

    def halve(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.get(held, mid) < key
        done = at["lo"] >= at["hi"]
        return F.struct(F.when(~done & below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(~done & ~below, mid).otherwise(at["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda at: at["lo"])


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Sets this session's Arrow batches to about ``size`` bytes, whatever rows they hold.

    A batch lies in the JVM beside the heap (twice while a vector grows) and in the worker. By rows alone, 10,000 of
    them, it is as large as the texts are long. The setting stays: what a query returns is computed after it has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buckets(texts: DataFrame, size: int = 32 << 20) -> int:
    """Buckets for what is gathered from texts (column text): one for each ``size`` bytes of them, and no fewer than shuffle partitions."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(texts.sparkSession), -(-total // size))


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n: the split of the contracts. A null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def release() -> None:
    """Gives back the memory that this worker's allocators hold and don't use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def released(run):
    """A function of mapInArrow after whose partition the worker gives back the memory that it doesn't use.

    Python workers live as long as their executor and go from stage to stage; what the
    allocators keep of one stage's arrays would otherwise count against the next one's.
    """

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def released_group(run, least: int = 2 << 20):
    """The same for a function of applyInArrow, after groups of ``least`` bytes or more."""

    @wraps(run)
    def wrapped(table):
        size = table.nbytes
        out = run(table)
        del table
        if size >= least:
            release()
        return out

    return wrapped
