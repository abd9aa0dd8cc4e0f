"""Messages delivered more than once: exact quotient tables over fixed-width identifiers.

An identifier (entity key, instant in whole seconds) is packed into 64 bits where it fits: six hexadecimal digits
are 24 bits, the second has 39. A bijection of the 64 bits (three xor-shifts, so nothing can overflow and nothing
is lost) spreads neighbouring identifiers; the upper bits are the quotient, which names the shard, and the table of
a shard stores the complete remainder. Quotient and remainder together are the identifier, so there are no false
matches. An identifier that doesn't fit keeps its own key and second beside the packed form (its quotient is a hash of
both), in the same table. Shards are what moves: every task first folds its own rows, so an identifier that holds a
third of all rows leaves each task as one row, then identifiers go to the partition of their quotient, and the hash
table there takes each once. Tables that are kept (`insert`) are folders by quotient: a later batch reads only the
shards it has identifiers for.

Defined results: a null or blank key or a null instant identifies nothing and is never a copy. The order column is
unique but for repeated rows, which are one message. An empty input gives an empty output. Extra columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import entity_key

#: Above this an epoch is in milliseconds: as seconds it would lie past the year 5000.
MILLIS_FROM = 100_000_000_000


def instant_seconds(epoch: Column | str) -> Column:
    """Whole seconds of an epoch that is in seconds or in milliseconds."""
    e = (F.col(epoch) if isinstance(epoch, str) else epoch).cast("bigint")
    return F.when(F.abs(e) >= MILLIS_FROM, F.floor(e / F.lit(1000))).otherwise(e).cast("bigint")


def identified(df: DataFrame, key: Column, second: Column, quotient_bits: int = 12) -> DataFrame:
    """df with the quotient _q and remainder _r of a packed identifier, and _k, _s of one that doesn't fit. Exact and
    reversible. Each step is a projection of its own, so that none is computed twice."""
    fits = F.col("_k").rlike("^[0-9a-f]{6}$") & F.col("_s").between(0, (1 << 39) - 1)
    df = df.withColumns({"_k": key, "_s": second}).withColumn("_fits", fits)
    df = df.withColumn("_r", F.when(F.col("_fits"), F.shiftleft(F.conv("_k", 16, 10).cast("bigint"), 39).bitwiseOR(F.col("_s"))))
    for shift, by in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
        df = df.withColumn("_r", F.col("_r").bitwiseXOR(shift("_r", by)))
    return df.withColumns({
        "_q": F.coalesce(F.shiftrightunsigned("_r", 64 - quotient_bits).cast("int"), F.pmod(F.xxhash64("_k", "_s"), F.lit(1 << quotient_bits)).cast("int")),
        "_r": F.col("_r").bitwiseAND(F.lit((1 << (64 - quotient_bits)) - 1)),
        "_k": F.when(~F.col("_fits"), F.col("_k")),
        "_s": F.when(~F.col("_fits"), F.col("_s")),
    }).drop("_fits")


IDENTIFIER = ["_q", "_r", "_k", "_s"]


def shards(df: DataFrame, key: str, instant: Column, order: str, quotient_bits: int = 12) -> DataFrame:
    """(_q, _r, _k, _s, first): the tables of all shards, each identifier once with the order value of its first copy.
    Partitioned by _q."""
    ident = identified(df.select(F.col(order).alias("_o"), entity_key(key).alias("_key"), instant.alias("_at")), F.col("_key"), F.col("_at"), quotient_bits)
    ident = ident.where("_key IS NOT NULL AND _at IS NOT NULL").withColumn("_p", F.spark_partition_id())
    folded = ident.groupBy("_p", *IDENTIFIER).agg(F.min("_o").alias("_o"))  # one row per task and identifier before anything moves
    return folded.repartition("_q").groupBy(*IDENTIFIER).agg(F.min("_o").alias("first"))


def first_copies(df: DataFrame, key: str, instant: Column, order: str, quotient_bits: int = 12) -> DataFrame:
    """The value of `order` of the first copy of every identified message: (first)."""
    return shards(df, key, instant, order, quotient_bits).select("first")


def insert(batch: DataFrame, path: str, key: str, instant: Column, order: str, quotient_bits: int = 12) -> DataFrame:
    """Inserts a batch into the kept tables at `path`; (first) of the identifiers that are new, written before it
    returns. Only shards with identifiers of the batch are read. A batch is one folder beside the earlier ones, under
    the hash of its lowest and highest order value, so a batch that is tried again after a failure gives the same."""
    new = shards(batch, key, instant, order, quotient_bits)
    span = batch.agg(F.xxhash64(F.min(order), F.max(order)).alias("h")).first()["h"]
    spark, name = batch.sparkSession, f"batch={span & 0xFFFFFFFFFFFFFFFF:016x}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kinds = ", ".join(f"`{c}` {t}" for c, t in new.dtypes) + ", batch string"
    if fs.exists(p):
        old = spark.read.schema(kinds).parquet(path).where(F.col("batch") != name.removeprefix("batch="))
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) if c != "_q" else F.col("n._q") == F.col("o._q") for c in IDENTIFIER]
        new = new.alias("n").join(old.alias("o"), same, "left_anti")
    new.write.mode("overwrite").partitionBy("_q").parquet(f"{path}/{name}")
    return spark.read.schema(kinds).parquet(path).where(F.col("batch") == name.removeprefix("batch=")).select("first")


def later_copies(df: DataFrame, key: str, instant: Column, order: str, quotient_bits: int = 12) -> DataFrame:
    """The values of `order` of all copies but the first of each message: (order).

    The second exchange is on `order`, which is unique, so a hot identifier can't skew it."""
    first = first_copies(df, key, instant, order, quotient_bits)
    known = df.where(entity_key(key).isNotNull() & instant.isNotNull()).select(order)
    return known.join(first.withColumnRenamed("first", order), order, "left_anti")


def exactly_once(df: DataFrame, key: str, instant: Column, order: str, quotient_bits: int = 12) -> DataFrame:
    """One copy of each message with all its columns: the first; rows that identify nothing all stay. Whole rows move
    once, by `order`."""
    known = entity_key(key).isNotNull() & instant.isNotNull()
    first = first_copies(df, key, instant, order, quotient_bits).withColumnRenamed("first", order)
    kept = df.where(known).join(first, order, "left_semi").dropDuplicates([order])
    return kept.unionByName(df.where(~F.coalesce(known, F.lit(False))))
