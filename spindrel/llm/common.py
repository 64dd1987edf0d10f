"""What the operators of this subpackage share: row keys, tables in the shared folder, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop_kept as drop_written
from ..sources.tables import fresh
from ..sources.tables import kept as written

#: Bytes (compressed) of a side of a join, by partition, up to which its partitions become hash tables.
HASH_PARTITION = 32 << 20
#: Bytes of an Arrow batch of texts: the JVM holds several copies of one outside its heap, and Python one.
BATCH = 2 << 20


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Rows with the same id and text get the same key: they count as one document."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, text: extra columns go before anything is computed, so their names can't clash."""
    return docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, whose key is not in `keys` (a column key; a written table, so that its
    size is known: see lookup())."""
    name = fresh(docs.columns, "__key")
    gone = lookup(keys.select(F.col("key").alias(name)), keys)
    return docs.withColumn(name, row_key(id_col, text_col)).join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def lookup(side: DataFrame, table: DataFrame | None = None, broadcast: bool = True) -> DataFrame:
    """A side of a join that meets whole texts: broadcast by Spark below its threshold; else hash tables
    of its partitions while these are small (a hash table doesn't spill), so that texts move once and
    aren't sorted; else sorted. `table`: a written table of at least its size, where side isn't one.
    broadcast=False: small tables take the plan of large ones."""
    conf = side.sparkSession._jsparkSession.sessionState().conf()
    size = _size(side if table is None else table)
    if (broadcast and 0 <= size <= conf.autoBroadcastJoinThreshold()) or size > HASH_PARTITION * conf.numShufflePartitions():
        return side
    return side.hint("shuffle_hash")


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH) -> Iterator[None]:
    """What is written inside goes to Python in Arrow batches of about `most` bytes, instead of 10,000 rows whatever their size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was, now = spark.conf.get(name, None), spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set(name, str(most if now <= 0 else min(most, now)))
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of longs: node, root (the least node of its component).

    Alternates large-star and small-star contraction, each a group and a join on
    the node; every round is written to the shared folder. The number of rounds
    grows with the logarithm of the longest path. Self-loops and nulls are
    dropped; no edges give no rows.
    """
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(lows, "u")
        star = linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = written(star, "edges")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_written(now)
        now = after
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new


def unique_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, text without rows that repeat an id with the same text. A count of keys, without
    texts, finds which do; only their texts move."""
    rows = narrow(docs, id_col, text_col)
    again = written(rows.groupBy("key").count().where("count > 1").select("key"), "again")
    if again.isEmpty():
        return rows
    return rows.join(lookup(again), "key", "left_anti").unionByName(rows.join(lookup(again), "key", "left_semi").dropDuplicates(["key"]))
