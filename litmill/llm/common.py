"""Shared pieces of the training-data operators: input tables, durable intermediate tables, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill import session

#: Rows a broadcast side may have; beyond it every caller takes its shuffled way.
BROADCAST_ROWS = 20_000
#: The same for tables of one 64-bit key, 32 MB at most.
BROADCAST_KEYS = 1_000_000


#: Rows in an Arrow batch, where the session has Spark's own default: texts may be long, and batches are held whole.
ARROW_ROWS = 1000


def expose_package(spark: SparkSession) -> None:
    """Prepares the session for Python workers: the package's path, and batches of bounded size."""
    session.expose_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_HELD: dict = {}


def only(key, make):
    """What ``make`` gave for ``key`` in this worker. Workers are reused, so what another step held goes first."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of what another step held in this worker, and hands freed memory back."""
    _HELD.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    expose_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``. Only a session without other machines may
    have none; it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="litmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table, wherever the file system is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """A folder of written tables that cut lineage and survive the loss of executors.

    A result that Spark evaluates lazily may still read the tables that are left, so those go when the
    interpreter ends; ``drop`` removes one as soon as nothing reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Writes ``df`` and returns it as read back from there."""
        self.count += 1
        path = f"{self.path}/{self.count:03d}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(self.spark, path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Removes all tables but these, once nothing else is read any more."""
        kept = {getattr(df, "_scratch_path", None) for df in tables}
        for n in range(1, self.count + 1):
            if (path := f"{self.path}/{n:03d}") not in kept:
                delete(self.spark, path)

    def close(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # the session ended before the interpreter did
            pass


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only when the counted size is within the bound."""
    return F.broadcast(df) if rows <= limit else df


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: longs): rows (node, root) of every node with an edge; root is the
    smallest node of its component.

    Alternates large-star and small-star steps, which keep the edge count within that of the input and end after
    about log(nodes) rounds; every round is a written table. Self loops and null ends are dropped.
    """
    now = scratch.write(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        stars = _small_star(_large_star(now))
        following = scratch.write(stars)
        state = following.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(cast(b AS decimal(38,0)))").alias("s")
        ).first()
        scratch.drop(now)
        now = following
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def unused(df: DataFrame, name: str) -> str:
    """A column name that begins like ``name`` and that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_column: str, text_column: str) -> Column:
    """A hash that rows of equal id and text share; nulls count as values."""
    return F.xxhash64(*[x for c in (id_column, text_column) for x in (F.col(c).isNull(), F.col(c))])


def lowest(rows: DataFrame, n: int, group: list[str]) -> DataFrame:
    """Of different rows (group ..., h, t) the ``n`` lowest (h, t) of each group. A group is first ranked in parts, so
    that no task sees more of it than ``n`` rows of each part."""
    salt = F.pmod(F.xxhash64("h", "t"), F.lit(16))
    nth = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("h", "t"))
    some = rows.withColumn("salt", salt).withColumn("nth", F.dense_rank().over(Window.partitionBy(*group, "salt").orderBy("h", "t"))).filter(F.col("nth") <= n)
    return some.select(*group, "h", "t").distinct().withColumn("nth", nth(group or [F.lit(0)])).filter(F.col("nth") <= n).drop("nth")


def running(scratch: Scratch, rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with columns that add up each of ``sums`` over all rows before in ``order``, which must tell rows apart.
    Ranges of rows add up on their own; one task handles a row for each range only."""
    part, columns = unused(rows, "part_of_range"), rows.columns
    placed = scratch.write(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(part).agg(*[F.sum(x).alias(f"{name}_of_part") for name, x in sums.items()])
    window = before([F.lit(0)], [part])
    offsets = totals.select(F.col(part).alias("part_"), *[F.coalesce(F.sum(f"{name}_of_part").over(window), F.lit(0)).alias(f"{name}_offset") for name in sums])
    own = placed.select("*", *[F.coalesce(F.sum(x).over(before([part], order)), F.lit(0)).alias(f"{name}_within") for name, x in sums.items()])
    joined = own.join(F.broadcast(offsets), F.col(part) == F.col("part_"))  # a row for each partition
    return joined.select(*columns, *[(F.col(f"{name}_within") + F.col(f"{name}_offset")).alias(name) for name in sums])


def keys_to_join(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The right side of a join by one 64-bit key: broadcast within the bound, else hashed, so that the left side is
    never sorted."""
    return F.broadcast(keys) if keys.count() <= limit else keys.hint("shuffle_hash")


def slices(column, limit: int):
    """Ranges [i, j) of an Arrow string column, each of about ``limit`` bytes and one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    i, n = 0, len(sizes)
    while i < n:
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + limit, "right")))
        yield i, j
        i = j
