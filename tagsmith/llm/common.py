"""Shared pieces of the training-data operators: staged tables, bounded bit filters, skew-safe joins, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.deploy import ship

#: A key that holds at least this share of the rows counts as heavy; so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 0.001
#: Copies of a row that very many rows of the other side join.
COPIES = 32
#: Upper size of a bit filter: 2**27 bits are 16 MB, whatever the input.
MAX_FILTER_BITS = 27


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own in local mode (tests) only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again: lineage ends there and a lost executor costs nothing.

    The path is kept as ``df.staged_path`` for ``drop_staged``.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables made by ``staged`` that nothing reads any more."""
    for df in frames:
        p, fs = _hadoop_path(df.sparkSession, df.staged_path)
        fs.delete(p, True)


def mapped(df: DataFrame, func, schema: str) -> DataFrame:
    """mapInArrow, with this package sent to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(func, schema)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Within it, what runs passes at most so many rows at once to Python, where the session allows more; for tables of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche (Stafford's variant 13)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


mix64 = _mix


class BitFilter:
    """A one-probe Bloom filter over longs, built by Spark and tested in numpy.

    Its size is a power of two fixed from the row count and never over 2**MAX_FILTER_BITS bits, so it can be
    shipped to every task. It passes every member; what else it passes is removed by the exact join behind it.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def test(self, values: np.ndarray) -> np.ndarray:
        pos = values.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.words[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_filter(df: DataFrame, key: str, rows: int | None = None) -> BitFilter:
    """A BitFilter of a long column that is already uniformly hashed (its low bits are used)."""
    rows = df.count() if rows is None else rows
    bits = min(MAX_FILTER_BITS, max(15, int(rows * 16).bit_length()))
    pos = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    got = df.select(F.shiftright(pos, 15).alias("b"), pos.bitwiseAND(F.lit(32767)).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    words = np.zeros(1 << (bits - 3), np.uint8)
    for r in got:
        words[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
    return BitFilter(words, bits)


def attach(left: DataFrame, keyed: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left join keyed (unique by keys) when one key may hold a third of left's rows.

    weight is keyed's column with the number of left rows of the key. Keys of at least HEAVY_SHARE of all rows are
    at most 1 / HEAVY_SHARE rows, so they are broadcast; the other keys go through a shuffle join.
    """
    floor = max(1.0, total * HEAVY_SHARE)
    heavy = keyed.where((F.col(weight) >= floor) & (F.col(weight) > 16)).drop(weight)
    light = keyed.where(~((F.col(weight) >= floor) & (F.col(weight) > 16))).drop(weight)
    values = [c for c in light.columns if c not in keys]
    marked = F.broadcast(heavy.select(*keys, F.struct(*values).alias("__heavy")))
    # rows of heavy keys are dealt by a hash of the whole row; no light row has a salt but 0, so they meet nothing
    salted = left.join(marked, keys, "left").withColumn("__salt", F.when(F.col("__heavy").isNull(), F.lit(0)).otherwise(F.xxhash64(*left.columns)))
    light = light.select(*keys, F.lit(0).cast("long").alias("__salt"), F.struct(*values).alias("__light"))
    out = salted.withColumn("__salt", F.col("__salt").cast("long")).join(light, [*keys, "__salt"], "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"__heavy.{v}"), F.col(f"__light.{v}")).alias(v) for v in values])


def hot_keys(df: DataFrame, key: str, rows: int) -> list[int]:
    """The values of key that hold at least HEAVY_SHARE of df's rows (and 256 of them): at most 1 / HEAVY_SHARE values."""
    floor = max(256, int(rows * HEAVY_SHARE))
    return [r[key] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= floor).select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: list[int]) -> DataFrame:
    """left inner join right (unique by key, with rows of any size); the hot keys of left are dealt to COPIES of right's row."""
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    others = [c for c, t in left.dtypes if c != key and t == "bigint"]
    salted = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*others), F.lit(COPIES))).otherwise(F.lit(0)).cast("long"))
    copies = F.sequence(F.lit(0).cast("long"), F.when(is_hot, F.lit(COPIES - 1)).otherwise(F.lit(0)).cast("long"))
    return salted.join(right.withColumn("__salt", F.explode(copies)), [key, "__salt"]).drop("__salt")


def with_row_keys(docs: DataFrame, id_col: str, key: str) -> tuple[DataFrame, bool]:
    """docs with a key of their own for each row, in the order of the ids, null ids last; and whether the ids serve as they are.

    Only if ids are missing or repeated are rows written anew; otherwise the key is the id and only ids are shuffled to see it.
    """
    odd = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where(F.col(id_col).isNull() | (F.col("__n") > 1))
    if not odd.limit(1).count():
        return docs.withColumn(key, F.col(id_col).cast("long")), True
    return staged(docs.orderBy(F.col(id_col).asc_nulls_last()).withColumn(key, F.monotonically_increasing_id()), "row-keys"), False


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the undirected edges (a, b): component is the smallest node that links reach.

    Minimum labels spread over the edges and then jump along labels, so long chains halve at each turn. Every
    turn's labels are a written table; only the number of changes comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, f"{name}-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}-labels")
    while True:
        # a node of very many links and the label of a large component are hot keys of joins with one row on the right: Spark splits those
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        spread = labels.join(near, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        nxt = staged(spread.join(jump, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component"), "old"), f"{name}-labels")
        changed = nxt.where("component <> old").limit(1).count()
        drop_staged(labels)
        labels = nxt
        if not changed:
            drop_staged(both)
            out = labels.select("node", "component")
            out.staged_path = labels.staged_path
            return out


def null_to_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))
