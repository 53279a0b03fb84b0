"""Helpers the operators of this subpackage share."""

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderline.sources.tables import use_checkpoint_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; the session's checkpoint folder where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    use_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs no recomputation, and a value that is not a function of the rows
    alone (a partition number) is fixed for every later reader.
    """
    path = f"{shared_folder(df.sparkSession)}/cinderline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that a later one has replaced."""
    spark = df.sparkSession
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/cinderline-" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(h: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def odd(seed: int) -> np.uint64:
    """A fixed odd 64-bit multiplier."""
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Gram:
    """Hashes of any substring of a byte array from prefix sums: ``sum(code[b_j] * base**-j)`` scaled by ``base**i``.

    ``base`` is odd, so it has an inverse modulo 2**64.
    """

    def __init__(self, seed: int):
        self.code = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = odd(seed + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            m = max(n + 1, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(m, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.down[: len(data)], out=out[1:])
        return out

    def window(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Hash of each substring of ``size`` bytes."""
        n = max(0, len(sums) - size)
        return mix((sums[size:] - sums[:n]) * self.up[:n])

    def pieces(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.up[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def portions(texts, most: int):
    """Slices of ``texts`` (strings or bytes) that hold about ``most`` characters each, or one longer text."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if len(texts) > start:
        yield slice(start, len(texts))


def numbered(df: DataFrame, order: list, label: str, name: str = "rank") -> DataFrame:
    """``df`` with its place (from 0) in the given order, by range partitions and their sizes: no single sorted task."""
    ranges = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), label)
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__range").orderBy(*order)
    return ranges.join(offsets, "__range").withColumn(name, F.col("__before") + F.row_number().over(own) - 1).drop("__range", "__before")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
