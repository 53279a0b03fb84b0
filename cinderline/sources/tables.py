"""Table readers, writers, and build-once materialisation.

Every reader takes a declared schema: nothing is inferred, a missing column is an
error, and NaN becomes NULL once, on load.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def _require(df: DataFrame, schema: T.StructType) -> DataFrame:
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_features(spark: SparkSession, path: str, schema: T.StructType, layer: str | None = None) -> DataFrame:
    """Parquet feature table; a named layer is a sub-directory of the data set."""
    full = path if layer is None else f"{path.rstrip('/')}/{layer}"
    return nan_to_null(_require(spark.read.parquet(full), schema))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return nan_to_null(
        spark.read.csv(path, header=True, schema=schema, nullValue="NA", enforceSchema=False)
    )


def read_many(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*", fmt: str = "parquet",
    tag: str | None = None, tag_regex: str = r"(\d{4})[^/]*$",
) -> DataFrame:
    """All files under ``path`` matching ``pattern`` as one table, optionally tagged from the file name."""
    reader = (
        spark.read.format(fmt).schema(schema).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
    )
    if fmt == "csv":
        reader = reader.option("header", "true").option("nullValue", "NA")
    df = reader.load(path)
    if tag is None:
        return nan_to_null(df)
    name = F.regexp_extract(F.col("_metadata.file_path"), tag_regex, 1)
    return nan_to_null(df.select("*", F.nullif(name, F.lit("")).alias(tag)))


def read_raster(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cell table ``(cx, cy, value[, year])``; partitioned by ``year`` where it has one."""
    return read_features(spark, path, schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA")


def write_features(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_raster(cells: DataFrame, path: str) -> None:
    write_features(cells, path, ["year"] if "year" in cells.columns else None)


def is_complete(spark: SparkSession, path: str) -> bool:
    """A finished Spark write leaves ``_SUCCESS``; a half-written directory does not count."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def read_or_build(spark: SparkSession, path: str, build, partition_by: list[str] | None = None) -> DataFrame:
    """Read ``path`` if it was fully written before, else run ``build()``, write it and read it back."""
    if not is_complete(spark, path):
        writer = build().write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local folder only where none is named (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cinderline-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's state as a table on reliable storage, so a lost executor costs no recomputation.

    A written table is computed once, where an eager ``checkpoint`` runs its plan a second time to write it.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
