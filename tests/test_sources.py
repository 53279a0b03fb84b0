import os

import pytest

from cinderline.sources import schemas
from cinderline.sources import tables as I


def test_nan_becomes_null_and_missing_columns_fail(spark, tmp_path):
    p = str(tmp_path / "cells")
    spark.createDataFrame([(1, 2, float("nan"))], "cx long, cy long, value double").write.parquet(p)
    assert I.read_raster(spark, p, schemas.CELLS).first().value is None
    with pytest.raises(ValueError, match="missing columns"):
        I.read_raster(spark, p, schemas.CELL_STACK)


def test_years_from_file_names(spark, tmp_path):
    for y in (2001, 2002):
        spark.createDataFrame([(1, 1, float(y))], "cx long, cy long, value double").write.parquet(str(tmp_path / f"mosaic_{y}"))
    tagged = I.read_many(spark, str(tmp_path), schemas.CELLS, "*.parquet", tag="year", tag_regex=r"mosaic_(\d{4})")
    assert {(r.year, r.value) for r in tagged.collect()} == {("2001", 2001.0), ("2002", 2002.0)}


def test_build_once(spark, tmp_path):
    p, calls = str(tmp_path / "built"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert I.read_or_build(spark, p, build).count() == I.read_or_build(spark, p, build).count() == 3
    assert calls == [1]
    os.remove(os.path.join(p, "_SUCCESS"))
    assert not I.is_complete(spark, p)
