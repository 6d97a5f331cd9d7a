"""Test sheets as a table function that is called laterally for each row of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="x double, y double, z double")
class Sheet:
    """Points of a sheet n wide: ``slope`` rises by one for each step, ``double`` is two sheets one apart, ``bent`` folds back in the middle and has a hole."""

    def eval(self, kind: str, n: int):
        for x in range(n or 0):
            for z in range(n):
                if kind == "slope":
                    yield float(x), float(2 + x), float(z)
                elif kind == "double":
                    yield float(x), float(z), float(z)
                    yield float(x), float(z + 1), float(z)
                elif kind == "bent":
                    half = n // 2
                    side = abs(half - x)
                    along = (side * side - (side // 2) ** 2) ** 0.5
                    lo, hi = 3 * n // 10, 7 * n // 10
                    if not (lo <= x < hi and lo <= z < hi):
                        yield half - along if x < half else half + along, float(n + side // 2), float(z)


def sheets(rows: DataFrame, kind: Column, n: Column) -> DataFrame:
    """The rows, each with the points of its sheet; a row of another kind or without size has none."""
    spark: SparkSession = rows.sparkSession
    spark.udtf.register("lamina_sheet", Sheet)
    return spark.sql("SELECT t.*, s.x, s.y, s.z FROM {t} AS t, LATERAL lamina_sheet(t._kind, t._n) AS s", t=rows.withColumns({"_kind": kind, "_n": n.cast("int")})).drop("_kind", "_n")
